"""WARC archives: written as one gzip member per record, read back from start to end in bounded memory."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import new_path, stage
from .files import create, open_stream, shared_folder

CHUNK = 1 << 20
DATE = "2000-01-01T00:00:00Z"  # pages carry no time of their own
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member. Line breaks within a field would end it early and are made spaces."""
    fields = fields | {"WARC-Block-Digest": f"sha1:{sha1_base32(block)}", "Content-Length": str(len(block))}
    head = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in fields.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or, where it refers to an equal one, a revisit that keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: "" if i is None else str(i)
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<{ID_PREFIX}{name(page_id)}>",
              "WARC-Date": DATE, "WARC-Target-URI": url or "", "Content-Type": "application/http; msgtype=response",
              "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}"}
    if refers_to is None:
        return record(fields, http + payload)
    return record(fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{ID_PREFIX}{refers_to}>"}, http)


def members(chunks: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """The decompressed pieces of each gzip member in turn. A member that is cut off raises EOFError."""
    source, rest = iter(chunks), b""

    def pieces(first: bytes) -> Iterator[bytes]:
        nonlocal rest
        unpacker, data = zlib.decompressobj(31), first
        while True:
            piece = unpacker.decompress(data, CHUNK)
            if piece:
                yield piece
            if unpacker.eof:
                rest = unpacker.unused_data
                return
            data = unpacker.unconsumed_tail or next(source, b"")
            if not data:
                raise EOFError("the archive ends within a record")

    while True:
        data, rest = rest or next(source, b""), b""
        if not data:
            return
        member = pieces(data)
        yield member
        for _ in member:  # what the caller has left
            pass


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def read_records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of each record, names in lower case. One record is in memory at a time.

    The block is framed by Content-Length and must be followed by two line breaks and the member's end. A wrong
    block or payload digest, a wrong length or a record without a header raises ValueError.
    """
    for member in members(chunks):
        data = b""
        for piece in member:
            data += piece
            if b"\r\n\r\n" in data:
                break
        head, found, begun = data.partition(b"\r\n\r\n")
        if not found or not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        length = int(fields["content-length"])
        parts = [begun, *member]
        body = b"".join(parts)
        block = body[:length]
        if len(block) != length or body[length:] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} does not have its stated length")
        if fields.get("warc-block-digest", "").removeprefix("sha1:") != sha1_base32(block):
            raise ValueError(f"record {fields.get('warc-record-id')} fails its block digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        if fields["warc-type"] == "response" and fields["warc-payload-digest"].removeprefix("sha1:") != sha1_base32(payload):
            raise ValueError(f"record {fields.get('warc-record-id')} fails its payload digest")
        yield fields, _fields(http), payload


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = 0) -> DataFrame:
    """Write every row as a record; the written table (path, n_records) of archives, one for each task.

    Of rows with equal payloads of at least `least_bytes` bytes, that with the largest id is a response, the others
    are revisits of it. Copies of that row with its id are responses too. A null html is an empty payload. A null id
    comes after all others; rows without any id in their group are responses.
    Only digests are grouped, and only those that occur twice or more are joined back.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, new_path(spark, "warc"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    marked = rows.withColumn("digest", F.when(F.octet_length("html") >= least_bytes, F.sha1("html")))
    kept = (marked.select("id", "digest").where(F.col("digest").isNotNull()).groupBy("digest")
            .agg(F.max("id").alias("response"), F.count("*").alias("n")).where(F.col("n") > 1).select("digest", "response"))
    told = marked.join(kept, "digest", "left").select("id", "url", "html", F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream, n = None, None, 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    path, stream = create(folder, "pages", ".warc.gz")
                stream.write(page_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
                n += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return stage(told.mapInArrow(run, "path string, n_records bigint"), "archives")


def _page(name: str | None) -> int | None:
    text = (name or "").strip("<>").removeprefix(ID_PREFIX)
    return int(text) if text else None


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record, read from the archives;
    each is read by one task from start to end. Digests are verified on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with open_stream(path) as stream:
                    for fields, http, payload in read_records(iter(lambda: stream.read(CHUNK), b"")):
                        size = len(payload) if fields["warc-type"] == "response" else int(http["content-length"])
                        rows.append((_page(fields["warc-record-id"]), fields["warc-target-uri"], size, fields["warc-payload-digest"].removeprefix("sha1:"),
                                     fields["warc-type"], _page(fields.get("warc-refers-to"))))
                        if len(rows) == 1000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    spread = archives.select("path").repartition(max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    return spread.mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
