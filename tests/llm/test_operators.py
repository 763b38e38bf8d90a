"""Every operator against a plain version of it, on the smallest tables and on odd rows."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from conftest_llm import SF_SMALL, groups_of
from glossaframe.llm import (byte_bpe, components, encode, line_dedup, merkle, packing, quality_rules, queries, secret_scan,
                             simhash_dedup, token_counts, token_files, warc)


def run(spark, name):
    return queries.QUERIES[name](spark, SF_SMALL).collect()


# near copies -------------------------------------------------------------------------------------------------------

def plain_simhash(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(rows):
    prints = [plain_simhash(t) for _, t in rows]
    root = groups_of(len(rows), ((i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2))
    first = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            first[root[i]].append(doc_id)
    return sorted(((d, f"{p:016x}", min(first[root[i]], default=None)) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)


def test_near_copies(spark, documents):
    assert sorted(map(tuple, run(spark, "op1_simhash_dedup")), key=repr) == plain_near(documents)


def test_near_copies_of_odd_rows(spark, edge, none):
    found = simhash_dedup.near_duplicates(edge).select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert sorted(map(tuple, found), key=repr) == plain_near([(r.doc_id, r.text) for r in edge.collect()])
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.keep_one(edge)
    assert kept.columns == edge.columns
    assert len(kept.collect()) == len({c for *_, c in plain_near([(r.doc_id, r.text) for r in edge.collect()])})
    assert simhash_dedup.keep_one(none).count() == 0


def test_links_of_crowded_fingerprints(spark):
    """Chains and balls of close fingerprints, where every pair within the radius must be connected and no other."""
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            values.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash_dedup.near_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"))
    found = {r.node: r.root for r in components.components(links, "fp", "hub").collect()}
    root = groups_of(len(values), ((i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2))
    same = lambda key: sorted(sorted(i for i in range(len(values)) if key[i] == k) for k in set(key))
    assert same([found.get(s, s) for s in signed]) == same(root)


def test_masks_cover_every_pair():
    for radius in (1, 2, 3):
        chosen = simhash_dedup.masks(radius)
        for bits in itertools.combinations(range(0, 64, 3), radius):
            difference = sum(1 << b for b in bits)
            assert any(not difference & m for m in chosen)


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, i) for i in range(1001, 2500)]
    links = spark.createDataFrame(chain + hub + [(5, 5), (None, 3)], "a bigint, b bigint")
    found = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    assert found == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 2500)}


# Merkle fingerprints ------------------------------------------------------------------------------------------------

def plain_edits(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0])
    return {i: (len(t), t[: len(t) - len(t) // 4] + rows[(k + 1) % len(rows)][1][: len(t) // 4]) for k, (i, t) in enumerate(rows)}


def test_merkle(spark, documents):
    expected = plain_edits(documents)
    found = run(spark, "op2_merkle")
    assert len(found) == len(documents)
    for r in found:
        n, edited = expected[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    texts = dict(documents)
    by_text = defaultdict(set)
    for r in found:
        by_text[texts[r.doc_id]].add(r.fingerprint)
        by_text[expected[r.doc_id][1]].add(r.edited_fingerprint)
    assert all(len(marks) == 1 for marks in by_text.values())
    assert len({m for marks in by_text.values() for m in marks}) == len(by_text)
    long = [r for r in found if r.n_chars > 400]
    assert np.mean([r.near_edited > 0.4 for r in long]) > 0.95
    assert np.mean([r.near_edited > r.near_next for r in found]) > 0.9


def test_merkle_of_odd_rows(spark, edge, none):
    found = merkle.with_edits(edge).collect()
    assert len(found) == edge.count()
    assert merkle.with_edits(none).count() == 0
    one = merkle.with_edits(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id bigint, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"a b c d e f a b").hexdigest() or one.n_chars == 15
    assert one.near_next == 1.0
    pieces = edge.where("text is not null").select("text", F.flatten(F.flatten(F.transform(merkle._parts(F.col("text"), merkle.SECTION_END), lambda s: F.transform(
        merkle._parts(s, merkle.PARAGRAPH_END), lambda p: F.regexp_extract_all(p, F.lit(merkle.RUN), F.lit(0)))))).alias("runs")).collect()
    assert all("".join(r.runs) == r.text for r in pieces)


def test_merkle_locates_edits(spark):
    rows = spark.createDataFrame([("One line.\nTwo lines.\n\nNew section.\nEnd.", "One line.\nTwo line.\n\nNew section.\nEnd.")], "a string, b string")
    marks = rows.select(merkle.fingerprint(F.col("a")).alias("a"), merkle.fingerprint(F.col("b")).alias("b"))
    r = marks.select(merkle.edited_paragraphs(F.col("a"), F.col("b")).alias("x"), merkle.edited_paragraphs(F.col("a"), F.col("a")).alias("y"),
                     merkle.likeness(F.col("a"), F.col("a")).alias("z")).first()
    assert (r.x, r.y, r.z) == ([1], [], 1.0)


# secrets ------------------------------------------------------------------------------------------------------------

def plain_base(text):
    found = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        found.append((m.start(), 0, m.end(), len(m[2]) >= 6))
    for k, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), k, m.end(), len(m[0]) >= least) for m in re.finditer(pattern, text or "")]
    return sorted((s, k, e) for s, k, e, fits in found if fits)


def test_secret_scan(spark, documents, edge, none):
    texts = dict(documents)
    found = run(spark, "op3_secret_scan")
    assert sorted(r.doc_id for r in found) == sorted(texts)
    odd = edge.collect()
    for r, text in [(r, texts[r.doc_id]) for r in found] + list(zip(secret_scan.scan(edge.coalesce(1)).collect(), [o.text for o in odd])):
        base = plain_base(text)
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple([k for _, k, _ in base].count(x) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert secret_scan.scan(none).count() == 0


def test_guess_cost():
    cost = secret_scan.guess_cost
    assert cost("") == 0
    assert max(cost("aaaaaaaaaaaaaaaa"), cost("password1999")) < 3 < cost("xK9#qLm2vR7$tw")
    assert cost("qwertyuiop") < 4 and cost("2024-01-31") < 6 and cost("abcdefghij") < 4
    assert cost("xK9#qLm2vR7$tw") > secret_scan.MIN_GUESSES_LOG10 > cost("changeme-password")
    for v in ("pa$$word", "x", "tokentoken2020aaaa"):  # never dearer than brute force
        assert cost(v) <= len(v) * np.log10(95) + 1e-9


def test_added_and_redacted_secrets():
    text = 'pwd: "xK9#qLm2vR7$tw" then secret=abcdef123 and bearer: passwordpassword'
    spans = secret_scan.find(text)
    assert [secret_scan.KINDS[k] for _, k, _ in spans] == ["guess", "assign"]
    assert secret_scan.redact_text(text) == 'pwd: "[guess]" then [assign] and bearer: passwordpassword'
    assert secret_scan.redact_text(None) is None and secret_scan.redact_text("") == ""


# token counts -------------------------------------------------------------------------------------------------------

def plain_unigram(model, word):
    best = [(0.0, 0)]
    for j in range(1, len(word) + 1):
        width = len(word[j - 1].encode())
        options = [(best[j - 1][0] + width * model.byte_score, best[j - 1][1] - width)]
        options += [(best[i][0] + model.scores[word[i:j]], best[i][1] - 1) for i in range(j) if word[i:j] in model.scores]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(spark, documents, edge, none):
    path = queries.vocabulary("piece_bpe_32k.model")
    model = token_counts.UnigramModel.from_sentencepiece(path)
    texts = dict(documents)
    for r in random.Random(1).sample(run(spark, "op4_token_counts"), 40):
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])
        assert (r.n_pretokens, r.n_tokens) == (len(words), sum(plain_unigram(model, "▁" + w) for w in words))
    odd = token_counts.count_tokens(edge.coalesce(1), path).collect()
    for r, o in zip(odd, edge.collect()):
        assert r.n_tokens == sum(plain_unigram(model, "▁" + w) for w in re.findall(r"[^\x20\x09-\x0D]+", o.text or ""))
    assert token_counts.count_tokens(none, path).count() == 0


# token files --------------------------------------------------------------------------------------------------------

def ids_of(name, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary(name))
    tokenizer.encode_special_tokens = True
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_token_files(spark, documents):
    expected, start = [], 0
    for (doc_id, _), ids in zip(documents, ids_of("byte_bpe_50k.json", [t for _, t in documents])):
        ids = ids + [2]
        expected.append((doc_id, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    assert sorted(map(tuple, run(spark, "op5_token_files"))) == expected


def test_token_files_of_odd_rows(spark, edge, none):
    path = queries.vocabulary("byte_bpe_50k.json")
    read = lambda df: token_files.read_token_files(token_files.with_starts(token_files.write_token_files(df, path))).collect()
    rows = sorted(((r.doc_id, r.text or "") for r in edge.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start, expected = 0, []
    for (doc_id, _), ids in zip(rows, ids_of("byte_bpe_50k.json", [t for _, t in rows])):
        expected.append((doc_id, start, len(ids) + 1, zlib.crc32(packed(ids + [2]))))
        start += len(ids) + 1
    assert sorted(map(tuple, read(edge)), key=lambda r: r[1]) == expected
    assert read(none) == []


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (token_files.unpack(data, bits, 1001) == ids).all()
    if bits < 32:
        with pytest.raises(ValueError):
            token_files.pack(np.array([1 << bits], "<u4"), bits)


def test_reader_refuses_other_files():
    with pytest.raises(ValueError):
        token_files.TokenFileReader(Bytes(bytes(64)))


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at: at + n]


def test_random_access():
    class Sink:
        data = b""

        def write(self, piece):
            self.data += piece

        def close(self):
            pass

    sink = Sink()
    writer, ids = token_files.TokenFileWriter(sink, 17), np.random.default_rng(0).integers(0, 1 << 17, 200_001).astype("<u4")
    for part in np.array_split(ids, 7):
        writer.append(part)
    writer.close()
    reader = token_files.TokenFileReader(Bytes(sink.data))
    for start, n in ((0, 5), (65_530, 12), (131_072, 1), (199_990, 11), (10, 150_000), (3, 0)):
        assert (reader.read(start, n) == ids[start: start + n]).all()


def test_cut_texts_have_the_ids_of_whole_texts(documents, edge):
    texts = [t for _, t in documents] + [r.text for r in edge.collect()]
    texts += ["".join(random.Random(s).choices(" \n\t  ab'sé1!\x85　\x1c", k=60)) for s in range(300)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = encode.TextEncoder(queries.vocabulary(name))
        assert encoder.cut in (encode.led_by_space, encode.between_spaces)
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == ids_of(name, texts)


# WARC ---------------------------------------------------------------------------------------------------------------

def plain_warc(rows):
    last = {}
    for page_id, html in rows:
        last[html or ""] = max(last.get(html or "", page_id), page_id)
    for page_id, html in rows:
        data = (html or "").encode()
        here = page_id == last[html or ""]
        yield (page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if here else "revisit", None if here else last[html or ""])


def test_warc(spark, none):
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    found = queries.QUERIES["op6_warc"](spark, SF_SMALL).select(columns).collect()
    assert sorted(map(tuple, found)) == sorted(plain_warc([(r.page_id, r.html) for r in pages.collect()]))
    rows = [(1, "a", "same"), (2, None, "same"), (5, "b\r\nX: y", "same"), (3, "c", None), (4, "d", ""), (6, "e", "ü" * 300_000), (7, "f", "end\r\n\r\n")]
    odd = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    back = warc.read_archives(warc.write_archives(odd))
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(plain_warc([(i, h) for i, _, h in rows]))
    assert warc.read_archives(warc.write_archives(odd.limit(0))).count() == 0
    bare = spark.createDataFrame([(None, "u", "x"), (None, "u", "x")], "page_id bigint, url string, html string")
    assert [r.record_type for r in warc.read_archives(warc.write_archives(bare)).collect()] == ["response"] * 2
    small = warc.read_archives(warc.write_archives(odd, least_bytes=5)).where("payload_bytes < 5").select("record_type").distinct().collect()
    assert [r.record_type for r in small] == ["response"]


def test_warc_reader_refuses_damage():
    good = warc.page_record(1, "u", b"payload " * 50, None) + warc.page_record(2, "u", b"other", 1)
    chunked = lambda data, n: [data[i: i + n] for i in range(0, len(data), n)]
    for n in (1, 7, 100_000):
        assert [(f["warc-type"], p) for f, _, p in warc.read_records(chunked(good, n))] == [("response", b"payload " * 50), ("revisit", b"")]
    with pytest.raises(EOFError):
        list(warc.read_records([good[:-5]]))
    with pytest.raises(ValueError):
        list(warc.read_records([warc.record({"WARC-Type": "response", "WARC-Payload-Digest": "sha1:AAAA"}, b"HTTP/1.1 200 OK\r\n\r\nx")]))


# line dedup ---------------------------------------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def similar_pairs(forms):
    """Places of all pairs of forms of sufficient edit similarity, each pair compared."""
    spark = SparkSession.getActiveSession()
    table = spark.createDataFrame(list(enumerate(forms)), "i int, form string").withColumn("n", F.char_length("form"))
    other = table.select(F.col("i").alias("j"), F.col("form").alias("other"), F.col("n").alias("m"))
    most = F.floor(F.greatest("n", "m") * (1 - line_dedup.SIMILARITY) + 1e-9).cast("int")
    pairs = table.repartition(16).join(other, (F.col("i") < F.col("j")) & (F.abs(F.col("n") - F.col("m")) <= most))
    return [(r.i, r.j) for r in pairs.where(F.call_function("levenshtein", "form", "other", most) >= 0).select("i", "j").collect()]


def plain_lines(rows):
    """{(id, text): lines that go}, by comparing all pairs of distinct normal forms by edit similarity alone."""
    spark = SparkSession.getActiveSession()
    texts = list({t for _, t in rows})
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    first, places = {}, defaultdict(set)
    for doc_id, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))
            if words:
                form, place = " ".join(words), (doc_id is None, doc_id or 0, hashes[text], n)
                places[form].add((doc_id, text, n))
                first[form] = min(first.get(form, place), place)
    forms = list(first)
    root = groups_of(len(forms), similar_pairs(forms))
    kept = {}
    for i, form in enumerate(forms):
        kept[root[i]] = min(kept.get(root[i], first[form]), first[form])
    gone = defaultdict(set)
    for i, form in enumerate(forms):
        for doc_id, text, n in places[form]:
            if (doc_id is None, doc_id or 0, hashes[text], n) != kept[root[i]]:
                gone[doc_id, text].add(n)
    return gone


def deduped(rows):
    gone = plain_lines(rows)
    return sorted(((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t])) for i, t in rows), key=repr)


def test_line_dedup(spark, documents):
    found = queries.QUERIES["op7_line_dedup"](spark, SF_SMALL)
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=repr) == deduped(documents)


def test_line_dedup_of_variants_and_odd_rows(spark, edge, none):
    rng = random.Random(3)
    base = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(70)) for _ in range(6)]
    rows = []
    for i in range(240):  # many variants of a few lines, some of them far apart
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2, 12])):
            words[rng.randrange(len(words))] = "".join(rng.choices("xyz", k=4))
        rows.append((i, " ".join(words) + "\n\nown line %d" % i))
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    # candidates are found with high probability: of all that go by comparing all pairs, all but a few, and nothing else
    gone = plain_lines(rows)
    for r in found:
        assert set(r.text.split("\n")) >= {x for n, x in enumerate(dict(rows)[r.doc_id].split("\n")) if n not in gone[r.doc_id, dict(rows)[r.doc_id]]}
    n_gone = sum(r.n_lines_gone for r in found)
    assert n_gone > 60 and 0.98 * sum(map(len, gone.values())) <= n_gone <= sum(map(len, gone.values()))
    odd = line_dedup.dedup_lines(edge)
    assert set(odd.columns) == {*edge.columns, "n_lines_gone"}
    assert sorted(((r.doc_id, r.text) for r in odd.collect()), key=repr) == deduped([(r.doc_id, r.text) for r in edge.collect()])
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_of_rows_that_share_an_id_or_have_none(spark):
    rows = [(None, "shared line here\nonly in the first"), (None, "shared line here\nonly in the second"), (7, "one more unique line\nshared line here"),
            (7, "quite another text of seven"), (7, "quite another text of seven"), (8, "quite another text of seven")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted([
        (None, "only in the first"), (None, "only in the second"), (7, "one more unique line\nshared line here"),
        (7, "quite another text of seven"), (7, "quite another text of seven"), (8, "")], key=repr)


def test_good_rows_without_an_id_do_not_keep_the_bad_ones(spark):
    good = "Every sentence of this text is different from the others. It has many words, and they do not repeat themselves much at all."
    bad = "spam eggs ham toast jam " * 12
    rows = [(None, good), (None, bad), (5, good + " Five."), (5, bad + "five")]
    assert {r.text for r in quality_rules.keep_good(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == {good, good + " Five."}


def test_normal_forms_agree(spark, edge):
    for r in edge.where("text is not null").select("text", line_dedup.normal_form(F.col("text")).alias("form")).collect():
        assert r.form == b" ".join(r.text.encode().lower().split()).decode()


# packing ------------------------------------------------------------------------------------------------------------

def check_pieces(rows, found):
    made = Counter()
    for (doc_id, _), ids in zip(rows, ids_of("word_bpe_49k.json", [t for _, t in rows])):
        ids, start = ids + [2], 0
        for length in packing.piece_lengths(len(ids)):
            made[(doc_id, start, length, zlib.crc32(packed(ids[start: start + length])), len(ids), 0)] += 1
            start += length
        assert start == len(ids)
    assert made == Counter((r[0], r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in found)
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))
    lengths = [r.length for r in sorted(found, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True) and all(n & (n - 1) == 0 and n <= 4096 for n in lengths)


def test_packing(spark, documents, edge, none):
    check_pieces(documents, run(spark, "op8_packing"))
    path = queries.vocabulary("word_bpe_49k.json")
    check_pieces([(r.doc_id, r.text) for r in edge.collect()], packing.pack_documents(edge, path).collect())
    assert packing.pack_documents(none, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(none, path, longest=1000)


# quality rules ------------------------------------------------------------------------------------------------------

def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i: i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i: i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, documents, edge, none):
    texts = dict(documents)
    found = run(spark, "op9_quality_rules")
    assert len(found) == len(documents)
    for r in found:
        n, chars, symbols, dups, repeated = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeated)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n)
        assert r.kept == (not r.base_failed and r.p_good >= 0.5)
    for r, o in zip(quality_rules.document_counts(edge.coalesce(1)).collect(), edge.collect()):
        assert tuple(r)[1:6] == plain_counts(o.text)
    assert quality_rules.judged(none).count() == 0
    assert quality_rules.keep_good(none).columns == none.columns
    assert quality_rules.keep_good(edge).columns == edge.columns


def test_estimated_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(40_000) < 0.7
    right = np.array([0.95, 0.8, 0.7, 0.9, 0.6])
    correct = rng.random((len(good), 5)) < right
    votes = np.where(rng.random(correct.shape) < 0.2, 0, np.where(correct == good[:, None], 1, -1))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, found, _ = quality_rules.estimate(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.03 and np.abs(found - right).max() < 0.05


def test_quality_agrees_with_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = queries.QUERIES["op9_quality_rules"](spark, "/root/testdata/sf0.01").where("NOT base_failed").collect()
    pairs = [(labels[r.doc_id], r.kept) for r in judged if r.doc_id in labels]
    assert np.mean([kept for quality, kept in pairs if quality]) > 0.97


# byte-level BPE -----------------------------------------------------------------------------------------------------

@pytest.fixture(scope="session")
def tiktoken_encoding():
    import tiktoken

    ranks = byte_bpe.read_ranks(queries.vocabulary("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, documents, tiktoken_encoding):
    texts = dict(documents)
    found = run(spark, "op10_byte_bpe")
    assert len(found) == len(documents)
    for r in found:
        ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("most_sent", [byte_bpe.MOST_SENT, 3, 0])
def test_byte_bpe_of_odd_rows(spark, edge, none, tiktoken_encoding, most_sent):
    path = queries.vocabulary("byte_bpe_multi_50k.tiktoken")
    found = byte_bpe.encode_documents(edge.coalesce(1), path, public_tokenizers.PATTERN, decode=True, most_sent=most_sent).collect()
    for r, o in zip(found, edge.collect()):
        assert np.frombuffer(r.ids, "<u4").tolist() == tiktoken_encoding.encode_ordinary(o.text or "")
        assert r.decoded == (o.text or "").encode()
    if most_sent == 0:
        assert byte_bpe.encode_documents(none, path, public_tokenizers.PATTERN).count() == 0
