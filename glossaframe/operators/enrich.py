"""Column enrichment: judge each distinct content once, remember the judgement, join it back.

The steps of a cached run, for a table of any size:

1. key      rows -> (cache_key, first _rid, number of rows), a partial aggregation over narrow rows; written
2. probe    keys joined with the memo: hits are done, the rest are misses
3. judge    one payload per missed key goes to the model; the raw answers are written before anything else
            looks at them, so that a retry downstream never pays again
4. decode   answers are checked against the declared type by Catalyst expressions
5. remember valid judgements are appended to the memo
6. join     the source rows are joined with the judgements on the content key; hot keys are salted

A labeler that is a pure expression, used without a memo, skips all of it: the column is added in the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, keys, values
from ..functions.text import ellipsis, text_or_empty
from ..scratch import stage
from ..sources.row_ids import RID
from .cache import JudgementCache
from .labelers import Request
from .skew import hot_keys, join_skewed, spread

HIT, LABELLED, EMBEDDED, SKIPPED, ERROR = "hit", "labelled", "embedded", "skipped", "error"
RESERVED = {RID}


def check_identifier(name: str) -> str:
    """Letters, digits and underscores, no digit first, not underscores alone, and not a reserved name."""
    if not re.fullmatch(r"\w+", name or "") or name[0].isdigit() or not name.strip("_"):
        raise ValueError(f"'{name}' is not a valid identifier")
    if name in RESERVED:
        raise ValueError(f"'{name}' is reserved")
    return name


def check_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def check_choice(name: str, value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {list(allowed)}")


@dataclass
class Decoder:
    """How the JSON of a judgement becomes one or more typed columns."""

    columns: dict[str, Callable[[Column], Column]]
    types: dict[str, str] = field(default_factory=dict)

    def value(self, value_json: Column) -> Column:
        """A column that is null exactly when the judgement is invalid."""
        return next(iter(self.columns.values()))(value_json)


@dataclass
class Enrichment:
    """The enriched rows, and one audit row per distinct content: `(n_rows, status, <new columns>)`."""

    df: DataFrame
    audit: DataFrame
    columns: list[str]

    def counters(self) -> DataFrame:
        """One row: total, cache_hits, calls, embed_assigns, skipped, errors. Calls count distinct contents."""

        def rows(status: str) -> Column:
            return F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n_rows"))), F.lit(0)).cast("bigint")

        asked = F.col("status").isin(LABELLED, SKIPPED, ERROR) & F.col("asked")
        return self.audit.agg(
            F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("total"),
            rows(HIT).alias("cache_hits"),
            F.count_if(asked).alias("calls"),
            rows(EMBEDDED).alias("embed_assigns"),
            rows(SKIPPED).alias("skipped"),
            rows(ERROR).alias("errors"),
        )

    def distribution(self, column: str | None = None) -> DataFrame:
        """`(label, n)` over the judged rows, nulls as 'NULL', the largest first."""
        label = F.coalesce(F.col(column or self.columns[-1]).cast("string"), F.lit("NULL"))
        return self.audit.groupBy(label.alias("label")).agg(F.sum("n_rows").cast("bigint").alias("n")).orderBy(F.desc("n"), "label")


def write_back(df: DataFrame, judged: DataFrame, key: str, columns: Sequence[str], hot: DataFrame | None = None,
               on_existing: str = "replace") -> DataFrame:
    """Join judgements to rows that carry their key, replacing or filling columns that exist already."""
    check_choice("on_existing", on_existing, ["replace", "merge"])
    fresh = {c: f"__new_{c}" for c in columns}
    judged = judged.select(key, *[F.col(c).alias(n) for c, n in fresh.items()])
    joined = join_skewed(df, judged, key, hot, F.col(RID))
    kept = [F.col(f"`{c}`") for c in df.columns if c != key and c not in fresh]
    new = [
        (F.coalesce(F.col(n), F.col(c)) if on_existing == "merge" and c in df.columns else F.col(n)).alias(c)
        for c, n in fresh.items()
    ]
    return joined.select(*kept, *new)


def run(df: DataFrame, *, row_content: Column, payload: Column, prompt: str, schema: dict, model: str, table: str,
        decoder: Decoder, judge: Callable[[DataFrame], DataFrame], expression: bool, cache: JudgementCache | None,
        rerun_mode: str, tool_name: str, cache_column: str, goal: str, prompt_preview: str, source_columns: Sequence[str],
        where: str | None = None, dry_run_rows: int | None = None, on_existing: str = "replace",
        share_across_tables: bool = False, dedupe: bool = True) -> Enrichment:
    """The engine behind all enrichment operators. `judge` adds `raw` (JSON answer) and `status` to a frame
    with a `payload` column."""
    check_choice("rerun_mode", rerun_mode, fixed.RERUN_MODES)
    check_columns(df, [RID])
    columns = list(decoder.columns)
    schema_json = keys.canonical_json(schema)
    scope = df.where(F.expr(where)) if where else df
    if dry_run_rows:
        scope = scope.orderBy(RID).limit(int(dry_run_rows))

    def decode(frame: DataFrame, value_json: str = "value_json") -> DataFrame:
        return frame.select("*", *[make(F.col(value_json)).alias(c) for c, make in decoder.columns.items()])

    def with_status(frame: DataFrame) -> DataFrame:
        skipped = F.col("value_json") == F.lit(f'"{fixed.SKIP_LABEL}"')
        status = (
            F.when(skipped, SKIPPED)
            .when(decoder.value(F.col("value_json")).isNull(), ERROR)
            .otherwise(F.col("status"))
        )
        return frame.withColumn("asked", F.col("status") == LABELLED).withColumn("status", status)

    if cache is None and (expression or not dedupe):
        # nothing to remember and nothing to pay for twice: one narrow pass, no shuffle
        answered = judge(scope.withColumn("payload", payload))
        if not expression:
            answered = stage(answered, "answers")
        judged = with_status(answered.withColumn("value_json", values.answer_value_json(F.col("raw"))))
        made = decode(judged.select(
            "value_json", "status", "asked", F.lit(1).cast("bigint").alias("n_rows"),
            F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        ))
        kept = [F.col("row").getField(c).alias(c) for c in df.columns if c not in columns]
        new = [
            (F.coalesce(F.col(c), F.col("row").getField(c)) if on_existing == "merge" and c in df.columns else F.col(c)).alias(c)
            for c in columns
        ]
        out = made.select(*kept, *new)
        if where and not dry_run_rows:
            outside = df.where(~F.coalesce(F.expr(where), F.lit(False)))
            types = {f.name: f.dataType for f in out.schema.fields}
            out = out.unionByName(outside.select(
                *[F.col(f"`{c}`") for c in df.columns if c not in columns],
                *[(F.col(c) if on_existing == "merge" and c in df.columns else F.lit(None).cast(types[c])).alias(c) for c in columns],
            ))
        return Enrichment(out, made.select("status", "asked", "n_rows", *columns), columns)

    key = keys.cache_key("" if share_across_tables else table, row_content, prompt, schema_json, model)
    keyed = scope.select(RID, key.alias("cache_key"), payload.alias("payload"))
    groups = stage(
        keyed.groupBy("cache_key").agg(F.min(RID).alias("rep"), F.count(F.lit(1)).alias("n_rows")), "content-keys"
    )
    sizes = groups.agg(F.sum("n_rows").alias("rows"), F.max("n_rows").alias("largest"), F.count(F.lit(1)).alias("keys")).first()
    total, largest, distinct = sizes["rows"] or 0, sizes["largest"] or 0, sizes["keys"]

    use_cache = cache is not None and rerun_mode == "reuse" and not cache.is_empty()
    if use_cache:
        known = cache.values(None if share_across_tables else table, groups)
        probed = stage(groups.join(known, "cache_key", "left"), "cache-probe")
        misses = probed.where(F.col("value_json").isNull()).select("cache_key", "rep", "n_rows")
        hits = probed.where(F.col("value_json").isNotNull()).select(
            "cache_key", "rep", "n_rows", "value_json", F.lit(HIT).alias("status"), F.lit(False).alias("asked")
        )
    else:
        misses, hits = groups, None

    if not use_cache and distinct == total:
        work = keyed.select("cache_key", "payload", F.col(RID).alias("rep"), F.lit(1).cast("bigint").alias("n_rows"))
    else:
        # row ids are unique, so this join has no hot key
        work = keyed.select(F.col(RID).alias("rep"), "payload").join(misses, "rep").select("cache_key", "payload", "rep", "n_rows")
    if not expression:
        work = spread(work)
    answered = stage(judge(work).select("cache_key", "rep", "n_rows", "raw", "status"), "answers")
    judged = with_status(answered.withColumn("value_json", values.answer_value_json(F.col("raw")))).drop("raw")

    if cache is not None and rerun_mode != "no_write_cache":
        # a skip is a judgement too and is remembered; errors are asked again next time
        keep = judged.where(F.col("status") != ERROR)
        preview = F.when(F.col("status") == EMBEDDED, F.lit(f"{prompt_preview} [embed]")).otherwise(F.lit(prompt_preview))
        cache.put(
            keep.select("cache_key", F.col("rep").alias("row_key"), F.col("value_json").alias("value"), "status"),
            table, cache_column, model, tool_name, goal, keys.hash_text(schema_json), preview, ",".join(source_columns),
        )

    resolved = judged if hits is None else judged.unionByName(hits.select(*judged.columns))
    resolved = decode(resolved)
    audit = resolved.select("status", "asked", "n_rows", *columns)
    hot = hot_keys(groups.withColumnRenamed("cache_key", "__key"), "__key", total=total, largest=largest)
    if dry_run_rows:
        base = scope.withColumn("__key", key)
    elif where:
        # rows outside the filter get a key of their own, which matches nothing and spreads them evenly
        base = df.withColumn("__key", F.when(F.expr(where), key).otherwise(F.col(RID).cast("string")))
    else:
        base = df.withColumn("__key", key)
    judgements = resolved.withColumnRenamed("cache_key", "__key")
    return Enrichment(write_back(base, judgements, "__key", columns, hot, on_existing), audit, columns)


# ---- operators ------------------------------------------------------------------------------------------


def labelled_by(labeler, request: Request) -> Callable[[DataFrame], DataFrame]:
    return lambda frame: labeler.label(frame, "payload", "raw", request).withColumn("status", F.lit(LABELLED))


def derive_column(df: DataFrame, new_column: str, source_columns: Sequence[str], prompt: str, output_type: str, labeler,
                  enum_values: Sequence[str] | None = None, sample_size: int | None = None, rerun_mode: str = "reuse",
                  cache: JudgementCache | None = None, table: str = "", share_across_tables: bool = False,
                  dedupe: bool = True) -> Enrichment:
    """Add a column by judging each row: the labeler sees the source columns as JSON, and the prompt, type and values.

    `sample_size` makes a dry run over the first rows: they come back labelled, and the memo is filled.
    """
    check_identifier(new_column)
    check_choice("output_type", output_type, list(fixed.OUTPUT_TYPES))
    if output_type == "enum" and not enum_values:
        raise ValueError("enum_values required when output_type='enum'")
    check_columns(df, source_columns)
    content = keys.row_json(source_columns)
    request = Request(prompt, output_type, tuple(enum_values or ()), goal=new_column)
    return run(
        df, row_content=content, payload=content, prompt=prompt,
        schema={"type": output_type, "enum": list(enum_values) if enum_values else None},
        model=labeler.name, table=table, judge=labelled_by(labeler, request), expression=labeler.expression,
        decoder=Decoder({new_column: lambda v: values.typed_value(v, output_type, enum_values)}),
        cache=cache, rerun_mode=rerun_mode, tool_name="derive_column", cache_column=new_column, goal=new_column,
        prompt_preview=prompt, source_columns=source_columns, dry_run_rows=sample_size,
        share_across_tables=share_across_tables, dedupe=dedupe,
    )


def _as_answer(value: Column) -> Column:
    return F.to_json(F.struct(value.alias("value")))


def classify_column(df: DataFrame, source_column: str, new_column: str, classifier, batch_size: int = 32,
                    rerun_mode: str = "reuse", cache: JudgementCache | None = None, table: str = "",
                    share_across_tables: bool = False, dedupe: bool = True) -> Enrichment:
    """Add the label a batch classifier gives to a text column."""
    check_identifier(new_column)
    check_columns(df, [source_column])
    text = text_or_empty(F.col(f"`{source_column}`"))

    def judge(frame: DataFrame) -> DataFrame:
        labelled = classifier.classify(frame, "payload", "__label", batch_size)
        return labelled.withColumn("raw", _as_answer(F.col("__label"))).drop("__label").withColumn("status", F.lit(LABELLED))

    return run(
        df, row_content=text, payload=text, prompt=classifier.name, schema={"model": classifier.name},
        model=classifier.name, table=table, judge=judge, expression=False,
        decoder=Decoder({new_column: lambda v: values.typed_value(v, "string")}),
        cache=cache, rerun_mode=rerun_mode, tool_name="classify_column", cache_column=new_column, goal=new_column,
        prompt_preview=classifier.name, source_columns=[source_column],
        share_across_tables=share_across_tables, dedupe=dedupe,
    )


def embed_column(df: DataFrame, source_column: str, new_column: str, encoder, where: str | None = None,
                 rerun_mode: str = "reuse", cache: JudgementCache | None = None, table: str = "",
                 on_existing: str = "replace", share_across_tables: bool = False) -> Enrichment:
    """Add an `array<float>` embedding of a text column. Only rows inside `where` are encoded, and written before
    anything reads them, so that nothing is encoded twice."""
    check_identifier(new_column)
    check_columns(df, [source_column])
    text = text_or_empty(F.col(f"`{source_column}`"))
    if cache is None:
        kept, merged = [F.col(f"`{c}`") for c in df.columns if c != new_column], on_existing == "merge" and new_column in df.columns
        encoded = encoder.encode((df.where(F.expr(where)) if where else df).withColumn("__text", text), "__text", "__vector")
        vector = F.coalesce("__vector", F.col(new_column)) if merged else F.col("__vector")
        out = inside = stage(encoded.select(*kept, vector.alias(new_column)), "encoded")
        if where:
            before = F.col(new_column) if merged else F.lit(None).cast(inside.schema[new_column].dataType)
            out = inside.unionByName(df.where(~F.coalesce(F.expr(where), F.lit(False))).select(*kept, before.alias(new_column)))
        audit = inside.select(
            F.lit(LABELLED).alias("status"), F.lit(True).alias("asked"), F.lit(1).cast("bigint").alias("n_rows"), new_column
        )
        return Enrichment(out, audit, [new_column])

    def judge(frame: DataFrame) -> DataFrame:
        encoded = encoder.encode(frame, "payload", "__vector")
        return encoded.withColumn("raw", _as_answer(F.col("__vector"))).drop("__vector").withColumn("status", F.lit(LABELLED))

    return run(
        df, row_content=text, payload=text, prompt=encoder.name, schema={"model": encoder.name}, model=encoder.name,
        table=table, judge=judge, expression=False, decoder=Decoder({new_column: values.vector_value}),
        cache=cache, rerun_mode=rerun_mode, tool_name="embed_column", cache_column=new_column, goal=new_column,
        prompt_preview=encoder.name, source_columns=[source_column], where=where, on_existing=on_existing,
        share_across_tables=share_across_tables,
    )


def preview_labels(result: Enrichment, source_columns: Sequence[str], rows: int = fixed.DRY_RUN_PREVIEW_ROWS) -> DataFrame:
    """The first judged rows with a short view of what was judged."""
    snippet = ellipsis(keys.row_json(source_columns), 120)
    return result.df.orderBy(RID).limit(rows).select(RID, *result.columns, snippet.alias("snippet"))
