"""Assigning a closed taxonomy, flat or parent/child, by labeler, by similarity, or similarity first."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, keys, values
from ..functions.text import polarity_of, text_or_empty
from ..scratch import stage
from .cache import JudgementCache
from .enrich import (EMBEDDED, Decoder, Enrichment, check_choice, check_columns, check_identifier,
                     labelled_by, run)
from .labelers import Request
from .similarity import best_prototype


@dataclass(frozen=True)
class Category:
    label: str
    definition: str = ""
    parent: str | None = None

    @property
    def prototype_text(self) -> str:
        parts = [self.label, self.definition] if self.parent is None else [self.parent, self.label, self.definition]
        return ". ".join(parts).strip()

    @property
    def answer(self) -> str:
        value = self.label if self.parent is None else {"parent": self.parent, "child": self.label}
        return keys.canonical_json({"value": value})


def parse_taxonomy(taxonomy: Sequence, shape: str, definitions: dict[str, str] | None = None) -> list[Category]:
    """Labels as text, `{label, definition}` or mined phrases when flat; `{parent, child, definition}` otherwise."""
    check_choice("taxonomy_shape", shape, ["flat", "hierarchical"])
    definitions = definitions or {}
    out = []
    for entry in taxonomy:
        if shape == "flat":
            given = entry if isinstance(entry, dict) else {"label": entry}
            label = str(given.get("label", "")).strip()
            if label:
                out.append(Category(label, str(definitions.get(label, given.get("definition", "")) or "").strip()))
            continue
        if not isinstance(entry, dict):
            raise ValueError("hierarchical taxonomy entries must have parent and child")
        parent, child = str(entry.get("parent", "")).strip(), str(entry.get("child", "")).strip()
        if not parent or not child:
            raise ValueError("hierarchical taxonomy entries must have parent and child")
        out.append(Category(child, str(entry.get("definition", "")).strip(), parent))
    if not out:
        raise ValueError("taxonomy must contain at least one label")
    return out


def prototype_texts(spark: SparkSession, categories: Sequence[Category]) -> DataFrame:
    """`(idx, text)`: what each category is encoded from."""
    rows = [(i, c.prototype_text) for i, c in enumerate(categories)]
    return spark.createDataFrame(rows, "idx bigint, text string")


def assign_taxonomy(df: DataFrame, text_column: str, new_column: str | None, goal: str, taxonomy: Sequence, labeler=None,
                    taxonomy_shape: str = "flat", category_definitions: dict[str, str] | None = None,
                    new_column_parent: str | None = None, new_column_child: str | None = None, where: str | None = None,
                    routing_mode: str = "llm_only", encoder=None, vector_column: str | None = None,
                    prototypes: DataFrame | None = None, confidence_threshold: float = fixed.CONFIDENCE_THRESHOLD,
                    sample_size: int | None = None, rerun_mode: str = "reuse", cache: JudgementCache | None = None,
                    table: str = "", on_existing: str = "replace", share_across_tables: bool = False) -> Enrichment:
    """Give each row one category of a closed taxonomy; anything else becomes NULL, and so does `__skip__`.

    Routing: `llm_only` asks the labeler, `embed_only` takes the most similar category at or above the
    threshold, `embed_then_llm` asks the labeler only about the rest. Rows are encoded by `encoder`, or come
    with a vector in `vector_column`; the categories likewise by `encoder`, or as `prototypes(idx, vector)`.
    """
    check_columns(df, [text_column] + ([vector_column] if vector_column else []))
    check_choice("routing_mode", routing_mode, fixed.ROUTING_MODES)
    categories = parse_taxonomy(taxonomy, taxonomy_shape, category_definitions)
    if taxonomy_shape == "flat":
        columns = [check_identifier(new_column)]
        labels = [c.label for c in categories]
        decoder = Decoder({new_column: lambda v: values.typed_value(v, "enum", labels)})
        payload_of_key = labels
    else:
        columns = [check_identifier(new_column_parent or ""), check_identifier(new_column_child or "")]
        pairs = [(c.parent, c.label) for c in categories]
        decoder = Decoder({
            columns[0]: lambda v: values.pair_value(v, pairs)["parent"],
            columns[1]: lambda v: values.pair_value(v, pairs)["child"],
        })
        payload_of_key = [{"parent": c.parent, "child": c.label, "definition": c.definition} for c in categories]
    if routing_mode != "embed_only" and labeler is None:
        raise ValueError(f"routing_mode '{routing_mode}' needs a labeler")
    routed = routing_mode != "llm_only"
    if routed and encoder is None and (vector_column is None or prototypes is None):
        raise ValueError("routing by similarity needs an encoder, or a vector column and prototypes")

    text = text_or_empty(F.col(f"`{text_column}`"))
    encoder_name = encoder.name if encoder is not None else f"column:{vector_column}"
    model = labeler.name if labeler is not None else encoder_name
    schema = {
        "goal": goal, "taxonomy_shape": taxonomy_shape, "labels": payload_of_key,
        "definitions": {c.label: c.definition for c in categories if c.parent is None and c.definition},
        "polarity": polarity_of(goal, where),
    }
    request = Request(
        goal, "enum" if taxonomy_shape == "flat" else "pair", tuple(labels if taxonomy_shape == "flat" else pairs),
        tuple(c.definition for c in categories), goal, schema["polarity"] or "",
    )
    if routed:
        schema["routing"] = {"mode": routing_mode, "model": encoder_name, "threshold": confidence_threshold}

    spark = df.sparkSession
    payload = text if not vector_column else F.struct(text.alias("text"), F.col(vector_column).alias("vector"))
    content = text if not vector_column else F.concat(text, F.lit("\0"), F.to_json(F.struct(F.col(vector_column).alias("v"))))

    def judge(frame: DataFrame) -> DataFrame:
        if not routed:
            return labelled_by(labeler, request)(frame)
        frame = frame if not vector_column else frame.select(
            *[c for c in frame.columns if c != "payload"], F.col("payload.text").alias("payload"), F.col("payload.vector").alias("__vector")
        )
        if not vector_column:
            frame = encoder.encode(frame, "payload", "__vector")
        against = prototypes
        if against is None:
            against = encoder.encode(prototype_texts(spark, categories), "text", "vector").select("idx", "vector")
        scored = best_prototype(frame, "__vector", against)
        answers = F.array(*[F.lit(c.answer) for c in categories])
        sure = F.col("best_similarity") >= F.lit(float(confidence_threshold))
        scored = scored.withColumn("raw", F.when(sure, F.get(answers, F.col("best_idx").cast("int"))))
        scored = scored.drop("__vector", "best_idx", "best_similarity")
        if routing_mode == "embed_only":
            return scored.withColumn("status", F.lit(EMBEDDED))
        scored = stage(scored, "routed")  # encoded once, read by both branches
        sure_rows = scored.where(F.col("raw").isNotNull()).withColumn("status", F.lit(EMBEDDED))
        rest = labelled_by(labeler, request)(scored.where(F.col("raw").isNull()).drop("raw"))
        return sure_rows.unionByName(rest)

    return run(
        df, row_content=content, payload=payload, prompt=goal, schema=schema, model=model, table=table, decoder=decoder,
        judge=judge, expression=routing_mode == "embed_only" or (not routed and labeler.expression), cache=cache, rerun_mode=rerun_mode,
        tool_name="assign_taxonomy", cache_column="|".join(columns), goal=goal, prompt_preview=goal,
        source_columns=[text_column], where=where, dry_run_rows=sample_size, on_existing=on_existing,
        share_across_tables=share_across_tables,
    )


def prototype_text(*parts: Column) -> Column:
    """The same text for a taxonomy that is read from a table."""
    return F.trim(F.concat_ws(". ", *[F.coalesce(p, F.lit("")) for p in parts]))
