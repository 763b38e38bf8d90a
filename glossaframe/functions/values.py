"""Typed values out of the JSON that a labeler answers with. A value of the wrong type is NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

NUMBER_TYPES = r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$"


def answer_value_json(raw: Column) -> Column:
    """The `value` field of a JSON object as JSON text; NULL for bad JSON, other shapes and JSON null."""
    parsed = F.try_parse_json(raw)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    value = F.try_variant_get(parsed, "$.value", "variant")
    # a number beyond the range of a double reads as infinity, which has no JSON form
    overflow = F.schema_of_variant(value).rlike(NUMBER_TYPES) & (
        F.abs(F.try_variant_get(value, "$", "double")) == F.lit(float("inf"))
    )
    text = F.to_json(value)
    return F.when(is_object & (text != "null") & ~F.coalesce(overflow, F.lit(False)), text)


def typed_value(value_json: Column, output_type: str, enum_values: Sequence[str] | None = None) -> Column:
    """Check the JSON type of a value, not whether it can be cast: '"5"' is no number and 'true' is none either."""
    parsed = F.try_parse_json(value_json)
    json_type = F.schema_of_variant(parsed)
    if output_type == "number":
        number = F.try_variant_get(parsed, "$", "double")
        return F.when(json_type.rlike(NUMBER_TYPES) & (F.abs(number) < F.lit(float("inf"))), number)
    if output_type == "boolean":
        return F.when(json_type == "BOOLEAN", F.try_variant_get(parsed, "$", "boolean"))
    text = F.when(json_type == "STRING", F.try_variant_get(parsed, "$", "string"))
    if output_type == "enum":
        return F.when(text.isin(list(enum_values or [])), text)
    if output_type == "string":
        return text
    raise ValueError(f"output_type must be one of {list(fixed.OUTPUT_TYPES)}")


def pair_value(value_json: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """`struct<parent, child>` when the answer is one of the allowed pairs, else NULL."""
    parsed = F.try_parse_json(value_json)
    parent = F.trim(F.try_variant_get(parsed, "$.parent", "string"))
    child = F.trim(F.try_variant_get(parsed, "$.child", "string"))
    allowed = F.concat_ws("\0", parent, child).isin([f"{p}\0{c}" for p, c in pairs])
    return F.when(parent.isNotNull() & child.isNotNull() & allowed, F.struct(parent.alias("parent"), child.alias("child")))


def vector_value(value_json: Column) -> Column:
    return F.from_json(value_json, "array<float>")
