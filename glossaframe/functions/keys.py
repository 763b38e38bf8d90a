"""Content keys of judgements."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_text(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def canonical_json(value) -> str:
    """JSON with sorted keys, for the parts of a key that are known on the driver."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def row_json(columns: Sequence[str]) -> Column:
    """The named columns of a row as JSON, keys sorted, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})


def cache_key(table: str, row_content: Column, prompt: str, schema: str, model: str) -> Column:
    """SHA-256 over the five parts that make a judgement reusable, each closed by a NUL."""
    nul = F.lit("\0")
    parts = [F.lit(table), row_content, F.lit(prompt), F.lit(schema), F.lit(model)]
    return F.sha2(F.concat(*[x for part in parts for x in (part, nul)]), 256)
