"""All named queries."""

from . import enrichment, loading, mining, sql_surface, transcripts, vectors  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
