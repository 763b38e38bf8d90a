"""A set of named tables, their lineage, and every operator by table name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed
from .operators import enrich, filters, mining, sampling, taxonomy, topics
from .operators.cache import JudgementCache
from .operators.enrich import Enrichment, check_identifier
from .operators.sides import SideTables
from .session import configure
from .scratch import stage
from .sources import readers, search, writers
from .sources.row_ids import RID, number_rows


@dataclass
class Table:
    df: DataFrame
    source: str
    parent: str | None = None


class Workspace:
    """Tables are immutable frames; an operator that adds a column registers a new frame under the same name."""

    def __init__(self, spark: SparkSession, cache_path: str | None = None, labeler=None, encoder=None, columns_apart: bool = False):
        """With `columns_apart`, a table is written in buckets when it gets its first new column, and each new column is a
        table of its own beside it; else the whole table is written anew with each."""
        self.spark = configure(spark)
        self.cache = JudgementCache(spark, cache_path) if cache_path else None
        self.labeler, self.encoder = labeler, encoder
        self.tables: dict[str, Table] = {}
        self.columns_apart = columns_apart
        self.apart: dict[str, SideTables] = {}

    # ---- catalog ------------------------------------------------------------------------------------------

    def register(self, name: str, df: DataFrame, source: str, parent: str | None = None) -> DataFrame:
        check_identifier(name)
        df.createOrReplaceTempView(name)
        self.tables[name] = Table(df, source, parent)
        self.apart.pop(name, None)
        return df

    def _show_apart(self, name: str, apart: SideTables) -> DataFrame:
        df = self.register(name, apart.frame(), self.tables[name].source, self.tables[name].parent)
        self.apart[name] = apart
        return df

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"table '{name}' not loaded")
        return self.tables[name].df

    def _update(self, name: str, result: Enrichment) -> Enrichment:
        """The enriched rows (or, with `columns_apart`, only the new columns) are written once, so that later reads repeat no key
        and no lookup."""
        if self.columns_apart:
            apart = self.apart.get(name) or SideTables(self.table(name), name=name)
            apart.add(result.df, result.columns)
            return replace(result, df=self._show_apart(name, apart))
        written = replace(result, df=stage(result.df, name))
        self.register(name, written.df, self.tables[name].source, self.tables[name].parent)
        return written

    def describe(self) -> DataFrame:
        """`(name, n_rows, columns, source)`; the rows are counted by the job that reads this frame."""
        out = None
        for name, table in sorted(self.tables.items()):
            one = table.df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("name"), "n_rows", F.lit(", ".join(table.df.columns)).alias("columns"),
                F.lit(table.source).alias("source"),
            )
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], "name string, n_rows bigint, columns string, source string")

    # ---- loading and querying -----------------------------------------------------------------------------

    def load_table(self, file_path: str, table_name: str, **options) -> DataFrame:
        check_identifier(table_name)
        return self.register(table_name, readers.load(self.spark, file_path, **options), file_path)

    def load_report(self, name: str) -> dict:
        """Row count, columns and the first three rows."""
        df = self.table(name)
        return {"n_rows": df.count(), "columns": df.columns, "preview": df.limit(fixed.LOAD_PREVIEW_ROWS)}

    def sql(self, query: str) -> DataFrame:
        text = query.strip().rstrip(";").strip()
        if not text:
            raise ValueError("empty query")
        return self.spark.sql(text)

    def sql_query(self, query: str, limit: int = fixed.PREVIEW_ROWS) -> DataFrame:
        """The first rows of a query as text. `sql` returns the whole result with its types."""
        return filters.preview(self.sql(query), limit)

    def create_table_as(self, name: str, query: str) -> DataFrame:
        """A query result as a new table of the catalog, written once, with a row key if it has none."""
        df = self.sql(query)
        df = stage(df, name) if RID in df.columns else number_rows(df)
        return self.register(name, df, f"sql: {query.strip()}")

    def export_table(self, query: str, output_path: str, **options) -> str:
        return writers.export_csv(self.sql(query), output_path, **options)

    def corpus_grep(self, name: str, pattern: str, text_column: str, limit: int | None = None) -> DataFrame:
        return search.grep(self.table(name), pattern, RID, text_column, limit)

    # ---- subsets and samples ------------------------------------------------------------------------------

    def materialize_subset(self, source_table: str, new_table: str, where: str, columns: Sequence[str] | None = None,
                           write: bool = False) -> DataFrame:
        check_identifier(new_table)
        df = filters.subset(self.table(source_table), where, columns)
        return self.register(new_table, stage(df, new_table) if write else df, f"{source_table}[{where}]", source_table)

    def sample_rows(self, table: str, sample_size: int, method: str = "random", columns: Sequence[str] | None = None,
                    new_table: str | None = None, **options) -> DataFrame:
        options.setdefault("encoder", self.encoder)
        df = sampling.sample_rows(self.table(table), sample_size, method=method, **options)
        if new_table:
            df = self.register(new_table, stage(df, new_table), f"{table}[sample:{method}]", table)
        return filters.subset(df, None, columns)

    # ---- enrichment ---------------------------------------------------------------------------------------

    def derive_column(self, table: str, new_column: str, source_columns: Sequence[str], prompt: str, output_type: str,
                      sample_size: int | None = None, **options) -> Enrichment:
        options.setdefault("labeler", self.labeler)
        result = enrich.derive_column(self.table(table), new_column, source_columns, prompt, output_type,
                                      sample_size=sample_size, cache=self.cache, table=table, **options)
        return result if sample_size else self._update(table, result)

    def classify_column(self, table: str, source_column: str, new_column: str, classifier, **options) -> Enrichment:
        return self._update(table, enrich.classify_column(self.table(table), source_column, new_column, classifier,
                                                          cache=self.cache, table=table, **options))

    def embed_column(self, table: str, source_column: str, new_column: str, **options) -> Enrichment:
        options.setdefault("encoder", self.encoder)
        return self._update(table, enrich.embed_column(self.table(table), source_column, new_column, cache=self.cache,
                                                       table=table, **options))

    def assign_taxonomy(self, table: str, text_column: str, new_column: str | None, goal: str, taxonomy_: Sequence,
                        sample_size: int | None = None, **options) -> Enrichment:
        options.setdefault("labeler", self.labeler)
        options.setdefault("encoder", self.encoder)
        result = taxonomy.assign_taxonomy(self.table(table), text_column, new_column, goal, taxonomy_,
                                          sample_size=sample_size, cache=self.cache, table=table, **options)
        return result if sample_size else self._update(table, result)

    # ---- discovery ----------------------------------------------------------------------------------------

    def discover_topics(self, table: str, text_column: str, **options) -> topics.Topics:
        options.setdefault("encoder", self.encoder)
        found = topics.discover_topics(self.table(table), text_column, **options)
        self.register(table, found.df, self.tables[table].source, self.tables[table].parent)
        return found

    def discover_taxonomy(self, table: str, text_column: str, goal: str, proposer=None, **options):
        """Proposed by a model from a sample if a proposer is given, else mined from all rows."""
        if proposer is not None:
            return mining.propose_taxonomy(self.table(table), text_column, goal, proposer, **options)
        return mining.mine_taxonomy(self.table(table), text_column, **options), {"recommended_column_name": f"{goal}_label"}

    def discover_issue_phrases(self, table: str, text_column: str, goal: str, proposer=None, **options):
        if proposer is not None:
            return mining.propose_phrases(self.table(table), text_column, goal, proposer, **options)
        return mining.mine_phrases(self.table(table), text_column, **options), {"recommended_column_name": "issue_phrase"}

    # ---- the memo -----------------------------------------------------------------------------------------

    def _need_cache(self) -> JudgementCache:
        if self.cache is None:
            raise ValueError("this workspace has no cache_path")
        return self.cache

    def cache_status(self, **filters_) -> DataFrame:
        return self._need_cache().status(**filters_)

    def invalidate_cache(self, table: str | None = None, column: str | None = None, tool_name: str | None = None,
                         goal: str | None = None, model: str | None = None, workspace_only: bool = False,
                         cache_only: bool = False, all_entries: bool = False) -> dict:
        """Forget matching judgements and drop the columns they filled. Returns what was deleted and dropped."""
        if workspace_only and cache_only:
            raise ValueError("workspace_only and cache_only cannot both be true")
        cache = self._need_cache()
        chosen = dict(table=table, column=column, tool_name=tool_name, goal=goal, model=model)
        groups = cache.status(**chosen, limit=None)
        # one row per table and column
        pairs = [(r["table_name"], r["column_name"]) for r in groups.select("table_name", "column_name").distinct().collect()]
        if not any(chosen.values()) and not all_entries and not workspace_only:
            raise ValueError("no filter given: pass all_entries=True to delete everything")
        dropped: list[str] = []
        if not cache_only:
            for name, joined in pairs:
                if name not in self.tables:
                    continue
                df = self.table(name)
                gone = [c for c in joined.split("|") if c in df.columns and c != RID]
                if gone and name in self.apart:
                    self.apart[name].drop(gone)
                    self._show_apart(name, self.apart[name])
                elif gone:
                    self.register(name, df.drop(*gone), self.tables[name].source, self.tables[name].parent)
                dropped += [f"{name}.{c}" for c in gone]
        deleted = 0 if workspace_only or not pairs else cache.delete(**chosen, all_entries=all_entries)
        return {"matched": len(pairs), "deleted": deleted, "dropped": sorted(dropped)}

    def reset(self) -> None:
        """Drop all tables of this workspace; the memo stays."""
        for name in self.tables:
            self.spark.catalog.dropTempView(name)
        self.tables.clear()
        self.apart.clear()
