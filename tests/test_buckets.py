"""Lookups and written columns that move nothing but what is new."""

import re

import pytest
from pyspark.sql import functions as F

from glossaframe import Workspace
from glossaframe.operators import labelers
from glossaframe.operators.cache import JudgementCache
from glossaframe.operators.sides import SideTables
from glossaframe.sources.row_ids import RID


def plan_of(df):
    """The executed plan of a frame, before it runs."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def tree(df):
    """(depth, node) of the executed plan, the adaptive wrapper left out."""
    return [(len(re.match(r"[\s:+\-*|]*", line)[0]), line) for line in plan_of(df).split("\n") if line.strip() and "Initial Plan" not in line]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def put(cache, rows, table="t", column="c"):
    spark = cache.spark
    frame = spark.createDataFrame(rows, "cache_key string, value string").withColumn("row_key", F.lit("1"))
    cache.put(frame, table, column, "m", "derive_column", "g", "h", "p", "s")


def test_lookup_does_not_shuffle_the_memo(spark, tmp_path, no_broadcast):
    cache = JudgementCache(spark, str(tmp_path / "memo"), buckets=6)
    put(cache, [(f"key{i}", f'"{i}"') for i in range(3000)])
    put(cache, [(f"key{i}", f'"new {i}"') for i in range(2900, 3100)])
    wanted = spark.createDataFrame([(f"key{i}",) for i in range(2950, 3150, 5)], "cache_key string")
    found = cache.values("t", wanted)
    assert {r.cache_key: r.value_json for r in found.collect()} == {f"key{i}": f'"new {i}"' for i in range(2950, 3100, 5)}
    # the only exchange is that of the keys: none stands above a scan of the memo without the join between them
    lines = tree(found)
    for at, (depth, line) in enumerate(lines):
        if "Exchange" in line:
            below = [text for d, text in lines[at + 1:at + 20] if d > depth]
            assert not any("batch_id" in text and "Scan" in text for text in below), plan_of(found)
    scan = next(line for _, line in lines if "FileScan" in line and "batch_id" in line)
    assert "Bucketed: true" in scan
    assert "row_key" not in scan and "created_at" not in scan


def shuffled_records(spark, df):
    """Rows that the run of a frame writes to shuffles, by Spark's own count of them in the executed plan."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
            continue
        if kind == "ShuffleExchangeExec":
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        children = plan.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_second_run_shuffles_in_proportion_to_its_rows(spark, tmp_path, no_broadcast):
    """50 and 500 keys against a memo of 5000."""
    cache = JudgementCache(spark, str(tmp_path / "memo"), buckets=4)
    put(cache, [(f"key{i}", f'"{i}"') for i in range(5000)])
    put(cache, [("key0", '"x"')])
    for n in (50, 500):
        wanted = spark.createDataFrame([(f"key{i}",) for i in range(n)], "cache_key string")
        assert 0 < shuffled_records(spark, wanted.join(cache.values("t", wanted), "cache_key", "left")) <= 2 * n


def test_memo_keeps_its_number_of_buckets_and_reads_older_batches(spark, tmp_path):
    root = str(tmp_path / "memo")
    put(JudgementCache(spark, root, buckets=3), [("a", '"1"'), ("b", '"2"')])
    other = JudgementCache(spark, root, buckets=9)
    put(other, [("b", '"3"'), ("c", '"4"')])
    assert {r["buckets"] for r in other._log()} == {3}
    assert {r.cache_key: r.value for r in other.entries().collect()} == {"a": '"1"', "b": '"3"', "c": '"4"'}
    # a batch without buckets, as written before there were any
    name = other._batch(3)
    other.entries().where("cache_key = 'a'").drop("batch_id").withColumn("value", F.lit('"5"')).write.partitionBy("table_name", "column_name").parquet(f"{root}/data/batch_id={name}")
    other._commit(3, "add", batch=name)
    assert {r.cache_key: r.value for r in other.entries().collect()} == {"a": '"5"', "b": '"3"', "c": '"4"'}
    assert {r.cache_key: r.value_json for r in other.values("t", spark.createDataFrame([("a",), ("z",)], "cache_key string")).collect()} == {"a": '"5"'}


def test_three_columns_are_three_narrow_tables_read_without_an_exchange(spark, tmp_path, monkeypatch):
    written = []
    from glossaframe.operators import sides

    def spy(df, path, key, n, partition_by=()):
        written.append(df.columns)
        return real(df, path, key, n, partition_by)

    real = sides.write_buckets
    monkeypatch.setattr(sides, "write_buckets", spy)
    rows = spark.range(400).select((F.col("id") + 1).alias(RID), F.concat(F.lit("text "), F.col("id") % 37).alias("text"), F.lit("wide").alias("other"))
    made = {}
    for apart in (False, True):
        ws = Workspace(spark, str(tmp_path / f"memo{apart}"), columns_apart=apart)
        ws.register("t", rows, "made")
        for digit in "123":
            ws.derive_column("t", f"has_{digit}", ["text"], digit, "enum", enum_values=["yes", "no"],
                             labeler=labelers.RuleLabeler(f"rules{digit}", [(digit, "yes")], "no"))
        made[apart] = ws.table("t")
    assert written == [rows.columns, [RID, "has_1"], [RID, "has_2"], [RID, "has_3"]]
    assert made[True].columns == made[False].columns
    assert sorted(made[True].collect()) == sorted(made[False].collect())
    assert "Exchange" not in plan_of(made[True]) and plan_of(made[True]).count("SortMergeJoin") == 3
    assert plan_of(made[True]).count("Bucketed: true") == 4


def test_columns_apart_are_replaced_dropped_and_chosen(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") + 1).alias(RID), F.col("id").alias("a"), F.lit("x").alias("b"))
    table = SideTables(rows, buckets=3)
    table.add(rows.where("a % 2 = 0").select(RID, (F.col("a") * 10).alias("c")), ["c"])
    table.add(rows.select(RID, F.lit("y").alias("b"), F.lit(1).alias("d")), ["b", "d"])
    assert table.frame().columns == [RID, "a", "c", "b", "d"]
    assert sorted(map(tuple, table.frame().collect())) == [(i + 1, i, i * 10 if i % 2 == 0 else None, "y", 1) for i in range(50)]
    assert plan_of(table.frame(["a", "d"])).count("SortMergeJoin") == 1
    table.add(rows.select(RID, F.lit(7).alias("c")), ["c"])
    table.drop(["d"])
    assert sorted(map(tuple, table.frame().collect())) == [(i + 1, i, "y", 7) for i in range(50)]


def test_a_workspace_with_columns_apart_forgets_and_reloads(spark, tmp_path, posts_csv):
    ws = Workspace(spark, str(tmp_path / "memo"), columns_apart=True, labeler=labelers.RuleLabeler("r", [("train", "yes")], "no"))
    ws.load_table(posts_csv, "posts")
    ws.derive_column("posts", "on_train", ["content"], "Train?", "enum", enum_values=["yes", "no"])
    again = ws.derive_column("posts", "on_train", ["content"], "Train?", "enum", enum_values=["yes", "no"])
    assert again.counters().first()["cache_hits"] == 4
    assert ws.sql("SELECT count(*) AS n FROM posts WHERE on_train = 'yes'").first()["n"] == 1
    assert ws.invalidate_cache(table="posts")["dropped"] == ["posts.on_train"]
    assert "on_train" not in ws.table("posts").columns
    assert ws.table("posts").count() == 4
    ws.load_table(posts_csv, "posts")
    assert not ws.apart
    ws.reset()
