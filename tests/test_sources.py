"""Loading, row keys, catalog, exports, search, subsets."""

import random

import pytest
from pyspark.sql import functions as F

from glossaframe.operators import filters
from glossaframe.scratch import shared_dir
from glossaframe.sources import dialects, readers, row_ids, search, writers


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_load_and_report(workspace, posts_csv):
    workspace.load_table(posts_csv, "posts")
    report = workspace.load_report("posts")
    assert report["n_rows"] == 4 and report["columns"] == ["_rid", "id", "author", "content", "likes"]
    assert report["preview"].count() == 3
    assert [r["_rid"] for r in workspace.table("posts").orderBy("id").collect()] == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="not a valid identifier"):
        workspace.load_table(posts_csv, "bad name")
    with pytest.raises(ValueError, match="unsupported"):
        readers.read_file(workspace.spark, "/tmp/x.xlsx")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        workspace.load_table("/tmp/no/such/file.csv", "nope")


def test_quoted_line_breaks_tabs_and_broken_rows(spark, tmp_path):
    quoted = tmp_path / "q.csv"
    quoted.write_text('id,t\n1,"two\nlines, ""quoted"""\n2,x\n')
    assert [r["t"] for r in readers.load(spark, str(quoted)).orderBy("_rid").collect()] == ['two\nlines, "quoted"', "x"]
    tabs = tmp_path / "t.tsv"
    tabs.write_text("id\tt\n1\ta,b\n")
    assert readers.load(spark, str(tabs)).first()["t"] == "a,b"
    broken = tmp_path / "b.csv"
    broken.write_text("id,t,u\n1,a,b,0\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_file(spark, str(broken), "id int, t string, u string").collect()


def test_json_lines_and_arrays(spark, tmp_path):
    array, rows = tmp_path / "a.json", tmp_path / "l.jsonl"
    array.write_text('[{"a": 1, "b": [1, 2]},\n {"a": 2, "b": []}]')
    rows.write_text('{"a": 1, "b": [1, 2]}\n{"a": 2, "b": []}\n')
    for path in (array, rows):
        assert [(r["_rid"], r["a"], list(r["b"])) for r in readers.load(spark, str(path)).orderBy("_rid").collect()] == [
            (1, 1, [1, 2]), (2, 2, [])]


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_row_ids_over_many_files_and_splits(spark, tmp_path, kind):
    folder = str(tmp_path / "many")
    frame = spark.range(1000).repartitionByRange(7, "id").sortWithinPartitions("id").select("id", F.lit("x" * 50).alias("pad"))
    getattr(frame.write.option("header", True), kind)(folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        loaded = readers.load(spark, folder, schema=frame.schema, fmt=f".{kind}", multiline=False)
        rows = [(r["_rid"], r["id"]) for r in loaded.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(rows) == [(i + 1, i) for i in range(1000)]


def test_parquet_row_ids_shuffle_nothing(spark):
    plan = plan_of(readers.load(spark, "/root/testdata/sf0.001/orders.parquet"))
    assert "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan and "Window" not in plan


def test_ordered_row_ids_with_ties_and_copies(spark):
    frame = spark.range(500).select((F.col("id") % 3).alias("k"), F.lit("same").alias("v"))
    rows = row_ids.number_rows_by(frame, ["k"], partitions=5).collect()
    assert sorted(r["_rid"] for r in rows) == list(range(1, 501))
    assert [r["k"] for r in sorted(rows, key=lambda r: r["_rid"])] == sorted(r["k"] for r in rows)


def test_row_ids_of_any_frame(spark):
    assert sorted(r["_rid"] for r in row_ids.number_rows(spark.range(100).repartition(6)).collect()) == list(range(1, 101))


def test_export(workspace, posts_csv, spark, tmp_path):
    workspace.load_table(posts_csv, "posts")
    out = workspace.export_table('SELECT "author", likes FROM posts WHERE likes > 10;', str(tmp_path / "out"), single_file=True)
    assert spark.read.option("header", True).csv(out).count() == 3
    with pytest.raises(ValueError, match="0 rows"):
        writers.export_csv(workspace.sql("SELECT * FROM posts WHERE likes < 0"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_sql_queries_quote_identifiers_and_raise(workspace, posts_csv):
    workspace.load_table(posts_csv, "posts")
    assert workspace.sql("SELECT COUNT(*) AS n FROM posts").first()["n"] == 4
    rows = workspace.sql('SELECT "author", SUM("likes") AS total FROM posts GROUP BY 1 ORDER BY 2 DESC;').collect()
    assert tuple(rows[0]) == ("jonas", 140)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_NOT_FOUND"):
        workspace.sql("SELECT * FROM nonexistent_table")
    with pytest.raises(ValueError, match="empty"):
        workspace.sql(" ; ")


def test_preview_limits_rows_and_cells(workspace, spark):
    workspace.register("t", spark.range(60).select("id", F.lit("y" * 250).alias("s"), F.lit(None).cast("int").alias("n")), "made")
    shown = workspace.sql_query("SELECT * FROM t ORDER BY id")
    rows = shown.collect()
    assert len(rows) == 50 and len(rows[0]["s"]) == 200 and rows[0]["s"].endswith("...") and rows[0]["n"] == "NULL"
    assert filters.is_truncated(workspace.sql("SELECT * FROM t")) and not filters.is_truncated(workspace.sql("SELECT * FROM t LIMIT 50"))


def test_subset_keeps_the_row_key_and_lineage(workspace, rides_csv):
    workspace.load_table(rides_csv, "posts")
    subset = workspace.materialize_subset("posts", "neg_posts", "tone = 'low'", columns=["content"], write=True)
    assert subset.columns == ["_rid", "content"] and subset.count() == 4
    entry = workspace.tables["neg_posts"]
    assert entry.source == "posts[tone = 'low']" and entry.parent == "posts"
    described = {r["name"]: (r["n_rows"], r["columns"]) for r in workspace.describe().collect()}
    assert described == {"posts": (5, "_rid, id, content, tone"), "neg_posts": (4, "_rid, content")}
    with pytest.raises(ValueError, match="not found"):
        workspace.materialize_subset("posts", "x", "true", columns=["nope"])


def test_drill_down_escapes_values(spark):
    frame = spark.createDataFrame([(1, "it's"), (2, "b")], "_rid bigint, k string")
    assert filters.drill_down(frame, "_rid > 0", "k", "it's").count() == 1
    assert filters.drill_down(frame, None, "k").count() == 2
    with pytest.raises(ValueError, match="parent_column"):
        filters.drill_down(frame, None, None, "x")


def test_filter_reaches_the_scan_before_a_python_stage(spark):
    from glossaframe.operators import enrich, labelers

    orders = readers.load(spark, "/root/testdata/sf0.001/orders.parquet")
    classifier = labelers.BatchClassifier("c", lambda: lambda t: ["x"] * len(t))
    found = enrich.classify_column(orders.where("o_totalprice > 1000"), "o_orderstatus", "c", classifier, dedupe=False)
    encoded = labelers.BatchEncoder("e", lambda: lambda t: [[1.0]] * len(t)).encode(
        orders.where("o_totalprice > 1000").select("_rid", "o_orderstatus"), "o_orderstatus", "v")
    assert "GreaterThan(o_totalprice,1000.0)" in plan_of(encoded)
    assert "o_orderpriority" not in plan_of(encoded)
    assert found.df.where("c = 'x'").count() == orders.where("o_totalprice > 1000").count()


def test_create_table_as_is_registered(workspace, posts_csv):
    workspace.load_table(posts_csv, "posts")
    workspace.create_table_as("totals", "SELECT author, SUM(likes) AS likes FROM posts GROUP BY author")
    assert workspace.table("totals").columns == ["_rid", "author", "likes"]
    assert workspace.sql("SELECT COUNT(*) AS n FROM totals").first()["n"] == 4


def test_grep_rows_and_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.py").write_text("import os\nx = 1  \r\nimport sys")
    (tmp_path / "two.txt").write_text("import nothing\n")
    found = search.grep_files(spark, str(tmp_path), "^import", include="*.py").orderBy("line_no").collect()
    assert [(r["file"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in found] == [("one.py", 1, "import os"), ("one.py", 3, "import sys")]
    assert search.grep_files(spark, str(tmp_path), "^x").first()["line"] == "x = 1"
    assert search.grep_files(spark, str(tmp_path), "import", limit=2).count() == 2
    texts = spark.createDataFrame([(1, "b\nab\n"), (2, None), (3, "")], "id bigint, t string")
    assert [(r["id"], r["line_no"]) for r in search.grep(texts, "b", "id", "t").orderBy("line_no").collect()] == [(1, 1), (1, 2)]


def test_grep_files_over_many_splits(spark, tmp_path):
    """One file in many tasks, with lines of every kind of break: the numbers of the whole file."""
    rng = random.Random(5)
    for name in ("a.txt", "b.txt"):
        parts = [rng.choice(["needle", "hay", "", "hay needle  ", "x" * 50]) + rng.choice(["\n", "\n", "\n", "\r\n", "\x0b", "\u2028", "\n\n"]) for _ in range(3000)]
        (tmp_path / name).write_bytes(("".join(parts) + "the needle").encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = search.grep_files(spark, str(tmp_path), "needle").collect()
        empty = search.grep_files(spark, str(tmp_path), "^$").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for rows, fits in ((found, lambda line: "needle" in line), (empty, lambda line: line == "")):
        expected = [(name, n, line.rstrip()) for name in ("a.txt", "b.txt")
                    for n, line in enumerate((tmp_path / name).read_bytes().decode().splitlines(), 1) if fits(line)]
        assert sorted((r["file"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in rows) == expected
    assert search.grep_files(spark, str(tmp_path), "no such line").count() == 0


@pytest.mark.parametrize("text, dialect", [
    ("a;b;c\n1;x,y;3\n2;z,z;4\n", (";", '"')),
    ("a|b\n1|x;y\n2|\n", ("|", '"')),
    ("a,b\n1,\"x;y\nz;w\"\n2,\"q\"\"r\"\n", (",", '"')),
    ("a;b\n'x;y';2\n'it''s';3\n", (";", "'")),
    ("a\tb\n1\t2\n\n", ("\t", '"')),
    ("one\nsingle, column\n", (",", '"')),
    ("", (",", '"')),
])
def test_dialects(spark, tmp_path, text, dialect):
    path = tmp_path / "x.csv"
    path.write_text(text)
    assert tuple(dialects.detect(spark, str(path))) == dialect


def test_files_load_without_a_delimiter_option(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("k;t\n1;'a;b'\n2;'it''s'\n")
    assert [tuple(r) for r in readers.load(spark, str(path)).orderBy("_rid").collect()] == [(1, 1, "a;b"), (2, 2, "it's")]
    path.write_text("k;t\n1;a;b;c\n2\n")
    with pytest.raises(ValueError, match="sep"):
        readers.load(spark, str(path))
    # records beyond the sample are not looked at, and a record that the sample ends in does not count
    many = ["k|t", *["1|a"] * (dialects.HEAD_LINES - 2), '1|"x', 'y"', "2|b"]
    path.write_text("\n".join(many) + "\n")
    assert readers.read_file(spark, str(path)).count() == dialects.HEAD_LINES
    with pytest.raises(ValueError, match="agree|sep"):
        dialects.detect_in(["a,b", "1"])
    assert dialects.detect_in(["a,b", "1"], cut=True) == (",", '"')


def test_lines_agree_with_python(spark):
    from glossaframe.functions.text import lines

    samples = ["a\r\nb\n\nc d\n", "", "x\n", "x\n" * 3, "\n", "a\x0bb\x85c\x1dd", "no end", "\r\r\n"]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    for r in frame.select("i", lines(F.col("t")).alias("l")).collect():
        assert list(r["l"]) == samples[r["i"]].splitlines()


class Session:
    """Just enough of a session to ask for its settings."""

    def __init__(self, settings, master, made=None):
        self.conf = self.sparkContext = self
        self.settings, self.master, self.made = settings, master, made

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, path):
        self.made = path


def test_shared_folder_is_the_one_the_session_names(tmp_path):
    named = Session({"spark.checkpoint.dir": "hdfs://shared/folder/"}, "yarn", "elsewhere")
    assert shared_dir(named) == "hdfs://shared/folder"
    assert shared_dir(Session({}, "yarn", "hdfs://set/earlier")) == "hdfs://set/earlier"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session({}, "yarn"))
    assert "glossaframe-" in shared_dir(Session({}, "local[2]"))
