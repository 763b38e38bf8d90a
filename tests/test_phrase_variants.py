from pyspark.sql import functions as F

from glossaframe.operators import mining

SPELLINGS = [f"{a} {b}" for a in ("late train", "Late train", "LATE train", "Late Train") for b in ("again", "again!", "AGAIN")]


def test_every_variant_is_returned(spark):
    posts = spark.createDataFrame(list(enumerate(SPELLINGS + SPELLINGS[:1])), "_rid bigint, content string")
    found = {r.label: r for r in mining.mine_phrases(posts, "content").collect()}
    assert list(found["late train again"].variants) == [SPELLINGS[0], *sorted(SPELLINGS[1:])]
    cut = {r.label: r for r in mining.mine_phrases(posts, "content", max_variants=2).collect()}
    assert list(cut["late train again"].variants) == [SPELLINGS[0], min(SPELLINGS[1:])]
    rows = mining.mine_phrase_variants(posts, "content").where(F.col("label") == "late train again").collect()
    assert {(r.support, r.variant, r.n) for r in rows} == {(13, s, 1 + (s == SPELLINGS[0])) for s in SPELLINGS}
    assert mining.mine_phrase_variants(posts.where("_rid < 1"), "content").isEmpty()
