import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF_SMALL = "/root/testdata/sf0.001"

LONG = "Wide words wander. " * 4000
EDGE = [
    (1, "A first line of words.\nAnother line here.\n", "x"),
    (2, None, "x"),
    (3, "", "y"),
    (4, "A first line of words.\nAnother line here.\n", "x"),
    (4, "A first line of words.\nAnother line here.\n", "x"),
    (None, "password: hunter2hunter2 and\ttabs  and  doubled  spaces \n\n end ", None),
    (7, " \t\n ", "z"),
    (8, LONG, "x"),
    (9, "ünïcödé \x85 odd\x1cblank space \U0001f600\U0001f600 中文字 <|endoftext|> don't 12345 'S", "x"),
    (10, "word", "x"),
    (11, "zero\0byte and  two blanks\r\n\r\nnext", "x"),
    (12, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa!!!!!!!!!!!!!!!!!!!!!!", "x"),
]
# extra columns, some of them named as columns that operators add
EDGE_SCHEMA = "doc_id bigint, text string, id string, n_chars bigint, h string, fp string, lines string"


@pytest.fixture(scope="session")
def spark():
    from glossaframe import local_session

    return local_session(8, shuffle_partitions=4, app="glossaframe-tests", memory="4g")


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame([(i, t, s, len(t or ""), s, s, s) for i, t, s in EDGE], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
