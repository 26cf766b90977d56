"""Every registered query against its SQL on DuckDB; TIDEMARK_SF picks the scale."""

import os

import pytest

import __spark_entry__
from tests.compare import connect, difference

FOLDER = f"/root/testdata/sf{os.environ.get('TIDEMARK_SF', '0.001')}"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, SQL[name]) is None


def test_file_manifest(spark):
    rows = QUERIES["src_file_manifest"](spark, FOLDER).collect()
    assert {r.path: r.size for r in rows} == {n: os.path.getsize(f"{FOLDER}/{n}") for n in os.listdir(FOLDER)}


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["l_orderkey", "l_linenumber", "fields"]
    assert rows.count() > 0
