"""SQL jobs, sinks, JSON rows, change rows and result reads on small tables."""


import pytest
from pyspark.sql import functions as F

from tidemark.operators import results
from tidemark.plans.sqljob import is_sink, run_sql_job
from tidemark.sources import sinks
from tidemark.sources.tables import Field, datagen, inline_rows

ORDERS = [
    Field("order_number", "bigint"),
    Field("price", "decimal(32,2)"),
    Field("buyer", "row", fields=(Field("first_name", "string"), Field("last_name", "string"))),
    Field("mset", "multiset"),
    Field("order_time", "timestamp"),
]


def test_failure_cancels_the_rest(spark):
    datagen(spark, ORDERS, 20).createOrReplaceTempView("Orders")
    statements = ["SELECT * FROM Orders", "EXPLAIN SELECT * FROM Orders", "SELECT * FROM", "SHOW TABLES", "SHOW CATALOGS"]
    last, log = run_sql_job(spark, statements)
    assert [r.status for r in log.orderBy("ordinal").collect()] == ["Finish", "Finish", "Fail", "Cancel", "Cancel"]
    assert log.where("status = 'Fail'").first().error and last.count() == 1


def test_failure_on_the_rows_cancels_the_rest(spark):
    bad = "SELECT CAST(s AS INT) AS n FROM VALUES ('1'), ('x') AS t(s)"
    before = spark.conf.get("spark.sql.ansi.enabled")
    conf = {"spark.sql.ansi.enabled": "true"}
    try:
        last, log = run_sql_job(spark, ["SELECT 1 AS x", bad, "SELECT 2 AS x"], conf=conf)
        assert [r.status for r in log.orderBy("ordinal").collect()] == ["Finish", "Fail", "Cancel"] and last.first().x == 1
        _, log = run_sql_job(spark, ["SHOW TABLES", bad], conf=conf)
        assert [r.status for r in log.orderBy("ordinal").collect()] == ["Finish", "Fail"]
        _, log = run_sql_job(spark, ["SHOW TABLES", bad], conf=conf, run_last=False)
        assert [r.status for r in log.orderBy("ordinal").collect()] == ["Finish", "Run"]
        _, log = run_sql_job(spark, ["SELECT 1 AS x", "SHOW TABLES"], run_last=False)
        assert [r.status for r in log.orderBy("ordinal").collect()] == ["Finish", "Finish"]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_set_and_reset(spark):
    last, log = run_sql_job(
        spark, ["SET tidemark.demo = 5", "SET tidemark.demo", "RESET tidemark.demo", "SELECT 1 AS x;"]
    )
    assert log.where("status <> 'Finish'").count() == 0 and last.first().x == 1
    assert spark.conf.get("tidemark.demo", None) is None


@pytest.mark.parametrize(
    "text, sink",
    [("insert into t select 1", True), ("-- note\n INSERT OVERWRITE t SELECT 1", True), ("select 'insert into'", False),
     ("create table t as select 1", True), ("create temporary view v as select 1", False), ("create table t (a int)", False),
     ("with x as (select 1) insert into t select * from x", True), ("merge into t using s on a=b when matched then delete", True)],
)
def test_sink_statements(text, sink):
    assert is_sink(text) is sink


def test_sinks_are_gated(spark, tmp_path):
    df = inline_rows(spark, [("Bob", 1), ("Alice", 2)], ["name", "n"])
    with pytest.raises(sinks.SinkNotAllowed):
        sinks.insert_select(df, f"{tmp_path}/t")
    _, log = run_sql_job(spark, ["INSERT INTO nowhere SELECT 1"])
    assert log.first().status == "Fail" and "not allowed" in log.first().error
    sinks.insert_select(df.where(F.col("name").like("%o%")), f"{tmp_path}/t", allow_sink=True)
    assert [r.name for r in spark.read.parquet(f"{tmp_path}/t").collect()] == ["Bob"]


def test_datagen(spark):
    spec = [*ORDERS, Field("age", "int", 10, 20, null_rate=0.5)]
    rows = datagen(spark, spec, 1000, seed=3)
    assert rows.schema["price"].dataType.simpleString() == "decimal(32,2)"
    again = datagen(spark, spec, 1000, seed=3).drop("mset")
    assert rows.repartition(7).drop("mset").exceptAll(again).count() == 0
    low, high, n = rows.agg(F.min("age"), F.max("age"), F.count("age")).first()
    assert 10 <= low <= high < 20 and 400 < n < 600


def test_rows_to_json(spark):
    row = spark.sql(
        """SELECT 1 AS a, CAST(NULL AS STRING) AS b, named_struct('x', 1, 'y', CAST(NULL AS INT)) AS c,
           CAST(12.50 AS DECIMAL(32, 2)) AS d, TIMESTAMP_NTZ '2024-01-02 03:04:05.120' AS e,
           TIMESTAMP '2024-01-02 03:04:05' AS f, map('k', 2) AS g, array(true, null) AS h, 'q"' AS i"""
    )
    assert results.rows_to_json(row).first().fields == (
        '[1,null,{"x":1,"y":null},12.50,"2024-01-02T03:04:05.12","2024-01-02T03:04:05Z",{"k":2},[true,null],"q\\""]'
    )


def test_changelog(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "c"), (4, "d"), (None, "m")], "k int, v string")
    got = {tuple(r) for r in results.changelog(old, new, ["k"]).collect()}
    assert got == {
        ("-U", 2, "b"), ("+U", 2, "c"), ("-D", 3, None), ("+I", 4, "d"), ("-U", None, "n"), ("+U", None, "m"),
    }


def test_offsets_and_drain(spark):
    df = spark.range(100).withColumnRenamed("id", "seq")
    chunk = results.result_offset_chunk(df, "seq", 95, 10).collect()
    assert [r.seq for r in chunk] == [96, 97, 98, 99] and {r.last_offset for r in chunk} == {99}
    seen = [r.seq for rows, _ in results.drain(df, "seq", 30) for r in rows.collect()]
    assert sorted(seen) == list(range(100))


def test_handles(spark):
    frames = spark.createDataFrame([("a", True), ("b", False)], "handle_id string, has_result boolean")
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "handle_id string, seq int")
    assert results.result_of(frames, rows, "a").count() == 2
    assert results.result_of(frames, rows, "b") is None
    with pytest.raises(KeyError):
        results.result_of(frames, rows, "c")
    page = results.plain_result_page(rows).first()
    assert (page.total_pages, page.page_index, page.has_next_page) == (1, 1, False)


def test_imports_need_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


