"""SQL jobs: kinds of statements by Spark's parser, sessions of their own, and one list of statements run over tables and over streams."""

import uuid

import pytest

from tidemark.plans.sqljob import run_sql_job, run_streaming_job, statement_kind
from tidemark.sources.tables import table, table_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "text, kind",
    [
        ("CREATE TABLE t AS (SELECT 1)", "sink"),
        ("CREATE TABLE t AS VALUES (1)", "sink"),
        ("CREATE TABLE t USING parquet AS TABLE x", "sink"),
        ("REPLACE TABLE t AS SELECT 1", "sink"),
        ("LOAD DATA INPATH '/x' INTO TABLE t", "sink"),
        ("FROM a INSERT INTO t SELECT * INSERT INTO u SELECT *", "sink"),
        ("INSERT OVERWRITE DIRECTORY '/x' USING parquet SELECT 1", "sink"),
        ("BEGIN INSERT INTO t SELECT 1; END", "sink"),
        ("EXECUTE IMMEDIATE 'insert into t select 1'", "sink"),
        ("WITH q AS (SELECT 'insert into t' AS s) SELECT * FROM q", "query"),
        ("-- insert into t\nSELECT 1 /* create table t as select 1 */", "query"),
        ("TABLE t", "query"),
        ("VALUES (1)", "query"),
        ("SET a = 1", "command"),
        ("RESET", "command"),
        ("EXPLAIN INSERT INTO t SELECT 1", "command"),
        ("CREATE TABLE t (a INT)", "command"),
        ("SHOW TABLES;", "command"),
        ("DROP TABLE t", "command"),
    ],
)
def test_kinds(spark, text, kind):
    assert statement_kind(spark, text) == kind


def test_nothing_outlives_a_job_but_its_tables(spark):
    spark.range(3).createOrReplaceTempView("of_the_caller")
    statements = [
        "SET spark.sql.shuffle.partitions = 7", "SET tidemark.own = 1", "CREATE TEMPORARY VIEW of_the_job AS SELECT * FROM of_the_caller",
        "CREATE OR REPLACE TEMPORARY VIEW of_the_caller AS SELECT 9 AS id", "CREATE TEMPORARY FUNCTION twice(x INT) RETURNS INT RETURN 2 * x",
        "SELECT sum(twice(CAST(id AS INT))) AS s FROM of_the_job",
    ]
    before = dict(spark.sparkContext.getConf().getAll()) | {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.ansi.enabled")}
    last, log = run_sql_job(spark, statements, conf={"spark.sql.ansi.enabled": "false", "tidemark.given": "2"})
    assert log.where("status <> 'Finish'").count() == 0 and last.first().s == 18
    after = dict(spark.sparkContext.getConf().getAll()) | {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.ansi.enabled")}
    assert before == after and spark.conf.get("tidemark.own", None) is None and spark.conf.get("tidemark.given", None) is None
    assert not spark.catalog.tableExists("of_the_job") and spark.table("of_the_caller").count() == 3
    assert "twice" not in {f.name for f in spark.catalog.listFunctions(pattern="twice")}


def _list(name: str, folder: str) -> list[str]:
    return [
        f"CREATE TABLE {name}_big (event_id BIGINT, value DOUBLE) USING parquet LOCATION '{folder}/{name}/big'",
        f"CREATE TABLE {name}_kinds (kind STRING, n BIGINT) USING parquet LOCATION '{folder}/{name}/kinds'",
        "CREATE TEMPORARY VIEW chosen AS SELECT * FROM arriving WHERE value > 50",
        f"WITH big AS (SELECT event_id, value FROM chosen) INSERT INTO {name}_big SELECT * FROM big",
        f"INSERT INTO {name}_kinds SELECT event_type, count(*) FROM arriving GROUP BY event_type",
        "SELECT event_type, count(*) AS n FROM chosen GROUP BY event_type",
        f"SELECT kind, n, (SELECT count(*) FROM {name}_big) AS big FROM {name}_kinds",
    ]


def test_one_list_in_both_modes(spark, tmp_path):
    name = f"t{uuid.uuid4().hex[:8]}"
    table(spark, SF, "events").createOrReplaceTempView("arriving")
    batch, batch_log = run_sql_job(spark, _list(f"{name}b", tmp_path), allow_sink=True)
    streams = {"arriving": table_stream(spark, SF, "events")}
    stream, stream_log = run_streaming_job(spark, _list(f"{name}s", tmp_path), streams, f"{tmp_path}/progress", allow_sink=True)
    try:
        assert [r.status for r in batch_log.orderBy("ordinal").collect()] == ["Finish"] * 7
        assert [(r.status, r.error) for r in stream_log.orderBy("ordinal").collect()] == [("Finish", None)] * 7
        assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect())) and stream.count() > 0
        read = [spark.read.parquet(f"{tmp_path}/{name}{m}/big") for m in "bs"]
        assert read[0].count() > 0 and read[0].exceptAll(read[1]).count() == 0 and read[0].count() == read[1].count()
        # The same list again over the same progress: what has been read is not written twice.
        again = _list(f"{name}s", tmp_path)[2:]
        _, log = run_streaming_job(spark, ["SHOW TABLES", "SHOW TABLES", *again], streams, f"{tmp_path}/progress", allow_sink=True)
        assert log.where("status <> 'Finish'").count() == 0 and spark.read.parquet(f"{tmp_path}/{name}s/big").count() == read[0].count()
    finally:
        for mode in "bs":
            spark.sql(f"DROP TABLE IF EXISTS {name}{mode}_big")
            spark.sql(f"DROP TABLE IF EXISTS {name}{mode}_kinds")


def test_failures_and_the_gate_over_streams(spark, tmp_path):
    streams = {"arriving": table_stream(spark, SF, "events")}
    _, log = run_streaming_job(spark, ["SELECT event_id FROM arriving", "INSERT INTO t SELECT * FROM arriving", "SHOW TABLES"], streams, f"{tmp_path}/a")
    assert [r.status for r in log.orderBy("ordinal").collect()] == ["Finish", "Fail", "Cancel"] and "not allowed" in log.where("ordinal = 2").first().error
    bad = ["SET spark.sql.ansi.enabled = true", "SELECT CAST(event_type AS INT) FROM arriving", "SHOW TABLES"]
    _, log = run_streaming_job(spark, bad, streams, f"{tmp_path}/b")
    assert [r.status for r in log.orderBy("ordinal").collect()] == ["Finish", "Fail", "Cancel"]
    assert not spark.catalog.tableExists("arriving") or not spark.table("arriving").isStreaming
