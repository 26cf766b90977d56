"""State of the streaming forms in Spark's store: late rows, expiry, restarts, and the changes of a running aggregate."""

import decimal
import time

from pyspark.sql import functions as F

from tidemark.streaming import changelog, stateful

TABLE = "k int, seq bigint, s string"


def feed(spark, folder, rows, schema=TABLE):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_late_rows_have_an_output_of_their_own(spark, tmp_path):
    end = F.col("s") == "end"
    for rows in ([(1, 5, "a"), (2, 1, "end"), (2, 2, "x")], [(1, 4, "z"), (1, 6, "b"), (2, 3, "y"), (1, None, "n"), (3, 9, "q")]):
        stream = feed(spark, f"{tmp_path}/in", rows)
        stateful.take_until_terminal_stream(stream, ["k"], "seq", end, f"{tmp_path}/c", f"{tmp_path}/out").awaitTermination()
    assert values(spark.read.parquet(f"{tmp_path}/out"), "k", "seq", "s") == [(1, 5, "a"), (1, 6, "b"), (2, 1, "end"), (3, 9, "q")]
    late = stateful.late_rows(spark, f"{tmp_path}/c")
    assert values(late, "k", "seq", "s", "_behind", "batch_id") == [(1, 4, "z", 5, 1), (1, None, "n", 5, 1)]


def test_values_pass_as_they_are(spark, tmp_path):
    """NaN, nulls, large longs and nested columns come out unchanged, and NaN after NaN is no change."""
    schema = "k int, seq bigint, d double, n bigint, m struct<a:array<int>>"
    rows = [(1, 1, float("nan"), 2**62 + 1, ([1, None],)), (1, 2, float("nan"), None, None), (1, 3, None, 7, None), (None, 1, 0.5, None, (None,))]
    stream = feed(spark, f"{tmp_path}/in", rows, schema)
    stateful.changes_stream(stream, ["k"], "seq", ["d"], f"{tmp_path}/c", f"{tmp_path}/out").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    assert got.exceptAll(spark.createDataFrame([rows[0], rows[2], rows[3]], schema)).count() == 0 and got.count() == 3


def test_ended_keys_expire(spark, tmp_path):
    """After its time to live an ended key is unknown again; the state holds nothing of it."""
    end, stream = F.col("s") == "end", feed(spark, f"{tmp_path}/in", [(1, 5, "end"), (1, 6, "after")])
    query = stateful.take_until_terminal_stream(stream, ["k"], "seq", end, f"{tmp_path}/c", f"{tmp_path}/out", ttl_ms=2000)
    try:
        for _ in range(120):
            if (tmp_path / "out").exists() and query.lastProgress and len(list((tmp_path / "c" / "progress" / "commits").glob("[0-9]*"))) > 0:
                break
            time.sleep(0.5)
        time.sleep(4)
        feed(spark, f"{tmp_path}/in", [(1, 1, "again")])
        for _ in range(120):
            if spark.read.parquet(f"{tmp_path}/out").count() > 1:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert values(spark.read.parquet(f"{tmp_path}/out"), "k", "seq", "s") == [(1, 1, "again"), (1, 5, "end")]


def test_changes_of_a_running_aggregate(spark, tmp_path):
    schema = "k string, v bigint, sign int"
    batches = [
        [("a", 1, 1), ("a", 2, 1), ("b", 5, 1), (None, 3, 1)],
        [("a", 4, 1), ("b", 5, -1), ("c", None, 1), ("d", 1, 1), ("d", 1, -1)],
        [("b", 7, 1), ("c", 0, 1), ("a", 1, 1), ("a", 1, -1)],
    ]
    for rows in batches:  # every batch a new start of the query
        stream = feed(spark, f"{tmp_path}/in", rows, schema)
        query = changelog.running_changelog(stream, ["k"], {"total": F.col("v")}, f"{tmp_path}/c", f"{tmp_path}/out", F.col("sign"))
        query.awaitTermination()
    log = spark.read.parquet(f"{tmp_path}/out")
    d = decimal.Decimal
    assert values(log, "batch_id", "op", "k", "total") == sorted(
        [(0, "+I", "a", d(3)), (0, "+I", "b", d(5)), (0, "+I", None, d(3)), (1, "-U", "a", d(3)), (1, "+U", "a", d(7)), (1, "-D", "b", d(5)), (1, "+I", "c", d(0)), (2, "+I", "b", d(7))],
        key=lambda r: repr((*r[:3], r[3].quantize(d("0.000001")))),
    )
    every = spark.read.schema(schema).parquet(f"{tmp_path}/in")
    whole = every.groupBy("k").agg(F.sum("sign").alias("n"), F.sum(F.coalesce(F.col("v"), F.lit(0)) * F.col("sign")).alias("total")).where("n <> 0")
    assert values(changelog.folded(spark, f"{tmp_path}/out", ["k"]), "k", "total") == values(whole.select("k", F.col("total").cast("decimal(38,6)").alias("total")), "k", "total")
