"""Interval joins of two streams over several micro-batches, and tails that are followed."""

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import joins, tail
from tidemark.streaming.windows import run_append

SCHEMA = "k string, at timestamp, id long"


def put(spark, folder, rows):
    made = spark.createDataFrame([(k, s, i) for k, s, i in rows], "k string, s long, id long")
    made.select("k", F.timestamp_seconds("s").alias("at"), "id").coalesce(1).write.mode("append").parquet(folder)


def pairs(spark, base, how, lots, low=-10, high=60):
    for left, right in lots:
        put(spark, f"{base}/l", left)
        put(spark, f"{base}/r", right)
        sides = [spark.readStream.schema(SCHEMA).parquet(f"{base}/{s}") for s in "lr"]
        met = joins.interval_join(*sides, ["k"], ("at", "at"), low, high, ("100 seconds", "100 seconds"), how)
        out = met.select(F.col("left.id").alias("l"), F.col("right.id").alias("r"))
        run_append(out, f"{base}/progress", f"{base}/out").awaitTermination()
    return sorted(map(tuple, spark.read.schema("l long, r long").parquet(f"{base}/out").collect()), key=repr)


FAR = 100_000
LOTS = [
    ([("a", 1000, 1), ("a", 1069, 2), (None, 1000, 3), ("b", 970, 4), ("b", -30, 8)], [("a", 990, 1), ("a", 989, 2), ("b", 1030, 5), ("b", 1031, 6), ("b", -30, 12), (None, 1000, 7)]),
    ([("c", 1100, 5)], [("a", 1060, 3), ("a", 1061, 4), ("c", 1160, 8), ("c", 1160, 9)]),
    ([("z", FAR, 6)], [("z", FAR + 500, 10)]),
    ([("a", 1000, 7)], [("a", 1010, 11)]),  # too late for either watermark
]
MET = [(1, 1), (1, 3), (2, 3), (2, 4), (5, 8), (5, 9)]


def test_inner_pairs_meet_once_across_batches(spark, tmp_path):
    # A watermark begins at 1970, so "b" at -30 is late even in the first batch.
    assert pairs(spark, tmp_path, "inner", LOTS) == sorted([*MET, (4, 5)], key=repr)


def test_outer_rows_come_once_nothing_can_meet_them(spark, tmp_path):
    got = pairs(spark, tmp_path, "left_outer", LOTS[:3])
    assert got == sorted([*MET, (4, 5), (3, None)], key=repr)


def test_wrong_intervals_are_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    for low, high, how in ((1, 0, "inner"), (0, 1, "full_outer")):
        with pytest.raises(ValueError):
            joins.interval_join(df, df, ["k"], ("at", "at"), low, high, ("1 second", "1 second"), how)


def follow(spark, base, tail_lines=2):
    tail.tail_then_follow(spark, f"{base}/in", SCHEMA, "k", ["id"], tail_lines, f"{base}/out").awaitTermination()
    return sorted(r.id for r in tail.followed(spark, SCHEMA, f"{base}/out").collect())


def test_tail_then_follow_over_restarts(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [("a", 1, 1), ("a", 1, 2), ("b", 1, 4)])
    put(spark, f"{tmp_path}/in", [("a", 1, 3)])
    assert follow(spark, tmp_path) == [2, 3, 4]
    assert follow(spark, tmp_path) == [2, 3, 4]
    put(spark, f"{tmp_path}/in", [("a", 1, k) for k in (5, 6, 7)])
    put(spark, f"{tmp_path}/in", [("c", 1, 8)])
    assert follow(spark, tmp_path) == [2, 3, 4, 5, 6, 7, 8]
    assert follow(spark, tmp_path) == [2, 3, 4, 5, 6, 7, 8]


def test_lines_added_between_cursor_and_tail_come_once(spark, tmp_path, monkeypatch):
    put(spark, f"{tmp_path}/in", [("a", 1, 1), ("a", 1, 2), ("a", 1, 3)])
    inner = tail.log_lines

    def late(*args, **more):
        put(spark, f"{tmp_path}/in", [("a", 1, 4), ("a", 1, 5)])
        return inner(*args, **more)

    monkeypatch.setattr(tail, "log_lines", late)
    assert follow(spark, tmp_path, 1) == [3, 4, 5]


def test_nothing_there_yet(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [])
    assert follow(spark, tmp_path) == []
    put(spark, f"{tmp_path}/in", [("a", 1, k) for k in range(5)])
    assert follow(spark, tmp_path) == [0, 1, 2, 3, 4]
