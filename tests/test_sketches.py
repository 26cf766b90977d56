"""Sketches that are merged, stored and compared."""

from pyspark.sql import functions as F

from tidemark.operators import sketches
from tidemark.session import scratch_dir


def test_merged_sketches_count_each_value_once(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("poll"), F.lit("c").alias("cluster"), (F.col("id") % 40_000).alias("value"))
    rows = rows.unionByName(rows).unionByName(spark.sql("SELECT 0L AS poll, 'empty' AS cluster, CAST(NULL AS BIGINT) AS value"))
    folder = scratch_dir(spark, "sketches")
    sketches.distinct_sketches(rows, ["cluster", "poll"], "value").write.parquet(folder)
    got = sketches.merged(spark.read.parquet(folder), ["cluster"]).select("cluster", "n_rows", sketches.estimate().alias("n"))
    found = {r.cluster: (r.n_rows, r.n) for r in got.collect()}
    assert found["empty"] == (1, 0) and found["c"][0] == 120_000
    assert abs(found["c"][1] - 40_000) <= 0.05 * 40_000


def test_turnover_of_two_polls(spark):
    old = spark.sql("SELECT * FROM VALUES ('a', 1), ('a', 2), ('a', 2), ('a', NULL), ('gone', 7) AS t(k, v)")
    new = spark.sql("SELECT * FROM VALUES ('a', 2), ('a', 3), ('a', 4), ('fresh', 8), ('fresh', 9) AS t(k, v)")
    told = sketches.turnover(*[sketches.distinct_sketches(p, ["k"], "v") for p in (old, new)], ["k"])
    found = {r.k: tuple(r)[1:] for r in told.collect()}
    assert found == {"a": (2, 3, 1, 2, 1), "gone": (1, 0, 0, 0, 1), "fresh": (0, 2, 0, 2, 0)}
