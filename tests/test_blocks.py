"""Quantile blocks, limits before the shuffle, and rows without an order value."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import results, status
from tidemark.plans import ordered
from tidemark.sources import files


@pytest.fixture
def bunched(spark):
    """100,000 ids close together near the end of the range and a stray 0; one key has half of all rows."""
    rows = spark.range(100_000).select((F.col("id") + 1_700_000_000_000_000_000).alias("seq"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    return rows.unionByName(spark.createDataFrame([(0, 0)], "seq long, k long")).withColumn("s", (F.col("seq") / 7).cast("long") % 3)


def test_blocks_hold_about_as_many_rows(bunched, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 1000)
    per = bunched.groupBy(ordered.block_of(bunched, "seq").alias("b")).agg(F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"))
    rows = per.orderBy("b").collect()
    mean = 100_001 / len(rows)
    assert 95 <= len(rows) <= 101 and max(r.n for r in rows) <= 2 * mean
    assert all(a.high < b.low for a, b in zip(rows, rows[1:], strict=False))


def test_scans_do_not_depend_on_the_blocks(bunched, monkeypatch):
    want = status.changes(bunched, ["k"], "seq", ["s"]).agg(F.count("*"), F.sum(F.xxhash64("k", "seq", "s").cast("decimal(20,0)"))).first()
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 5000)
    got = status.changes(bunched, ["k"], "seq", ["s"]).agg(F.count("*"), F.sum(F.xxhash64("k", "seq", "s").cast("decimal(20,0)"))).first()
    assert tuple(want) == tuple(got) and want[0] > 0


def test_limit_before_the_shuffle(bunched):
    for kept in (results.retain_last(bunched, "seq", 20, ["k"]), results.retain_first(bunched, "seq", 20, ["k"]), files.log_lines(bunched, "k", ["seq"], tail_lines=40)):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2 and plan.index("Exchange") < plan.rindex("WindowGroupLimit")


@pytest.fixture
def gaps(spark):
    """Some rows without an order value."""
    return spark.createDataFrame([(k % 3, None if k % 10 == 0 else k, f"r{k}") for k in range(200)], "k int, seq long, name string").repartition(4)


@pytest.mark.parametrize("n", [0, 1, 3, 30, 60, 190, 500])
def test_both_ways_keep_rows_without_an_order_value(gaps, monkeypatch, n):
    def found(how, keys, **small):
        for name, value in small.items():
            monkeypatch.setattr(results, name, value)
        # Rows without a value are equal in order, so that only their number is certain.
        return sorted((r.k, r.seq if r.seq is not None else -1) if keys else r.seq if r.seq is not None else -1 for r in how(gaps, "seq", n, keys).collect())

    for how in (results.retain_first, results.retain_last):
        assert found(how, None, SHALLOW_ROWS=10_000) == found(how, None, SHALLOW_ROWS=-1) and len(found(how, None)) == min(n, 200)
        assert found(how, ["k"], GROUP_LIMIT=1000) == found(how, ["k"], GROUP_LIMIT=-1)


def test_pages_reach_rows_without_an_order_value(gaps, monkeypatch):
    pages = {}
    for limit in (10_000, -1):
        monkeypatch.setattr(results, "SHALLOW_ROWS", limit)
        pages[limit] = [sorted(r.seq or -1 for r in results.result_page(gaps, "seq", p, 30).collect()) for p in range(1, 8)]
    assert pages[10_000] == pages[-1] and sum(map(len, pages[-1])) == 200
