"""A keyed table changed in place: the rows of the batch forms, and no bucket written that nothing touched."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators.keyed import lww_upsert, snapshot_reconcile
from tidemark.session import scratch_dir
from tidemark.sources import kept

SCHEMA = "k long, part string, v long, at long"


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.fixture
def store(spark):
    rows = made(spark, [(k, "p", k * k, 1) for k in range(300)] + [(None, None, None, 1)])
    return kept.create(rows, ["k", "part"], scratch_dir(spark, "kept"), at="at", buckets=32), rows


def test_equal_snapshots_write_nothing(store):
    table, rows = store
    assert same(table.rows(), rows) and table.version() == 0
    assert kept.reconcile(table, rows.withColumn("at", F.lit(2).cast("long")), ["v"], "at") == set()
    assert table.version() == 0 and same(table.rows(), rows)


def test_only_touched_buckets_are_written(spark, store):
    table, rows = store
    now = rows.where("k <> 7 OR k IS NULL").withColumn("v", F.when(F.col("k") == 9, -1).otherwise(F.col("v"))).withColumn("at", F.lit(2).cast("long"))
    now = now.unionByName(made(spark, [(1000, "p", 5, 2)]))
    want_buckets = {r[0] for r in now.where("k IN (7, 9, 1000)").unionByName(rows.where("k = 7")).select(table.bucket()).collect()}
    before = {r[kept.BUCKET]: r["part"] for r in table.manifest()}
    want = snapshot_reconcile(rows, now, table.keys, ["v"], "at").select("k", "part", "v", "at")
    wanted = sorted(map(tuple, want.collect()), key=repr)
    assert kept.reconcile(table, now, ["v"], "at") == want_buckets and 1 <= len(want_buckets) <= 3
    after = {r[kept.BUCKET]: r["part"] for r in table.manifest()}
    assert {b for b in after if before.get(b) != after[b]} == want_buckets
    # Equal rows keep their poll time in every bucket, written or not.
    assert sorted(map(tuple, table.rows().collect()), key=repr) == wanted
    assert same(table.rows(version=0), rows)


def test_upserts_and_deletes(spark, store):
    table, rows = store
    updates = made(spark, [(5, "p", 1, 2), (None, None, 4, 2), (2000, "q", 6, 2)])
    change = {"v": F.coalesce(F.col("old.v"), F.lit(0)) + F.col("new.v")}
    assert len(kept.upsert(table, updates, change)) <= 3
    want = lww_upsert(rows, updates, table.keys, change)
    assert same(table.rows(), want)
    kept.delete(table, updates.select("part", "k"))
    assert same(table.rows(), rows.where("k <> 5"))
    kept.delete(table, table.rows())
    assert table.rows().count() == 0 and table.manifest() == []
    kept.upsert(table, updates, change)
    assert same(table.rows(), updates)


def test_a_job_that_dies_leaves_the_table_as_it_was(store):
    table, rows = store
    with pytest.raises(Exception, match="stop here"):
        kept.change(table, {1, 2, 3}, lambda old: old.withColumn("v", F.raise_error(F.lit("stop here")).cast("long")))
    assert table.version() == 0 and same(table.rows(), rows)


def test_an_empty_table(spark):
    none = made(spark, [])
    table = kept.create(none, ["k"], scratch_dir(spark, "kept"), at="at", buckets=4)
    assert table.rows().count() == 0 and kept.reconcile(table, none, ["v"], "at") == set()
    rows = made(spark, [(1, "a", 2, 3)])
    assert len(kept.reconcile(table, rows, ["v"], "at")) == 1 and same(table.rows(), rows)
    with pytest.raises(ValueError):
        kept.create(rows.withColumn(kept.BUCKET, F.lit(1)), ["k"], scratch_dir(spark, "kept"))
