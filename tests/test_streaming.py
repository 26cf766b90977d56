"""Streaming forms over several time-ordered files, one per batch, against the batch forms."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import keyed, results, status
from tidemark.queries.keyed import as_change_events
from tidemark.sources import sinks
from tidemark.sources.files import follow_lines
from tidemark.sources.tables import Field, datagen_stream
from tidemark.streaming import stateful

COLS = ["event_id", "user_id", "event_type", "value", "props"]


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(*COLS)


@pytest.fixture
def folder(events, tmp_path):
    """Three files; the first is there at once, the others come with ``add``."""
    n = events.count()

    def add(i):
        part = events.where(F.col("event_id").between(i * n // 3, (i + 1) * n // 3 - 1))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    add(0)
    return f"{tmp_path}/in", add


def _stream(spark, path, events):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run_with_restarts(start, add):
    for i in range(3):
        if i:
            add(i)
        start().awaitTermination()


def test_changes(spark, events, folder, tmp_path):
    path, add = folder
    args = (["user_id"], "event_id", ["event_type"])
    _run_with_restarts(
        lambda: stateful.changes_stream(
            _stream(spark, path, events), *args, f"{tmp_path}/c", f"{tmp_path}/out", block_rows=97
        ),
        add,
    )
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    want = status.changes(events, *args)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_take_until_terminal(spark, events, folder, tmp_path):
    path, add = folder
    end = F.col("event_type") == "purchase"
    _run_with_restarts(
        lambda: stateful.take_until_terminal_stream(
            _stream(spark, path, events), ["user_id"], "event_id", end, f"{tmp_path}/c", f"{tmp_path}/out", 97
        ),
        add,
    )
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch_id")
    want = status.take_until_terminal(events, ["user_id"], "event_id", end)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_retain_last(spark, events, folder, tmp_path):
    path, add = folder
    _run_with_restarts(
        lambda: stateful.retain_last_stream(
            _stream(spark, path, events), ["user_id"], "event_id", 5, f"{tmp_path}/c", 97
        ),
        add,
    )
    got = stateful.remembered(spark, f"{tmp_path}/c")
    want = results.retain_last(events, "event_id", 5, ["user_id"])
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_apply_change_events(spark, events, folder, tmp_path):
    path, add = folder
    args = (["cluster_id"], "name", "kind", "event_id")
    _run_with_restarts(
        lambda: stateful.apply_change_events_stream(
            as_change_events(_stream(spark, path, events)), *args, f"{tmp_path}/c"
        ),
        add,
    )
    got = keyed.apply_change_events(stateful.remembered(spark, f"{tmp_path}/c"), *args)
    want = keyed.apply_change_events(as_change_events(events), *args)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_late_rows_are_left_out(spark, tmp_path):
    def feed(rows):
        spark.createDataFrame(rows, "k int, seq bigint, s string").coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/in"
        )
        stream = spark.readStream.schema("k int, seq bigint, s string").parquet(f"{tmp_path}/in")
        stateful.changes_stream(
            stream, ["k"], "seq", ["s"], f"{tmp_path}/c", f"{tmp_path}/out"
        ).awaitTermination()

    feed([(1, 5, "a"), (1, 6, "b")])
    feed([(1, 4, "z"), (1, 7, "b"), (1, 8, "c")])
    got = sorted(tuple(r)[:3] for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 5, "a"), (1, 6, "b"), (1, 8, "c")]


def test_statement_set(spark, events, folder, tmp_path):
    path, add = folder
    inserts = [
        (f"{tmp_path}/a", lambda s: s.where("event_type = 'purchase'")),
        (f"{tmp_path}/b", lambda s: s.where("event_type <> 'purchase'")),
    ]
    with pytest.raises(sinks.SinkNotAllowed):
        sinks.stream_statement_set(_stream(spark, path, events), inserts, f"{tmp_path}/c")
    _run_with_restarts(
        lambda: sinks.stream_statement_set(
            _stream(spark, path, events), inserts, f"{tmp_path}/c", allow_sink=True
        ),
        add,
    )
    assert sum(spark.read.parquet(t).count() for t, _ in inserts) == events.count()


def test_generated_stream(spark, tmp_path):
    stream = datagen_stream(spark, [Field("n", "bigint", 3, 9), Field("s", "string")], per_second=50)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/c")
        .start()
    )
    try:
        for _ in range(60):
            query.awaitTermination(1)
            if (query.lastProgress or {}).get("numInputRows", 0) > 0:
                break
        query.processAllAvailable()
    finally:
        query.stop()
    low, high, n = spark.read.parquet(f"{tmp_path}/out").agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert n > 0 and 3 <= low <= high < 9


def test_follow_lines(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "pod-1.log").write_text("one\ntwo\n")
    query = (
        follow_lines(spark, f"{tmp_path}/logs")
        .writeStream.format("parquet")
        .option("path", f"{tmp_path}/out")
        .option("checkpointLocation", f"{tmp_path}/c")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["one", "two"]
