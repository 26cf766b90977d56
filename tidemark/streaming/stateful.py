"""The ordered operators over streams, with their state in Spark's own state store.

``changes`` and ``take_until_terminal`` remember a few values of each key, ``retain_last`` its newest rows, in state variables of
``transformWithState``: RocksDB on the executors, versioned and restored by Spark's checkpoint, so nothing is rewritten but the keys
that a micro-batch touches. ``apply_change_events`` is a last state and stays a built-in aggregation, combined on the map side.

A key's rows of one micro-batch are sorted in one task; the trigger's file limit bounds them. Rows whose ``seq`` is not above the newest
one of their key in earlier batches come too late: they go to an output of their own (``late_rows``), each with the ``seq`` it came behind. With ``ttl_ms``
what is known of a key expires that long after its last row, that of an ended key too; such a query runs until it is stopped. Null ``seq`` is
late always. ``block_rows`` is accepted for the batch operators' sake; streams need no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.windows import final_updates

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE, BEHIND = "_late", "_behind"


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """State variables need the RocksDB store; a query keeps the settings it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _same(a, b) -> bool:
    """Equality of values as in SQL's null-safe one: NaN equals NaN."""
    if isinstance(a, (tuple, list)) and isinstance(b, (tuple, list)):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b or (a != a and b != b)


class _Ordered(StatefulProcessor):
    """Walks a key's new rows in order; late rows come out marked."""

    def __init__(self, schema: T.StructType, seq: str, remembered: T.StructType, ttl_ms: int | None):
        self.at = schema.names.index(seq)
        self.made, self.remembered, self.ttl_ms = Row(*schema.names, LATE, BEHIND), remembered, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("known", self.remembered, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = tuple(self.state.get()) if self.state.exists() else None
        newest = known[0] if known else None
        fresh, late = [], []
        for row in rows:
            in_time = row[self.at] is not None and (newest is None or row[self.at] > newest)
            (fresh if in_time else late).append(tuple(row))
        fresh.sort(key=lambda row: row[self.at])
        if fresh:
            kept, known = self.walk(fresh, known)
            self.state.update(known)
            yield from (self.made(*row, False, None) for row in kept)
        yield from (self.made(*row, True, newest) for row in late)

    def walk(self, rows: list[tuple], known: tuple | None) -> tuple[list[tuple], tuple]:
        """(rows to give out, what to remember); the newest ``seq`` comes first in what is remembered."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Changes(_Ordered):
    def __init__(self, schema, seq, cols, ttl_ms):
        self.cols = [schema.names.index(c) for c in cols]
        super().__init__(schema, seq, T.StructType([schema[seq], *[schema[c] for c in cols]]), ttl_ms)

    def walk(self, rows, known):
        kept, last = [], known[1:] if known else None
        for row in rows:
            values = tuple(row[c] for c in self.cols)
            if last is None or not _same(values, last):
                kept.append(row)
            last = values
        return kept, (rows[-1][self.at], *last)


class _UntilTerminal(_Ordered):
    def __init__(self, schema, seq, end, ttl_ms):
        self.end = schema.names.index(end)
        super().__init__(schema, seq, T.StructType([schema[seq], T.StructField("ended", T.BooleanType())]), ttl_ms)

    def walk(self, rows, known):
        kept, ended = [], bool(known and known[1])
        for row in rows:
            if ended:
                break
            kept.append(row)
            ended = bool(row[self.end])
        return kept, (rows[-1][self.at], ended)


class _RetainLast(StatefulProcessor):
    """The ``n`` newest rows of a key, oldest first."""

    def __init__(self, schema: T.StructType, seq: str, n: int, ttl_ms: int | None):
        self.schema, self.at, self.n, self.ttl_ms = schema, schema.names.index(seq), n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("kept", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.state.get()] if self.state.exists() else []
        for row in rows:
            held.append(tuple(row))
            if len(held) > 4 * self.n + 1024:
                held = self.newest(held)
        self.state.put(self.newest(held))
        return iter(())

    def newest(self, rows: list[tuple]) -> list[tuple]:
        rows.sort(key=lambda row: (row[self.at] is not None, row[self.at] or 0))
        return rows[-self.n :] if self.n else []

    def close(self) -> None:
        pass


def start_stateful(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: T.StructType, write, checkpoint: str, until_empty: bool = True):
    """Run a processor over a keyed stream, each micro-batch of its output through ``write``."""
    names = [F.col(f"`{k}`") for k in keys]
    # With expiry Spark goes on making batches without data, also when it was asked to end with its input.
    out = stream.groupBy(*names).transformWithState(processor, schema, "Append", "ProcessingTime" if processor.ttl_ms else "None")
    with _state_store(stream.sparkSession):
        writer = out.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{checkpoint}/progress")
        return writer.trigger(availableNow=True).start() if until_empty and not processor.ttl_ms else writer.start()


def _with_late(schema: T.StructType, seq: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(LATE, T.BooleanType()), T.StructField(BEHIND, schema[seq].dataType)])


def _split(checkpoint: str, out: str, dropped: list[str]):
    """Rows in time go to ``out``, late ones below the checkpoint; a batch that runs again replaces its own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            in_time = batch.where(~F.col(LATE)).drop(LATE, BEHIND, *dropped)
            in_time.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
            batch.where(F.col(LATE)).drop(LATE, *dropped).write.mode("overwrite").parquet(f"{checkpoint}/late/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return write


def changes_stream(
    stream: DataFrame,
    keys: list[str],
    seq: str,
    cols: list[str],
    checkpoint: str,
    out: str,
    block_rows: int | None = None,
    ttl_ms: int | None = None,
    until_empty: bool = True,
):
    """``changes`` over a stream; remembers the compared values of each key's newest row."""
    schema = stream.schema
    processor = _Changes(schema, seq, cols, ttl_ms)
    return start_stateful(stream, keys, processor, _with_late(schema, seq), _split(checkpoint, out, []), checkpoint, until_empty)


def take_until_terminal_stream(
    stream: DataFrame,
    keys: list[str],
    seq: str,
    is_end: Column,
    checkpoint: str,
    out: str,
    block_rows: int | None = None,
    ttl_ms: int | None = None,
    until_empty: bool = True,
):
    """``take_until_terminal`` over a stream; remembers how far each key is and whether it has ended."""
    marked = stream.withColumn("_end", F.coalesce(is_end, F.lit(False)))
    schema = marked.schema
    processor = _UntilTerminal(schema, seq, "_end", ttl_ms)
    return start_stateful(marked, keys, processor, _with_late(schema, seq), _split(checkpoint, out, ["_end"]), checkpoint, until_empty)


def retain_last_stream(
    stream: DataFrame,
    keys: list[str],
    seq: str,
    n: int,
    checkpoint: str,
    block_rows: int | None = None,
    ttl_ms: int | None = None,
    until_empty: bool = True,
):
    """``retain_last`` over a stream; ``remembered`` reads the result from the state. No row is late: an old one may still be among the last ``n``."""
    processor = _RetainLast(stream.schema, seq, n, ttl_ms)
    return start_stateful(stream, keys, processor, stream.schema, lambda batch, _: batch.write.format("noop").mode("overwrite").save(), checkpoint, until_empty)


def apply_change_events_stream(stream: DataFrame, owner: list[str], name: str, kind: str, seq: str, checkpoint: str, until_empty: bool = True):
    """``apply_change_events`` over a stream: the last event of every name, and of every owner's resets, which have no name."""
    known = stream.where(F.col(kind).isin("Reset", "Added", "Modified", "Deleted"))
    named = known.withColumn("_name", F.when(F.col(kind) != "Reset", F.struct(F.col(name))))
    rest = [c for c in stream.columns if c not in owner]
    last = named.groupBy(*owner, "_name").agg(F.max_by(F.struct(*rest), F.struct(seq)).alias("_last"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(*owner, "_name", "_last.*").write.mode("overwrite").parquet(f"{checkpoint}/updates/batch_id={batch_id}")

    with _state_store(stream.sparkSession):
        writer = last.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{checkpoint}/progress")
        return writer.trigger(availableNow=True).start() if until_empty else writer.start()


def late_rows(spark: SparkSession, checkpoint: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows that came too late, with the newest ``seq`` of their key at that time as ``_behind`` and their batch."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{checkpoint}/late")


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What ``retain_last_stream`` or ``apply_change_events_stream`` has kept after its last finished batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/updates")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        updates = spark.read.parquet(f"{checkpoint}/updates")
        keys = updates.columns[: updates.columns.index("_name") + 1]
        return final_updates(spark, f"{checkpoint}/updates", keys).drop("_name")
    with _state_store(spark):
        state = spark.read.format("statestore").option("stateVarName", "kept").load(f"{checkpoint}/progress")
    return state.select("list_element.*")
