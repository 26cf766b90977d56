"""Writes: one INSERT from a query, or several as one unit over a shared input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class SinkNotAllowed(PermissionError):
    """The job was not started with ``allow_sink=True``."""


def insert_select(df: DataFrame, target: str, allow_sink: bool = False, mode: str = "append") -> None:
    """``INSERT INTO target SELECT ...``; the target is a table name, or a folder if it has a slash."""
    if not allow_sink:
        raise SinkNotAllowed(target)
    if "/" in target:
        df.write.mode(mode).parquet(target)
    else:
        df.write.mode(mode).saveAsTable(target)


def statement_set(
    shared: DataFrame,
    inserts: list[tuple[str, Callable[[DataFrame], DataFrame]]],
    allow_sink: bool = False,
    mode: str = "append",
) -> None:
    """Several inserts over one input that is computed once and spills to disk if it has to."""
    if not allow_sink:
        raise SinkNotAllowed(", ".join(t for t, _ in inserts))
    shared.persist()
    try:
        for target, build in inserts:
            insert_select(build(shared), target, allow_sink, mode)
    finally:
        shared.unpersist()


def stream_statement_set(
    shared: DataFrame,
    inserts: list[tuple[str, Callable[[DataFrame], DataFrame]]],
    checkpoint: str,
    allow_sink: bool = False,
):
    """The same over a stream: every micro-batch goes to all targets.

    Each batch has its own folder below the target and replaces it when the batch is run again, so
    a restart writes nothing twice.
    """
    if not allow_sink:
        raise SinkNotAllowed(", ".join(t for t, _ in inserts))

    def write(batch: DataFrame, batch_id: int) -> None:
        parts = [(f"{target}/batch_id={batch_id}", build) for target, build in inserts]
        statement_set(batch, parts, allow_sink=True, mode="overwrite")

    return (
        shared.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
