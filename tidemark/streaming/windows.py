"""Event-time windows, late data, and draining a result incrementally."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.operators.keyed import latest_state


def windowed(stream: DataFrame, window: Column, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates per event-time window and key; the window bounds come out as columns."""
    grouped = stream.groupBy(window.alias("w"), *keys).agg(*aggs)
    return grouped.select("w.start", "w.end", *[c for c in grouped.columns if c != "w"]).withColumnsRenamed(
        {"start": "window_start", "end": "window_end"}
    )


def run_updates(updates: DataFrame, checkpoint: str, out: str):
    """Run a stateful aggregation to the end of its input, one folder of changed rows per batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        updates.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_append(stream: DataFrame, checkpoint: str, out: str):
    """Run a query whose rows never change once written."""
    return (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def final_updates(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest version of every row the batches wrote."""
    log = spark.read.parquet(out)
    return latest_state(log, keys, ["batch_id"]).drop("batch_id")
