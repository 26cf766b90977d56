"""Tail, then follow: the last lines of each source, and after them every line that is added, none lost and none twice.

The files that are there at the start are the cursor. It is written down first; the tail is read from those files, and the stream leaves out
those files and no others, so it does not matter what is added in between. A restart finds cursor, tail and the stream's progress as they were left.
A file counts as added as a whole, as Spark's file streams read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.files import log_lines

FILE = "_file"


def tail_then_follow(
    spark: SparkSession, folder: str, schema, source: str, order: list[str], tail_lines: int, base: str, kind: str = "parquet", until_empty: bool = True
):
    """Start following ``folder``; lines go to ``base``/rows, those of the tail with batch_id -1. ``order`` is the place of a line in its source."""
    if not _done(spark, f"{base}/cursor"):
        files = spark.read.schema(schema).format(kind).load(folder).select(F.col("_metadata.file_path").alias(FILE)).distinct()
        files.write.mode("overwrite").parquet(f"{base}/cursor")
    cursor = spark.read.schema(f"{FILE} string").parquet(f"{base}/cursor")
    if not _done(spark, f"{base}/rows/batch_id=-1"):
        there = _with_file(spark.read.schema(schema).format(kind).load(folder)).join(cursor, FILE, "left_semi").drop(FILE)
        log_lines(there, source, order, tail_lines=tail_lines).write.mode("overwrite").parquet(f"{base}/rows/batch_id=-1")
    added = _with_file(spark.readStream.schema(schema).format(kind).load(folder)).join(cursor, FILE, "left_anti").drop(FILE)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch_id={batch_id}")

    writer = added.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{base}/progress")
    return (writer.trigger(availableNow=True) if until_empty else writer).start()


def followed(spark: SparkSession, schema, base: str) -> DataFrame:
    """All lines so far."""
    return spark.read.schema(schema).parquet(f"{base}/rows").drop("batch_id")


def _with_file(lines: DataFrame) -> DataFrame:
    return lines.select("*", F.col("_metadata.file_path").alias(FILE))


def _done(spark: SparkSession, folder: str) -> bool:
    """Was this table written to its end?"""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
