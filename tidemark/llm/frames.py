"""Small DataFrame helpers shared by the operators of this folder."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_dir

#: Bytes of text that one vectorised step takes at a time; its arrays hold several 8-byte numbers for each byte.
STEP_BYTES = 512 << 10
#: Rows of blobs that a task hands over at a time; Spark holds a whole batch outside its heap.
BLOB_ROWS = 16
#: Rows of sets that a step takes or hands over at a time.
SET_ROWS = 1000
#: Row keys of a table that is broadcast: 8 bytes each, at most these.
MOST_KEYS = 1_000_000
ROW_BITS = 36
_noted: list[list[str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def utf8(name: str = "text") -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return text_or_empty(name).cast("binary")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def even_keys(spark: SparkSession, parts: int) -> list[int]:
    """For each of ``parts`` partitions an int that hash partitioning sends there, so that groups of these keys never share a task."""
    number = F.col("id").cast("int")
    part = F.pmod(F.hash(number), F.lit(parts)).alias("part")
    found = dict(spark.range(40 * parts).select(number.alias("key"), part).groupBy("part").agg(F.min("key").alias("key")).collect())
    # A partition that none of 40 keys apiece falls into (hardly ever) shares another's task.
    return [found.get(p, 40 * parts + p) for p in range(parts)]


def table_of(schema: str, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], df: DataFrame) -> DataFrame:
    return df.mapInArrow(step, schema)


def portions(batches: Iterator[pa.RecordBatch], rows: int = SET_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which share the memory of the larger ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def noted_folders() -> Iterator[list[str]]:
    """The folders that ``written`` makes inside, so that the caller can remove them."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def remove_folders(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, which outlives executors and cuts the lineage."""
    path = scratch_dir(df.sparkSession, name)
    if _noted:
        _noted[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def addressed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a long that names each row, and that column's name: the number of the row's file and its place there.

    Rows that do not come straight from Parquet files are written first. The driver gets the list of files.
    """
    own = docs.columns
    address = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    whole = F.struct(*[F.col(f"`{c}`") for c in own]).alias("row")
    try:
        if "_metadata" in own:
            raise AnalysisException("a column of the caller")
        placed = docs.select(whole, *address)
    except AnalysisException:
        placed = written(docs.select(whole), "rows").select("row", *address)
    key = next(k for k in (f"_key{i}" for i in range(len(own) + 1)) if k not in own)
    files = sorted(r[0] for r in placed.select("_file").distinct().collect())
    # From a Python list Spark makes rows in Python workers of their own, which then stay in the executors' memory.
    listed = F.from_json(F.lit(json.dumps(files)), "array<string>")
    numbers = docs.sparkSession.range(0, 1, 1, 1).select(F.posexplode(listed)).select(F.col("pos").cast("long").alias("_number"), F.col("col").alias("_file"))
    numbered = placed.join(F.broadcast(numbers), "_file")
    return numbered.select(*[F.col(f"row.`{c}`") for c in own], (F.shiftleft("_number", ROW_BITS) + F.col("_at")).alias(key)), key


def without_rows(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows of ``addressed`` documents whose key is not in ``gone`` (one column of that name), without the key.

    The keys to leave out go to the texts as long as they are few; beyond that both sides are shuffled.
    """
    gone = written(gone.select(key), "gone")
    side = F.broadcast(gone) if gone.count() <= MOST_KEYS else gone
    return docs.join(side, key, "left_anti").drop(key)
