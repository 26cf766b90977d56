"""A keyed table that is changed in place: only the buckets that a change touches are written again.

Rows lie in ``buckets`` folders by a hash of their key. A manifest names, for each bucket that has rows, the folder that holds it, its number of rows and a digest
of its keys and content (two sums of 64-bit hashes; the poll time ``at`` is left out). A change reads and writes the touched buckets alone, in a new folder, and
then writes the next manifest; readers take the newest finished one, so they see a change whole or not at all, and a job that dies leaves the table as it was.

A snapshot is compared by digests first: buckets with equal ones are neither read nor written. Keys are unique, so buckets are even; choose their number so that
one fits a task. The driver sees the manifest, one row a bucket. One writer at a time: a second one fails when it writes the same manifest.
Folders of older manifests stay for their readers.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.keyed import lww_upsert, snapshot_reconcile

BUCKET = "_bucket"
MANIFEST = f"{BUCKET} int, part string, version_of int, n_rows long, one decimal(38,0), other decimal(38,0)"
DIGEST = ["n_rows", "one", "other"]


@dataclass(frozen=True)
class Kept:
    """A stored table: where it is, what its rows are, its keys, and the column that is no content."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    keys: list[str]
    at: str | None
    buckets: int

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def version(self) -> int:
        """Number of the newest finished manifest; -1 before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest/*/_SUCCESS")
        done = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        return max((int(s.getPath().getParent().getName()) for s in done), default=-1)

    def manifest(self, version: int | None = None) -> list:
        number = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{number}").collect() if number >= 0 else []

    def rows(self, only: set[int] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        parts = sorted(f"{r['part']}/{BUCKET}={r[BUCKET]}" for r in self.manifest(version) if only is None or r[BUCKET] in only)
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/{p}" for p in parts))

    def digests(self, df: DataFrame) -> DataFrame:
        """(_bucket, n_rows, one, other) of rows; combined on the map side, whatever their order."""
        row = [F.col(f"`{c}`") for c in self.schema.names if c != self.at]
        sums = [F.sum(F.xxhash64(*row, *salt).cast("decimal(38,0)")) for salt in ([], [F.lit("other")])]
        return df.groupBy(self.bucket()).agg(F.count("*").alias("n_rows"), sums[0].alias("one"), sums[1].alias("other"))


def create(df: DataFrame, keys: list[str], folder: str, at: str | None = None, buckets: int = 64) -> Kept:
    """Store rows with unique keys; ``at`` is a column that may differ between equal rows."""
    if BUCKET in df.columns:
        raise ValueError(f"{BUCKET} names the buckets")
    kept = Kept(df.sparkSession, folder, df.schema, keys, at, buckets)
    _write(kept, df, set(range(buckets)))
    return kept


def reconcile(kept: Kept, current: DataFrame, content: list[str], at: str) -> set[int]:
    """Make the table ``snapshot_reconcile`` of itself and ``current``; gives the buckets that were written."""
    own = {r[BUCKET]: tuple(r[c] for c in DIGEST) for r in kept.manifest()}
    theirs = {r[BUCKET]: tuple(r[c] for c in DIGEST) for r in kept.digests(current.select(*kept.schema.names)).collect()}
    touched = {b for b in own.keys() | theirs.keys() if own.get(b) != theirs.get(b)}
    return change(kept, touched, lambda old: snapshot_reconcile(old, _inside(kept, current, touched), kept.keys, content, at))


def upsert(kept: Kept, updates: DataFrame, change_of: dict[str, Column]) -> set[int]:
    """``lww_upsert`` in place; gives the buckets that were written."""
    touched = _touched(kept, updates)
    return change(kept, touched, lambda old: lww_upsert(old, _inside(kept, updates, touched), kept.keys, change_of))


def delete(kept: Kept, doomed: DataFrame) -> set[int]:
    """Remove the rows whose keys are in ``doomed``; gives the buckets that were written."""
    same = [F.col(f"old.`{k}`").eqNullSafe(F.col(f"doomed.`{k}`")) for k in kept.keys]
    condition = same[0]
    for part in same[1:]:
        condition &= part
    gone = doomed.select(*[F.col(f"`{k}`") for k in kept.keys])
    return change(kept, _touched(kept, gone), lambda old: old.alias("old").join(gone.alias("doomed"), condition, "left_anti"))


def change(kept: Kept, touched: set[int], made: Callable[[DataFrame], DataFrame]) -> set[int]:
    """Replace the rows of these buckets by ``made`` of them, which must keep each key in its bucket."""
    if touched:
        _write(kept, made(kept.rows(touched)), touched)
    return touched


def _touched(kept: Kept, df: DataFrame) -> set[int]:
    return {r[BUCKET] for r in df.select(kept.bucket()).distinct().collect()}


def _inside(kept: Kept, df: DataFrame, touched: set[int]) -> DataFrame:
    return df.where(F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in kept.keys]), F.lit(kept.buckets)).isin(sorted(touched))) if touched else df.limit(0)


def _write(kept: Kept, rows: DataFrame, touched: set[int]) -> None:
    version = kept.version()
    stays = [tuple(r) for r in kept.manifest(version) if r[BUCKET] not in touched]
    part = f"{version + 1}-{os.urandom(6).hex()}"
    placed = rows.select(*[F.col(f"`{c}`") for c in kept.schema.names]).withColumn(BUCKET, kept.bucket())
    placed.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{kept.folder}/data/{part}")
    whole = T.StructType([*kept.schema.fields, T.StructField(BUCKET, T.IntegerType())])
    digests = kept.digests(kept.spark.read.schema(whole).parquet(f"{kept.folder}/data/{part}").drop(BUCKET))
    fresh = digests.select(BUCKET, F.lit(part).alias("part"), F.lit(version + 1).alias("version_of"), *DIGEST)
    listed = kept.spark.createDataFrame(stays, MANIFEST).unionByName(fresh)
    listed.coalesce(1).write.parquet(f"{kept.folder}/manifest/{version + 1}")
