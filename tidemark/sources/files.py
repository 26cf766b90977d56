"""Log lines and file manifests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.ordered import GROUP_LIMIT, block_of, first_in_key, rank_in_key

#: Files of this size or more are read in pieces; smaller ones as one binary value.
PIECES_FROM = 64 << 20
PIECE = 1 << 20
#: Names that a scan by lines would unpack.
UNPACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|lzo|passthrough)$"
MARK = b"\xef\xbb\xbf"


def text_lines(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """One row per line of a text column, with its number."""
    return df.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def log_lines(
    df: DataFrame,
    pod: str,
    order: list[str],
    container: str | None = None,
    tail_lines: int | None = None,
    since_s: int | None = None,
    ts: str | None = None,
    now: Column | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Lines of one container per pod: the last ``tail_lines``, the last ``since_s`` seconds, or all.

    ``block`` is any number that never falls along ``order``; by default it cuts the first order
    column, which must then be an integer.
    """
    if container is not None:
        df = df.where(F.col("container") == container)
    if since_s is not None:
        edge = (now if now is not None else F.current_timestamp()) - F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), F.lit(since_s).cast("decimal(18,6)")
        )
        df = df.where(F.col(ts) >= edge)
    if tail_lines is None:
        return df
    if tail_lines <= GROUP_LIMIT:
        return first_in_key(df, [pod], [F.col(c).desc_nulls_last() for c in order], tail_lines)
    cut = block if block is not None else block_of(df, order[0])
    ranked = rank_in_key(df, [pod], order, cut, backwards=True)
    return ranked.where(F.col("_rank") <= tail_lines).drop("_rank")


def follow_lines(spark: SparkSession, folder: str, glob: str = "*.log") -> DataFrame:
    """Lines of log files as they are written, with the file they come from."""
    lines = spark.readStream.option("pathGlobFilter", glob).text(folder)
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the lines that follow one another in a split, each after its separator, in pieces that are numbered."""
    number = 0
    for batch in batches:
        file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
        new = (np.diff(file.indices.to_numpy()) != 0) | (np.diff(start) != 0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            data = b"\n" + b"\n".join(batch.column("line").slice(a, b - a).to_pylist())
            for at in range(0, len(data), PIECE):
                row = batch.column("file")[a].as_py(), batch.column("size")[a].as_py(), int(start[a]), number, data[at : at + PIECE]
                number += 1
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "size", "start", "number", "piece"), row, strict=True))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MD5 of each file whose pieces come one after the other. The scan leaves out a byte order mark and the last separator; the size tells."""
    name, size, plain, marked, total = None, 0, None, None, 0

    def ended() -> pa.RecordBatch:
        missing = size - total
        if missing not in (0, 1, len(MARK), len(MARK) + 1):
            raise ValueError(f"{name}: read {total} of {size} bytes")
        digest = marked if missing >= len(MARK) else plain
        digest.update(b"\n" * (missing % len(MARK)))
        return pa.RecordBatch.from_pylist([{"file": name, "md5": digest.hexdigest()}])

    for batch in batches:
        for k in range(batch.num_rows):
            piece = memoryview(batch.column("piece")[k].as_buffer())
            if (file := batch.column("file")[k].as_py()) != name:
                if name is not None:
                    yield ended()
                name, size, plain, marked, total = file, batch.column("size")[k].as_py(), hashlib.md5(), hashlib.md5(MARK), 0
                piece = piece[1:]
            plain.update(piece)
            marked.update(piece)
            total += len(piece)
    if name is not None:
        yield ended()


def file_manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Name, size and MD5 of the files in a folder.

    Large files are read in splits, as lines, and one task adds up the pieces of each in their order without holding them, as MD5 is one chain. Files with the
    suffix of a codec, which a scan by lines would unpack, are read as one value and must be below 2 GB, as must a line.
    """

    def scan(kind: str, **options: str) -> DataFrame:
        reader = spark.read.format(kind).options(pathGlobFilter=glob, recursiveFileLookup="true", **options)
        return reader.load(folder)

    files, length = scan("binaryFile"), F.col("length")
    unpacked = F.col("_metadata.file_name").rlike(UNPACKED)
    large, whole = length >= PIECES_FROM, ["path", length.alias("size"), F.md5("content").alias("md5")]
    lines = scan("text", lineSep="\n").where((F.col("_metadata.file_size") >= PIECES_FROM) & ~unpacked).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"),
    )
    pieces = lines.mapInArrow(_pieces, "file string, size long, start long, number long, piece binary")
    digests = pieces.repartition("file").sortWithinPartitions("file", "start", "number").mapInArrow(_digests, "file string, md5 string")
    names = files.where(large & ~unpacked).select("path", length.alias("size"), F.col("_metadata.file_path").alias("file"))
    found = files.where(~large).select(*whole).unionByName(files.where(large & unpacked).select(*whole))
    return found.unionByName(names.join(digests, "file").select("path", "size", "md5"))


def file_manifest_diff(remote: DataFrame, local: DataFrame) -> DataFrame:
    """For each remote file: is there a local copy, and is it still the same?"""
    mine = local.select("path", F.col("md5").alias("_local"))
    verdict = (
        F.when(F.col("_local").isNull(), "missing")
        .when(F.col("_local") == F.col("md5"), "hit")
        .otherwise("stale")
    )
    return remote.join(mine, "path", "left").withColumn("verdict", verdict).drop("_local")
