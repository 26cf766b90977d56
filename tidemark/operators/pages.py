"""A finished result kept in order, with an index: pages and chunks read the files they overlap and nothing else.

``write_ordered`` sorts a result once into files of about ``file_rows`` rows and writes beside them one index row for each run of ``step``
rows of a file: its place in the whole order, its number of rows and the bounds of the first order column. After that

* a page's counters come from the index alone, so they stand for a page or chunk without rows too;
* the rows of a page are those at its places, read from the files that hold them, with the bounds pushed down to the row groups;
* a chunk goes on from a cursor in the same way, so draining a result reads every row once or twice, not once for every chunk.

Rows are ordered by all columns of ``order``, nulls first. Rows that tie in all of them keep the place they were written at, so the pages of
a written result never overlap. Files are dealt by ranges of the order columns: where one value may stand for many rows, name further columns.
The index holds one row for ``step`` rows of the result, and numbering its files is one task's work on a row a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_ROWS = 1 << 20
STEP = 1 << 14


@dataclass(frozen=True)
class Ordered:
    """A written result: its folder, the type of its rows and its order."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    order: list[str]

    @property
    def index(self) -> DataFrame:
        """(file, place, rows, low, high) of every run of rows."""
        bound = self.schema[self.order[0]].dataType
        kinds = T.StructType(
            [
                T.StructField("file", T.StringType()), T.StructField("place", T.LongType()), T.StructField("in_file", T.LongType()),
                T.StructField("rows", T.LongType()), T.StructField("low", bound), T.StructField("high", bound),
            ]
        )
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/index")


def write_ordered(df: DataFrame, order: list[str], folder: str, file_rows: int = FILE_ROWS, step: int = STEP) -> Ordered:
    """Write ``df`` in the order of ``order`` below ``folder``, with its index."""
    spark, by = df.sparkSession, [F.col(f"`{c}`") for c in order]
    files = max(1, -(-df.count() // file_rows))
    df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.parquet(f"{folder}/rows")
    written = spark.read.schema(df.schema).parquet(f"{folder}/rows")
    runs = (
        written.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"), by[0].alias("value"))
        .groupBy("file", F.expr(f"at div {int(step)}").alias("run"))
        .agg(
            F.min("at").alias("in_file"), F.count("*").alias("rows"), F.count("value").alias("filled"),
            F.min("value").alias("least"), F.max("value").alias("high"),
        )
    )
    # Files bear the numbers of their ranges, which have more digits from 100,000 on.
    earlier = Window.orderBy(F.regexp_extract("file", "^part-([0-9]+)", 1).cast("bigint"), "file").rowsBetween(Window.unboundedPreceding, -1)
    files_at = runs.groupBy("file").agg(F.sum("rows").alias("n")).select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    indexed = runs.join(files_at, "file").select(
        "file", (F.col("start") + F.col("in_file")).alias("place"), "in_file", "rows",
        F.when(F.col("filled") == F.col("rows"), F.col("least")).alias("low"), "high",
    )
    indexed.repartitionByRange(1 + files // FILE_ROWS, "place").sortWithinPartitions("place").write.parquet(f"{folder}/index")
    return Ordered(spark, folder, df.schema, order)


def open_ordered(spark: SparkSession, folder: str, order: list[str]) -> Ordered:
    """A result that was written before, in this order."""
    return Ordered(spark, folder, spark.read.parquet(f"{folder}/rows").schema, order)


def files_of(result: Ordered, start: int, size: int) -> list[str]:
    """Names of the files that hold rows at the places [start, start + size): at most ``size`` of them."""
    return sorted({r["file"] for r in _runs(result, start, size)})


def _runs(result: Ordered, start: int, size: int) -> list:
    inside = (F.col("place") < start + size) & (F.col("place") + F.col("rows") > start)
    return result.index.where(inside).orderBy("place").collect()


def _rows(result: Ordered, runs: list, start: int, size: int) -> DataFrame:
    """Rows at the places [start, start + size), which ``runs`` hold, with their place in ``_place``."""
    spark, schema = result.spark, result.schema
    if not runs:
        return spark.createDataFrame([], schema).withColumn("_place", F.lit(0).cast("bigint"))
    starts = {r["file"]: r["place"] - r["in_file"] for r in runs}
    found = spark.read.schema(schema).parquet(*(f"{result.folder}/rows/{name}" for name in sorted(starts)))
    known = spark.createDataFrame(sorted(starts.items()), "_file string, _start bigint")
    if all(r["low"] is not None for r in runs):  # nothing is known of the bounds of runs with nulls
        key, kind = F.col(f"`{result.order[0]}`"), schema[result.order[0]].dataType
        found = found.where((key >= F.lit(runs[0]["low"]).cast(kind)) & (key <= F.lit(runs[-1]["high"]).cast(kind)))
    placed = found.select(
        F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("_row"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at")
    )
    place = F.col("_start") + F.col("_at")
    return placed.join(F.broadcast(known), "_file").where((place >= start) & (place < start + size)).select("_row.*", place.alias("_place"))


def page_views(result: Ordered, pages: list[int], size: int, running: bool = False) -> DataFrame:
    """One row of counters for each page, with or without rows, from the index alone."""
    if size < 1 or any(p < 1 for p in pages):
        raise ValueError("page and size start at 1")
    total = result.index.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("_n"))
    here = F.col("page_index")
    numbered = total.select("_n", F.explode(F.array(*[F.lit(p) for p in pages])).alias("page_index"))
    counted = numbered.withColumn("total_pages", F.ceil(F.col("_n") / F.lit(size)).cast("bigint"))
    before = (here.cast("bigint") - 1) * F.lit(size)
    return counted.select(
        "total_pages", "page_index", ((here < F.col("total_pages")) | F.lit(running)).alias("has_next_page"),
        ((here >= F.col("total_pages")) & F.lit(running)).alias("has_more_rows"),
        F.greatest(F.lit(0), F.least(F.lit(size), F.col("_n") - before)).cast("bigint").alias("page_rows"),
    )


def page(result: Ordered, number: int, size: int, running: bool = False) -> DataFrame:
    """Rows of page ``number`` (from 1) with the counters beside each; a page without rows is one row of counters and nulls."""
    view = page_views(result, [number], size, running)
    start = (number - 1) * size
    rows = _rows(result, _runs(result, start, size), start, size)
    return _with_view(view, rows)


def _with_view(view: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row beside the view's one row, which stays if there are none."""
    own = [c for c in rows.columns if c != "_place"]
    held = rows.select(F.lit(1).alias("_one"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"))
    joined = F.broadcast(view.withColumn("_one", F.lit(1))).join(held, "_one", "left")
    return joined.select("_row.*", *[c for c in view.columns if c not in own])


def chunk(result: Ordered, offset, size: int, running: bool = False) -> DataFrame:
    """The first ``size`` rows whose (unique, filled) order value is above ``offset``, with the cursor to go on from; without rows, one row with the old cursor."""
    key = F.col(f"`{result.order[0]}`")
    rows = _after(result, offset, size)
    kind = result.schema[result.order[0]].dataType
    view = rows.agg(F.coalesce(F.max(key), F.lit(offset).cast(kind)).alias("last_offset")).withColumn("has_next", F.lit(running))
    return _with_view(view, rows)


def _after(result: Ordered, offset, size: int) -> DataFrame:
    """The first ``size`` rows above ``offset``: from the run that may hold it on, as many runs as hold that many rows more."""
    key = F.col(f"`{result.order[0]}`")
    first = result.index.where(F.col("high") > F.lit(offset)).agg(F.min(F.struct("place", "rows")).alias("r")).first()["r"]
    if first is None:
        return _rows(result, [], 0, 0)
    start, span = first["place"], first["rows"] + size
    return _rows(result, _runs(result, start, span), start, span).where(key > F.lit(offset)).orderBy("_place").limit(size)


def drained(result: Ordered, size: int, offset=None) -> Iterator[tuple[DataFrame, int]]:
    """(rows, place after them) of chunk after chunk from place ``offset`` on; every row comes once."""
    start = offset or 0
    total = result.index.agg(F.sum("rows")).first()[0] or 0
    while start < total:
        rows = _rows(result, _runs(result, start, size), start, size)
        start = min(start + size, total)
        yield rows.drop("_place"), start

