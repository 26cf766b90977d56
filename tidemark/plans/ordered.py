"""Ordered scans over keyed logs that stay balanced when one key holds most rows.

``Window.partitionBy(key).orderBy(seq)`` sends a whole key to one task.  Here the log is cut into
*blocks* of the order column, so a task sorts one (key, block).  What a block needs to know about
the rows before it is a few values, computed in three small steps:

1. aggregate per (key, block) -- map-side combined, so a hot key costs one row per block and task;
2. fold those summaries along the blocks of each key;
3. hand the folded values to the block as one extra leading row (the *carry* row).

A window over (key, block) then sees the carry row first and needs nothing else.  The input is read
twice, the first time for the few columns of step 1 only; write or persist an input that is costly
to compute.

The order column is a unique number.  Blocks are cut at quantiles of it, taken from a mergeable sketch in one pass, so
they hold about ``BLOCK_ROWS`` rows each however the numbers are spread, up to ``MAX_BLOCKS`` of them, which bounds step 2; from there
on they grow with the table.  Rows without a number are a block of their own, before all others.

``first_in_key`` is the short cut for the few first rows of each key: a limit per key in every task before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 1 << 20
MAX_BLOCKS = 1 << 14
#: Rank error of the sketch: a quarter of the smallest block.
SKETCH_ACCURACY = 4 * MAX_BLOCKS
#: Up to so many rows a key are found by a limit in every task; the task of a key gets as many from each.
GROUP_LIMIT = 128
BLOCK = "_block"
IS_ROW = "_is_row"


@dataclass(frozen=True)
class Carry:
    """One value handed from block to block: aggregate of a block, and how blocks are folded."""

    agg: Column
    fold: str  # prev | last | max | min | sum


def _below(splits: Column, value: Column) -> Column:
    """How many of the sorted splits are not above the value: a binary search in ``log2(MAX_BLOCKS)`` steps."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MAX_BLOCKS.bit_length()))])

    def step(found: Column, width: Column) -> Column:
        return F.when(F.get(splits, found + width - 1) <= value, found + width).otherwise(found)

    return F.aggregate(steps, F.lit(0), step)


def block_of(df: DataFrame, seq: str, block_rows: int | None = None) -> Column:
    """Block number of an order column: never falls as ``seq`` rises; null where ``seq`` is.

    The bounds are quantiles of the data, at most ``MAX_BLOCKS`` numbers that one pass brings to the driver, unless a width is given; a
    table that fits one block is only counted.
    """
    if block_rows is not None:
        return F.expr(f"`{seq}` div {int(block_rows)}L")
    blocks = max(1, min(MAX_BLOCKS, -(-df.select(seq).count() // BLOCK_ROWS)))
    if blocks == 1:
        return F.when(F.col(seq).isNotNull(), F.lit(0)).cast("bigint")
    shares = F.split(F.lit(" ".join(repr(k / MAX_BLOCKS) for k in range(1, MAX_BLOCKS))), " ").cast("array<double>")
    splits = df.agg(F.percentile_approx(seq, shares, F.lit(SKETCH_ACCURACY))).first()[0]
    if splits is None:
        return F.lit(None).cast("bigint")
    bounds = [splits[-(-k * MAX_BLOCKS // blocks) - 1] for k in range(1, blocks)]
    listed = F.split(F.lit(" ".join(map(str, bounds))), " ").cast(T.ArrayType(df.schema[seq].dataType))
    return F.when(F.col(seq).isNotNull(), _below(listed, F.col(seq))).cast("bigint")


def first_in_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; each task drops what cannot be among them before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def order_key(order: list[str]) -> Column:
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _fold(name: str, how: str, upto: WindowSpec, by_block: WindowSpec) -> Column:
    if how == "prev":
        return F.lag(name).over(by_block)
    if how == "last":
        return F.last(name, ignorenulls=True).over(upto)
    return {"max": F.max, "min": F.min, "sum": F.sum}[how](name).over(upto)


def with_carry(
    df: DataFrame,
    keys: list[str],
    carries: dict[str, Carry],
    block: Column,
    backwards: bool = False,
) -> DataFrame:
    """``df`` plus one carry row for each (key, block) that has earlier blocks (later, if backwards).

    Carry rows have ``_is_row`` false, the folded values in the columns named by ``carries`` and
    NULL elsewhere.
    """
    rows = df.withColumn(BLOCK, block)
    summary = rows.groupBy(*keys, BLOCK).agg(*[c.agg.alias(n) for n, c in carries.items()])
    along = F.col(BLOCK).desc() if backwards else F.col(BLOCK).asc()
    by_block = Window.partitionBy(*keys).orderBy(along)
    upto = by_block.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        BLOCK,
        *[_fold(n, c.fold, upto, by_block).alias(n) for n, c in carries.items()],
        F.lag(F.lit(True)).over(by_block).alias("_has_before"),
    )
    carried = carried.where("_has_before").drop("_has_before").withColumn(IS_ROW, F.lit(False))
    return rows.withColumn(IS_ROW, F.lit(True)).unionByName(carried, allowMissingColumns=True)


def block_window(keys: list[str], order: list[str], backwards: bool = False) -> WindowSpec:
    cols = [F.col(c).desc() if backwards else F.col(c).asc() for c in order]
    return Window.partitionBy(*keys, BLOCK).orderBy(F.col(IS_ROW).asc(), *cols)


def rows_only(df: DataFrame, *helpers: str) -> DataFrame:
    return df.where(F.col(IS_ROW)).drop(BLOCK, IS_ROW, *helpers)


def seen_before(
    df: DataFrame,
    keys: list[str],
    seq: str,
    hit: Column,
    name: str = "_seen",
    block_rows: int | None = None,
) -> DataFrame:
    """Add ``name``: is there a strictly earlier row of the same key for which ``hit`` is true?"""
    marked = df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    block = block_of(df, seq, block_rows)
    both = with_carry(marked, keys, {"_hit": Carry(F.max("_hit"), "max")}, block)
    before = block_window(keys, [seq]).rowsBetween(Window.unboundedPreceding, -1)
    flagged = both.withColumn(name, F.coalesce(F.max("_hit").over(before), F.lit(False)))
    return rows_only(flagged, "_hit")


def rank_in_key(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    backwards: bool = False,
    name: str = "_rank",
) -> DataFrame:
    """Add the 1-based position of each row inside its key, from the first row or from the last."""
    both = with_carry(df, keys, {"_before": Carry(F.count("*"), "sum")}, block, backwards)
    local = block_window(keys, order, backwards)
    frame = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.sum(F.when(F.col(IS_ROW), F.lit(1)).otherwise(F.col("_before"))).over(frame)
    return rows_only(both.withColumn(name, position), "_before")


def page_of_order(
    df: DataFrame, seq: str, start: int, size: int, block_rows: int | None = None, backwards: bool = False
) -> DataFrame:
    """Rows at positions [start, start+size) of the total order by a unique number ``seq``, nulls first (last, if backwards).

    Only the blocks that overlap the page are sorted; each of them holds at least one page row, so
    at most ``size`` block numbers are broadcast.
    """
    rows = df.withColumn(BLOCK, block_of(df, seq, block_rows))
    per_block = rows.groupBy(BLOCK).agg(F.count("*").alias("_n"))

    def along(name: str) -> Column:
        return F.col(name).desc_nulls_last() if backwards else F.col(name).asc_nulls_first()

    upto = Window.orderBy(along(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    needed = (
        per_block.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .where((F.col("_before") < start + size) & (F.col("_before") + F.col("_n") > start))
        .select(F.col(BLOCK).alias("_needed"), "_before")
    )
    position = F.row_number().over(Window.partitionBy(BLOCK).orderBy(along(seq))) + F.col("_before")
    return (
        rows.join(F.broadcast(needed), F.col(BLOCK).eqNullSafe(F.col("_needed")))
        .withColumn("_pos", position)
        .where((F.col("_pos") > start) & (F.col("_pos") <= start + size))
        .drop(BLOCK, "_needed", "_before", "_pos")
    )
