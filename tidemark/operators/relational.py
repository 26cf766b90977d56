"""Joins by time that Spark SQL has no keyword for, and user-defined aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lookup import skew_join
from tidemark.plans.ordered import (
    Carry,
    block_of,
    block_window,
    order_key,
    rows_only,
    with_carry,
)


def asof_join(
    probes: DataFrame,
    facts: DataFrame,
    keys: list[str],
    seq: str,
    values: list[str],
    block_rows: int | None = None,
) -> DataFrame:
    """Each probe with the ``values`` of the newest fact of its key at or before its ``seq``.

    One ordered scan over both inputs; nothing is joined, and a hot key is cut into blocks.
    """
    state = F.struct(*values)
    left = probes.withColumn("_side", F.lit(1))
    right = facts.select(*keys, seq, state.alias("_state")).withColumn("_side", F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    order = [seq, "_side"]
    newest = F.max_by("_state", F.when(F.col("_state").isNotNull(), order_key(order)))
    carried = with_carry(both, keys, {"_state": Carry(newest, "last")}, block_of(both, seq, block_rows))
    upto = block_window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = carried.withColumn("_found", F.last("_state", ignorenulls=True).over(upto))
    found = rows_only(matched).where(F.col("_side") == 1)
    return found.select(*probes.columns, *[F.col("_found")[v].alias(v) for v in values])


def partial_aggregate(
    df: DataFrame,
    keys: list[str],
    partial: Callable,
    state: str,
    merge: dict[str, Callable[[str], Column]],
    finish: dict[str, Column],
) -> DataFrame:
    """A user-defined aggregate in Python that combines before the shuffle.

    ``partial`` turns one pandas batch into one row per key with the ``state`` columns; Spark merges
    those with built-in aggregates and ``finish`` gives the result columns.  No task ever holds all
    rows of a key.
    """

    def batches(frames):
        for frame in frames:
            yield partial(frame)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), state])
    parts = df.mapInPandas(batches, schema)
    merged = parts.groupBy(*keys).agg(*[how(c).alias(c) for c, how in merge.items()])
    return merged.select(*keys, *[expr.alias(name) for name, expr in finish.items()])


def _levels(df: DataFrame, start: str, end: str, side: str) -> DataFrame:
    """(side, start, end, level) of rows with an interval; its level is the smallest power of two that is not shorter than the interval."""
    first, last = (F.col(f"`{c}`").cast("bigint") for c in (start, end))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(side), first.alias(f"{side}_start"), last.alias(f"{side}_end"))
    length = F.col(f"{side}_end").cast("decimal(20,0)") - F.col(f"{side}_start").cast("decimal(20,0)") + 1
    level = F.least(F.lit(62), F.ceil(F.log2(length.cast("double"))).cast("int"))
    return rows.where(F.col(f"{side}_start") <= F.col(f"{side}_end")).withColumn(f"{side}_level", level)


def _binned(df: DataFrame, side: str, others: list[int]) -> DataFrame:
    """A row for each bin an interval touches: in bins of its own level, and of every longer level the other side has."""
    longer = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda k: k > F.col(f"{side}_level"))
    levelled = df.withColumn("_level", F.explode(F.concat(F.array(f"{side}_level"), longer)))
    return levelled.withColumn("_bin", F.explode(F.expr(f"sequence(shiftright({side}_start, _level), shiftright({side}_end, _level))")))


def interval_join(left: DataFrame, right: DataFrame, left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """(left, right), as structs, of all pairs whose intervals [start, end] of integers have a number in common; no key is needed.

    Intervals lie in bins as wide as they are, to the next power of two, so each touches two at most. Two intervals meet in the bins of the
    longer one's level, and the pair belongs to the first bin they share, so it comes out once. The work is an equal-key join on (level, bin) with hot
    bins cut up. The driver gets the list of levels, 63 at most. Rows without bounds, or that end before they start, meet nothing.
    """
    one, other = _levels(left, *left_bounds, "left"), _levels(right, *right_bounds, "right")
    in_use = [[r[0] for r in df.select(f"{side}_level").distinct().collect()] for df, side in ((one, "left"), (other, "right"))]
    spread = ["left_start", "left_end", "left"]
    met = skew_join(_binned(one, "left", in_use[1]), _binned(other, "right", in_use[0]), ["_level", "_bin"], spread_by=spread)
    shared = F.expr("greatest(shiftright(left_start, _level), shiftright(right_start, _level))")
    overlap = (F.col("left_start") <= F.col("right_end")) & (F.col("right_start") <= F.col("left_end"))
    return met.where(overlap & (F.greatest("left_level", "right_level") == F.col("_level")) & (F.col("_bin") == shared)).select("left", "right")
