"""Distinct counts that add up: one sketch for each poll, merged over any polls later.

A theta sketch of ``2 ** lg`` hashes (8 bytes each) counts the distinct values of a group exactly up to that many, beyond with a standard error of
about ``1 / sqrt(2 ** lg)``. Sketches are aggregates combined on the map side, so a hot group is one sketch a task, however many rows it has; stored sketches are merged without
the rows. Nulls are not counted, and a group without values has a sketch of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG = 14
SKETCH = "sketch"


def distinct_sketches(df: DataFrame, keys: list[str], value: str, lg: int = LG) -> DataFrame:
    """One sketch of the distinct ``value`` for each group (say, cluster and poll), with its number of rows."""
    return df.groupBy(*keys).agg(F.theta_sketch_agg(value, lg).alias(SKETCH), F.count("*").alias("n_rows"))


def merged(sketches: DataFrame, keys: list[str], lg: int = LG) -> DataFrame:
    """Sketches and row counts of coarser groups, from those of finer ones."""
    return sketches.groupBy(*keys).agg(F.theta_union_agg(SKETCH, lg).alias(SKETCH), F.sum("n_rows").alias("n_rows"))


def estimate(sketch: str | Column = SKETCH) -> Column:
    """Estimated number of distinct values; 0 for a group that is not there."""
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("bigint")


def turnover(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of two polls' sketches the estimated values of either poll, of both, and those that came and went."""
    left = old.select(*keys, F.col(SKETCH).alias("_old"))
    right = new.select(*keys, F.col(SKETCH).alias("_new"))
    both = F.theta_intersection("_old", "_new")
    return left.join(right, keys, "full").select(
        *keys,
        estimate("_old").alias("n_old"),
        estimate("_new").alias("n_new"),
        estimate(both).alias("n_both"),
        F.when(F.col("_old").isNull(), estimate("_new")).otherwise(estimate(F.theta_difference("_new", "_old"))).alias("n_came"),
        F.when(F.col("_new").isNull(), estimate("_old")).otherwise(estimate(F.theta_difference("_old", "_new"))).alias("n_went"),
    )
