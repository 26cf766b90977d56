"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders")


def lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def customer(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer")


def iso(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


def epoch_ms(col: str) -> Column:
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {col})")


def choose(col: Column, table: dict[str, str], other: str | None = None) -> Column:
    """Text chosen by the value of ``col``."""
    out = None
    for key, value in table.items():
        out = F.when(col == key, value) if out is None else out.when(col == key, value)
    return out if other is None else out.otherwise(other)


def sql_choose(col: str, table: dict[str, str], other: str | None = None) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    tail = f" ELSE '{other}'" if other is not None else ""
    return f"CASE {col} {arms}{tail} END"
