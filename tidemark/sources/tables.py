"""Table sources: files in a folder, inline rows and generated rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(
    spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None
) -> DataFrame:
    """The same files as an unbounded table, which may be one file or a folder of files."""
    own = table(spark, folder, name)
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(own.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    files = own.inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)


def inline_rows(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """``VALUES (...) AS t(...)``; the values are bound, not pasted into the text."""
    args = {f"r{i}c{j}": value for i, row in enumerate(rows) for j, value in enumerate(row)}
    marks = (f"({', '.join(f':r{i}c{j}' for j in range(len(columns)))})" for i in range(len(rows)))
    return spark.sql(f"SELECT * FROM VALUES {', '.join(marks)} AS t({', '.join(columns)})", args=args)


@dataclass(frozen=True)
class Field:
    """One generated column: SQL type, value range and share of NULLs."""

    name: str
    kind: str  # bigint | int | double | decimal(p,s) | string | timestamp | multiset | row
    low: int = 0
    high: int = 1000
    null_rate: float = 0.0
    fields: tuple[Field, ...] = ()


def _draw(seed: int, salt: str, n: int) -> Column:
    """Number in [0, n) that depends on the row id, the column and the seed alone."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(f"{seed}/{salt}")), F.lit(n))


def _generated(f: Field, seed: int, path: str = "") -> Column:
    name = f"{path}{f.name}"
    number = _draw(seed, name, f.high - f.low) + f.low
    if f.kind == "row":
        value = F.struct(*[_generated(g, seed, f"{name}.").alias(g.name) for g in f.fields])
    elif f.kind == "string":
        value = F.concat(F.lit(f"{f.name}_"), number.cast("string"))
    elif f.kind == "multiset":
        value = F.create_map(number.cast("string"), (_draw(seed, f"{name}#", 9) + 1).cast("int"))
    elif f.kind == "timestamp":
        start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        value = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), number.cast("decimal(18,6)"))
    elif f.kind.startswith("decimal"):
        value = (number + _draw(seed, f"{name}.", 100) / F.lit(100.0)).cast(f.kind)
    else:
        value = number.cast(f.kind)
    if f.null_rate > 0:
        value = F.when(_draw(seed, f"{name}?", 10_000) >= int(f.null_rate * 10_000), value)
    return value


def datagen(spark: SparkSession, fields: list[Field], rows: int, seed: int = 0) -> DataFrame:
    """Bounded generated table; the same seed gives the same rows on any number of tasks."""
    return spark.range(rows).select(*[_generated(f, seed).alias(f.name) for f in fields])


def datagen_from(ids: DataFrame, id_col: str, fields: list[Field], seed: int = 0) -> DataFrame:
    """Generated columns for the ids of a table."""
    return ids.select(F.col(id_col).alias("id")).select(
        "id", *[_generated(f, seed).alias(f.name) for f in fields]
    )


def datagen_stream(spark: SparkSession, fields: list[Field], per_second: int, seed: int = 0) -> DataFrame:
    """Unbounded generated table at ``per_second`` rows per second."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.withColumnRenamed("value", "id").select(
        *[_generated(f, seed).alias(f.name) for f in fields]
    )
