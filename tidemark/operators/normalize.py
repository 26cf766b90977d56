"""Normalisation of paths, quantities and configuration over whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths, quantity, settings
from tidemark.plans.lookup import skew_join


def quantity_normalize(
    df: DataFrame, text: str, target: str, owner: list[str] | None = None, exact: bool = False
) -> DataFrame:
    """Quantities parsed and converted to ``target``; summed per owner if one is given."""
    parsed = df.withColumn("_q", quantity.parse(F.col(text)))
    amount = quantity.convert(F.col("_q.value"), F.col("_q.unit"), target, exact)
    if owner is None:
        return (
            parsed.withColumn("value", F.col("_q.value"))
            .withColumn("unit", F.col("_q.unit"))
            .withColumn("amount", amount)
            .drop("_q")
        )
    return parsed.groupBy(*owner).agg(
        F.sum(amount).alias("amount"),
        F.count("_q").alias("n_parsed"),
        F.count(F.when(F.col("_q").isNull() & F.col(text).isNotNull(), 1)).alias("n_malformed"),
    )


def path_normalize(df: DataFrame, path: str, platform_scheme: str = paths.PLATFORM_SCHEME) -> DataFrame:
    """All the forms of a path column."""
    col = F.col(path)
    return df.select(
        *df.columns,
        paths.scheme(col).alias("scheme"),
        paths.without_scheme(col).alias("no_scheme"),
        paths.without_first_slash(col).alias("no_first_slash"),
        paths.pure_path(col).alias("pure_path"),
        paths.file_name(col).alias("file_name"),
        paths.is_s3(col).alias("is_s3"),
        paths.is_platform(col, platform_scheme).alias("is_platform"),
        paths.s3_to_s3p(col).alias("s3p_path"),
    )


def scheme_counts(df: DataFrame, path: str) -> DataFrame:
    """Number of paths per scheme."""
    return df.groupBy(paths.scheme(F.col(path)).alias("scheme")).agg(F.count("*").alias("n"))


def path_to_http(
    df: DataFrame, path: str, host: str, port: int, platform_scheme: str = paths.PLATFORM_SCHEME
) -> tuple[DataFrame, DataFrame]:
    """Rows with their download address, and the rejected rows of other schemes."""
    url = paths.to_http(F.col(path), host, port, platform_scheme)
    mine = paths.is_platform(F.col(path), platform_scheme)
    return df.where(mine).withColumn("http_url", url), df.where(~mine)


def user_libs(
    df: DataFrame,
    ids: list[str],
    jars: str,
    host: str,
    port: int,
    platform_scheme: str = paths.PLATFORM_SCHEME,
) -> DataFrame:
    """File name and download address of each platform jar of a spec."""
    own = F.array_distinct(F.filter(jars, lambda j: paths.is_platform(j, platform_scheme)))
    return df.select(*ids, F.explode(own).alias("_jar")).select(
        *ids,
        paths.file_name(F.col("_jar")).alias("file_name"),
        paths.to_http(F.col("_jar"), host, port, platform_scheme).alias("http_url"),
    )


def s3_required(places: list[Column], jars: Column) -> Column:
    """Does any of the given places or jars lie on S3?"""
    known = F.array_compact(F.concat(F.array(*places), F.coalesce(jars, F.array().cast("array<string>"))))
    return F.exists(known, paths.is_s3)


def plugin_names(names: Column, version: Column, scala: Column) -> Column:
    """Trimmed plugin list without blanks or repeats, known names replaced by their jar name."""
    trimmed = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n.isNotNull() & (n != ""))
    jars = F.transform(trimmed, lambda n: F.coalesce(settings.plugin_jar(n, version, scala), n))
    return F.array_distinct(jars)


def config_merge(layers: DataFrame, owner: list[str], key: str, value: str, layer: str) -> DataFrame:
    """Layered settings in long form; the highest layer that names a key wins."""
    return layers.groupBy(*owner, key).agg(F.max(F.struct(layer, value)).alias("_top")).select(
        *owner, key, f"_top.{value}"
    )


def config_deny_list(
    df: DataFrame, key: str, value: str, denied: list[str] | None = None
) -> DataFrame:
    """Settings with keys and values trimmed, without blanks and without the denied keys."""
    return (
        df.withColumn(key, F.trim(key))
        .withColumn(value, F.trim(value))
        .where((F.col(key) != "") & (F.col(value) != ""))
        .where(~F.col(key).isin(settings.LOCKED_KEYS if denied is None else denied))
    )


def config_mask(df: DataFrame, owner: list[str], key: str, value: str) -> DataFrame:
    """Settings in key order, with secrets hidden."""
    return df.withColumn(value, settings.masked(F.col(key), F.col(value))).orderBy(*owner, key)


def effective_config(
    log: DataFrame,
    session: list[str],
    seq: str,
    kind: str,
    key: str,
    value: str,
    defaults: dict[str, str],
) -> DataFrame:
    """Current settings of each session after its SET and RESET statements.

    RESET of a key gives its initial value back, or removes a key that had none; RESET without a
    key does so for all.  Locked keys are not shown.
    """
    cleared = (
        log.where((F.col(kind) == "RESET") & F.col(key).isNull())
        .groupBy(*session)
        .agg(F.max(seq).alias("_cleared"))
    )
    last = (
        log.where(F.col(key).isNotNull())
        .groupBy(*session, key)
        .agg(F.max(F.struct(seq, kind, value)).alias("_last"))
    )
    initial = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]) if defaults else None
    base = initial[F.col(key)] if defaults else F.lit(None).cast("string")
    touched = skew_join(last, cleared, session, "left", [key]).where(
        F.col("_cleared").isNull() | (F.col("_last")[seq] > F.col("_cleared"))
    )
    now = touched.select(
        *session,
        key,
        F.when(F.col("_last")[kind] == "SET", F.col("_last")[value]).otherwise(base).alias(value),
    )
    if defaults:
        untouched = (
            log.select(*session)
            .distinct()
            .select(*session, F.explode(initial).alias(key, "_initial"))
            .join(touched.select(*session, key), [*session, key], "left_anti")
            .select(*session, key, F.col("_initial").alias(value))
        )
        now = now.unionByName(untouched)
    return now.where(F.col(value).isNotNull() & ~F.col(key).isin(settings.SESSION_LOCKED_KEYS))
