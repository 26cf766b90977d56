"""Equi-joins and per-key lists that stay balanced when one key holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 4096


def hot_keys(fact: DataFrame, on: list[str], share: int = HOT_SHARE) -> DataFrame:
    """Keys with more than 1/share of all rows, and the number of pieces each is cut into.

    Fewer than ``share`` keys can qualify whatever the data, which is what bounds the broadcast.
    """
    counts = fact.groupBy(F.struct(*on).alias("_hot_key")).agg(F.count("*").alias("_hot_n"))
    total = counts.agg(F.sum("_hot_n").alias("_hot_total")).scalar()
    weighted = counts.withColumn("_hot_total", total)
    return weighted.where(F.col("_hot_n") * share > F.col("_hot_total")).select(
        "_hot_key", F.ceil(F.col("_hot_n") * share / F.col("_hot_total")).cast("int").alias("_hot_pieces")
    )


def fits_broadcast(df: DataFrame) -> bool:
    """Does Catalyst's size estimate for ``df`` stay below the session's broadcast threshold?"""
    session = df.sparkSession
    limit = session._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return limit > 0 and int(str(size)) <= limit


def skew_join(
    fact: DataFrame,
    dim: DataFrame,
    on: list[str],
    how: str = "inner",
    spread_by: list[str] | None = None,
    share: int = HOT_SHARE,
) -> DataFrame:
    """``fact`` join ``dim`` on ``on`` (inner, left, left_semi, left_anti) with hot fact keys cut up.

    Rows of a hot key are spread over its pieces by a hash of ``spread_by`` (all columns unless
    given); the matching ``dim`` rows are repeated once per piece.  All hot keys together have at
    most ``2 * share`` pieces, so little is repeated.  A ``dim`` that Catalyst will broadcast by
    size needs none of this: the fact side is then not shuffled at all.
    """
    if fits_broadcast(dim):
        return fact.join(dim, on, how)
    hot = F.broadcast(hot_keys(fact, on, share))
    key = F.struct(*on)
    spread = F.xxhash64(*(spread_by or fact.columns))
    left = (
        fact.withColumn("_hot_key", key)
        .join(hot, "_hot_key", "left")
        .withColumn("_hot_piece", F.coalesce(F.pmod(spread, F.col("_hot_pieces")).cast("int"), F.lit(0)))
        .drop("_hot_key", "_hot_pieces")
    )
    pieces = F.sequence(F.lit(0), F.coalesce(F.col("_hot_pieces"), F.lit(1)) - 1)
    right = (
        dim.withColumn("_hot_key", key)
        .join(hot, "_hot_key", "left")
        .withColumn("_hot_piece", F.explode(pieces))
        .drop("_hot_key", "_hot_pieces")
    )
    return left.join(right, [*on, "_hot_piece"], how).drop("_hot_piece")


def listed(
    df: DataFrame,
    keys: list[str],
    lists: dict[str, Column],
    piece_rows: int | None = None,
) -> DataFrame:
    """Sorted value lists per key (NULLs left out): one row a key, piece 0, however many values it has.

    With ``piece_rows`` a key has as many pieces as it has that many rows, of about ``piece_rows``
    rows each; equal values are dealt over the pieces too.
    """
    # The owner as one struct, so that NULL keys find their counts too.
    rows = df.select(
        F.struct(*keys).alias("_owner"), *[value.alias(name) for name, value in lists.items()]
    )
    if piece_rows is None:
        whole = rows.groupBy("_owner").agg(*[F.sort_array(F.collect_list(name)).alias(name) for name in lists])
        return whole.select("_owner.*", F.lit(0).alias("piece"), *lists)
    same = rows.groupBy("_owner", *lists).agg(F.count("*").alias("_n"))
    counts = same.groupBy("_owner").agg(
        F.ceil(F.sum("_n") / F.lit(piece_rows)).cast("int").alias("_pieces")
    )
    # A run of equal values goes to the piece of its hash, the next run to the next piece.
    runs = same.withColumn("_run", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / piece_rows).cast("int") - 1)))
    cut = skew_join(runs, counts, ["_owner"]).withColumn(
        "piece", F.pmod(F.pmod(F.xxhash64(*lists), F.col("_pieces")) + F.col("_run"), F.col("_pieces")).cast("int")
    )
    times = F.least(F.lit(piece_rows), F.col("_n") - F.col("_run") * piece_rows).cast("int")
    grouped = cut.groupBy("_owner", "piece").agg(
        *[
            F.sort_array(F.flatten(F.collect_list(F.when(F.col(name).isNotNull(), F.array_repeat(F.col(name), times))))).alias(name)
            for name in lists
        ]
    )
    return grouped.select("_owner.*", "piece", *lists)
