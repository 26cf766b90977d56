"""Result-set operators: JSON rows, change kinds, bounded retention, paging and offset reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.lookup import skew_join
from tidemark.plans.ordered import GROUP_LIMIT, block_of, first_in_key, page_of_order, rank_in_key

DEFAULT_CAPACITY = 1024
#: Rows up to this place are a top-k, deeper ones are found through blocks; both give the same rows.
SHALLOW_ROWS = 10_000


def _iso(wall_clock: Column) -> Column:
    """Text of a timestamp without zone; a cast, since formatting would take it for a time of the session's zone."""
    return F.translate(wall_clock.cast("string"), " ", "T")


def _plain(value: Column, kind: T.DataType) -> Column:
    """``value`` with timestamps as ISO-8601 text and NULL map keys as '' all the way down."""
    if isinstance(kind, T.TimestampNTZType):
        return _iso(value)
    if isinstance(kind, T.TimestampType):
        # From the epoch: in a zone that changes its clocks, a shifted wall clock may not exist.
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        micros = F.unix_micros(value).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
        utc = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(18,6)"))
        return F.concat(_iso(utc), F.lit("Z"))
    if isinstance(kind, T.StructType):
        fields = [_plain(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(
            F.transform(
                F.map_entries(value),
                lambda e: F.struct(
                    F.coalesce(_plain(e["key"], kind.keyType).cast("string"), F.lit("")),
                    _plain(e["value"], kind.valueType),
                ),
            )
        )
    return value


def rows_to_json(df: DataFrame, name: str = "fields", keep: list[str] | None = None) -> DataFrame:
    """Each row as one positional JSON array of all its columns; ``keep`` columns are kept beside it."""
    cells = []
    for field in df.schema.fields:
        text = F.to_json(
            F.array(_plain(F.col(f"`{field.name}`"), field.dataType)), {"ignoreNullFields": "false"}
        )
        cells.append(F.substring(text, F.lit(2), F.length(text) - 2))
    row = F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))
    return df.select(*(keep or []), row.alias(name))


def changelog(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of two keyed tables as rows tagged +I, -D, or -U and +U."""
    values = [c for c in old.columns if c not in keys]
    row = F.struct(*keys, *values)
    left = old.select(F.struct(*keys).alias("_key"), row.alias("_old"))
    right = new.select(F.struct(*keys).alias("_key"), row.alias("_new"))

    def entry(op: str, side: str) -> Column:
        return F.struct(F.lit(op).alias("op"), F.col(side).alias("row"))

    pair = (
        F.when(F.col("_old").isNull(), F.array(entry("+I", "_new")))
        .when(F.col("_new").isNull(), F.array(entry("-D", "_old")))
        .otherwise(F.array(entry("-U", "_old"), entry("+U", "_new")))
    )
    return (
        left.join(right, "_key", "full")
        .where(~F.col("_old").eqNullSafe(F.col("_new")))
        .select(F.explode(pair).alias("_e"))
        .select("_e.op", "_e.row.*")
    )


def retain_first(
    df: DataFrame,
    seq: str,
    n: int = DEFAULT_CAPACITY,
    keys: list[str] | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """The first ``n`` rows by ``seq`` (of each key, if keys are given); n < 0 keeps everything."""
    return _retain(df, seq, n, keys, block_rows, backwards=False)


def retain_last(
    df: DataFrame,
    seq: str,
    n: int = DEFAULT_CAPACITY,
    keys: list[str] | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """The last ``n`` rows by ``seq`` (of each key, if keys are given); n < 0 keeps everything."""
    return _retain(df, seq, n, keys, block_rows, backwards=True)


def _retain(df, seq, n, keys, block_rows, backwards):
    if n < 0:
        return df
    by = F.col(seq).desc_nulls_last() if backwards else F.col(seq).asc_nulls_first()
    if not keys:
        if n <= SHALLOW_ROWS:
            return df.orderBy(by).limit(n).orderBy(seq)
        return page_of_order(df, seq, 0, n, block_rows, backwards)
    if n <= GROUP_LIMIT:
        return first_in_key(df, keys, [by], n)
    ranked = rank_in_key(df, keys, [seq], block_of(df, seq, block_rows), backwards)
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def result_page(
    df: DataFrame,
    seq: str,
    page: int,
    size: int,
    running: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Page ``page`` (from 1) of the rows in ``seq`` order, with the page counters beside each row."""
    if page < 1 or size < 1:
        raise ValueError("page and size start at 1")
    start = (page - 1) * size
    if start + size <= SHALLOW_ROWS:
        rows = df.orderBy(seq).offset(start).limit(size)
    else:
        rows = page_of_order(df, seq, start, size, block_rows)
    total = df.agg(F.ceil(F.count("*") / F.lit(size)).cast("bigint").alias("n")).scalar()
    here = F.lit(page)
    return (
        rows.withColumn("total_pages", total)
        .withColumn("page_index", here)
        .withColumn("has_next_page", (here < F.col("total_pages")) | F.lit(running))
        .withColumn("has_more_rows", (here >= F.col("total_pages")) & F.lit(running))
    )


def plain_result_page(df: DataFrame) -> DataFrame:
    """A finished non-query result is always page 1 of 1."""
    return (
        df.withColumn("total_pages", F.lit(1).cast("bigint"))
        .withColumn("page_index", F.lit(1))
        .withColumn("has_next_page", F.lit(False))
        .withColumn("has_more_rows", F.lit(False))
    )


def result_offset_chunk(
    df: DataFrame, seq: str, offset: int, chunk: int, running: bool = False
) -> DataFrame:
    """The first ``chunk`` rows after cursor ``offset``, and the cursor to go on from."""
    rows = df.where(F.col(seq) > offset).orderBy(seq).limit(chunk)
    last = rows.agg(F.coalesce(F.max(seq), F.lit(offset)).cast("bigint").alias("last")).scalar()
    return rows.withColumn("last_offset", last).withColumn("has_next", F.lit(running))


def drain(df: DataFrame, seq: str, chunk: int, offset: int = -1):
    """Yield (rows, last_offset) chunk after chunk until none is left; every row comes once."""
    while True:
        after = df.where(F.col(seq) > offset)
        last = after.orderBy(seq).limit(chunk).agg(F.max(seq)).first()[0]
        if last is None:
            return
        yield after.where(F.col(seq) <= last), last
        offset = last


def latest_result_only(frames: DataFrame, rows: DataFrame, session: str, handle: str, seq: str) -> DataFrame:
    """Rows of the most recent query of each session; older handles keep no rows."""
    newest = frames.groupBy(session).agg(F.max_by(handle, seq).alias(handle))
    return skew_join(rows, newest.select(handle), [handle], "left_semi")


def result_of(frames: DataFrame, rows: DataFrame, handle: str) -> DataFrame | None:
    """Rows of one handle: error for an unknown handle, None while it has no result."""
    known = frames.where(F.col("handle_id") == handle).select("has_result").limit(1).collect()
    if not known:
        raise KeyError(f"unknown handle {handle}")
    return rows.where(F.col("handle_id") == handle) if known[0][0] else None
