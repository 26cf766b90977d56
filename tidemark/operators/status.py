"""Status-stream operators over events keyed and ordered by a unique increasing ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.lookup import skew_join
from tidemark.plans.ordered import (
    Carry,
    block_of,
    block_window,
    rows_only,
    seen_before,
    with_carry,
)

# Statement states that end a frame, and those that may carry rows.
TERMINAL_STATUS = ["Finish", "Fail", "Cancel"]
STATUS_WITH_ROWS = ["Run", "Finish", "Cancel"]

# Job states known to the platform, and those that mean the job is over.
JOB_STATES = [
    "INITIALIZING", "CREATED", "RUNNING", "FAILING", "FAILED", "CANCELLING",
    "CANCELED", "FINISHED", "RESTARTING", "SUSPENDED", "RECONCILING", "UNKNOWN",
]
INACTIVE_JOB_STATES = ["FAILED", "CANCELED", "FINISHED"]


def changes(
    df: DataFrame,
    keys: list[str],
    seq: str,
    cols: list[str],
    block_rows: int | None = None,
    until: Column | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Rows that differ in ``cols`` from the previous row of their key; the first row is kept.

    ``block`` is a ``block_of`` taken from a table that is cheaper to read than ``df``.

    With ``until``, which may depend on ``cols`` alone, a key ends with its first row for which it
    holds: that row always is a change, so one scan does for both.
    """
    carries = {c: Carry(F.max_by(c, seq), "prev") for c in cols}
    if until is not None:
        df = df.withColumn("_hit", F.coalesce(until, F.lit(False)))
        carries["_hit"] = Carry(F.max("_hit"), "max")
    cut = block if block is not None else block_of(df, seq, block_rows)
    both = with_carry(df, keys, carries, cut)
    state, window = F.struct(*cols), block_window(keys, [seq])
    marked = both.withColumn("_same", state.eqNullSafe(F.lag(state).over(window)))
    if until is None:
        return rows_only(marked.where(~F.col("_same")), "_same")
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max("_hit").over(earlier), F.lit(False))
    return rows_only(
        marked.withColumn("_ended", ended).where(~F.col("_same") & ~F.col("_ended")),
        "_same", "_ended", "_hit",
    )


def first_distinct_errors(
    df: DataFrame,
    keys: list[str],
    seq: str,
    cols: list[str],
    is_error: Column,
    block_rows: int | None = None,
) -> DataFrame:
    """``changes`` among the errors alone: a success between two equal errors does not reset."""
    return changes(df.where(is_error), keys, seq, cols, block_rows)


def take_until_terminal(
    df: DataFrame, keys: list[str], seq: str, is_end: Column, block_rows: int | None = None
) -> DataFrame:
    """Rows of each key up to and including its first terminal one."""
    return seen_before(df, keys, seq, is_end, "_ended", block_rows).where(~F.col("_ended")).drop("_ended")


def last_state(df: DataFrame, keys: list[str], seq: str, is_end: Column) -> DataFrame:
    """The first terminal row of each key by ``seq``, else its newest row, in one aggregation."""
    rest = [c for c in df.columns if c not in keys and c != seq]
    row = F.struct(seq, *rest)
    # Only ``seq`` is compared, so that a column may be a map; as a struct, so that a NULL sorts first.
    place = F.struct(seq)
    found = df.groupBy(*keys).agg(
        F.coalesce(F.min_by(row, F.when(is_end, place)), F.max_by(row, place)).alias("_last")
    )
    return found.select(*keys, "_last.*")


def concat_in_order(df: DataFrame, key: str, seq: str, ids: list) -> DataFrame:
    """The streams of ``ids``, one after the other in the order of that list."""
    place = F.create_map(*[F.lit(x) for i, k in enumerate(ids) for x in (k, i)])
    return (
        df.where(F.col(key).isin(ids))
        .withColumn("position", place[F.col(key)])
        .orderBy("position", seq)
    )


def frames_with_rows(
    frames: DataFrame,
    rows: DataFrame,
    handle: str,
    seq: str,
    status: str,
    is_query: Column,
    block_rows: int | None = None,
) -> DataFrame:
    """Each changed frame paired with its result rows, if its state and kind can have rows."""
    changed = changes(frames, [handle], seq, [status], block_rows)
    may = F.coalesce(F.col(status).isin(STATUS_WITH_ROWS) & is_query, F.lit(False))
    paired = skew_join(rows, changed.where(may), [handle], "inner")
    with_rows = rows.select(handle).distinct().withColumn("_rows", F.lit(True))
    alone = (
        changed.withColumn("_may", may)
        .join(with_rows, handle, "left")
        .where(~F.col("_may") | F.col("_rows").isNull())
        .drop("_may", "_rows")
    )
    return paired.unionByName(alone, allowMissingColumns=True)


def cascade_cancel(
    df: DataFrame, batch: list[str], seq: str, status: str, block_rows: int | None = None
) -> DataFrame:
    """Within a batch everything after the first Fail becomes Cancel."""
    failed = F.col(status) == "Fail"
    seen = seen_before(df, batch, seq, failed, "_failed", block_rows)
    return seen.withColumn(
        status, F.when(F.col("_failed"), F.lit("Cancel")).otherwise(F.col(status))
    ).drop("_failed")


def cancel_log(
    frames: DataFrame, cancels: DataFrame, session: list[str], seq: str, status: str
) -> DataFrame:
    """Cancelling a session turns its waiting and running statements into Cancel."""
    latest = cancels.groupBy(*session).agg(F.max(seq).alias("_cancel_seq"))
    hit = F.col(status).isin("Wait", "Run") & (F.col(seq) < F.col("_cancel_seq"))
    return (
        skew_join(frames, latest, session, "left", [seq])
        .withColumn(status, F.when(hit, F.lit("Cancel")).otherwise(F.col(status)))
        .drop("_cancel_seq")
    )


def handle_listing(frames: DataFrame) -> DataFrame:
    """Handles with their status in the order they were submitted."""
    return frames.select("handle_id", "status", "submit_at_ms").orderBy("submit_at_ms", "handle_id")


def known_job_state(state: Column) -> Column:
    return F.when(state.isin(JOB_STATES), state).otherwise(F.lit("UNKNOWN"))


def is_active(state: Column) -> Column:
    return ~known_job_state(state).isin(INACTIVE_JOB_STATES)


def active_jobs(jobs: DataFrame, state: str, start_ms: str, now_ms: int) -> DataFrame:
    """Jobs that are not over, with their running time at ``now_ms``."""
    return (
        jobs.where(is_active(F.col(state)))
        .withColumn(state, known_job_state(F.col(state)))
        .withColumn("duration_ms", F.lit(now_ms).cast("bigint") - F.col(start_ms))
    )
