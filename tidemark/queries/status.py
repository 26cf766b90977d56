"""Status-stream operators over ``events`` (key user, order event id) and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import entities, status
from tidemark.plans.ordered import block_of
from tidemark.queries.base import (
    choose,
    epoch_ms,
    events,
    lineitem,
    orders,
    sql_choose,
)

JOB_STATE = {"P": "RUNNING", "F": "FINISHED", "O": "CREATED"}
FRAME_STATUS = {"P": "Run", "F": "Finish", "O": "Wait"}
STATEMENT = {"error": "Fail", "click": "Run", "view": "Wait", "signup": "Wait", "purchase": "Finish"}
OPERATION = {"purchase": "COMPLETED", "view": "IN_PROGRESS", "click": "IN_PROGRESS", "signup": "NEW"}
STREAM_ORDER = ["signup", "view", "click", "purchase", "error"]
NOW_MS = 1_100_000_000_000


def q_changes(spark, d):
    ev = events(spark, d).select("event_id", "user_id", "event_type")
    return status.changes(ev, ["user_id"], "event_id", ["event_type"])


def q_first_distinct_errors(spark, d):
    ev = events(spark, d).select(
        "event_id", "user_id", "event_type", F.floor(F.col("value") / 10).alias("error_code")
    )
    is_error = F.col("event_type") == "error"
    return status.first_distinct_errors(ev, ["user_id"], "event_id", ["error_code"], is_error)


def q_take_until_terminal(spark, d):
    ev = events(spark, d).select("event_id", "user_id", "event_type", "value")
    return status.take_until_terminal(ev, ["user_id"], "event_id", F.col("event_type") == "purchase")


def q_last_state(spark, d):
    ev = events(spark, d).select("event_id", "user_id", "event_type", "value")
    return status.last_state(ev, ["user_id"], "event_id", F.col("event_type") == "purchase")


def q_concat_in_order(spark, d):
    ev = events(spark, d).select("event_id", "user_id", "event_type")
    return status.concat_in_order(ev, "event_type", "event_id", STREAM_ORDER)


def _frames(spark, d):
    """An order's life as statement frames: all wait, open ones run, finished ones finish."""
    states = (
        F.when(F.col("o_orderstatus") == "F", F.array(*map(F.lit, ("Wait", "Wait", "Run", "Finish"))))
        .when(F.col("o_orderstatus") == "P", F.array(*map(F.lit, ("Wait", "Run", "Run", "Fail"))))
        .otherwise(F.array(F.lit("Wait"), F.lit("Cancel")))
    )
    return (
        orders(spark, d)
        .select("o_orderkey", "o_orderpriority", F.posexplode(states).alias("i", "status"))
        .select(
            F.col("o_orderkey").alias("handle_id"),
            (F.col("o_orderkey") * 4 + F.col("i")).alias("frame_seq"),
            "status",
            (F.col("o_orderpriority") != "5-LOW").alias("is_query"),
        )
    )


def q_frames_with_rows(spark, d):
    rows = lineitem(spark, d).select(
        F.col("l_orderkey").alias("handle_id"), "l_partkey", "l_linenumber", "l_quantity"
    )
    return status.frames_with_rows(
        _frames(spark, d), rows, "handle_id", "frame_seq", "status", F.col("is_query")
    )


_FRAMES_SQL = """
  SELECT o_orderkey AS handle_id, o_orderkey * 4 + i AS frame_seq, states[i + 1] AS status,
         o_orderpriority <> '5-LOW' AS is_query
  FROM (SELECT *, unnest(range(len(states))) AS i
        FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN ['Wait', 'Wait', 'Run', 'Finish']
                                           WHEN 'P' THEN ['Wait', 'Run', 'Run', 'Fail']
                                           ELSE ['Wait', 'Cancel'] END AS states FROM orders))"""


def _statements(spark, d):
    return events(spark, d).select(
        "user_id",
        F.to_date("ts").cast("string").alias("batch_day"),
        "event_id",
        choose(F.col("event_type"), STATEMENT).alias("status"),
    )


def q_cascade_cancel(spark, d):
    return status.cascade_cancel(_statements(spark, d), ["user_id", "batch_day"], "event_id", "status")


def q_cancel_log(spark, d):
    cancels = events(spark, d).where(F.col("event_type") == "signup").select("user_id", "event_id")
    frames = _statements(spark, d).select("user_id", "event_id", "status")
    return status.cancel_log(frames, cancels, ["user_id"], "event_id", "status")


def q_handle_listing(spark, d):
    frames = orders(spark, d).select(
        F.col("o_orderkey").alias("handle_id"),
        choose(F.col("o_orderstatus"), FRAME_STATUS).alias("status"),
        epoch_ms("o_orderdate").alias("submit_at_ms"),
    )
    return status.handle_listing(frames)


def q_active_jobs(spark, d):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    jobs = orders(spark, d).select(
        F.col("o_custkey").alias("cluster_id"),
        F.col("o_orderkey").alias("job_id"),
        F.when(urgent, F.lit("STRANGE"))
        .otherwise(choose(F.col("o_orderstatus"), JOB_STATE))
        .alias("state"),
        epoch_ms("o_orderdate").alias("start_ms"),
    )
    return status.active_jobs(jobs, "state", "start_ms", NOW_MS)


def _savepoint_polls(spark, d):
    where = F.concat(F.lit("/savepoints/"), F.col("user_id").cast("string"))
    operation = F.when(
        F.col("event_type") == "purchase", F.struct(where.alias("location"))
    )
    payload = F.to_json(
        F.struct(
            F.struct(choose(F.col("event_type"), OPERATION, "BROKEN").alias("id")).alias("status"),
            operation.alias("operation"),
        )
    )
    polls = events(spark, d).select("user_id", "event_id", payload.alias("payload"))
    return entities.savepoint_status(polls, "payload", ["user_id", "event_id"])


def q_savepoint_watch(spark, d):
    polls, block = _savepoint_polls(spark, d), block_of(events(spark, d), "event_id")
    watched = entities.savepoint_watch(polls, ["user_id"], "event_id", block=block)
    return watched.select("user_id", "event_id", "state", "location", "is_completed", "is_failed")


QUERIES = {
    "changes": q_changes,
    "first_distinct_errors": q_first_distinct_errors,
    "take_until_terminal": q_take_until_terminal,
    "last_state": q_last_state,
    "concat_in_order": q_concat_in_order,
    "frames_with_rows": q_frames_with_rows,
    "cascade_cancel": q_cascade_cancel,
    "cancel_log": q_cancel_log,
    "handle_listing": q_handle_listing,
    "active_jobs": q_active_jobs,
    "savepoint_watch": q_savepoint_watch,
}

_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_UNTIL = f"""
  SELECT * FROM (
    SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY event_id {_BEFORE}), 0) AS ended
    FROM events) WHERE ended = 0"""

SQL = {
    "changes": """
SELECT event_id, user_id, event_type
FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
WHERE n = 1 OR event_type IS DISTINCT FROM before""",
    "first_distinct_errors": """
SELECT event_id, user_id, event_type, error_code
FROM (SELECT *, lag(error_code) OVER (PARTITION BY user_id ORDER BY event_id) AS before,
             row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n
      FROM (SELECT *, CAST(floor(value / 10) AS BIGINT) AS error_code
            FROM events WHERE event_type = 'error'))
WHERE n = 1 OR error_code IS DISTINCT FROM before""",
    "take_until_terminal": f"SELECT event_id, user_id, event_type, value FROM ({_UNTIL})",
    "last_state": f"""
SELECT event_id, user_id, event_type, value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM ({_UNTIL}))
WHERE n = 1""",
    "concat_in_order": f"""
SELECT event_id, user_id, event_type,
       CAST(list_position({STREAM_ORDER}, event_type) - 1 AS INTEGER) AS position
FROM events ORDER BY position, event_id""",
    "frames_with_rows": f"""
WITH frames AS ({_FRAMES_SQL}),
changed AS (
  SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY handle_id ORDER BY frame_seq) AS before
                 FROM frames) WHERE status IS DISTINCT FROM before)
SELECT c.handle_id, c.frame_seq, c.status, c.is_query, l.l_partkey, l.l_linenumber, l.l_quantity
FROM changed c LEFT JOIN lineitem l
  ON l.l_orderkey = c.handle_id AND c.is_query AND c.status IN ('Run', 'Finish', 'Cancel')""",
    "cascade_cancel": f"""
SELECT user_id, batch_day, event_id, CASE WHEN failed = 1 THEN 'Cancel' ELSE status END AS status
FROM (SELECT *, max(CASE WHEN status = 'Fail' THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id, batch_day ORDER BY event_id {_BEFORE}) AS failed
      FROM (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS batch_day, event_id,
                   {sql_choose("event_type", STATEMENT)} AS status FROM events))""",
    "cancel_log": f"""
SELECT e.user_id, e.event_id,
       CASE WHEN e.status IN ('Wait', 'Run') AND e.event_id < c.last_cancel THEN 'Cancel'
            ELSE e.status END AS status
FROM (SELECT user_id, event_id, {sql_choose("event_type", STATEMENT)} AS status FROM events) e
LEFT JOIN (SELECT user_id, max(event_id) AS last_cancel FROM events
           WHERE event_type = 'signup' GROUP BY user_id) c ON e.user_id = c.user_id""",
    "handle_listing": f"""
SELECT o_orderkey AS handle_id, {sql_choose("o_orderstatus", FRAME_STATUS)} AS status,
       epoch_ms(o_orderdate) AS submit_at_ms FROM orders ORDER BY submit_at_ms, handle_id""",
    "active_jobs": f"""
SELECT * FROM (
  SELECT o_custkey AS cluster_id, o_orderkey AS job_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'UNKNOWN'
              ELSE {sql_choose("o_orderstatus", JOB_STATE)} END AS state,
         epoch_ms(o_orderdate) AS start_ms, {NOW_MS} - epoch_ms(o_orderdate) AS duration_ms
  FROM orders) WHERE state NOT IN ('FAILED', 'CANCELED', 'FINISHED')""",
    "savepoint_watch": f"""
WITH polls AS (
  SELECT user_id, event_id, event_type = 'purchase' AS is_completed,
         CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'view' THEN 'InProgress'
                         WHEN 'click' THEN 'InProgress' ELSE 'Unknown' END AS state,
         CASE event_type WHEN 'purchase' THEN '/savepoints/' || user_id END AS location
  FROM events),
changed AS (
  SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM polls)
  WHERE state IS DISTINCT FROM before)
SELECT user_id, event_id, state, location, is_completed, false AS is_failed
FROM (SELECT *, coalesce(max(CASE WHEN is_completed THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY event_id {_BEFORE}), 0) AS ended FROM changed)
WHERE ended = 0""",
}
