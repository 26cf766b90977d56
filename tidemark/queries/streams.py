"""Streaming forms over the files of ``events``, run until the input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.keyed import apply_change_events
from tidemark.queries.keyed import CURRENT_SQL, as_change_events
from tidemark.queries.status import SQL as STATUS_SQL
from tidemark.session import scratch_dir
from tidemark.sources.tables import table, table_stream
from tidemark.streaming import changelog, joins, stateful, tail
from tidemark.streaming.windows import final_updates, run_append, run_updates, windowed

BOUNDS = ["window_start", "window_end"]


def _counts():
    return [F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("n_sales")]


def _stream(spark, d):
    return table_stream(spark, d, "events")


def _shown(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in BOUNDS})


def _windows(spark, d, name, window, key):
    base = scratch_dir(spark, name)
    stream = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = windowed(stream, window, [key], _counts())
    run_updates(counted, f"{base}/progress", f"{base}/rows").awaitTermination()
    return _shown(final_updates(spark, f"{base}/rows", [*BOUNDS, key]))


def q_stream_tumbling(spark, d):
    return _windows(spark, d, "tumbling", F.window("ts", "1 hour"), "event_type")


def q_stream_sliding(spark, d):
    return _windows(spark, d, "sliding", F.window("ts", "2 hours", "1 hour"), "event_type")


def q_stream_watermark(spark, d):
    """Hours that can get no more rows once rows up to two hours late have been waited for."""
    base = scratch_dir(spark, "watermark")
    stream = (
        _stream(spark, d)
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", "2 hours")
    )
    counted = windowed(stream, F.window("ts", "1 hour"), ["event_type"], _counts())
    run_append(counted, f"{base}/progress", f"{base}/rows").awaitTermination()
    return _shown(spark.read.schema(counted.schema).parquet(f"{base}/rows"))


def q_stream_session(spark, d):
    """Closed sessions: five minutes without an event of the user, half an hour of lateness."""
    base = scratch_dir(spark, "session")
    stream = (
        _stream(spark, d)
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", "30 minutes")
    )
    counted = windowed(stream, F.session_window("ts", "5 minutes"), ["user_id"], _counts())
    run_append(counted, f"{base}/progress", f"{base}/rows").awaitTermination()
    return _shown(spark.read.schema(counted.schema).parquet(f"{base}/rows"))


def q_stream_changes(spark, d):
    base = scratch_dir(spark, "changes")
    stream = _stream(spark, d).select("event_id", "user_id", "event_type")
    stateful.changes_stream(
        stream, ["user_id"], "event_id", ["event_type"], base, f"{base}/rows"
    ).awaitTermination()
    return spark.read.parquet(f"{base}/rows").drop("batch_id")


def q_stream_take_until_terminal(spark, d):
    base = scratch_dir(spark, "until")
    stream = _stream(spark, d).select("event_id", "user_id", "event_type", "value")
    stateful.take_until_terminal_stream(
        stream, ["user_id"], "event_id", F.col("event_type") == "purchase", base, f"{base}/rows"
    ).awaitTermination()
    return spark.read.parquet(f"{base}/rows").drop("batch_id")


def q_stream_retain_last(spark, d):
    base = scratch_dir(spark, "retain")
    stream = _stream(spark, d).select("event_id", "user_id", "event_type")
    stateful.retain_last_stream(stream, ["user_id"], "event_id", 20, base).awaitTermination()
    return stateful.remembered(spark, base)


def q_stream_apply_change_events(spark, d):
    base = scratch_dir(spark, "events")
    stream = as_change_events(_stream(spark, d))
    stateful.apply_change_events_stream(
        stream, ["cluster_id"], "name", "kind", "event_id", base
    ).awaitTermination()
    kept = stateful.remembered(spark, base)
    return apply_change_events(kept, ["cluster_id"], "name", "kind", "event_id")


def q_stream_changelog(spark, d):
    """Running sums of each user in four micro-batches; an error takes an event back. The log of changes, played back."""
    base = scratch_dir(spark, "changelog")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    rows.repartitionByRange(4, "event_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    sale = F.when(F.col("event_type") == "purchase", F.col("event_id")).otherwise(0)
    sign = F.when(F.col("event_type") == "error", -1).otherwise(1)
    sums = {"n": F.lit(1), "sales": sale}
    changelog.running_changelog(stream, ["user_id"], sums, f"{base}/state", f"{base}/rows", sign).awaitTermination()
    kept = changelog.folded(spark, f"{base}/rows", ["user_id"])
    return kept.select("user_id", F.col("n").cast("long").alias("n"), F.col("sales").cast("long").alias("sales"))


def _clicks_and_sales(spark, d, how):
    base = scratch_dir(spark, "join")
    clicks, sales = (
        _stream(spark, d).where(F.col("event_type") == kind).select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
        for kind in ("click", "purchase")
    )
    pairs = joins.interval_join(clicks, sales, ["user_id"], ("ts", "ts"), 0, 6 * 3600, ("1 hour", "1 hour"), how)
    shown = pairs.select("left.user_id", F.col("left.event_id").alias("click_id"), F.col("right.event_id").alias("sale_id"))
    run_append(shown, f"{base}/progress", f"{base}/rows").awaitTermination()
    return spark.read.schema(shown.schema).parquet(f"{base}/rows")


def q_stream_join_interval(spark, d):
    """Clicks and the purchases of the same user in the six hours after."""
    return _clicks_and_sales(spark, d, "inner")


def q_stream_join_outer(spark, d):
    """The same with the clicks that no purchase can follow in time any more."""
    return _clicks_and_sales(spark, d, "left_outer")


def q_stream_tail_follow(spark, d):
    """The last 20 events of each user before a day, then every event from that day on, which come in two lots with a restart between."""
    base = scratch_dir(spark, "tail")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    days = [F.lit(f"{day} 00:00:00").cast("timestamp_ntz") for day in ("2024-01-16", "2024-01-24")]
    lots = [rows.where(F.col("ts") < days[0]), rows.where((F.col("ts") >= days[0]) & (F.col("ts") < days[1])), rows.where(F.col("ts") >= days[1])]
    for lot in lots:
        lot.write.mode("append").parquet(f"{base}/in")
        tail.tail_then_follow(spark, f"{base}/in", rows.schema, "user_id", ["event_id"], 20, f"{base}/out").awaitTermination()
    return tail.followed(spark, rows.schema, f"{base}/out").select("event_id", "user_id", "event_type")


QUERIES = {
    "stream_join_interval": q_stream_join_interval,
    "stream_join_outer": q_stream_join_outer,
    "stream_tail_follow": q_stream_tail_follow,
    "stream_changelog": q_stream_changelog,
    "stream_tumbling": q_stream_tumbling,
    "stream_sliding": q_stream_sliding,
    "stream_session": q_stream_session,
    "stream_watermark": q_stream_watermark,
    "stream_changes": q_stream_changes,
    "stream_take_until_terminal": q_stream_take_until_terminal,
    "stream_retain_last": q_stream_retain_last,
    "stream_apply_change_events": q_stream_apply_change_events,
}

_TIME = "'%Y-%m-%d %H:%M:%S.%f'"
_HOURLY = f"""
SELECT strftime(s, {_TIME}) AS window_start, strftime(s + INTERVAL 1 HOUR, {_TIME}) AS window_end, event_type,
       count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS n_sales
FROM (SELECT *, date_trunc('hour', ts) AS s FROM events)"""

_PAIRS = """
WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
     m AS (SELECT c.user_id, c.event_id AS click_id, p.event_id AS sale_id FROM c JOIN p
           ON p.user_id = c.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR)
SELECT * FROM m"""

SQL = {
    "stream_join_interval": _PAIRS,
    "stream_join_outer": f"""{_PAIRS}
UNION ALL SELECT user_id, event_id, NULL FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.click_id = c.event_id)
  AND ts + INTERVAL 6 HOUR < (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p))) - INTERVAL 1 HOUR""",
    "stream_tail_follow": """
SELECT event_id, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00')
WHERE n <= 20
UNION ALL SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'""",
    "stream_changelog": """
SELECT user_id, CAST(sum(CASE event_type WHEN 'error' THEN -1 ELSE 1 END) AS BIGINT) AS n,
       CAST(sum(CASE event_type WHEN 'purchase' THEN event_id ELSE 0 END) AS BIGINT) AS sales
FROM events GROUP BY user_id HAVING sum(CASE event_type WHEN 'error' THEN -1 ELSE 1 END) <> 0""",
    "stream_tumbling": f"{_HOURLY} GROUP BY s, event_type",
    "stream_sliding": f"""
SELECT strftime(s, {_TIME}) AS window_start, strftime(s + INTERVAL 2 HOUR, {_TIME}) AS window_end, event_type,
       count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS n_sales
FROM (SELECT *, date_trunc('hour', ts) - to_hours(b) AS s FROM events, (VALUES (0), (1)) AS v(b))
GROUP BY s, event_type""",
    "stream_watermark": f"""{_HOURLY}
WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY s, event_type""",
    "stream_session": f"""
SELECT strftime(min(ts), {_TIME}) AS window_start, strftime(max(ts) + INTERVAL 5 MINUTE, {_TIME}) AS window_end,
       user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS n_sales
FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 5 MINUTE
                 THEN 0 ELSE 1 END AS fresh FROM events))
GROUP BY user_id, session
HAVING max(ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE""",
    "stream_changes": STATUS_SQL["changes"],
    "stream_take_until_terminal": STATUS_SQL["take_until_terminal"],
    "stream_retain_last": """
SELECT event_id, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20""",
    "stream_apply_change_events": f"""
SELECT cluster_id, name, event_id, CASE event_type WHEN 'signup' THEN 'Added' ELSE 'Modified' END AS kind,
       props AS payload FROM ({CURRENT_SQL})""",
}
