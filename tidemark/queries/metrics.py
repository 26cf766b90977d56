"""Metric operators over ``events``: entity user, value the event value as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.queries.base import events

TYPES = ["click", "error", "purchase", "signup", "view"]
DOUBLES = {"click", "view"}
OTHER_IDS = ["Status.Unheard.Of", "madeUp"]


def _long_rows(spark, d):
    """Clicks and views carry decimals, errors and signups whole numbers, purchases a bad whole number."""
    kind, value = F.col("event_type"), F.col("value")
    text = (
        F.when(kind.isin("click", "view"), value.cast("string"))
        .when(kind == "purchase", F.concat(F.floor(value).cast("string"), F.lit("x")))
        .otherwise(F.floor(value).cast("string"))
    )
    return events(spark, d).select("user_id", "event_id", kind.alias("metric"), text.alias("value"))


def q_metric_pivot(spark, d):
    return metrics.metric_pivot(
        _long_rows(spark, d), ["user_id"], "metric", "value", "event_id", TYPES, DOUBLES
    )


def _spread_rows(spark, d, keys):
    ids = [*keys, *OTHER_IDS]
    at = (F.col("event_id") % len(ids) + 1).cast("int")
    metric = F.element_at(F.array(*map(F.lit, ids)), at)
    whole = F.floor(F.col("value")).cast("string")
    text = F.when(metric.isin(list(metrics.DOUBLE_METRICS)), F.col("value").cast("string")).otherwise(whole)
    return events(spark, d).select("user_id", "event_id", metric.alias("metric"), text.alias("value"))


def _pivot_of(keys):
    def build(spark, d):
        rows = _spread_rows(spark, d, keys)
        return metrics.metric_pivot(rows, ["user_id"], "metric", "value", "event_id", keys)

    return build


def q_metric_select(spark, d):
    return metrics.metric_select(_long_rows(spark, d), "metric", ["click", "purchase"])


def q_metric_ids(spark, d):
    rows = _spread_rows(spark, d, metrics.JOB_METRICS).withColumn(
        "kind", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd")
    )
    return metrics.metric_ids(rows, ["kind"], "metric")


def q_metric_type_infer(spark, d):
    return metrics.metric_type_infer(_long_rows(spark, d), "metric", "value")


def q_metric_field_name(spark, d):
    ids = metrics.metric_ids(_spread_rows(spark, d, metrics.TASKMANAGER_METRICS), [], "metric")
    return ids.select("metric", metrics.metric_field_name(F.col("metric")).alias("field_name"))


KINDS = {
    "metric_pivot_jobmanager": metrics.JOBMANAGER_METRICS,
    "metric_pivot_taskmanager": metrics.TASKMANAGER_METRICS,
    "metric_pivot_job": metrics.JOB_METRICS,
}

QUERIES = {
    "metric_pivot": q_metric_pivot,
    **{name: _pivot_of(keys) for name, keys in KINDS.items()},
    "metric_select": q_metric_select,
    "metric_ids": q_metric_ids,
    "metric_type_infer": q_metric_type_infer,
    "metric_field_name": q_metric_field_name,
}

_LONG = """(SELECT user_id, event_id, event_type AS metric,
  CASE WHEN event_type IN ('click', 'view') THEN CAST(value AS VARCHAR)
       WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) || 'x'
       ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value FROM events)"""


def _spread_sql(keys: list[str]) -> str:
    ids = [*keys, *OTHER_IDS]
    real = ", ".join(f"'{k}'" for k in sorted(metrics.DOUBLE_METRICS))
    return f"""(SELECT user_id, event_id, metric,
  CASE WHEN metric IN ({real}) THEN CAST(value AS VARCHAR)
       ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS value
  FROM (SELECT *, ({ids})[event_id % {len(ids)} + 1] AS metric FROM events))"""


def _pivot_sql(source: str, keys: list[str], doubles: set[str]) -> str:
    """Newest value per entity and metric by window, then one conditional aggregate per metric."""
    cols = []
    for key in keys:
        kind = "DOUBLE" if key in doubles else "BIGINT"
        cols.append(
            f"max(TRY_CAST(CASE WHEN metric = '{key}' THEN value END AS {kind})) AS {metrics.field_name_text(key)}"
        )
    listed = ", ".join(f"'{k}'" for k in keys)
    real = ", ".join(f"'{k}'" for k in keys if k in doubles) or "''"
    newest = f"""SELECT *, row_number() OVER (PARTITION BY user_id, metric ORDER BY event_id DESC) AS n
      FROM {source} WHERE metric IN ({listed})"""
    bad = f"""SELECT user_id, count(*) AS bad FROM {source} WHERE metric IN ({listed}) AND
      CASE WHEN metric IN ({real}) THEN TRY_CAST(value AS DOUBLE) IS NULL
           ELSE NOT regexp_matches(value, '^[+-]?[0-9]+$') END GROUP BY user_id"""
    return f"""
SELECT p.*, coalesce(bad, 0) AS malformed
FROM (SELECT user_id, {", ".join(cols)} FROM ({newest}) WHERE n = 1 GROUP BY user_id) p
LEFT JOIN ({bad}) b ON b.user_id = p.user_id"""


_NAME = "replace(replace(regexp_replace(translate(metric, '._', ''), '^Status', ''), 'JVM', 'jvm'), 'CPU', 'Cpu')"

SQL = {
    "metric_pivot": _pivot_sql(_LONG, TYPES, DOUBLES),
    **{
        name: _pivot_sql(_spread_sql(keys), keys, metrics.DOUBLE_METRICS) for name, keys in KINDS.items()
    },
    "metric_select": f"SELECT * FROM {_LONG} WHERE metric IN ('click', 'purchase')",
    "metric_ids": f"""
SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, metric
FROM {_spread_sql(metrics.JOB_METRICS)}""",
    "metric_type_infer": f"""
SELECT metric, CASE WHEN bool_or(contains(value, '.')) THEN 'Double' ELSE 'Long' END AS metric_type,
       {_NAME} AS field_name FROM {_LONG} GROUP BY metric""",
    "metric_field_name": f"""
SELECT DISTINCT metric, {_NAME} AS field_name FROM {_spread_sql(metrics.TASKMANAGER_METRICS)}""",
}
