"""The relational surface: one SQL statement per operator, run as a SQL job, and UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import sketches
from tidemark.operators.relational import asof_join, interval_join, partial_aggregate
from tidemark.plans.sqljob import register_tables, run_sql_job, run_streaming_job
from tidemark.queries.base import events
from tidemark.session import scratch_dir
from tidemark.sources.tables import table, table_stream

# Exact sums: doubles are added as decimals, so the order of the rows cannot show.
_REVENUE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE)"

# Statements both engines read as they are.
SHARED = {
    "rel_project": ("orders", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders"),
    "rel_filter_like": (
        "part",
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%o%' AND p_size BETWEEN 10 AND 40",
    ),
    "rel_group_count": (
        "orders",
        "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority",
    ),
    "rel_join_inner": (
        "customer orders",
        """SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_custkey) AS n_customers
           FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    ),
    "rel_join_left": (
        "customer orders",
        """SELECT c_custkey, count(o_orderkey) AS n FROM customer
           LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""",
    ),
    "rel_join_full": (
        "orders lineitem",
        """SELECT o.o_orderkey, l.l_orderkey, l.n FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') o
           FULL JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) l
           ON l.l_orderkey = o.o_orderkey""",
    ),
    "rel_join_semi": (
        "customer orders",
        """SELECT c_custkey, c_name FROM customer
           WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
    ),
    "rel_join_anti": (
        "customer orders",
        """SELECT c_custkey, c_name FROM customer
           WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""",
    ),
    "rel_join_range": (
        "orders lineitem",
        """SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
           AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 365 DAY""",
    ),
    "rel_distinct_agg": (
        "lineitem",
        """SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers
           FROM lineitem GROUP BY l_returnflag""",
    ),
    "rel_grouping_sets": (
        "lineitem",
        f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {_REVENUE} AS revenue FROM lineitem
            GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    ),
    "rel_rollup": (
        "lineitem",
        f"""SELECT l_returnflag, l_linestatus, {_REVENUE} AS revenue FROM lineitem
            GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    ),
    "rel_cube": (
        "orders",
        """SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
           GROUP BY CUBE (o_orderstatus, o_orderpriority)""",
    ),
    "rel_window_rank": (
        "lineitem supplier",
        f"""SELECT s_nationkey, l_suppkey, revenue, place FROM (
              SELECT *, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY revenue DESC) AS INT) AS place FROM (
                SELECT s_nationkey, l_suppkey, {_REVENUE} AS revenue
                FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey, l_suppkey) r) p
            WHERE place <= 5""",
    ),
    "rel_window_frame": (
        "lineitem",
        """SELECT l_returnflag, y, n, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY y
             ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS n_near
           FROM (SELECT l_returnflag, CAST(year(l_shipdate) AS INT) AS y, count(*) AS n FROM lineitem
                 GROUP BY l_returnflag, year(l_shipdate)) m""",
    ),
    "rel_topk": (
        "lineitem",
        f"""SELECT l_orderkey, {_REVENUE} AS revenue FROM lineitem GROUP BY l_orderkey
            ORDER BY revenue DESC, l_orderkey LIMIT 25""",
    ),
    "rel_union": (
        "customer supplier",
        """SELECT c_nationkey AS nation, 'c' AS kind, c_custkey AS id FROM customer
           UNION ALL SELECT s_nationkey, 's', s_suppkey FROM supplier""",
    ),
    "rel_intersect": (
        "orders lineitem",
        "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_partkey FROM lineitem",
    ),
    "rel_except": (
        "orders lineitem",
        "SELECT o_orderkey AS id FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'",
    ),
    "rel_scalar_string": (
        "customer",
        """SELECT c_custkey, upper(c_mktsegment) AS u, substring(c_name, 10, 9) AS tail, CAST(length(c_name) AS INT) AS n,
                  replace(c_mktsegment, 'E', '_') AS r, concat(c_mktsegment, '/', c_name) AS both_names,
                  trim(concat(' ', c_mktsegment, ' ')) AS t, lpad(c_mktsegment, 12, '.') AS p FROM customer""",
    ),
    "rel_scalar_date": (
        "orders",
        """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m,
                  CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q,
                  CAST(extract(doy FROM o_orderdate) AS INT) AS doy FROM orders""",
    ),
    "rel_scalar_math": (
        "part",
        """SELECT p_partkey, abs(p_size - 25) AS a, p_size % 7 AS m, CAST(floor(p_size / 4.0) AS BIGINT) AS f,
                  round(p_retailprice * 1.5, 1) AS r, CAST(sign(p_size - 25.0) AS INTEGER) AS s, sqrt(p_size) AS q,
                  greatest(p_size, 30) AS g FROM part""",
    ),
    "rel_subquery": (
        "orders lineitem",
        """SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice >
             (SELECT 10 * max(l_extendedprice) FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""",
    ),
}

# Statements whose text differs between the engines.
SPARK_ONLY = {
    "rel_join_broadcast": (
        "lineitem nation supplier",
        f"""SELECT /*+ BROADCAST(nation) */ n_name, {_REVENUE} AS revenue
            FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
            GROUP BY n_name""",
    ),
    "rel_scalar_array_map": (
        "part",
        """SELECT p_partkey, size(words) AS n, array_join(array_sort(words), ',') AS sorted,
                  array_join(transform(words, w -> upper(w)), ' ') AS upped, map(p_brand, p_type)[p_brand] AS kind
           FROM (SELECT *, split(p_name, ' ') AS words FROM part)""",
    ),
    "rel_scalar_json": (
        "events",
        """SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k,
                  to_json(named_struct('id', event_id, 'kind', event_type)) AS packed FROM events""",
    ),
    "sql_job": (
        "lineitem orders",
        f"""SELECT o_orderpriority, count(*) AS n, {_REVENUE} AS revenue FROM shipped GROUP BY o_orderpriority""",
    ),
}


def _sql_query(tables: str, text: str, before: tuple[str, ...] = ()):
    def build(spark, d):
        register_tables(spark, d, tables.split())
        result, log = run_sql_job(spark, [*before, text], run_last=False)
        if failed := log.where("status = 'Fail'").first():
            raise RuntimeError(f"statement {failed.ordinal}: {failed.error}")
        return result

    return build


_SHIPPED = """CREATE OR REPLACE TEMPORARY VIEW shipped AS
  SELECT * FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F'"""


# The third statement fails on its rows, not when it is analysed.
_LOGGED = (
    "SELECT count(*) AS n FROM orders",
    _SHIPPED,
    "SELECT CAST(o_orderpriority AS INT) AS n FROM orders",
    "SELECT count(*) AS n FROM shipped",
)


def q_sql_job_log(spark, d):
    register_tables(spark, d, ["lineitem", "orders"])
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        _, log = run_sql_job(spark, list(_LOGGED), conf={"spark.sql.ansi.enabled": "true"})
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    return log.select("ordinal", "status", F.col("error").isNotNull().alias("failed"))


def q_sql_job_streaming(spark, d):
    """One list over streams: two tables are defined and filled, one of them by an aggregate, then read together; the run log is joined to it."""
    base = scratch_dir(spark, "job")
    name = f"job_{base[-8:]}"
    statements = [
        f"CREATE TABLE {name}_sales (event_id BIGINT, user_id BIGINT) USING parquet LOCATION '{base}/sales'",
        f"CREATE TABLE {name}_kinds (kind STRING, n BIGINT) USING parquet LOCATION '{base}/kinds'",
        f"INSERT INTO {name}_sales SELECT event_id, user_id FROM arriving WHERE event_type = 'purchase'",
        f"INSERT INTO {name}_kinds SELECT event_type, count(*) FROM arriving GROUP BY event_type",
        f"SELECT count(*) FROM {name}_sales JOIN {name}_kinds ON kind = 'purchase'",
        f"DROP TABLE {name}_sales",
        f"DROP TABLE {name}_kinds",
    ]
    _, log = run_streaming_job(spark, statements, {"arriving": table_stream(spark, d, "events")}, f"{base}/progress", allow_sink=True)
    sales = spark.read.schema("event_id bigint, user_id bigint").parquet(f"{base}/sales")
    kinds = spark.read.schema("kind string, n bigint").parquet(f"{base}/kinds")
    done = log.groupBy(F.col("status").alias("kind")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("bigint")
    return (
        kinds.select(F.lit("kind").alias("part"), "kind", "n", none.alias("event_id"), none.alias("user_id"))
        .unionByName(done.select(F.lit("log").alias("part"), "kind", "n", none.alias("event_id"), none.alias("user_id")))
        .unionByName(sales.select(F.lit("sale").alias("part"), F.lit(None).cast("string").alias("kind"), none.alias("n"), "event_id", "user_id"))
    )


def q_join_asof(spark, d):
    ev = events(spark, d)
    sales = ev.where(F.col("event_type") == "purchase").select("user_id", "event_id", "value")
    clicks = ev.where(F.col("event_type") == "click").select(
        "user_id", "event_id", F.col("event_id").alias("click_id"), F.col("value").alias("click_value")
    )
    return asof_join(sales, clicks, ["user_id"], "event_id", ["click_id", "click_value"])


def q_join_interval(spark, d):
    """Purchases and the errors during them: a purchase lasts as many seconds as its value, an error ten times that."""
    timed = events(spark, d).withColumn("start", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))

    def lasting(kind, factor):
        seconds = F.floor(F.col("value") * factor).cast("bigint")
        return timed.where(F.col("event_type") == kind).select("event_id", "user_id", "start", (F.col("start") + seconds).alias("end"))

    met = interval_join(lasting("purchase", 1), lasting("error", 10), ("start", "end"), ("start", "end"))
    return met.select(F.col("left.event_id").alias("purchase_id"), F.col("right.event_id").alias("error_id"), F.col("right.user_id").alias("user_id"))


def _exact(df, keys, value, name):
    return df.groupBy(*keys).agg(F.count_distinct(value).alias(name))


def q_distinct_sketch(spark, d):
    """One sketch of the orders for each month of shipping, merged over all months; is every estimate within 5 % of the exact count?"""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", F.date_format("l_shipdate", "yyyy-MM").alias("poll"))
    merged = sketches.merged(sketches.distinct_sketches(lines, ["l_returnflag", "poll"], "l_orderkey"), ["l_returnflag"])
    both = merged.join(_exact(lines, ["l_returnflag"], "l_orderkey", "n_orders"), "l_returnflag")
    close = F.abs(sketches.estimate() - F.col("n_orders")) <= 0.05 * F.col("n_orders")
    return both.select("l_returnflag", "n_rows", "n_orders", close.alias("within"))


def q_distinct_turnover(spark, d):
    """Parts shipped in two years by return flag: in both, come and gone, each within 5 % of the parts of either year."""
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_partkey", F.year("l_shipdate").alias("poll"))
    polls = [lines.where(F.col("poll") == year) for year in (1994, 1995)]
    told = sketches.turnover(*[sketches.distinct_sketches(p, ["l_returnflag"], "l_partkey") for p in polls], ["l_returnflag"])
    seen = lines.where(F.col("poll").isin(1994, 1995)).groupBy("l_returnflag", "l_partkey").agg(
        F.max((F.col("poll") == 1994).cast("long")).alias("o"), F.max((F.col("poll") == 1995).cast("long")).alias("n")
    )
    exact = seen.groupBy("l_returnflag").agg(F.sum(F.col("o") * F.col("n")).alias("n_both"), F.sum("o").alias("n_old"), F.sum("n").alias("n_new"), F.count("*").alias("_all"))
    near = told.select("l_returnflag", *[F.col(c).alias(f"_{c}") for c in ("n_both", "n_came", "n_went")]).join(exact, "l_returnflag")
    off = [F.abs(F.col("_n_both") - F.col("n_both")), F.abs(F.col("_n_came") - F.col("n_new") + F.col("n_both")), F.abs(F.col("_n_went") - F.col("n_old") + F.col("n_both"))]
    return near.select("l_returnflag", "n_both", "n_old", "n_new", (F.greatest(*off) <= 0.05 * F.col("_all")).alias("within"))


@F.pandas_udf(T.StringType())
def value_band(value: pd.Series) -> pd.Series:
    """Size class of a value."""
    bands = pd.cut(value, [-np.inf, 10, 100, np.inf], labels=["low", "mid", "high"], right=False)
    return bands.astype(object).where(value.notna(), None)


def q_udf_scalar(spark, d):
    return events(spark, d).select("event_id", value_band("value").alias("band"))


def _value_state(frame: pd.DataFrame) -> pd.DataFrame:
    cents = (frame["value"] * 100).round().astype("int64")
    state = cents.groupby(frame["event_type"]).agg(["sum", "count", "min", "max"])
    return state.reset_index().set_axis(["event_type", "total", "n", "low", "high"], axis=1)


def q_udf_agg(spark, d):
    rows = events(spark, d).select("event_type", "value").where(F.col("value").isNotNull())
    return partial_aggregate(
        rows,
        ["event_type"],
        _value_state,
        "total bigint, n bigint, low bigint, high bigint",
        {"total": F.sum, "n": F.sum, "low": F.min, "high": F.max},
        {
            "n": F.col("n"),
            "mean_cents": F.floor(F.col("total") / F.col("n")).cast("bigint"),
            "range_cents": F.col("high") - F.col("low"),
        },
    )


class WordSplit:
    """Words of a text with their place."""

    def eval(self, text: str):
        for place, word in enumerate((text or "").split(" ")):
            yield place, word


def q_udf_table(spark, d):
    # Arrow would make a batch of each row's words, ten times the work; and the rows are dealt out, as a file of few row groups is few tasks.
    split = F.udtf(WordSplit, returnType="place: int, word: string", useArrow=False)
    spark.udtf.register("word_split", split)
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).createOrReplaceTempView("named_parts")
    return spark.sql("SELECT p_partkey, w.place, w.word FROM named_parts, LATERAL word_split(p_name) w")


QUERIES = {
    **{k: _sql_query(t, s) for k, (t, s) in SHARED.items()},
    **{
        k: _sql_query(t, s, (_SHIPPED,) if k == "sql_job" else ())
        for k, (t, s) in SPARK_ONLY.items()
    },
    "sql_job_log": q_sql_job_log,
    "rel_join_interval": q_join_interval,
    "rel_distinct_sketch": q_distinct_sketch,
    "rel_distinct_turnover": q_distinct_turnover,
    "sql_job_streaming": q_sql_job_streaming,
    "rel_join_asof": q_join_asof,
    "udf_scalar": q_udf_scalar,
    "udf_agg": q_udf_agg,
    "udf_table": q_udf_table,
}

SQL = {
    **{k: s for k, (_, s) in SHARED.items()},
    "rel_join_broadcast": f"""
SELECT n_name, {_REVENUE} AS revenue FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name""",
    "rel_scalar_array_map": """
SELECT p_partkey, CAST(len(words) AS INTEGER) AS n, array_to_string(list_sort(words), ',') AS sorted,
       upper(p_name) AS upped, p_type AS kind
FROM (SELECT *, string_split(p_name, ' ') AS words FROM part)""",
    "rel_scalar_json": """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS packed FROM events""",
    "sql_job": f"""
SELECT o_orderpriority, count(*) AS n, {_REVENUE} AS revenue
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F' GROUP BY o_orderpriority""",
    "rel_join_interval": """
WITH timed AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
SELECT p.event_id AS purchase_id, e.event_id AS error_id, e.user_id AS user_id
FROM timed p JOIN timed e ON p.event_type = 'purchase' AND e.event_type = 'error'
  AND p.s <= e.s + CAST(floor(e.value * 10) AS BIGINT) AND e.s <= p.s + CAST(floor(p.value) AS BIGINT)""",
    "rel_distinct_sketch": """
SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_orders, true AS within FROM lineitem GROUP BY l_returnflag""",
    "rel_distinct_turnover": """
SELECT l_returnflag, CAST(sum(o * n) AS BIGINT) AS n_both, CAST(sum(o) AS BIGINT) AS n_old, CAST(sum(n) AS BIGINT) AS n_new, true AS within
FROM (SELECT l_returnflag, l_partkey, max(CASE year(l_shipdate) WHEN 1994 THEN 1 ELSE 0 END) AS o, max(CASE year(l_shipdate) WHEN 1995 THEN 1 ELSE 0 END) AS n
      FROM lineitem WHERE year(l_shipdate) IN (1994, 1995) GROUP BY ALL) GROUP BY l_returnflag""",
    "sql_job_streaming": """
SELECT 'kind' AS part, event_type AS kind, count(*) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS user_id
FROM events GROUP BY event_type
UNION ALL SELECT 'log', 'Finish', 7, NULL, NULL
UNION ALL SELECT 'sale', NULL, NULL, event_id, user_id FROM events WHERE event_type = 'purchase'""",
    "sql_job_log": """
SELECT CAST(1 AS INTEGER) AS ordinal, 'Finish' AS status, false AS failed
UNION ALL SELECT 2, 'Finish', false
UNION ALL SELECT 3, CASE WHEN bad > 0 THEN 'Fail' ELSE 'Finish' END, bad > 0 FROM (
  SELECT count(*) AS bad FROM orders WHERE o_orderpriority IS NOT NULL AND TRY_CAST(o_orderpriority AS INTEGER) IS NULL)
UNION ALL SELECT 4, CASE WHEN bad > 0 THEN 'Cancel' ELSE 'Finish' END, false FROM (
  SELECT count(*) AS bad FROM orders WHERE o_orderpriority IS NOT NULL AND TRY_CAST(o_orderpriority AS INTEGER) IS NULL)""",
    "rel_join_asof": """
SELECT s.user_id, s.event_id, s.value, c.event_id AS click_id, c.value AS click_value
FROM (SELECT * FROM events WHERE event_type = 'purchase') s
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c
  ON c.user_id = s.user_id AND c.event_id <= s.event_id""",
    "udf_scalar": """
SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'mid'
       WHEN value IS NOT NULL THEN 'high' END AS band FROM events""",
    "udf_agg": """
SELECT event_type, count(*) AS n, CAST(floor(sum(cents) / count(*)) AS BIGINT) AS mean_cents,
       max(cents) - min(cents) AS range_cents
FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events WHERE value IS NOT NULL)
GROUP BY event_type""",
    "udf_table": """
SELECT p_partkey, CAST(unnest(range(len(w))) AS INTEGER) AS place, unnest(w) AS word
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""",
}
