"""Result-set operators over ``events``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import pages, results
from tidemark.operators.keyed import latest_state
from tidemark.queries.base import events, iso, lineitem, orders
from tidemark.session import scratch_dir
from tidemark.sources.tables import table_stream
from tidemark.streaming.windows import run_append

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
#: Rows a file of the results that are kept in order.
PAGED_FILE = 1 << 16
AS_OF = "1999-01-01 00:00:00"


def q_rows_to_json(spark, d):
    return results.rows_to_json(events(spark, d), "fields", keep=["event_id"])


def q_changelog_rows(spark, d):
    log = lineitem(spark, d).select(*LINE_KEY, *LINE_ORDER, "l_quantity", "l_returnflag")
    cols = [*LINE_KEY, "l_quantity", "l_returnflag"]
    early = log.where(F.col("l_shipdate") < F.lit(AS_OF).cast("timestamp_ntz"))
    old = latest_state(early, LINE_KEY, LINE_ORDER).select(*cols)
    # Lines returned in the end are no longer in the store, which gives the -D rows.
    new = latest_state(log, LINE_KEY, LINE_ORDER).where(F.col("l_returnflag") != "R").select(*cols)
    return results.changelog(old, new, LINE_KEY)


def q_retain_first(spark, d):
    ev = events(spark, d).select("event_id", "user_id", "event_type")
    return results.retain_first(ev, "event_id", 16, ["user_id"])


def q_retain_last(spark, d):
    ev = events(spark, d).select("event_id", "user_id", "event_type", "value")
    return results.retain_last(ev, "event_id")


def q_retain_last_by_key(spark, d):
    ev = events(spark, d).select("event_id", "user_id", "event_type")
    return results.retain_last(ev, "event_id", 20, ["user_id"])


def q_result_page(spark, d):
    rows = orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus")
    return results.result_page(rows, "o_orderkey", 3, 1000)


def q_result_page_deep(spark, d):
    rows = orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus")
    return results.result_page(rows, "o_orderkey", 13, 1000, running=True)


def q_result_offset_chunk(spark, d):
    ev = events(spark, d).select("event_id", "user_id", "event_type")
    return results.result_offset_chunk(ev, "event_id", 500, 200)


def q_result_drain(spark, d):
    base = scratch_dir(spark, "drain")
    stream = table_stream(spark, d, "events").select("event_id", "user_id", "event_type")
    run_append(stream, f"{base}/progress", f"{base}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def _kept_orders(spark, d):
    rows = orders(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus")
    return pages.write_ordered(rows, ["o_orderkey"], scratch_dir(spark, "ordered"), file_rows=PAGED_FILE, step=PAGED_FILE // 8)


def q_result_page_indexed(spark, d):
    return pages.page(_kept_orders(spark, d), 2, 1000, running=True)


def q_result_page_views(spark, d):
    """Counters of three pages, the last of which no table of ours reaches."""
    return pages.page_views(_kept_orders(spark, d), [1, 2, 1_000_000], 1000, running=True)


def q_result_chunk_indexed(spark, d):
    """A chunk in the middle, and one behind the last row, which is its cursor alone."""
    kept = _kept_orders(spark, d)
    return pages.chunk(kept, 700, 300).unionByName(pages.chunk(kept, 1 << 60, 300))


def q_latest_result_only(spark, d):
    frames = orders(spark, d).select(
        F.col("o_custkey").alias("session"),
        F.col("o_orderkey").alias("handle_id"),
        F.struct("o_orderdate", "o_orderkey").alias("seq"),
    )
    rows = lineitem(spark, d).select(
        F.col("l_orderkey").alias("handle_id"), "l_linenumber", "l_partkey", iso("l_shipdate").alias("shipped")
    )
    return results.latest_result_only(frames, rows, "session", "handle_id", "seq")


QUERIES = {
    "rows_to_json": q_rows_to_json,
    "changelog_rows": q_changelog_rows,
    "retain_first": q_retain_first,
    "retain_last": q_retain_last,
    "retain_last_by_key": q_retain_last_by_key,
    "result_page": q_result_page,
    "result_page_deep": q_result_page_deep,
    "result_offset_chunk": q_result_offset_chunk,
    "result_page_indexed": q_result_page_indexed,
    "result_page_views": q_result_page_views,
    "result_chunk_indexed": q_result_chunk_indexed,
    "result_drain": q_result_drain,
    "latest_result_only": q_latest_result_only,
}

_ISO = r"regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\.?0+$', '')"
_LATEST = """
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n
    FROM lineitem {where}) WHERE n = 1"""
_PAGE = """
SELECT o_orderkey, o_custkey, o_orderstatus, total_pages, {page} AS page_index,
       {page} < total_pages OR {running} AS has_next_page,
       {page} >= total_pages AND {running} AS has_more_rows
FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET {offset}),
     (SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) AS total_pages FROM orders)"""

SQL = {
    "rows_to_json": f"""
SELECT event_id, '[' || event_id || ',"' || {_ISO} || '",' || user_id || ',"' || event_type || '",'
       || CAST(value AS VARCHAR) || ',' || CAST(to_json(props) AS VARCHAR) || ']' AS fields FROM events""",
    "changelog_rows": f"""
WITH old AS ({_LATEST.format(where=f"WHERE l_shipdate < TIMESTAMP '{AS_OF}'")}),
     new AS (SELECT * FROM ({_LATEST.format(where="")}) WHERE l_returnflag <> 'R'),
     pair AS (SELECT o.l_orderkey AS ok, n.l_orderkey AS nk, coalesce(o.l_orderkey, n.l_orderkey) AS l_orderkey,
                     coalesce(o.l_linenumber, n.l_linenumber) AS l_linenumber,
                     o.l_quantity AS oq, o.l_returnflag AS orf, n.l_quantity AS nq, n.l_returnflag AS nrf
              FROM old o FULL JOIN new n ON o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber)
SELECT '+I' AS op, l_orderkey, l_linenumber, nq AS l_quantity, nrf AS l_returnflag FROM pair WHERE ok IS NULL
UNION ALL SELECT '-D', l_orderkey, l_linenumber, oq, orf FROM pair WHERE nk IS NULL
UNION ALL SELECT '-U', l_orderkey, l_linenumber, oq, orf FROM pair
  WHERE ok IS NOT NULL AND nk IS NOT NULL AND (oq IS DISTINCT FROM nq OR orf IS DISTINCT FROM nrf)
UNION ALL SELECT '+U', l_orderkey, l_linenumber, nq, nrf FROM pair
  WHERE ok IS NOT NULL AND nk IS NOT NULL AND (oq IS DISTINCT FROM nq OR orf IS DISTINCT FROM nrf)""",
    "retain_first": """
SELECT event_id, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 16""",
    "retain_last": """
SELECT * FROM (SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 1024)
ORDER BY event_id""",
    "retain_last_by_key": """
SELECT event_id, user_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20""",
    "result_page": _PAGE.format(page=3, offset=2000, running="false"),
    "result_page_deep": _PAGE.format(page=13, offset=12000, running="true"),
    "result_offset_chunk": """
WITH c AS (SELECT event_id, user_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200)
SELECT *, (SELECT coalesce(max(event_id), 500) FROM c) AS last_offset, false AS has_next FROM c""",
    "result_page_indexed": """
SELECT p.o_orderkey, p.o_custkey, p.o_orderstatus, total_pages, 2 AS page_index, true AS has_next_page,
       2 >= total_pages AS has_more_rows, CAST((SELECT greatest(0, least(1000, count(*) - 1000)) FROM orders) AS BIGINT) AS page_rows
FROM (SELECT CAST(ceil(count(*) / 1000.0) AS BIGINT) AS total_pages FROM orders)
LEFT JOIN (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000 OFFSET 1000) p ON true""",
    "result_page_views": """
SELECT CAST(ceil(n / 1000.0) AS BIGINT) AS total_pages, CAST(page AS INTEGER) AS page_index, true AS has_next_page,
       page >= ceil(n / 1000.0) AS has_more_rows, CAST(greatest(0, least(1000, n - (page - 1) * 1000)) AS BIGINT) AS page_rows
FROM (SELECT count(*) AS n FROM orders), (VALUES (1), (2), (1000000)) AS v(page)""",
    "result_chunk_indexed": """
WITH c AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 700 ORDER BY o_orderkey LIMIT 300)
SELECT *, (SELECT max(o_orderkey) FROM c) AS last_offset, false AS has_next FROM c
UNION ALL SELECT NULL, NULL, NULL, CAST(1152921504606846976 AS BIGINT), false""",
    "result_drain": "SELECT event_id, user_id, event_type FROM events",
    "latest_result_only": """
SELECT l.l_orderkey AS handle_id, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS shipped
FROM lineitem l JOIN (
  SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1) o ON o.o_orderkey = l.l_orderkey""",
}
