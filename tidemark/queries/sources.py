"""Sources and sinks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.entities import parse_json
from tidemark.queries.base import events, lineitem, orders
from tidemark.session import scratch_dir
from tidemark.sources import files, sinks
from tidemark.sources.tables import Field, datagen_from, inline_rows, table

LABELS = [("click", "use"), ("view", "use"), ("purchase", "sale"), ("signup", "join"), ("signup", "sale")]
GENERATED = [
    Field("order_number", "bigint", 0, 1_000_000),
    Field("price", "decimal(32,2)", 5, 900),
    Field("buyer", "row", fields=(Field("first_name", "string"), Field("last_name", "string"))),
    Field("mset", "multiset", 0, 50),
    Field("order_time", "timestamp", 0, 86_400),
    Field("age", "int", 0, 1000, null_rate=0.05),
]


def q_src_parquet(spark, d):
    return lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")


def q_src_datagen(spark, d):
    """One generated row per order, and how many of them keep to what was asked for."""
    rows = datagen_from(orders(spark, d), "o_orderkey", GENERATED, seed=7)
    first_day = F.to_date("order_time") == F.lit("2024-01-01").cast("date")
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count(F.when(F.col("order_number").between(0, 999_999), 1)).alias("n_number"),
        F.count(F.when(F.col("price").between(5, 900), 1)).alias("n_price"),
        F.count(F.when(F.startswith(F.col("buyer.first_name"), F.lit("first_name_")), 1)).alias("n_buyer"),
        F.count(F.when(F.size("mset") == 1, 1)).alias("n_mset"),
        F.count(F.when(first_day, 1)).alias("n_time"),
        F.count(F.when(F.col("age").isNull() | F.col("age").between(0, 999), 1)).alias("n_age"),
    )


def q_src_values(spark, d):
    labels = inline_rows(spark, LABELS, ["event_type", "label"])
    return (
        events(spark, d)
        .join(labels, "event_type")
        .groupBy("label")
        .agg(F.count("*").alias("n"))
    )


def q_src_json_snapshot(spark, d):
    parsed = parse_json(events(spark, d).select("event_id", "user_id", "props"), "props", "k int")
    return parsed.select("event_id", "user_id", "k")


def q_src_log_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("pod"), "lang", "text")
    lines = files.text_lines(docs, ["doc_id", "pod", F.col("lang").alias("container")], "text")
    return files.log_lines(lines, "pod", ["doc_id", "line_no"], tail_lines=40)


def q_src_log_since(spark, d):
    lines = events(spark, d).select(
        F.col("user_id").alias("pod"), F.col("event_type").alias("container"), "event_id", "ts"
    )
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    recent = files.log_lines(
        lines, "pod", ["event_id"], container="click", since_s=86_400 * 10, ts="ts", now=now
    )
    return recent.select("pod", "container", "event_id")


def q_src_file_manifest(spark, d):
    found = files.file_manifest(spark, d, "*.parquet")
    return found.withColumn("path", F.element_at(F.split("path", "/"), -1))


def _doc_manifest(docs):
    path = F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string"))
    return docs.select(path.alias("path"), F.length("text").cast("bigint").alias("size"), F.md5("text").alias("md5"))


def q_file_manifest_diff(spark, d):
    docs = table(spark, d, "documents")
    kept = docs.where(F.col("lang") != "de").withColumn(
        "text", F.when(F.col("lang") == "fr", F.upper("text")).otherwise(F.col("text"))
    )
    return files.file_manifest_diff(_doc_manifest(docs), _doc_manifest(kept))


def q_sink_insert_select(spark, d):
    target = f"{scratch_dir(spark, 'insert')}/big"
    picked = events(spark, d).where(F.col("event_type").like("%i%")).select("event_id", "event_type", "value")
    sinks.insert_select(picked, target, allow_sink=True)
    return spark.read.schema(picked.schema).parquet(target)


def q_sink_statement_set(spark, d):
    base = scratch_dir(spark, "set")
    shared = events(spark, d).select("event_id", "user_id", "event_type", "value")
    inserts = [
        (f"{base}/sales", lambda s: s.where(F.col("event_type") == "purchase").select("event_id", "user_id")),
        (f"{base}/rest", lambda s: s.where(F.col("event_type") != "purchase").select("event_id", "user_id")),
    ]
    sinks.statement_set(shared, inserts, allow_sink=True)
    schema = "event_id bigint, user_id bigint"
    sales, rest = (spark.read.schema(schema).parquet(t) for t, _ in inserts)
    return sales.withColumn("target", F.lit("sales")).unionByName(rest.withColumn("target", F.lit("rest")))


QUERIES = {
    "src_parquet": q_src_parquet,
    "src_datagen": q_src_datagen,
    "src_values": q_src_values,
    "src_json_snapshot": q_src_json_snapshot,
    "src_log_lines": q_src_log_lines,
    "src_log_since": q_src_log_since,
    "src_file_manifest": q_src_file_manifest,
    "file_manifest_diff": q_file_manifest_diff,
    "sink_insert_select": q_sink_insert_select,
    "sink_statement_set": q_sink_statement_set,
}

_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in LABELS)

SQL = {
    "src_parquet": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag FROM lineitem",
    "src_datagen": """
SELECT n AS n_rows, n AS n_number, n AS n_price, n AS n_buyer, n AS n_mset, n AS n_time, n AS n_age
FROM (SELECT count(*) AS n FROM orders)""",
    "src_values": f"""
SELECT label, count(*) AS n FROM events JOIN (VALUES {_VALUES}) AS v(event_type, label)
  ON v.event_type = events.event_type GROUP BY label""",
    "src_json_snapshot": """
SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "src_log_lines": """
SELECT doc_id, pod, container, CAST(line_no AS INTEGER) AS line_no, line FROM (
  SELECT *, row_number() OVER (PARTITION BY pod ORDER BY doc_id DESC, line_no DESC) AS n FROM (
    SELECT doc_id, source AS pod, lang AS container, unnest(range(len(lines))) AS line_no, unnest(lines) AS line
    FROM (SELECT *, string_split(text, chr(10)) AS lines FROM documents)))
WHERE n <= 40""",
    "src_log_since": """
SELECT user_id AS pod, event_type AS container, event_id FROM events
WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10 00:00:00'""",
    "file_manifest_diff": """
SELECT source || '/' || doc_id AS path, CAST(length(text) AS BIGINT) AS size, md5(text) AS md5,
       CASE WHEN lang = 'de' THEN 'missing' WHEN lang = 'fr' AND upper(text) <> text THEN 'stale' ELSE 'hit' END AS verdict
FROM documents""",
    "sink_insert_select": "SELECT event_id, event_type, value FROM events WHERE event_type LIKE '%i%'",
    "sink_statement_set": """
SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN 'sales' ELSE 'rest' END AS target FROM events""",
}
