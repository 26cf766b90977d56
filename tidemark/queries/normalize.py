"""Normalisation operators over ``pages``, ``lineitem``, ``part``, ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import settings
from tidemark.operators import normalize
from tidemark.queries.base import events, lineitem, orders
from tidemark.sources.tables import table

HOST, PORT = "files.example", 3400
UNIT_BY_LINE = ["", "m", "k", "Ki", "Mi", "u", "M"]


def _quantities(spark, d):
    unit = F.element_at(F.array(*map(F.lit, UNIT_BY_LINE)), F.col("l_linenumber"))
    text = F.when(F.col("l_returnflag") == "R", F.lit("much")).otherwise(
        F.concat(F.col("l_quantity").cast("int").cast("string"), unit)
    )
    return lineitem(spark, d).select("l_suppkey", "l_orderkey", "l_linenumber", text.alias("text"))


def _micro(amount: Column) -> Column:
    return F.round(amount * 1e6).cast("bigint")


def q_quantity_normalize(spark, d):
    out = normalize.quantity_normalize(_quantities(spark, d), "text", "k")
    return out.withColumn("amount", _micro(F.col("amount"))).drop("l_suppkey")


def q_quantity_exact(spark, d):
    out = normalize.quantity_normalize(_quantities(spark, d), "text", "Ki", exact=True)
    return out.select("l_orderkey", "l_linenumber", "text", F.round("amount", 3).alias("amount"))


def q_quantity_rollup(spark, d):
    out = normalize.quantity_normalize(_quantities(spark, d), "text", "k", ["l_suppkey"])
    # The parts are multiples of 1e-6, so the offset keeps the sum's rounding error off the edges.
    return out.withColumn("amount", F.floor(F.col("amount") * 100 + 0.00003).cast("bigint"))


def _paths(spark, d):
    bare = F.regexp_replace("url", "^https?://", "")
    kind = F.col("page_id") % 6
    path = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.concat(F.lit("s3a://"), bare))
        .when(kind == 2, F.concat(F.lit("store:///"), bare))
        .when(kind == 3, F.concat(F.lit("/"), bare))
        .when(kind == 4, F.concat(F.lit("s3://"), bare, F.lit("/")))
        .otherwise(F.lit("s3"))
    )
    return table(spark, d, "pages").select("page_id", path.alias("path"))


def q_path_normalize(spark, d):
    return normalize.path_normalize(_paths(spark, d), "path")


def q_path_scheme_counts(spark, d):
    return normalize.scheme_counts(_paths(spark, d), "path")


def q_path_to_http(spark, d):
    good, bad = normalize.path_to_http(_paths(spark, d), "path", HOST, PORT)
    return good.unionByName(bad, allowMissingColumns=True)


def _jar(name: str) -> Column:
    return F.concat(F.lit(f"{name}-"), F.col("o_custkey").cast("string"), F.lit(".jar"))


def _specs(spark, d):
    jars = F.array(
        F.concat(F.lit("store://libs/"), _jar("a")),
        F.concat(F.when(F.col("o_orderstatus") == "F", F.lit("s3a://libs/")).otherwise(F.lit("file:///libs/")), _jar("b")),
        F.concat(F.lit("store://"), _jar("c")),
    )
    low = F.col("o_orderpriority") == "5-LOW"
    return orders(spark, d).select(
        F.col("o_orderkey").alias("spec_id"),
        F.when(low, F.lit("s3p://ckpt")).otherwise(F.lit("hdfs://ckpt")).alias("checkpoint_dir"),
        F.lit(None).cast("string").alias("savepoint_dir"),
        F.when(F.col("o_orderpriority") == "2-HIGH", F.lit("s3://ha")).alias("ha_dir"),
        jars.alias("jars"),
    )


def q_user_libs(spark, d):
    return normalize.user_libs(_specs(spark, d), ["spec_id"], "jars", HOST, PORT)


def q_s3_required(spark, d):
    places = [F.col("checkpoint_dir"), F.col("savepoint_dir"), F.col("ha_dir")]
    return _specs(spark, d).select("spec_id", normalize.s3_required(places, F.col("jars")).alias("s3_required"))


def q_id_codec(spark, d):
    packed = orders(spark, d).select(
        "o_orderkey",
        settings.cluster_id(
            F.concat(F.lit("c-"), F.col("o_custkey").cast("string")), F.lower("o_orderstatus")
        ).alias("entity_id"),
    )
    return packed.select("*", settings.split_cluster_id(F.col("entity_id")).alias("k")).select(
        "o_orderkey", "entity_id", "k.*"
    )


def q_major_version(spark, d):
    version = F.concat_ws(
        ".",
        F.lit("1"),
        F.when(F.col("p_size") > 5, (F.col("p_size") % 4 + 13).cast("string")),
        F.when(F.col("p_size") > 10, F.col("p_size").cast("string")),
    )
    major = settings.major_version(F.col("version"))
    return table(spark, d, "part").select("p_partkey", version.alias("version")).select(
        "p_partkey", "version", major.alias("major"), major.isin(settings.SUPPORTED_VERSIONS).alias("supported")
    )


def q_plugin_names(spark, d):
    names = F.array(
        F.lit(" flink-s3-fs-presto "),
        F.when(F.col("p_size") > 10, F.lit("flink-cep")).otherwise(F.lit("  ")),
        F.col("p_name"),
        F.lit("flink-s3-fs-presto"),
        F.lit(None).cast("string"),
    )
    jars = normalize.plugin_names(names, F.lit("1.16.1"), F.lit("2.12"))
    return table(spark, d, "part").select("p_partkey", F.array_join(jars, ";").alias("plugins"))


def _typed_settings() -> dict[str, Column]:
    size = F.col("p_size")
    tags = F.filter(F.array(F.col("p_brand"), F.when(size > 25, F.col("p_type"))), lambda t: t.isNotNull())
    return {
        "memory": F.concat(settings.valid_or(size, size > 10, 1920).cast("string"), F.lit("m")),
        "dir": F.when(size > 20, F.concat(F.lit("/tmp/"), F.col("p_brand"))),
        "blank": F.lit(""),
        "tags": tags,
        "labels": F.when(size > 5, F.create_map(F.lit("kind"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))),
        "none": F.filter(F.array(F.lit("x")), lambda t: t == "y"),
    }


def _flat(conf: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(conf)), lambda e: F.concat(e["key"], F.lit(" -> "), e["value"]))
    return F.array_join(pairs, "|")


def _settings_text(spark, d, sep: str, pair: str, empty: str | None):
    typed = _typed_settings()
    text = {
        **typed,
        "tags": settings.joined(typed["tags"], sep),
        "none": settings.joined(typed["none"], sep),
        "labels": settings.joined_map(typed["labels"], pair, sep),
    }
    conf = settings.present(text, empty)
    return table(spark, d, "part").select("p_partkey", _flat(conf).alias("conf"))


def q_config_flatten(spark, d):
    return _settings_text(spark, d, ",", ":", None)


def q_config_set(spark, d):
    return _settings_text(spark, d, ";", "=", "")


def _layers(spark, d):
    size = F.col("p_size").cast("string")
    rows = [
        (0, "image", F.lit("base")),
        (1, "memory", size),
        (2, "image", F.when(F.col("p_size") > 25, F.lit("big"))),
        (3, "s3.secret-key", F.col("p_brand")),
        (4, " kubernetes.namespace ", F.col("p_type")),
        (4, "memory", F.when(F.col("p_size") > 40, F.lit(" huge "))),
        (5, "note ", F.when(F.col("p_size") > 10, F.lit(" "))),
        (5, "deploy.source", F.lit("tidemark")),
    ]
    cells = F.array(
        *[F.struct(F.lit(n).alias("layer"), F.lit(k).alias("key"), v.alias("value")) for n, k, v in rows]
    )
    return (
        table(spark, d, "part")
        .select("p_partkey", F.explode(cells).alias("c"))
        .select("p_partkey", "c.*")
        .where(F.col("value").isNotNull())
    )


def q_config_merge(spark, d):
    return normalize.config_merge(_layers(spark, d), ["p_partkey"], "key", "value", "layer")


def q_config_deny_list(spark, d):
    return normalize.config_deny_list(_layers(spark, d), "key", "value")


def q_config_mask(spark, d):
    merged = normalize.config_merge(_layers(spark, d), ["p_partkey"], "key", "value", "layer")
    return normalize.config_mask(merged, ["p_partkey"], "key", "value")


def q_config_clamp(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey",
        settings.at_least(size, 10).alias("slots"),
        settings.valid_or(size, size > 20, 1920).alias("memory"),
        settings.at_least(F.col("p_retailprice"), 950.5).alias("cpu"),
    )


CONFIG_DEFAULTS = {"parallelism": "1", "mode": "streaming", "pipeline.jars": "a.jar"}


def q_effective_config(spark, d):
    kind = F.when(F.col("event_type").isin("click", "view"), "SET").otherwise("RESET")
    key = F.when(
        F.col("event_type") != "error",
        F.element_at(F.array(*map(F.lit, ("parallelism", "mode", "color", "size"))), (F.col("event_id") % 4 + 1).cast("int")),
    )
    key = F.when((F.col("event_type") == "error") & (F.col("value") <= 150), F.lit("color")).otherwise(key)
    log = events(spark, d).select(
        "user_id", "event_id", kind.alias("kind"), key.alias("key"), F.floor("value").cast("string").alias("value")
    )
    return normalize.effective_config(log, ["user_id"], "event_id", "kind", "key", "value", CONFIG_DEFAULTS)


QUERIES = {
    "quantity_normalize": q_quantity_normalize,
    "quantity_exact": q_quantity_exact,
    "quantity_rollup": q_quantity_rollup,
    "path_normalize": q_path_normalize,
    "path_scheme_counts": q_path_scheme_counts,
    "path_to_http": q_path_to_http,
    "user_libs": q_user_libs,
    "s3_required": q_s3_required,
    "id_codec": q_id_codec,
    "major_version": q_major_version,
    "plugin_names": q_plugin_names,
    "config_flatten": q_config_flatten,
    "config_set": q_config_set,
    "config_merge": q_config_merge,
    "config_deny_list": q_config_deny_list,
    "config_mask": q_config_mask,
    "config_clamp": q_config_clamp,
    "effective_config": q_effective_config,
}

_Q = f"""(SELECT *, CASE WHEN l_returnflag = 'R' THEN 'much' ELSE CAST(l_quantity AS INTEGER) || u END AS text,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS value,
    CASE WHEN l_returnflag <> 'R' THEN CASE WHEN u = '' THEN 'k' ELSE u END END AS unit
  FROM (SELECT *, ({UNIT_BY_LINE})[l_linenumber] AS u FROM lineitem))"""
_TO_K = """CASE unit WHEN 'k' THEN value WHEN 'm' THEN value * 0.001 WHEN 'u' THEN value * 0.000001
  WHEN 'M' THEN value * 1000 WHEN 'Ki' THEN value / 1.024 WHEN 'Mi' THEN value / 1.024 * 1000 END"""
_TO_KI_EXACT = """CASE unit WHEN 'k' THEN value * 1000 / 1024 WHEN 'm' THEN value / 1024 WHEN 'u' THEN value / 1024000
  WHEN 'M' THEN value * 1000000 / 1024 WHEN 'Ki' THEN value WHEN 'Mi' THEN value * 1024 END"""
_BARE = "regexp_replace(url, '^https?://', '')"
_PATHS = f"""(SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 's3a://' || {_BARE}
    WHEN 2 THEN 'store:///' || {_BARE} WHEN 3 THEN '/' || {_BARE} WHEN 4 THEN 's3://' || {_BARE} || '/'
    ELSE 's3' END AS path, {_BARE} AS bare, page_id % 6 AS kind, regexp_extract(url, '^[a-z]+') AS web FROM pages)"""
_SCHEME = "CASE kind WHEN 0 THEN web WHEN 1 THEN 's3a' WHEN 2 THEN 'store' WHEN 4 THEN 's3' END"
_PURE = "CASE kind WHEN 4 THEN bare || '/' WHEN 5 THEN 's3' ELSE bare END"
_LAYERS = """(SELECT p_partkey, layer, key, value FROM part, LATERAL (VALUES
    (0, 'image', 'base'), (1, 'memory', CAST(p_size AS VARCHAR)),
    (2, 'image', CASE WHEN p_size > 25 THEN 'big' END), (3, 's3.secret-key', p_brand),
    (4, ' kubernetes.namespace ', p_type), (4, 'memory', CASE WHEN p_size > 40 THEN ' huge ' END),
    (5, 'note ', CASE WHEN p_size > 10 THEN ' ' END), (5, 'deploy.source', 'tidemark')) AS v(layer, key, value)
  WHERE value IS NOT NULL)"""
_MERGED = f"""(SELECT p_partkey, key, value FROM (
    SELECT *, row_number() OVER (PARTITION BY p_partkey, key ORDER BY layer DESC) AS n FROM {_LAYERS}) WHERE n = 1)"""
_KINDS = """(SELECT user_id, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'SET' ELSE 'RESET' END AS kind,
    CASE WHEN event_type = 'error' THEN CASE WHEN value <= 150 THEN 'color' END
         ELSE (['parallelism', 'mode', 'color', 'size'])[event_id % 4 + 1] END AS key,
    CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS value FROM events)"""

SQL = {
    "quantity_normalize": f"""
SELECT l_orderkey, l_linenumber, text, value, unit, CAST(round(({_TO_K}) * 1e6) AS BIGINT) AS amount FROM {_Q}""",
    "quantity_exact": f"""
SELECT l_orderkey, l_linenumber, text, round({_TO_KI_EXACT}, 3) AS amount FROM {_Q}""",
    "quantity_rollup": f"""
SELECT l_suppkey, CAST(floor(sum({_TO_K}) * 100 + 0.00003) AS BIGINT) AS amount, count(value) AS n_parsed,
       count(*) - count(value) AS n_malformed FROM {_Q} GROUP BY l_suppkey""",
    "path_normalize": f"""
SELECT page_id, path, {_SCHEME} AS scheme,
       CASE kind WHEN 2 THEN '/' || bare WHEN 3 THEN '/' || bare ELSE {_PURE} END AS no_scheme,
       CASE kind WHEN 3 THEN bare ELSE path END AS no_first_slash, {_PURE} AS pure_path,
       CASE WHEN kind = 5 THEN 's3' ELSE list_extract(string_split(rtrim(bare, '/'), '/'), -1) END AS file_name,
       kind IN (1, 4, 5) AS is_s3, kind = 2 AS is_platform,
       CASE kind WHEN 1 THEN 's3p://' || bare WHEN 4 THEN 's3p://' || bare || '/' ELSE path END AS s3p_path
FROM {_PATHS}""",
    "path_scheme_counts": f"SELECT {_SCHEME} AS scheme, count(*) AS n FROM {_PATHS} GROUP BY 1",
    "path_to_http": f"""
SELECT page_id, path, CASE WHEN kind = 2 THEN 'http://{HOST}:{PORT}/fs/' || bare END AS http_url FROM {_PATHS}""",
    "user_libs": f"""
SELECT o_orderkey AS spec_id, f || o_custkey || '.jar' AS file_name,
       'http://{HOST}:{PORT}/fs/' || p || f || o_custkey || '.jar' AS http_url
FROM orders, (VALUES ('libs/', 'a-'), ('', 'c-')) AS v(p, f)""",
    "s3_required": """
SELECT o_orderkey AS spec_id, o_orderpriority IN ('5-LOW', '2-HIGH') OR o_orderstatus = 'F' AS s3_required
FROM orders""",
    "id_codec": """
SELECT o_orderkey, 'c-' || o_custkey || '@' || lower(o_orderstatus) AS entity_id, 'c-' || o_custkey AS cluster_id,
       lower(o_orderstatus) AS namespace FROM orders""",
    "major_version": """
SELECT p_partkey, version, major, major IN ('1.16', '1.15') AS supported FROM (
  SELECT p_partkey, CASE WHEN p_size > 10 THEN '1.' || (p_size % 4 + 13) || '.' || p_size
                         WHEN p_size > 5 THEN '1.' || (p_size % 4 + 13) ELSE '1' END AS version,
         CASE WHEN p_size > 5 THEN '1.' || (p_size % 4 + 13) ELSE '1' END AS major FROM part)""",
    "plugin_names": """
SELECT p_partkey, 'flink-s3-fs-presto-1.16.1.jar;' || CASE WHEN p_size > 10 THEN 'flink-cep_2.12-1.16.1.jar;' ELSE '' END
       || trim(p_name) AS plugins FROM part""",
    "config_flatten": """
SELECT p_partkey, 'blank -> ' || CASE WHEN p_size > 20 THEN '|dir -> /tmp/' || p_brand ELSE '' END
       || CASE WHEN p_size > 5 THEN '|labels -> brand:' || p_brand || ',kind:' || p_type ELSE '' END
       || '|memory -> ' || CASE WHEN p_size > 10 THEN p_size ELSE 1920 END || 'm'
       || '|tags -> ' || p_brand || CASE WHEN p_size > 25 THEN ',' || p_type ELSE '' END AS conf FROM part""",
    "config_set": """
SELECT p_partkey, 'blank -> |dir -> ' || CASE WHEN p_size > 20 THEN '/tmp/' || p_brand ELSE '' END
       || '|labels -> ' || CASE WHEN p_size > 5 THEN 'brand=' || p_brand || ';kind=' || p_type ELSE '' END
       || '|memory -> ' || CASE WHEN p_size > 10 THEN p_size ELSE 1920 END || 'm|none -> '
       || '|tags -> ' || p_brand || CASE WHEN p_size > 25 THEN ';' || p_type ELSE '' END AS conf FROM part""",
    "config_merge": f"SELECT * FROM {_MERGED}",
    "config_deny_list": f"""
SELECT p_partkey, layer, trim(key) AS key, trim(value) AS value FROM {_LAYERS}
WHERE trim(value) <> '' AND trim(key) <> 'kubernetes.namespace'""",
    "config_mask": f"""
SELECT p_partkey, key, CASE WHEN key = 's3.secret-key' THEN '***' ELSE value END AS value FROM {_MERGED}
ORDER BY p_partkey, key""",
    "config_clamp": """
SELECT p_partkey, greatest(p_size, 10) AS slots, CASE WHEN p_size > 20 THEN p_size ELSE 1920 END AS memory,
       greatest(p_retailprice, 950.5) AS cpu FROM part""",
    "effective_config": f"""
WITH log AS (SELECT * FROM {_KINDS}),
cleared AS (SELECT user_id, max(event_id) AS at FROM log WHERE kind = 'RESET' AND key IS NULL GROUP BY user_id),
last AS (SELECT l.user_id, l.key, l.kind, l.value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, key ORDER BY event_id DESC) AS n FROM log
    WHERE key IS NOT NULL) l LEFT JOIN cleared c ON c.user_id = l.user_id
  WHERE n = 1 AND (c.at IS NULL OR event_id > c.at))
SELECT user_id, key, value FROM last WHERE kind = 'SET'
UNION ALL SELECT b.user_id, b.key, b.value
FROM (SELECT DISTINCT user_id, k AS key, b AS value FROM log, (VALUES ('parallelism', '1'), ('mode', 'streaming')) AS v(k, b)) b
LEFT JOIN last l ON l.user_id = b.user_id AND l.key = b.key WHERE l.key IS NULL OR l.kind = 'RESET'""",
}
