"""Keyed-snapshot operators.

``lineitem`` is the log of a keyed store: key (order, line), order (ship date, part, supplier,
price), and a return flag R stands for a removal.  ``events`` gives set and change-event logs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import keyed
from tidemark.queries.base import choose, customer, events, iso, lineitem, orders, sql_choose
from tidemark.queries.status import JOB_STATE
from tidemark.session import scratch_dir
from tidemark.sources import kept
from tidemark.sources.tables import table

KEY = ["l_orderkey", "l_linenumber"]
ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
AS_OF = "1999-01-01 00:00:00"


def _log(spark, d):
    return lineitem(spark, d).select(*KEY, *ORDER, "l_quantity", "l_returnflag", "l_linestatus")


def _shown(store):
    return store.withColumn("l_shipdate", iso("l_shipdate"))


def q_latest_state(spark, d):
    return _shown(keyed.latest_state(lineitem(spark, d), KEY, ORDER))


def q_lww_remove(spark, d):
    return _shown(keyed.lww_remove(_log(spark, d), KEY, ORDER, F.col("l_returnflag") == "R"))


def q_lww_remove_where(spark, d):
    store = keyed.latest_state(_log(spark, d), KEY, ORDER)
    return _shown(keyed.lww_remove_where(store, F.col("l_linestatus") == "F"))


def _order_quantity(spark, d):
    total = F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double")
    return (
        lineitem(spark, d)
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(total.alias("amount"), F.lit("UPDATED").alias("origin"))
    )


def _finished_orders(spark, d):
    done = orders(spark, d).where(F.col("o_orderstatus") == "F")
    return done.select("o_orderkey", F.col("o_totalprice").alias("amount"), F.lit("STORE").alias("origin"))


def q_lww_update(spark, d):
    change = {
        "amount": F.round(F.col("old.amount") + F.col("new.amount"), 2),
        "origin": F.col("new.origin"),
    }
    return keyed.lww_update(_finished_orders(spark, d), _order_quantity(spark, d), ["o_orderkey"], change)


def q_lww_upsert(spark, d):
    change = {
        "amount": F.round(F.col("old.amount") + F.col("new.amount"), 2),
        "origin": F.lit("REPLACED"),
    }
    return keyed.lww_upsert(_finished_orders(spark, d), _order_quantity(spark, d), ["o_orderkey"], change)


def q_lww_read(spark, d):
    store = _finished_orders(spark, d)
    wanted = lineitem(spark, d).select(F.col("l_orderkey").alias("o_orderkey"))
    size = keyed.lww_size(store).scalar()
    found = keyed.lww_contains(store, wanted, ["o_orderkey"])
    got = keyed.lww_get(store, wanted, ["o_orderkey"]).select("o_orderkey", "amount")
    return found.join(got, "o_orderkey", "left").withColumn("size", size)


def _big_error():
    return (F.col("event_type") == "error") & (F.col("value") > 200)


def q_or_set(spark, d):
    op = (
        F.when(F.col("event_type").isin("signup", "view", "click"), "add")
        .when(F.col("event_type") == "purchase", "remove")
        .when(_big_error(), "clear")
    )
    log = events(spark, d).select(
        (F.col("user_id") % 10).alias("set_id"), "user_id", op.alias("op"), "event_id"
    )
    return keyed.or_set(log, ["set_id"], "user_id", "op", "event_id")


def as_change_events(rows):
    """Rows of ``events`` (a table or a stream) read as a cluster's change log."""
    kind = (
        F.when(F.col("event_type") == "signup", "Added")
        .when(F.col("event_type").isin("view", "click"), "Modified")
        .when(F.col("event_type") == "purchase", "Deleted")
        .when(_big_error(), "Reset")
    )
    return rows.select(
        (F.col("user_id") % 10).alias("cluster_id"),
        F.col("user_id").alias("name"),
        kind.alias("kind"),
        "event_id",
        F.col("props").alias("payload"),
    )


def q_apply_change_events(spark, d):
    return keyed.apply_change_events(as_change_events(events(spark, d)), ["cluster_id"], "name", "kind", "event_id")


def _parts_by(spark, d, flag):
    return (
        lineitem(spark, d)
        .where(F.col("l_returnflag") == flag)
        .select(F.col("l_suppkey").alias("cluster_id"), F.col("l_partkey").alias("member_id"))
    )


def q_snapshot_removed(spark, d):
    return keyed.snapshot_removed(
        _parts_by(spark, d, "A"), _parts_by(spark, d, "N"), ["cluster_id", "member_id"]
    )


def q_snapshot_changed(spark, d):
    polls = (
        events(spark, d)
        .select(
            "user_id",
            F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("poll_day"),
            "event_type",
        )
        .distinct()
    )
    changed = keyed.snapshot_changed(polls, ["user_id"], "poll_day", ["event_type"])
    return changed.select("user_id", "poll_day", "n_rows")


def q_snapshot_reconcile(spark, d):
    log = _shown(_log(spark, d))
    newest = [keyed.latest_state(log.where(F.col("l_linestatus") == s), KEY, ORDER) for s in ("F", "O")]
    return keyed.snapshot_reconcile(*newest, KEY, ["l_returnflag"], "l_shipdate")


def q_kept_table_reconcile(spark, d):
    """As ``snapshot_reconcile``, on a stored table that is changed in place."""
    log = _shown(_log(spark, d))
    first, second = (keyed.latest_state(log.where(F.col("l_linestatus") == s), KEY, ORDER) for s in ("F", "O"))
    store = kept.create(first, KEY, scratch_dir(spark, "kept"), at="l_shipdate", buckets=16)
    kept.reconcile(store, second, ["l_returnflag"], "l_shipdate")
    return store.rows()


def q_kept_table_changes(spark, d):
    """Two orders of three are stored; every second one is added, or its price doubled where it is there; those of one status are removed."""
    all_orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    store = kept.create(all_orders.where(F.col("o_orderkey") % 3 != 0), ["o_orderkey"], scratch_dir(spark, "kept"), buckets=16)
    price = (F.col("old.price") + F.col("new.price")).cast("decimal(18,2)")
    kept.upsert(store, all_orders.where(F.col("o_orderkey") % 2 == 0), {"price": price})
    kept.delete(store, all_orders.where(F.col("o_orderstatus") == "P").select("o_orderkey"))
    return store.rows().withColumn("price", F.col("price").cast("string"))


def q_live_members_metrics(spark, d):
    live = keyed.apply_change_events(
        as_change_events(events(spark, d)), ["cluster_id"], "name", "kind", "event_id"
    )
    metrics = events(spark, d).select(
        (F.col("user_id") % 10).alias("cluster_id"),
        F.col("user_id").alias("name"),
        "event_id",
        "value",
        (F.col("event_type") != "error").alias("found"),
    )
    return keyed.live_members_metrics(metrics, live, ["cluster_id", "name"], F.col("found"))


def q_cascade_delete(spark, d):
    removed = customer(spark, d).where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("cluster_id"))
    tables = {
        "customer": customer(spark, d).select(
            F.col("c_custkey").alias("cluster_id"), F.col("c_custkey").alias("id")
        ),
        "orders": orders(spark, d).select(
            F.col("o_custkey").alias("cluster_id"), F.col("o_orderkey").alias("id")
        ),
    }
    left = keyed.cascade_delete(tables, removed, ["cluster_id"])
    tagged = [t.select(F.lit(name).alias("table_name"), "cluster_id", "id") for name, t in left.items()]
    return tagged[0].unionByName(tagged[1])


def q_list_by_cluster(spark, d):
    wanted = (
        table(spark, d, "supplier")
        .where(F.col("s_acctbal") > 0)
        .select(F.col("s_suppkey").alias("l_suppkey"), F.lit("F").alias("l_linestatus"))
    )
    rows = lineitem(spark, d).select("l_suppkey", "l_linestatus", "l_orderkey", "l_linenumber", "l_partkey")
    return keyed.list_by_cluster(rows, wanted, ["l_suppkey", "l_linestatus"])


def _jobs(spark, d):
    return orders(spark, d).select(
        F.col("o_custkey").alias("cluster_id"),
        F.col("o_orderkey").alias("job_id"),
        choose(F.col("o_orderstatus"), JOB_STATE).alias("state"),
    )


def q_job_state_map(spark, d):
    states = keyed.job_state_map(_jobs(spark, d), ["cluster_id"], "job_id", "state")
    text = F.array_join(
        F.transform(F.map_entries("states"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ","
    )
    return states.select("cluster_id", "piece", text.alias("states"))


def q_cluster_refs(spark, d):
    cust = customer(spark, d).select("c_nationkey", "c_name", "c_mktsegment")
    supp = table(spark, d, "supplier")
    tables = {
        "deployment": cust.where(F.col("c_mktsegment") == "BUILDING").select("c_nationkey", "c_name"),
        "service": supp.select("s_nationkey", "s_name"),
        "pod": cust.select("c_nationkey", "c_name"),
        "configmap": table(spark, d, "nation").select("n_nationkey", "n_name"),
    }
    tables = {k: t.toDF("cluster_id", "name") for k, t in tables.items()}
    refs = keyed.cluster_refs(tables, ["cluster_id"], "name")
    return refs.select("cluster_id", "piece", *[F.array_join(k, ",").alias(k) for k in tables])


def _newest_order(spark, d, status):
    return (
        orders(spark, d)
        .where(F.col("o_orderstatus") == status)
        .groupBy(F.col("o_custkey").alias("cluster_id"))
        .agg(F.max("o_orderkey").alias("endpoint"))
    )


def _customers(spark, d):
    return customer(spark, d).select(F.col("c_custkey").alias("cluster_id"), "c_acctbal", "c_mktsegment")


def q_lookup_with_fallback(spark, d):
    return keyed.lookup_with_fallback(
        _customers(spark, d),
        _newest_order(spark, d, "F"),
        _newest_order(spark, d, "O"),
        ["cluster_id"],
        "endpoint",
    )


def _tracked(spark, d):
    return _customers(spark, d).where(F.col("c_acctbal") > 0).select("cluster_id")


def q_gated_put(spark, d):
    accepted, rejected = keyed.gated_put(_jobs(spark, d), _tracked(spark, d), ["cluster_id"])
    return accepted.withColumn("accepted", F.lit(True)).unionByName(
        rejected.withColumn("accepted", F.lit(False))
    )


def q_enabled_with_endpoint(spark, d):
    return keyed.enabled_with_endpoint(_tracked(spark, d), _newest_order(spark, d, "F"), ["cluster_id"])


def q_tracker_status(spark, d):
    per_order = orders(spark, d).groupBy(F.col("o_custkey").alias("cluster_id"))
    cluster = per_order.agg(F.bool_or(F.col("o_orderstatus") == "F").alias("up"))
    k8s = (
        _customers(spark, d)
        .where(F.col("c_acctbal") > 0)
        .select("cluster_id", (F.col("c_mktsegment") == "BUILDING").alias("up"))
    )
    return keyed.tracker_status(
        _customers(spark, d),
        {"cluster_tracker": (cluster, "up"), "k8s_tracker": (k8s, "up")},
        ["cluster_id"],
    )


def _alive(spark, d):
    return keyed.cluster_alive(
        _customers(spark, d),
        _tracked(spark, d),
        _newest_order(spark, d, "F"),
        _newest_order(spark, d, "O"),
        ["cluster_id"],
    )


def q_cluster_alive(spark, d):
    return _alive(spark, d)


def q_deploy_decision(spark, d):
    endpoints = _customers(spark, d).where(F.col("c_mktsegment") != "BUILDING")
    jobs = _jobs(spark, d).withColumn("position", F.col("job_id"))
    return keyed.deploy_decision(
        _customers(spark, d), _alive(spark, d), endpoints, jobs, ["cluster_id"], "job_id", "state", "position"
    )


QUERIES = {
    "latest_state": q_latest_state,
    "lww_remove": q_lww_remove,
    "lww_remove_where": q_lww_remove_where,
    "lww_update": q_lww_update,
    "lww_upsert": q_lww_upsert,
    "lww_read": q_lww_read,
    "or_set": q_or_set,
    "apply_change_events": q_apply_change_events,
    "snapshot_removed": q_snapshot_removed,
    "snapshot_changed": q_snapshot_changed,
    "snapshot_reconcile": q_snapshot_reconcile,
    "kept_table_reconcile": q_kept_table_reconcile,
    "kept_table_changes": q_kept_table_changes,
    "live_members_metrics": q_live_members_metrics,
    "cascade_delete": q_cascade_delete,
    "list_by_cluster": q_list_by_cluster,
    "job_state_map": q_job_state_map,
    "cluster_refs": q_cluster_refs,
    "lookup_with_fallback": q_lookup_with_fallback,
    "gated_put": q_gated_put,
    "enabled_with_endpoint": q_enabled_with_endpoint,
    "tracker_status": q_tracker_status,
    "cluster_alive": q_cluster_alive,
    "deploy_decision": q_deploy_decision,
}

_DATE = "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate"
_COLS = f"l_orderkey, l_linenumber, {_DATE}, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus"


def _latest(where: str = "") -> str:
    return f"""
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n
    FROM lineitem {where}) WHERE n = 1"""


_STORE = "SELECT o_orderkey, o_totalprice AS amount FROM orders WHERE o_orderstatus = 'F'"
_UPDATES = """SELECT l_orderkey AS o_orderkey,
  CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS amount FROM lineitem GROUP BY l_orderkey"""
_RESET = "event_type = 'error' AND value > 200"
CURRENT_SQL = f"""
  SELECT * FROM (
    SELECT user_id % 10 AS cluster_id, user_id AS name, event_id, event_type, props,
           row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n
    FROM events WHERE event_type <> 'error') e
  LEFT JOIN (SELECT user_id % 10 AS c, max(event_id) AS reset_id FROM events WHERE {_RESET} GROUP BY 1) r
    ON r.c = e.cluster_id
  WHERE n = 1 AND event_type <> 'purchase' AND (reset_id IS NULL OR event_id > reset_id)"""
_NEWEST = """(SELECT o_custkey AS cluster_id, max(o_orderkey) AS endpoint FROM orders
   WHERE o_orderstatus = '{}' GROUP BY o_custkey)"""
_ALIVE = f"""
SELECT c_custkey AS cluster_id,
       CASE WHEN c_acctbal > 0 THEN f.endpoint IS NOT NULL ELSE o.endpoint IS NOT NULL END AS alive
FROM customer LEFT JOIN {_NEWEST.format("F")} f ON f.cluster_id = c_custkey
     LEFT JOIN {_NEWEST.format("O")} o ON o.cluster_id = c_custkey"""

_RECONCILED = f"""
SELECT c.l_orderkey, c.l_linenumber,
       strftime(CASE WHEN p.l_returnflag = c.l_returnflag THEN p.l_shipdate ELSE c.l_shipdate END,
                '%Y-%m-%d %H:%M:%S') AS l_shipdate,
       c.l_partkey, c.l_suppkey, c.l_extendedprice, c.l_quantity, c.l_returnflag, c.l_linestatus
FROM ({_latest("WHERE l_linestatus = 'O'")}) c LEFT JOIN ({_latest("WHERE l_linestatus = 'F'")}) p
  ON p.l_orderkey = c.l_orderkey AND p.l_linenumber = c.l_linenumber"""

SQL = {
    "latest_state": f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
       l_returnflag, l_linestatus, {_DATE} FROM ({_latest()})""",
    "lww_remove": f"SELECT {_COLS} FROM ({_latest()}) WHERE l_returnflag <> 'R'",
    "lww_remove_where": f"SELECT {_COLS} FROM ({_latest()}) WHERE l_linestatus <> 'F'",
    "lww_update": f"""
SELECT s.o_orderkey, CASE WHEN u.o_orderkey IS NULL THEN s.amount ELSE round(s.amount + u.amount, 2) END AS amount,
       CASE WHEN u.o_orderkey IS NULL THEN 'STORE' ELSE 'UPDATED' END AS origin
FROM ({_STORE}) s LEFT JOIN ({_UPDATES}) u ON u.o_orderkey = s.o_orderkey""",
    "lww_upsert": f"""
SELECT coalesce(s.o_orderkey, u.o_orderkey) AS o_orderkey,
       CASE WHEN u.o_orderkey IS NULL THEN s.amount WHEN s.o_orderkey IS NULL THEN u.amount
            ELSE round(s.amount + u.amount, 2) END AS amount,
       CASE WHEN u.o_orderkey IS NULL THEN 'STORE' WHEN s.o_orderkey IS NULL THEN 'UPDATED'
            ELSE 'REPLACED' END AS origin
FROM ({_STORE}) s FULL JOIN ({_UPDATES}) u ON u.o_orderkey = s.o_orderkey""",
    "lww_read": f"""
SELECT w.o_orderkey, s.o_orderkey IS NOT NULL AS found, s.amount,
       (SELECT count(*) FROM ({_STORE})) AS size
FROM (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem) w
LEFT JOIN ({_STORE}) s ON s.o_orderkey = w.o_orderkey""",
    "or_set": f"""
SELECT cluster_id AS set_id, name AS user_id FROM ({CURRENT_SQL})""",
    "apply_change_events": f"""
SELECT cluster_id, name, event_id, CASE event_type WHEN 'signup' THEN 'Added' ELSE 'Modified' END AS kind,
       props AS payload FROM ({CURRENT_SQL})""",
    "snapshot_removed": """
SELECT DISTINCT l_suppkey AS cluster_id, l_partkey AS member_id FROM lineitem WHERE l_returnflag = 'A'
EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'""",
    "snapshot_changed": """
SELECT user_id, poll_day, n_rows FROM (
  SELECT *, lag(content) OVER (PARTITION BY user_id ORDER BY poll_day) AS before FROM (
    SELECT user_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS poll_day,
           string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS content,
           count(DISTINCT event_type) AS n_rows
    FROM events GROUP BY 1, 2))
WHERE content IS DISTINCT FROM before""",
    "snapshot_reconcile": _RECONCILED,
    "kept_table_reconcile": _RECONCILED,
    "kept_table_changes": """
SELECT o_orderkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 6 IN (2, 4) THEN 2 ELSE 1 END AS VARCHAR) AS price
FROM orders WHERE (o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0) AND o_orderstatus <> 'P'""",
    "live_members_metrics": f"""
SELECT user_id % 10 AS cluster_id, user_id AS name, event_id, value, true AS found
FROM events WHERE event_type <> 'error' AND user_id IN (SELECT name FROM ({CURRENT_SQL}))""",
    "cascade_delete": """
SELECT 'customer' AS table_name, c_custkey AS cluster_id, c_custkey AS id FROM customer WHERE NOT c_acctbal < 0
UNION ALL SELECT 'orders', o_custkey, o_orderkey FROM orders
  WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "list_by_cluster": """
SELECT l_suppkey, l_linestatus, l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_linestatus = 'F' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
    "job_state_map": f"""
SELECT o_custkey AS cluster_id, 0 AS piece,
       string_agg(o_orderkey || ':' || {sql_choose("o_orderstatus", JOB_STATE)}, ',' ORDER BY o_orderkey) AS states
FROM orders GROUP BY o_custkey""",
    "cluster_refs": """
WITH refs AS (
  SELECT c_nationkey AS cluster_id, 'deployment' AS kind, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION ALL SELECT s_nationkey, 'service', s_name FROM supplier
  UNION ALL SELECT c_nationkey, 'pod', c_name FROM customer
  UNION ALL SELECT n_nationkey, 'configmap', n_name FROM nation)
SELECT cluster_id, 0 AS piece,
       coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE kind = 'deployment'), '') AS deployment,
       coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE kind = 'service'), '') AS service,
       coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE kind = 'pod'), '') AS pod,
       coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE kind = 'configmap'), '') AS configmap
FROM refs GROUP BY cluster_id""",
    "lookup_with_fallback": f"""
SELECT c_custkey AS cluster_id, coalesce(f.endpoint, o.endpoint) AS endpoint,
       CASE WHEN f.endpoint IS NOT NULL THEN 'store' WHEN o.endpoint IS NOT NULL THEN 'fallback'
            ELSE 'none' END AS origin
FROM customer LEFT JOIN {_NEWEST.format("F")} f ON f.cluster_id = c_custkey
     LEFT JOIN {_NEWEST.format("O")} o ON o.cluster_id = c_custkey""",
    "gated_put": """
SELECT DISTINCT o_custkey AS cluster_id,
       o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS accepted FROM orders""",
    "enabled_with_endpoint": f"""
SELECT c_custkey AS cluster_id, f.endpoint
FROM customer LEFT JOIN {_NEWEST.format("F")} f ON f.cluster_id = c_custkey WHERE c_acctbal > 0""",
    "tracker_status": """
SELECT c_custkey AS cluster_id,
       CASE WHEN o.up THEN 'Running' WHEN NOT o.up THEN 'Idle' ELSE 'Unknown' END AS cluster_tracker,
       CASE WHEN c_acctbal > 0 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN 'Running' ELSE 'Idle' END
            ELSE 'Unknown' END AS k8s_tracker
FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS up FROM orders GROUP BY 1) o
  ON o.o_custkey = c_custkey""",
    "cluster_alive": _ALIVE,
    "deploy_decision": f"""
SELECT cluster_id, decision, CASE WHEN decision = 'reject' THEN job_id END AS job_id,
       CASE WHEN decision = 'reject' THEN state END AS state
FROM (
  SELECT a.cluster_id, j.job_id, j.state,
         CASE WHEN NOT a.alive THEN 'ready'
              WHEN c.c_mktsegment <> 'BUILDING' AND j.state IN ('RUNNING', 'CREATED') THEN 'reject'
              ELSE 'clear' END AS decision
  FROM ({_ALIVE}) a JOIN customer c ON c.c_custkey = a.cluster_id
  LEFT JOIN (SELECT o_custkey, o_orderkey AS job_id, {sql_choose("o_orderstatus", JOB_STATE)} AS state
             FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
             WHERE n = 1) j ON j.o_custkey = a.cluster_id)""",
}
