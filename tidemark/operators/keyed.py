"""Keyed-snapshot operators: merge, remove, diff and join of last-known states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.status import changes, is_active
from tidemark.plans.lookup import listed, skew_join
from tidemark.plans.ordered import block_of


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.MapType)


def latest_state(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last writer wins: the newest row of each key.

    The whole row is one aggregation buffer, so each map task sends at most one row per key.  Equal
    order values are settled by the other columns, whatever the arrival order.
    """
    rest = [c for c in log.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    newest = F.max_by(row, F.struct(*order)) if _has_map(log.schema) else F.max(row)
    found = log.groupBy(*keys).agg(newest.alias("_row"))
    return found.select(*keys, "_row.*").select(*log.columns)


def lww_remove(log: DataFrame, keys: list[str], order: list[str], is_remove: Column) -> DataFrame:
    """Merge where a newest removal hides the key and a later put revives it."""
    return latest_state(log, keys, order).where(~F.coalesce(is_remove, F.lit(False)))


def lww_remove_where(store: DataFrame, pred: Column) -> DataFrame:
    """Drop every key the predicate selects."""
    return store.where(~F.coalesce(pred, F.lit(False)))


def _by_key(store: DataFrame, updates: DataFrame, keys: list[str], how: str) -> DataFrame:
    left = store.select(F.struct(*keys).alias("_key"), F.struct(*store.columns).alias("old"))
    right = updates.select(F.struct(*keys).alias("_key"), F.struct(*updates.columns).alias("new"))
    return left.join(right, "_key", how)


def lww_update(
    store: DataFrame, updates: DataFrame, keys: list[str], change: dict[str, Column]
) -> DataFrame:
    """Change the columns of keys that are present; updates of absent keys do nothing.

    ``change`` maps a column to an expression over ``old.*`` and ``new.*``; ``updates`` has one row
    per key.
    """
    both = _by_key(store, updates, keys, "left")
    cols = [
        F.when(F.col("new").isNotNull(), change[c]).otherwise(F.col(f"old.{c}")).alias(c)
        if c in change
        else F.col(f"old.{c}")
        for c in store.columns
    ]
    return both.select(*cols)


def lww_upsert(
    store: DataFrame, updates: DataFrame, keys: list[str], change: dict[str, Column]
) -> DataFrame:
    """Absent keys take the new row, present keys the changed one, the rest stay."""
    both = _by_key(store, updates, keys, "full")
    cols = []
    for c in store.columns:
        present = change.get(c, F.col(f"old.{c}"))
        cols.append(
            F.when(F.col("old").isNull(), F.col(f"new.{c}"))
            .when(F.col("new").isNull(), F.col(f"old.{c}"))
            .otherwise(present)
            .alias(c)
        )
    return both.select(*cols)


def lww_get(store: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the wanted keys."""
    return store.join(wanted.select(*keys).distinct(), keys, "left_semi")


def lww_contains(store: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys with the flag ``found``."""
    have = store.select(*keys).withColumn("_have", F.lit(True))
    return (
        wanted.select(*keys)
        .distinct()
        .join(have, keys, "left")
        .select(*keys, F.coalesce("_have", F.lit(False)).alias("found"))
    )


def lww_size(store: DataFrame | None, spark=None) -> DataFrame:
    """Number of keys; a store that does not exist has size 0."""
    if store is None:
        return spark.range(1).select(F.lit(0).cast("bigint").alias("size"))
    return store.agg(F.count("*").alias("size"))


def or_set(log: DataFrame, owner: list[str], member: str, op: str, seq: str) -> DataFrame:
    """Members of each set from its add/remove/clear log."""
    is_clear = F.col(op) == "clear"
    last = (
        log.where(F.col(op).isin("add", "remove"))
        .groupBy(*owner, member)
        .agg(F.max(F.struct(seq, op)).alias("_last"))
        .where(F.col("_last")[op] == "add")
    )
    cleared = log.where(is_clear).groupBy(*owner).agg(F.max(seq).alias("_cleared"))
    return (
        skew_join(last, cleared, owner, "left", [member])
        .where(F.col("_cleared").isNull() | (F.col("_last")[seq] > F.col("_cleared")))
        .select(*owner, member)
    )


def snapshot_removed(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Ids of the previous snapshot that the current one lacks."""
    return previous.select(*keys).distinct().join(current.select(*keys).distinct(), keys, "left_anti")


def content_hash(df: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Order-insensitive hash of the rows of each key."""
    text = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
    return df.groupBy(*keys).agg(
        F.sum(F.xxhash64(text).cast("decimal(20,0)")).alias("content_hash"),
        F.count("*").alias("n_rows"),
    )


def snapshot_changed(
    polls: DataFrame, owner: list[str], poll: str, content: list[str], block_rows: int | None = None
) -> DataFrame:
    """Polls whose content differs from the owner's previous poll."""
    hashed = content_hash(polls, [*owner, poll], content)
    block = block_of(polls, poll, block_rows)
    return changes(hashed, owner, poll, ["content_hash", "n_rows"], block=block)


def snapshot_reconcile(
    previous: DataFrame, current: DataFrame, keys: list[str], content: list[str], at: str
) -> DataFrame:
    """The store after a poll: removed keys are gone, changed ones replaced, equal ones keep ``at``."""
    both = _by_key(previous, current, keys, "right")
    old, new = (F.struct(*[F.col(f"{side}.{c}") for c in content]) for side in ("old", "new"))
    same = F.col("old").isNotNull() & old.eqNullSafe(new)
    cols = [
        F.when(same, F.col(f"old.{at}")).otherwise(F.col(f"new.{at}")).alias(at)
        if c == at
        else F.col(f"new.{c}")
        for c in current.columns
    ]
    return both.select(*cols)


def apply_change_events(
    events: DataFrame, owner: list[str], name: str, kind: str, seq: str
) -> DataFrame:
    """Current rows from a Reset/Added/Modified/Deleted log."""
    rest = [c for c in events.columns if c not in owner and c not in (name, kind, seq)]
    last = (
        events.where(F.col(kind).isin("Added", "Modified", "Deleted"))
        .groupBy(*owner, name)
        .agg(F.max_by(F.struct(seq, kind, *rest), F.struct(seq)).alias("_last"))
        .where(F.col("_last")[kind] != "Deleted")
    )
    reset = events.where(F.col(kind) == "Reset").groupBy(*owner).agg(F.max(seq).alias("_reset"))
    return (
        skew_join(last, reset, owner, "left", [name])
        .where(F.col("_reset").isNull() | (F.col("_last")[seq] > F.col("_reset")))
        .select(*owner, name, "_last.*")
    )


def live_members_metrics(metrics: DataFrame, members: DataFrame, keys: list[str], found: Column) -> DataFrame:
    """Metrics of members that still exist; polls that found nothing are skipped."""
    return skew_join(metrics.where(found), members.select(*keys).distinct(), keys, "left_semi")


def cascade_delete(
    tables: dict[str, DataFrame], removed: DataFrame, keys: list[str]
) -> dict[str, DataFrame]:
    """Every table without the rows of the removed ids."""
    ids = removed.select(*keys).distinct()
    return {name: skew_join(t, ids, keys, "left_anti") for name, t in tables.items()}


def list_by_cluster(table: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the wanted clusters."""
    return skew_join(table, clusters.select(*keys).distinct(), keys, "left_semi")


def job_state_map(jobs: DataFrame, owner: list[str], job: str, state: str) -> DataFrame:
    """Map from job id to state for each owner, one row an owner; ``job_state_rows`` for owners too large for a row."""
    lists = listed(jobs, owner, {"_jobs": F.struct(job, state)})
    return lists.select(*owner, "piece", F.map_from_entries("_jobs").alias("states"))


def job_state_rows(jobs: DataFrame, owner: list[str], job: str, state: str) -> DataFrame:
    """What ``job_state_map`` holds as rows (owner, job, state): no owner is gathered in one task."""
    return jobs.select(*owner, job, state)


def cluster_ref_rows(tables: dict[str, DataFrame], owner: list[str], value: str) -> DataFrame:
    """What ``cluster_refs`` holds as rows (owner, kind, value): no owner is gathered in one task."""
    parts = None
    for name, table in tables.items():
        part = table.select(*owner, F.lit(name).alias("kind"), F.col(value).alias("value"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.where(F.col("value").isNotNull())


def cluster_refs(tables: dict[str, DataFrame], owner: list[str], value: str) -> DataFrame:
    """One sorted list per table and owner, one row an owner, empty where a table has nothing for the owner."""
    parts = None
    for name, table in tables.items():
        part = table.select(*owner, F.col(value).alias("_value"), F.lit(name).alias("_table"))
        parts = part if parts is None else parts.unionByName(part)
    pick = {n: F.when(F.col("_table") == n, F.col("_value")) for n in tables}
    return listed(parts, owner, pick)


def lookup_with_fallback(
    wanted: DataFrame, store: DataFrame, second: DataFrame, keys: list[str], value: str
) -> DataFrame:
    """Value of each wanted key from the store, else from the second source; of several values of a key the largest."""
    return (
        wanted.select(*keys)
        .distinct()
        .join(store.groupBy(*keys).agg(F.max(value).alias("_first")), keys, "left")
        .join(second.groupBy(*keys).agg(F.max(value).alias("_second")), keys, "left")
        .select(
            *keys,
            F.coalesce("_first", "_second").alias(value),
            F.when(F.col("_first").isNotNull(), F.lit("store"))
            .when(F.col("_second").isNotNull(), F.lit("fallback"))
            .otherwise(F.lit("none"))
            .alias("origin"),
        )
    )


def gated_put(requests: DataFrame, tracked: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests for tracked clusters, and those rejected because the cluster is not tracked."""
    ids, known = requests.select(*keys).distinct(), tracked.select(*keys).distinct()
    return ids.join(known, keys, "left_semi"), ids.join(known, keys, "left_anti")


def enabled_with_endpoint(enabled: DataFrame, endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """Enabled clusters, each with its endpoint if it has one; of several endpoints the largest by their columns' order."""
    rest = [c for c in endpoints.columns if c not in keys]
    one = endpoints.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_endpoint")).select(*keys, "_endpoint.*") if rest else endpoints.distinct()
    return enabled.select(*keys).distinct().join(one, keys, "left")


def tracker_status(
    tracked: DataFrame, answers: dict[str, tuple[DataFrame, str]], keys: list[str]
) -> DataFrame:
    """Running, Idle or Unknown for each tracked cluster and kind of tracker; one answer that it is up outweighs others."""
    out = tracked.select(*keys).distinct()
    for name, (table, flag) in answers.items():
        out = out.join(table.groupBy(*keys).agg(F.max(flag).alias(f"_{name}")), keys, "left")
    for name in answers:
        up = F.col(f"_{name}")
        state = F.when(up, "Running").when(~up, "Idle").otherwise("Unknown")
        out = out.withColumn(name, state).drop(f"_{name}")
    return out


def cluster_alive(
    clusters: DataFrame,
    tracked: DataFrame,
    deployments: DataFrame,
    endpoints: DataFrame,
    keys: list[str],
) -> DataFrame:
    """Tracked clusters live while they have a deployment, others while an endpoint exists."""
    out = clusters.select(*keys).distinct()
    for name, table in {"_tracked": tracked, "_deployed": deployments, "_endpoint": endpoints}.items():
        flag = table.select(*keys).distinct().withColumn(name, F.lit(True))
        out = out.join(flag, keys, "left")
    alive = F.when(F.col("_tracked"), F.col("_deployed").isNotNull()).otherwise(
        F.col("_endpoint").isNotNull()
    )
    return out.select(*keys, alive.alias("alive"))


def deploy_decision(
    requests: DataFrame,
    alive: DataFrame,
    endpoints: DataFrame,
    jobs: DataFrame,
    keys: list[str],
    job: str,
    state: str,
    position: str,
) -> DataFrame:
    """ready, clear or reject for each requested application cluster.

    Only a live cluster that answers and whose first job is still active rejects a deployment.
    """
    first = jobs.groupBy(*keys).agg(F.min(F.struct(position, job, state)).alias("_first"))
    has_endpoint = endpoints.select(*keys).distinct().withColumn("_endpoint", F.lit(True))
    blocked = F.col("_endpoint") & F.col("_first").isNotNull() & is_active(F.col("_first")[state])
    decision = (
        F.when(~F.coalesce("alive", F.lit(False)), "ready")
        .when(F.coalesce(blocked, F.lit(False)), "reject")
        .otherwise("clear")
    )
    rejected = F.col("decision") == "reject"
    return (
        requests.select(*keys)
        .distinct()
        .join(alive.select(*keys, "alive"), keys, "left")
        .join(has_endpoint, keys, "left")
        .join(first, keys, "left")
        .withColumn("decision", decision)
        .select(
            *keys,
            "decision",
            F.when(rejected, F.col("_first")[job]).alias(job),
            F.when(rejected, F.col("_first")[state]).alias(state),
        )
    )
