"""Configuration maps, versions and composite ids as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Settings a user may not override.
LOCKED_KEYS = [
    "execution.target",
    "kubernetes.cluster-id",
    "kubernetes.namespace",
    "kubernetes.container.image",
    "kubernetes.service-account",
    "kubernetes.jobmanager.service-account",
    "kubernetes.pod-template-file",
    "kubernetes.pod-template-file.taskmanager",
    "kubernetes.pod-template-file.jobmanager",
    "$internal.deployment.config-dir",
    "pipeline.jars",
    "$internal.application.main",
    "$internal.application.program-args",
]

# Settings a session may not show or change.
SESSION_LOCKED_KEYS = [
    "execution.target",
    "execution.attached",
    "execution.shutdown-on-attached-exit",
    "pipeline.jars",
]

# Settings whose value is masked.
SECRET_KEYS = ["hive.s3.aws-secret-key", "fs.s3a.secret.key", "s3.secret-key"]

# Execution targets, by name and by raw value.
TARGETS = {
    "Local": "local",
    "Remote": "remote",
    "Embedded": "embedded",
    "K8sSession": "kubernetes-session",
    "K8sApplication": "kubernetes-application",
    "YarnSession": "yarn-session",
    "YarnApplication": "yarn-application",
    "YarnPerJob": "yarn-per-job",
}

# Built-in plugins, and whether the jar name carries the language version.
PLUGINS = {
    "flink-s3-fs-hadoop": False,
    "flink-gs-fs-hadoop": False,
    "flink-oss-fs-hadoop": False,
    "flink-azure-fs-hadoop": False,
    "flink-s3-fs-presto": False,
    "flink-cep": True,
    "flink-gelly": True,
    "flink-python": True,
}

# Engine versions with an interpreter.
SUPPORTED_VERSIONS = ["1.16", "1.15"]


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of ``key`` in a small fixed table, NULL if absent."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def joined(items: Column, sep: str = ",") -> Column:
    """List as text, NULL when there is nothing in it."""
    return F.when(F.size(items) > 0, F.array_join(items, sep))


def joined_map(entries: Column, pair: str = ":", sep: str = ",") -> Column:
    """Map as text in key order, NULL when there is nothing in it."""
    pairs = F.transform(
        F.array_sort(F.map_entries(entries)),
        lambda e: F.concat(e["key"], F.lit(pair), F.coalesce(e["value"], F.lit(""))),
    )
    return joined(pairs, sep)


def present(settings: dict[str, Column], empty: str | None = None) -> Column:
    """Map of the given text settings; missing ones are left out, or written as ``empty``."""
    entries = F.array(
        *[
            F.struct(
                F.lit(key).alias("key"),
                (value if empty is None else F.coalesce(value, F.lit(empty))).alias("value"),
            )
            for key, value in settings.items()
        ]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def masked(key: Column, value: Column) -> Column:
    return F.when(key.isin(SECRET_KEYS), F.lit("***")).otherwise(value)


def at_least(value: Column, floor) -> Column:
    return F.when(value >= floor, value).otherwise(F.lit(floor))


def valid_or(value: Column, ok: Column, default) -> Column:
    return F.when(ok, value).otherwise(F.lit(default))


def major_version(version: Column) -> Column:
    parts = F.split(F.regexp_replace(version, r"\.+$", ""), r"\.", -1)
    return F.when(F.size(parts) < 2, version).otherwise(F.concat_ws(".", F.slice(parts, 1, 2)))


def cluster_id(cluster: Column, namespace: Column) -> Column:
    return F.concat(cluster, F.lit("@"), namespace)


def split_cluster_id(text: Column) -> Column:
    parts = F.split(text, "@", -1)
    return F.struct(parts[0].alias("cluster_id"), F.get(parts, F.lit(1)).alias("namespace"))


def plugin_jar(name: Column, version: Column, scala: Column) -> Column:
    """Jar name of a known plugin, NULL for any other name."""
    bound = F.create_map(*[F.lit(x) for kv in PLUGINS.items() for x in kv])[name]
    return F.when(bound, F.concat(name, F.lit("_"), scala, F.lit("-"), version, F.lit(".jar"))).when(
        ~bound, F.concat(name, F.lit("-"), version, F.lit(".jar"))
    )
