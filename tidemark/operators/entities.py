"""Nested cluster and job payloads (JSON text columns) as flat typed rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import quantity
from tidemark.functions.settings import TARGETS, lookup
from tidemark.operators.status import changes, known_job_state

# Payload schemas, as the services send them.
JOBS_OVERVIEW = """jobs array<struct<jid:string,name:string,state:string,`start-time`:bigint,
 `end-time`:bigint,`last-modification`:bigint,tasks:struct<total:int,created:int,scheduled:int,
 deploying:int,running:int,finished:int,canceling:int,canceled:int,failed:int,reconciling:int,
 initializing:int>>>"""
JOBS_STATUS = "jobs array<struct<id:string,status:string>>"
WORKERS = "taskmanagers array<struct<id:string>>"
CLUSTER_OVERVIEW = """`flink-version` string,taskmanagers int,`slots-total` int,
 `slots-available` int,`jobs-running` int,`jobs-finished` int,`jobs-cancelled` int,
 `jobs-failed` int"""
_RESOURCE = """struct<cpuCores:float,taskHeapMemory:bigint,taskOffHeapMemory:bigint,
 managedMemory:bigint,networkMemory:bigint>"""
WORKER_DETAIL = f"""id string,path string,dataPort int,slotsNumber int,freeSlots int,
 totalResource {_RESOURCE},freeResource {_RESOURCE},
 hardware struct<cpuCores:float,physicalMemory:bigint,freeMemory:bigint,managedMemory:bigint>,
 memoryConfiguration struct<frameworkHeap:bigint,taskHeap:bigint,frameworkOffHeap:bigint,
 taskOffHeap:bigint,networkMemory:bigint,managedMemory:bigint,jvmMetaspace:bigint,
 jvmOverhead:bigint,totalFlinkMemory:bigint,totalProcessMemory:bigint>"""
SAVEPOINT = """status struct<id:string>,operation struct<location:string,
 `failure-cause`:struct<`stack-trace`:string>>"""
POD_METRICS = """timestamp string,
 containers array<struct<name:string,usage:struct<cpu:string,memory:string>>>"""
_META = "metadata struct<name:string,namespace:string,creationTimestamp:string,labels:map<string,string>>"
_CONDITIONS = """conditions:array<struct<type:string,status:string,reason:string,message:string,
 lastTransitionTime:string>>"""
SERVICE = f"""{_META},spec struct<selector:map<string,string>,clusterIP:string,
 ports:array<struct<name:string,protocol:string,port:int,targetPort:int>>>"""
DEPLOYMENT = f"""{_META},spec struct<selector:struct<matchLabels:map<string,string>>>,
 status struct<observedGeneration:bigint,replicas:int,readyReplicas:int,unavailableReplicas:int,
 availableReplicas:int,updatedReplicas:int,{_CONDITIONS}>"""
_STATE = """state:struct<running:struct<startedAt:string>,
 waiting:struct<message:string,reason:string>,
 terminated:struct<exitCode:int,message:string,reason:string,signal:int,startedAt:string,
 finishedAt:string>>"""
_LIMITS = "struct<cpu:string,memory:string>"
POD = f"""{_META},spec struct<nodeName:string,
 containers:array<struct<name:string,resources:struct<limits:{_LIMITS},requests:{_LIMITS}>>>>,
 status struct<phase:string,reason:string,hostIP:string,podIP:string,startTime:string,
 {_CONDITIONS},containerStatuses:array<struct<name:string,image:string,ready:boolean,
 restartCount:int,{_STATE}>>>"""

# Fixed values.
POD_PHASES = ["Pending", "Running", "Succeeded", "Failed", "Unknown"]
CONDITION_STATUS = ["True", "False", "Unknown"]
REST_PORT = 8081
SOURCE_KEY, TARGET_KEY = "deploy.source", "deploy.target"
NATIVE_TYPE = "flink-native-kubernetes"


def _open(df: DataFrame, payload: str, schema: str, ok: Callable | None = None) -> DataFrame:
    """Add the parsed payload as ``_p``, keeping only payloads for which ``ok`` holds.

    Exploding a one-element array keeps the optimizer from copying the parse into every filter and
    field access above it: each payload is parsed once.
    """
    one = F.array(F.from_json(payload, schema))
    parsed = one if ok is None else F.filter(one, ok)
    return df.withColumn("_p", F.explode(parsed)).drop(payload)


def parse_json(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """The payload's fields as typed columns beside the others."""
    keep = [c for c in df.columns if c != payload]
    return _open(df, payload, schema).select(*keep, "_p.*")


def _one_of(value: Column, known: list[str], other: str = "Unknown") -> Column:
    return F.when(value.isin(known), value).otherwise(F.lit(other))


def _epoch_s(text: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(text))


def job_overview(df: DataFrame, payload: str, ids: list[str]) -> DataFrame:
    """One row per job of each jobs payload."""
    jobs = _open(df, payload, JOBS_OVERVIEW).select(*ids, F.explode("_p.jobs").alias("j"))
    return jobs.select(
        *ids,
        F.col("j.jid").alias("job_id"),
        F.col("j.name").alias("job_name"),
        known_job_state(F.col("j.state")).alias("state"),
        F.col("j.`start-time`").alias("start_ms"),
        F.col("j.`end-time`").alias("end_ms"),
        F.col("j.tasks").alias("tasks"),
    )


def job_status_list(df: DataFrame, payload: str, ids: list[str]) -> DataFrame:
    """Job id, its state and its place in the list, which decides what the first job is."""
    jobs = _open(df, payload, JOBS_STATUS).select(*ids, F.posexplode("_p.jobs").alias("position", "j"))
    return jobs.select(
        *ids, "position", F.col("j.id").alias("job_id"), known_job_state(F.col("j.status")).alias("state")
    )


def worker_ids(df: DataFrame, payload: str, ids: list[str]) -> DataFrame:
    """Worker ids of each cluster, an empty list when the endpoint is absent."""
    found = F.transform("_p.taskmanagers", lambda t: t["id"])
    empty = F.array().cast("array<string>")
    return _open(df, payload, WORKERS).select(*ids, F.coalesce(found, empty).alias("worker_ids"))


def pairs_to_map(pairs: Column, key: str, value: str) -> Column:
    """Array of key/value structs as a map; the later of two equal keys wins, absent gives {}."""
    sep = F.transform(pairs, lambda p, i: F.struct(p[key].alias("k"), (-i).alias("at"), p[value].alias("v")))
    ordered = F.array_sort(sep)
    # Sorted by key and latest first, so the winner of a key is the entry after another key.
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform(ordered, lambda e: e["k"]))
    winners = F.filter(
        F.arrays_zip(ordered.alias("e"), before.alias("b")),
        lambda z: z["e"].isNotNull() & z["e"]["k"].isNotNull() & ~z["e"]["k"].eqNullSafe(z["b"]),
    )
    entries = F.transform(winners, lambda z: F.struct(z["e"]["k"], z["e"]["v"]))
    return F.coalesce(F.map_from_entries(entries), F.create_map().cast("map<string,string>"))


def pairs_payload_to_map(df: DataFrame, payload: str, key: str, name: str) -> DataFrame:
    """A payload that is an array of ``{key, value}`` objects as one map column."""
    rest = [c for c in df.columns if c != payload]
    pairs = pairs_to_map(F.col("_p"), key, "value")
    return _open(df, payload, f"array<struct<{key}:string,value:string>>").select(
        *rest, pairs.alias(name)
    )


def cluster_overview(df: DataFrame, payload: str, ids: list[str]) -> DataFrame:
    """Cluster totals with the job counts nested."""
    p = F.col("_p")
    return _open(df, payload, CLUSTER_OVERVIEW).select(
        *ids,
        p["flink-version"].alias("version"),
        p["taskmanagers"].alias("tm_total"),
        p["slots-total"].alias("slots_total"),
        p["slots-available"].alias("slots_available"),
        F.struct(
            p["jobs-running"].alias("running"),
            p["jobs-finished"].alias("finished"),
            p["jobs-cancelled"].alias("canceled"),
            p["jobs-failed"].alias("failed"),
        ).alias("jobs"),
    )


def worker_detail(df: DataFrame, payload: str, ids: list[str]) -> DataFrame:
    """Worker description with its four nested structs."""
    return (
        parse_json(df.select(*ids, payload), payload, WORKER_DETAIL)
        .withColumnRenamed("id", "tm_id")
        .withColumnsRenamed(
            {
                "dataPort": "data_port",
                "slotsNumber": "slots_number",
                "freeSlots": "free_slots",
                "totalResource": "total_resource",
                "freeResource": "free_resource",
                "memoryConfiguration": "memory_configuration",
            }
        )
    )


def exec_type(conf: Column) -> Column:
    """Execution type from the injected marker (name or raw value), else from the raw setting."""
    by_raw = {raw: name for name, raw in TARGETS.items()}
    marker = conf[TARGET_KEY]
    raw = lookup(by_raw, F.coalesce(conf["execution.target"], F.lit("unknown")))
    plain = F.when(raw == "Embedded", F.lit("K8sApplication")).otherwise(raw)
    named = F.when(marker.isin(list(TARGETS)), marker)
    return F.coalesce(named, lookup(by_raw, F.coalesce(marker, F.lit(""))), plain, F.lit("Unknown"))


def deployed_by_platform(conf: Column, source: str) -> Column:
    return F.coalesce(conf[SOURCE_KEY] == source, F.lit(False))


def savepoint_status(df: DataFrame, payload: str, ids: list[str]) -> DataFrame:
    """State, location and failure of a savepoint operation."""
    p = F.col("_p")
    state = p["status"]["id"]
    return (
        _open(df, payload, SAVEPOINT)
        .select(
            *ids,
            F.when(state == "COMPLETED", "Completed")
            .when(state == "IN_PROGRESS", "InProgress")
            .otherwise("Unknown")
            .alias("state"),
            p["operation"]["location"].alias("location"),
            p["operation"]["failure-cause"]["stack-trace"].alias("failure_cause"),
        )
        .withColumn("is_completed", F.col("state") == "Completed")
        .withColumn("is_failed", F.col("failure_cause").isNotNull())
    )


def savepoint_watch(
    polls: DataFrame,
    trigger: list[str],
    seq: str,
    block_rows: int | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Changed states of each trigger until it is completed.

    ``block`` from the unparsed polls spares a pass over the payloads.
    """
    cols = ["state", "location", "failure_cause"]
    done = F.col("state") == "Completed"
    return changes(polls, trigger, seq, cols, block_rows, until=done, block=block)


def _missing(p: Column, schema: str, labels: Callable) -> Column:
    """Names of the required fields that an entity lacks."""
    required = {
        "name": p["metadata"]["name"],
        "namespace": p["metadata"]["namespace"],
        "creationTimestamp": _epoch_s(p["metadata"]["creationTimestamp"]),
        "spec": p["spec"],
        "app": labels(p)["app"],
        "component": labels(p)["component"],
    }
    if "status struct" in schema:
        required["status"] = p["status"]
    return F.array_compact(
        F.array(*[F.when(value.isNull(), F.lit(name)) for name, value in required.items()])
    )


def entity_quarantine(
    df: DataFrame, payload: str, schema: str, labels: Callable
) -> tuple[DataFrame, DataFrame]:
    """Entities with every required field (parsed, as ``_p``), and the rejected rest.

    ``labels`` picks the map that must name the app and the component out of the parsed entity.
    """
    valid = _open(df, payload, schema, lambda p: F.size(_missing(p, schema, labels)) == 0)
    gaps = F.transform(F.array(F.from_json(payload, schema)), lambda p: _missing(p, schema, labels))
    rejected = df.withColumn("missing", F.explode(F.filter(gaps, lambda m: F.size(m) > 0)))
    return valid, rejected


SERVICE_LABELS = lambda p: p["spec"]["selector"]
DEPLOYMENT_LABELS = lambda p: p["spec"]["selector"]["matchLabels"]
POD_LABELS = lambda p: p["metadata"]["labels"]


def _identity(labels: Column) -> list[Column]:
    p = F.col("_p")
    return [
        labels["app"].alias("cluster_id"),
        p["metadata"]["namespace"].alias("namespace"),
        p["metadata"]["name"].alias("name"),
        labels["component"].alias("component"),
        _epoch_s(p["metadata"]["creationTimestamp"]).alias("create_s"),
    ]


def _conditions(raw: Column) -> Column:
    """Newest transition first; equal times come out in reverse input order."""
    plain = F.transform(
        raw,
        lambda c: F.struct(
            c["type"].alias("cond_type"),
            _one_of(c["status"], CONDITION_STATUS).alias("status"),
            c["reason"].alias("reason"),
            c["message"].alias("message"),
            _epoch_s(c["lastTransitionTime"]).alias("last_transition_s"),
        ),
    )
    keyed = F.transform(
        plain,
        lambda c, i: F.struct(
            F.coalesce(c["last_transition_s"], F.lit(0)).alias("t"), i.alias("i"), c.alias("c")
        ),
    )
    return F.transform(F.reverse(F.array_sort(keyed)), lambda e: e["c"])


def service_snapshot(df: DataFrame, payload: str, keep: list[str] = ()) -> DataFrame:
    """Services as rows: complete ports without repeats, DNS name, rest flag."""
    p = F.col("_p")
    valid, _ = entity_quarantine(df, payload, SERVICE, SERVICE_LABELS)
    complete = F.filter(
        p["spec"]["ports"],
        lambda x: x["name"].isNotNull()
        & x["protocol"].isNotNull()
        & x["port"].isNotNull()
        & x["targetPort"].isNotNull(),
    )
    ports = F.transform(
        complete,
        lambda x: F.struct(
            x["name"].alias("name"),
            x["protocol"].alias("protocol"),
            x["port"].alias("port"),
            x["targetPort"].alias("target_port"),
        ),
    )
    none = F.array().cast("array<struct<name:string,protocol:string,port:int,target_port:int>>")
    name, namespace = p["metadata"]["name"], p["metadata"]["namespace"]
    return valid.select(
        *keep,
        *_identity(SERVICE_LABELS(p)),
        F.concat_ws(".", name, namespace).alias("dns"),
        p["spec"]["clusterIP"].alias("cluster_ip"),
        F.coalesce(F.array_distinct(ports), none).alias("ports"),
        F.endswith(name, F.lit("-rest")).alias("is_rest"),
    )


def deployment_snapshot(df: DataFrame, payload: str, keep: list[str] = ()) -> DataFrame:
    """Deployments as rows; missing counters are 0."""
    p = F.col("_p")
    valid, _ = entity_quarantine(df, payload, DEPLOYMENT, DEPLOYMENT_LABELS)
    counters = {
        "observed_generation": "observedGeneration",
        "replicas": "replicas",
        "ready_replicas": "readyReplicas",
        "unavailable_replicas": "unavailableReplicas",
        "available_replicas": "availableReplicas",
        "updated_replicas": "updatedReplicas",
    }
    return valid.select(
        *keep,
        *_identity(DEPLOYMENT_LABELS(p)),
        _conditions(p["status"]["conditions"]).alias("conditions"),
        *[F.coalesce(p["status"][raw], F.lit(0)).alias(c) for c, raw in counters.items()],
    )


def container_state(state: Column) -> Column:
    """State name by precedence running, waiting, terminated, and the details of that state."""
    running, waiting, ended = state["running"], state["waiting"], state["terminated"]
    tag = (
        F.when(running.isNotNull(), "Running")
        .when(waiting.isNotNull(), "Waiting")
        .when(ended.isNotNull(), "Terminated")
        .otherwise("Unknown")
    )
    is_wait = running.isNull() & waiting.isNotNull()
    is_end = running.isNull() & waiting.isNull() & ended.isNotNull()

    def text(field: str) -> Column:
        return F.when(is_wait, waiting[field]).when(is_end, ended[field])

    started = F.when(running.isNotNull(), running["startedAt"]).when(is_end, ended["startedAt"])
    return F.struct(
        tag.alias("state"),
        F.when(is_end, ended["exitCode"]).alias("exit_code"),
        text("message").alias("message"),
        text("reason").alias("reason"),
        F.when(is_end, ended["signal"]).alias("signal"),
        _epoch_s(started).alias("started_s"),
        _epoch_s(F.when(is_end, ended["finishedAt"])).alias("finished_s"),
    )


def _let(value: Column, body: Callable) -> Column:
    """``body(value)`` with ``value`` worked out once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _limits_by_container(containers: Column) -> Column:
    """Parsed limits and requests of each container, the last container of a name first."""
    return F.reverse(
        F.transform(
            containers,
            lambda c: F.struct(
                c["name"].alias("name"),
                quantity.parse(c["resources"]["limits"]["cpu"]).alias("cpu_limit"),
                quantity.parse(c["resources"]["requests"]["cpu"]).alias("cpu_request"),
                quantity.parse(c["resources"]["limits"]["memory"]).alias("memory_limit"),
                quantity.parse(c["resources"]["requests"]["memory"]).alias("memory_request"),
            ),
        )
    )


def pod_snapshot(df: DataFrame, payload: str, keep: list[str] = ()) -> DataFrame:
    """Pods as rows, each container status joined to its resources by name inside the row."""
    p = F.col("_p")
    valid, _ = entity_quarantine(df, payload, POD, POD_LABELS)
    blank = F.lit("")
    sizes = ["cpu_limit", "cpu_request", "memory_limit", "memory_request"]

    def container(c: Column, limits: Column) -> Column:
        own = [c[f].alias(n) for f, n in (("name", "name"), ("image", "image"), ("ready", "ready"))]
        size = F.get(F.filter(limits, lambda r: r["name"] == c["name"]), F.lit(0))
        return F.struct(
            *own,
            c["restartCount"].alias("restart_count"),
            container_state(c["state"]).alias("state"),
            *[size[f].alias(f) for f in sizes],
        )

    containers = _let(
        _limits_by_container(p["spec"]["containers"]),
        lambda limits: F.transform(p["status"]["containerStatuses"], lambda c: container(c, limits)),
    )
    return valid.select(
        *keep,
        *_identity(POD_LABELS(p)),
        _conditions(p["status"]["conditions"]).alias("conditions"),
        _one_of(p["status"]["phase"], POD_PHASES).alias("phase"),
        p["status"]["reason"].alias("reason"),
        containers.alias("containers"),
        F.coalesce(p["spec"]["nodeName"], blank).alias("node_name"),
        F.coalesce(p["status"]["hostIP"], blank).alias("host_ip"),
        F.coalesce(p["status"]["podIP"], blank).alias("pod_ip"),
        _epoch_s(p["status"]["startTime"]).alias("start_s"),
    )


def pod_metrics(df: DataFrame, payload: str, ids: list[str]) -> DataFrame:
    """One row per container with its cpu and memory quantity."""
    p = F.col("_p")
    return (
        _open(df, payload, POD_METRICS)
        .select(
            *ids,
            F.unix_millis(F.try_to_timestamp(p["timestamp"])).alias("metric_ms"),
            F.explode(p["containers"]).alias("c"),
        )
        .select(
            *ids,
            "metric_ms",
            F.col("c.name").alias("container"),
            quantity.parse(F.col("c.usage.cpu")).alias("cpu"),
            quantity.parse(F.col("c.usage.memory")).alias("memory"),
        )
    )


def namespace_scan(
    deployments: DataFrame, labels: str, name: str, namespace: str, kind: str = NATIVE_TYPE
) -> DataFrame:
    """Clusters found by their type label; deployments without a name are skipped."""
    return (
        deployments.where((F.col(labels)["type"] == kind) & F.col(name).isNotNull())
        .select(F.col(name).alias("cluster_id"), F.col(namespace).alias("namespace"))
        .distinct()
    )


def _urls(df: DataFrame, endpoint: str) -> DataFrame:
    host = F.col("dns") if endpoint == "dns" else F.col("cluster_ip")
    port = F.col("port").cast("string")
    return (
        df.withColumn("dns_url", F.concat(F.lit("http://"), "dns", F.lit(":"), port))
        .withColumn("ip_url", F.concat(F.lit("http://"), "cluster_ip", F.lit(":"), port))
        .withColumn("url", F.concat(F.lit("http://"), host, F.lit(":"), port))
    )


def endpoint_from_service(services: DataFrame, keep: list[str], endpoint: str = "dns") -> DataFrame:
    """Endpoints of rest services that have a cluster address and a port named rest."""
    rest = F.get(F.filter("ports", lambda x: x["name"] == "rest"), F.lit(0))["port"]
    found = services.where("is_rest").select(
        *keep, F.col("name").alias("svc_name"), "namespace", "dns", "cluster_ip", rest.alias("port")
    )
    return _urls(found.where(F.col("cluster_ip").isNotNull() & F.col("port").isNotNull()), endpoint)


def endpoint_from_ports(services: DataFrame, keep: list[str], endpoint: str = "dns") -> DataFrame:
    """Endpoints by the target of the well-known port, which is also the default."""
    known = F.get(F.filter("ports", lambda x: x["port"] == REST_PORT), F.lit(0))["target_port"]
    found = services.where(F.col("cluster_ip").isNotNull()).select(
        *keep,
        F.col("name").alias("svc_name"),
        "namespace",
        "dns",
        "cluster_ip",
        F.coalesce(known, F.lit(REST_PORT)).alias("port"),
    )
    return _urls(found, endpoint)
