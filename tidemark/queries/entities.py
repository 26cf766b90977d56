"""Entity operators.

Each row of ``orders`` (or ``lineitem``, ``customer``) is written as the JSON payload a service would
send and parsed back, so the work is one pass over the table whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import entities
from tidemark.queries.base import choose, customer, epoch_ms, lineitem, orders, sql_choose
from tidemark.queries.status import JOB_STATE
from tidemark.sources.tables import table

SOURCE = "tidemark"
NAMESPACE = {"P": "dev", "F": "prod", "O": "test"}


def _named(**fields) -> Column:
    """Struct with hyphens for double underscores in the field names."""
    return F.struct(*[_col(v).alias(k.replace("__", "-")) for k, v in fields.items()])


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _payload(df: DataFrame, ids: dict[str, Column], body: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in ids.items()], F.to_json(body).alias("payload"))


def _cluster_ids() -> dict[str, Column]:
    return {
        "cluster_id": F.col("o_custkey"),
        "namespace": choose(F.col("o_orderstatus"), NAMESPACE),
    }


IDS = ["cluster_id", "namespace"]
_IDS_SQL = f"o_custkey AS cluster_id, {sql_choose('o_orderstatus', NAMESPACE)} AS namespace"


def q_job_overview(spark, d):
    size = F.length("o_orderpriority")
    tasks = F.struct(
        size.alias("total"), F.lit(1).alias("created"), (size - 1).alias("running"), F.lit(0).alias("failed")
    )
    def job(prefix, state):
        return _named(
            jid=F.concat(F.lit(prefix), F.col("o_orderkey").cast("string")),
            name=F.col("o_orderpriority"),
            state=state,
            start__time=epoch_ms("o_orderdate"),
            end__time=F.lit(-1).cast("bigint"),
            last__modification=epoch_ms("o_orderdate") + 5,
            tasks=tasks,
        )

    body = F.struct(
        F.array(
            job("a", choose(F.col("o_orderstatus"), JOB_STATE)), job("b", F.col("o_orderpriority"))
        ).alias("jobs")
    )
    raw = _payload(orders(spark, d), _cluster_ids(), body)
    jobs = entities.job_overview(raw, "payload", IDS)
    return jobs.select(
        *IDS, "job_id", "job_name", "state", "start_ms", "end_ms", "tasks.total", "tasks.running", "tasks.canceled"
    )


def q_job_status_list(spark, d):
    body = F.struct(
        F.array(
            _named(id=F.concat(F.lit("a"), F.col("o_orderkey").cast("string")),
                   status=choose(F.col("o_orderstatus"), JOB_STATE)),
            _named(id=F.concat(F.lit("b"), F.col("o_orderkey").cast("string")), status="LOST"),
        ).alias("jobs")
    )
    return entities.job_status_list(_payload(orders(spark, d), _cluster_ids(), body), "payload", IDS)


def q_worker_ids(spark, d):
    key = F.col("o_orderkey").cast("string")
    body = F.struct(
        F.array(_named(id=F.concat(F.lit("tm-"), key, F.lit("-1"))),
                _named(id=F.concat(F.lit("tm-"), key, F.lit("-2")))).alias("taskmanagers")
    )
    ids = {"job_id": F.col("o_orderkey")}
    raw = _payload(orders(spark, d), ids, F.when(F.col("o_orderstatus") != "P", body))
    found = entities.worker_ids(raw, "payload", ["job_id"])
    return found.select("job_id", F.array_join("worker_ids", ",").alias("workers"), F.size("worker_ids").alias("n"))


def _part_pairs(spark, d):
    def pair(key, value):
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    pairs = F.array(
        pair("type", F.col("p_type")),
        pair("brand", F.col("p_brand")),
        pair("type", F.col("p_name")),
        pair("size", F.col("p_size").cast("string")),
    )
    return table(spark, d, "part").select(
        "p_partkey", F.to_json(F.when(F.col("p_size") > 3, pairs)).alias("payload")
    )


def q_pairs_to_map(spark, d):
    out = entities.pairs_payload_to_map(_part_pairs(spark, d), "payload", "key", "conf")
    return out.select(
        "p_partkey", F.size("conf").alias("n"), *[F.col("conf")[k].alias(k) for k in ("brand", "size", "type")]
    )


def q_cluster_overview(spark, d):
    n = F.col("o_orderkey") % 7
    body = _named(
        flink__version=F.concat(F.lit("1.16."), n.cast("string")),
        taskmanagers=n, slots__total=n * 4, slots__available=n * 2, jobs__running=n + 1,
        jobs__finished=F.length("o_orderpriority"), jobs__cancelled=0, jobs__failed=n + 3,
    )
    raw = _payload(orders(spark, d), {**_cluster_ids(), "poll": F.col("o_orderkey")}, body)
    out = entities.cluster_overview(raw, "payload", [*IDS, "poll"])
    return out.select(*[c for c in out.columns if c != "jobs"], "jobs.*")


def q_worker_detail(spark, d):
    def resource(factor):
        return _named(
            cpuCores=F.col("l_linenumber") * factor, taskHeapMemory=F.col("l_partkey") * 1024,
            taskOffHeapMemory=0, managedMemory=F.col("l_suppkey") * 2048, networkMemory=F.col("l_partkey"),
        )

    memory = {
        name: F.col("l_partkey") * (i + 1)
        for i, name in enumerate(
            ["frameworkHeap", "taskHeap", "frameworkOffHeap", "taskOffHeap", "networkMemory",
             "managedMemory", "jvmMetaspace", "jvmOverhead", "totalFlinkMemory", "totalProcessMemory"]
        )
    }
    body = _named(
        id=F.concat(F.lit("tm-"), F.col("l_linenumber").cast("string")), path="akka.tcp://tm",
        dataPort=F.col("l_linenumber") + 6000, slotsNumber=4, freeSlots=F.col("l_linenumber") % 4,
        totalResource=resource(0.5), freeResource=resource(0.25),
        hardware=_named(cpuCores=8.0, physicalMemory=F.col("l_suppkey"), freeMemory=1, managedMemory=2),
        memoryConfiguration=_named(**memory),
    )
    raw = _payload(lineitem(spark, d), {"cluster_id": F.col("l_orderkey"), "poll": F.col("l_partkey")}, body)
    out = entities.worker_detail(raw, "payload", ["cluster_id", "poll"])
    return out.select(
        "cluster_id", "poll", "tm_id", "path", "data_port", "slots_number", "free_slots",
        F.col("total_resource.cpuCores").cast("double").alias("cpu"),
        F.col("free_resource.cpuCores").cast("double").alias("free_cpu"),
        F.col("total_resource.managedMemory").alias("managed"),
        F.col("hardware.physicalMemory").alias("physical"),
        F.col("memory_configuration.jvmOverhead").alias("overhead"),
        F.col("memory_configuration.totalProcessMemory").alias("process"),
    )


def _order_conf(spark, d):
    target = choose(F.col("o_orderstatus"), {"P": "embedded", "F": "yarn-session", "O": "mainframe"})
    marker = choose(
        F.col("o_orderpriority"), {"1-URGENT": "K8sSession", "2-HIGH": "kubernetes-application", "3-MEDIUM": "odd"}
    )
    source = F.when(F.col("o_custkey") % 3 != 0, F.when(F.col("o_custkey") % 3 == 1, SOURCE).otherwise("hand"))
    entries = F.array(
        F.struct(F.lit("execution.target"), target),
        F.struct(F.lit("deploy.target"), marker),
        F.struct(F.lit("deploy.source"), source),
    )
    return orders(spark, d).select("o_orderkey", F.map_from_entries(entries).alias("conf"))


def q_exec_type(spark, d):
    return _order_conf(spark, d).select("o_orderkey", entities.exec_type(F.col("conf")).alias("exec_type"))


def q_deployed_by_platform(spark, d):
    mine = entities.deployed_by_platform(F.col("conf"), SOURCE)
    return _order_conf(spark, d).select("o_orderkey", mine.alias("deployed_by_platform"))


def q_savepoint_status(spark, d):
    failed = F.col("o_orderstatus") == "F"
    cause = _named(**{"stack__trace": F.concat(F.lit("boom "), F.col("o_orderpriority"))})
    operation = F.when(
        F.col("o_orderstatus") != "O",
        F.struct(
            F.when(~failed, F.concat(F.lit("/sp/"), F.col("o_orderkey").cast("string"))).alias("location"),
            F.when(failed, cause).alias("failure-cause"),
        ),
    )
    state = choose(F.col("o_orderstatus"), {"P": "COMPLETED", "F": "COMPLETED", "O": "IN_PROGRESS"})
    state = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("HALF")).otherwise(state)
    body = F.struct(F.struct(state.alias("id")).alias("status"), operation.alias("operation"))
    raw = _payload(orders(spark, d), {"trigger_id": F.col("o_orderkey")}, body)
    return entities.savepoint_status(raw, "payload", ["trigger_id"])


def _iso_time(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _app_labels(kind: str) -> Column:
    return F.struct(
        F.concat(F.lit("app-"), F.col("o_custkey").cast("string")).alias("app"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.lit("jobmanager")).alias("component"),
        F.lit(kind).alias("type"),
    )


def _metadata(name: Column, labels: Column | None = None) -> Column:
    return F.struct(
        name.alias("name"),
        choose(F.col("o_orderstatus"), NAMESPACE).alias("namespace"),
        _iso_time("o_orderdate").alias("creationTimestamp"),
        *([labels.alias("labels")] if labels is not None else []),
    )


def _service_name() -> Column:
    tail = F.when(F.col("o_orderstatus") == "F", F.lit("-rest")).otherwise(F.lit("-rpc"))
    return F.concat(F.lit("svc-"), F.col("o_orderkey").cast("string"), tail)


def _services(spark, d):
    def port(name, number, target):
        return F.struct(
            _col(name).alias("name"),
            F.lit("TCP").alias("protocol"),
            _col(number).alias("port"),
            _col(target).alias("targetPort"),
        )

    web = port("rest", 8081, (F.col("o_custkey") % 100 + 9000).cast("int"))
    broken = port(F.lit(None).cast("string"), 1, 1)
    ports = F.array(broken, port("rpc", 6123, 6123), web, web)
    few = F.array(port("rpc", 6123, 6123))
    spec = F.struct(
        _app_labels("x").alias("selector"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("10.0.0."), (F.col("o_custkey") % 250).cast("string")))
        .alias("clusterIP"),
        F.when(F.col("o_custkey") % 5 == 0, few).otherwise(ports).alias("ports"),
    )
    body = F.struct(_metadata(_service_name()).alias("metadata"), spec.alias("spec"))
    return _payload(orders(spark, d), {"o_orderkey": F.col("o_orderkey")}, body)


def _service_rows(spark, d):
    return entities.service_snapshot(_services(spark, d), "payload", ["o_orderkey"])


def q_service_snapshot(spark, d):
    ports = F.transform(
        "ports", lambda x: F.concat_ws("/", x["name"], x["protocol"], x["port"].cast("string"), x["target_port"].cast("string"))
    )
    return _service_rows(spark, d).withColumn("ports", F.array_join(ports, ","))


_CONDITION_TIMES = {"a": 3600, "b": 7200, "c": 7200}


def _raw_conditions() -> Column:
    def cond(kind, status, seconds):
        at = F.expr(f"o_orderdate + make_dt_interval(0, 0, 0, {seconds})") if seconds else None
        when = (
            F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'") if at is not None else F.lit(None).cast("string")
        )
        return F.struct(
            F.lit(kind).alias("type"), _col(status).alias("status"), when.alias("lastTransitionTime")
        )

    return F.array(
        cond("a", "True", 3600),
        cond("b", F.col("o_orderpriority"), 7200),
        cond("c", "False", 7200),
        cond("d", "Unknown", None),
    )


def _shown_conditions() -> Column:
    return F.array_join(
        F.transform("conditions", lambda c: F.concat_ws(":", c["cond_type"], c["status"], c["last_transition_s"].cast("string"))),
        ",",
    )


def q_deployment_snapshot(spark, d):
    status = F.struct(
        F.col("o_orderkey").alias("observedGeneration"),
        F.when(F.col("o_orderstatus") == "F", F.lit(3)).alias("replicas"),
        F.length("o_orderpriority").alias("readyReplicas"),
        _raw_conditions().alias("conditions"),
    )
    spec = F.struct(F.struct(_app_labels("x").alias("matchLabels")).alias("selector"))
    name = F.concat(F.lit("dep-"), F.col("o_orderkey").cast("string"))
    body = F.struct(_metadata(name).alias("metadata"), spec.alias("spec"), status.alias("status"))
    raw = _payload(orders(spark, d), {"o_orderkey": F.col("o_orderkey")}, body)
    out = entities.deployment_snapshot(raw, "payload", ["o_orderkey"])
    return out.withColumn("conditions", _shown_conditions())


def _raw_state() -> Column:
    at = _iso_time("o_orderdate")
    running = F.when(F.col("o_orderstatus") == "P", F.struct(at.alias("startedAt")))
    waiting = F.when(
        F.col("o_orderpriority") == "2-HIGH",
        F.struct(F.lit("pulling").alias("message"), F.lit("ImagePull").alias("reason")),
    )
    ended = F.when(
        F.col("o_orderstatus") == "F",
        F.struct(
            F.lit(137).alias("exitCode"),
            F.lit("killed").alias("message"),
            F.lit("OOMKilled").alias("reason"),
            at.alias("startedAt"),
            F.date_format(F.expr("o_orderdate + make_dt_interval(0, 1, 0, 0)"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("finishedAt"),
        ),
    )
    return F.struct(running.alias("running"), waiting.alias("waiting"), ended.alias("terminated"))


def _pods(spark, d):
    cpu = F.concat((F.col("o_custkey") % 10 + 1).cast("string"), F.lit("00m"))
    limits = F.struct(cpu.alias("cpu"), F.lit("2Gi").alias("memory"))
    requests = F.struct(F.lit("250m").alias("cpu"), F.lit("512Mi").alias("memory"))
    containers = F.array(
        F.struct(F.lit("main").alias("name"), F.struct(requests.alias("limits"), requests.alias("requests")).alias("resources")),
        F.struct(F.lit("main").alias("name"), F.struct(limits.alias("limits"), requests.alias("requests")).alias("resources")),
    )
    statuses = F.array(
        F.struct(
            F.lit("main").alias("name"), F.lit("img:1").alias("image"), (F.col("o_orderstatus") == "P").alias("ready"),
            F.length("o_orderpriority").alias("restartCount"), _raw_state().alias("state"),
        ),
        F.struct(
            F.lit("side").alias("name"), F.lit("img:2").alias("image"), F.lit(True).alias("ready"),
            F.lit(0).alias("restartCount"), F.lit(None).cast(_raw_state_type(spark, d)).alias("state"),
        ),
    )
    status = F.struct(
        choose(F.col("o_orderstatus"), {"P": "Running", "F": "Failed", "O": "Odd"}).alias("phase"),
        F.when(F.col("o_orderstatus") == "P", F.lit("10.1.1.1")).alias("podIP"),
        _iso_time("o_orderdate").alias("startTime"),
        _raw_conditions().alias("conditions"),
        statuses.alias("containerStatuses"),
    )
    spec = F.struct(F.lit("node-1").alias("nodeName"), containers.alias("containers"))
    name = F.concat(F.lit("pod-"), F.col("o_orderkey").cast("string"))
    body = F.struct(
        _metadata(name, _app_labels("x")).alias("metadata"), spec.alias("spec"), status.alias("status")
    )
    return _payload(orders(spark, d), {"o_orderkey": F.col("o_orderkey")}, body)


def _raw_state_type(spark, d):
    return orders(spark, d).select(_raw_state().alias("s")).schema["s"].dataType


def q_pod_snapshot(spark, d):
    out = entities.pod_snapshot(_pods(spark, d), "payload", ["o_orderkey"])
    main, side = F.col("containers")[0], F.col("containers")[1]
    return out.select(
        "o_orderkey", "cluster_id", "namespace", "name", "component", "create_s", "phase", "reason",
        "node_name", "host_ip", "pod_ip", "start_s",
        _shown_conditions().alias("conditions"),
        main["ready"].alias("ready"), main["restart_count"].alias("restarts"),
        main["state"]["state"].alias("main_state"), side["state"]["state"].alias("side_state"),
        main["cpu_limit"]["value"].alias("cpu_limit"), main["cpu_limit"]["unit"].alias("cpu_unit"),
        main["memory_request"]["value"].alias("memory_request"), main["memory_request"]["unit"].alias("memory_unit"),
        side["cpu_limit"].isNull().alias("side_unlimited"),
    )


def q_container_state(spark, d):
    raw = orders(spark, d).select("o_orderkey", F.to_json(_raw_state()).alias("payload"))
    schema = "running struct<startedAt:string>,waiting struct<message:string,reason:string>," \
             "terminated struct<exitCode:int,message:string,reason:string,signal:int,startedAt:string,finishedAt:string>"  # fmt: skip
    parsed = raw.select("o_orderkey", F.from_json("payload", schema).alias("raw"))
    return parsed.select("o_orderkey", entities.container_state(F.col("raw")).alias("s")).select("o_orderkey", "s.*")


def q_entity_quarantine(spark, d):
    valid, rejected = entities.entity_quarantine(
        _services(spark, d), "payload", entities.SERVICE, entities.SERVICE_LABELS
    )
    good = valid.select("o_orderkey", F.lit("valid").alias("verdict"), F.lit("").alias("missing"))
    bad = rejected.select(
        "o_orderkey", F.lit("rejected").alias("verdict"), F.array_join("missing", ",").alias("missing")
    )
    return good.unionByName(bad)


def q_pod_metrics(spark, d):
    def usage(name, cpu, memory):
        return F.struct(
            F.lit(name).alias("name"), F.struct(cpu.alias("cpu"), memory.alias("memory")).alias("usage")
        )

    quantity = F.col("l_quantity").cast("int").cast("string")
    body = F.struct(
        _iso_time("l_shipdate").alias("timestamp"),
        F.array(
            usage("main", F.concat(quantity, F.lit("n")), F.concat(quantity, F.lit("Ki"))),
            usage("side", quantity, F.lit("1E")),
        ).alias("containers"),
    )
    raw = _payload(lineitem(spark, d), {"name": F.col("l_orderkey"), "part": F.col("l_partkey")}, body)
    out = entities.pod_metrics(raw, "payload", ["name", "part"])
    return out.select(
        "name", "part", "metric_ms", "container",
        F.col("cpu.value").alias("cpu"), F.col("cpu.unit").alias("cpu_unit"),
        F.col("memory.value").alias("memory"), F.col("memory.unit").alias("memory_unit"),
    )


def q_namespace_scan(spark, d):
    kind = choose(F.col("c_mktsegment"), {"BUILDING": entities.NATIVE_TYPE, "MACHINERY": entities.NATIVE_TYPE}, "plain")
    deployments = customer(spark, d).select(
        F.create_map(F.lit("type"), kind).alias("labels"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"),
        F.concat(F.lit("ns-"), F.col("c_nationkey").cast("string")).alias("namespace"),
    )
    return entities.namespace_scan(deployments, "labels", "name", "namespace")


def q_endpoint_from_service(spark, d):
    return entities.endpoint_from_service(_service_rows(spark, d), ["o_orderkey"])


def q_endpoint_from_ports(spark, d):
    return entities.endpoint_from_ports(_service_rows(spark, d), ["o_orderkey"], endpoint="ip")


QUERIES = {
    "job_overview": q_job_overview,
    "job_status_list": q_job_status_list,
    "worker_ids": q_worker_ids,
    "pairs_to_map": q_pairs_to_map,
    "cluster_overview": q_cluster_overview,
    "worker_detail": q_worker_detail,
    "exec_type": q_exec_type,
    "deployed_by_platform": q_deployed_by_platform,
    "savepoint_status": q_savepoint_status,
    "service_snapshot": q_service_snapshot,
    "deployment_snapshot": q_deployment_snapshot,
    "pod_snapshot": q_pod_snapshot,
    "container_state": q_container_state,
    "entity_quarantine": q_entity_quarantine,
    "pod_metrics": q_pod_metrics,
    "namespace_scan": q_namespace_scan,
    "endpoint_from_service": q_endpoint_from_service,
    "endpoint_from_ports": q_endpoint_from_ports,
}

_NS = sql_choose("o_orderstatus", NAMESPACE)
_STATE = sql_choose("o_orderstatus", JOB_STATE)
_CREATED = "CAST(epoch_ms(o_orderdate) // 1000 AS BIGINT)"
_SERVICE_NAME = "'svc-' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN '-rest' ELSE '-rpc' END"
_COND = f"""'c:False:' || ({_CREATED} + 7200) || ',b:Unknown:' || ({_CREATED} + 7200) ||
  ',a:True:' || ({_CREATED} + 3600) || ',d:Unknown'"""
_IDENTITY = f"""o_orderkey, 'app-' || o_custkey AS cluster_id, {_NS} AS namespace,
  'jobmanager' AS component, {_CREATED} AS create_s"""
_KNOWN = "o_orderpriority <> '5-LOW'"
_IP = "CASE WHEN o_orderpriority <> '1-URGENT' THEN '10.0.0.' || (o_custkey % 250) END"
_TAG = """CASE WHEN o_orderstatus = 'P' THEN 'Running' WHEN o_orderpriority = '2-HIGH' THEN 'Waiting'
  WHEN o_orderstatus = 'F' THEN 'Terminated' ELSE 'Unknown' END"""

SQL = {
    "job_overview": f"""
SELECT {_IDS_SQL}, p || o_orderkey AS job_id, o_orderpriority AS job_name,
       CASE p WHEN 'a' THEN {_STATE} ELSE 'UNKNOWN' END AS state, epoch_ms(o_orderdate) AS start_ms,
       CAST(-1 AS BIGINT) AS end_ms, CAST(length(o_orderpriority) AS INTEGER) AS total,
       CAST(length(o_orderpriority) - 1 AS INTEGER) AS running, CAST(NULL AS INTEGER) AS canceled
FROM orders, (VALUES ('a'), ('b')) AS v(p)""",
    "job_status_list": f"""
SELECT {_IDS_SQL}, i AS position, p || o_orderkey AS job_id,
       CASE p WHEN 'a' THEN {_STATE} ELSE 'UNKNOWN' END AS state
FROM orders, (VALUES ('a', 0), ('b', 1)) AS v(p, i)""",
    "worker_ids": """
SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus = 'P' THEN ''
       ELSE 'tm-' || o_orderkey || '-1,tm-' || o_orderkey || '-2' END AS workers,
       CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 2 END AS n FROM orders""",
    "pairs_to_map": """
SELECT p_partkey, CASE WHEN p_size > 3 THEN 3 ELSE 0 END AS n, CASE WHEN p_size > 3 THEN p_brand END AS brand,
       CASE WHEN p_size > 3 THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_size > 3 THEN p_name END AS type
FROM part""",
    "cluster_overview": f"""
SELECT {_IDS_SQL}, o_orderkey AS poll, '1.16.' || (o_orderkey % 7) AS version,
       CAST(o_orderkey % 7 AS INTEGER) AS tm_total, CAST(o_orderkey % 7 * 4 AS INTEGER) AS slots_total,
       CAST(o_orderkey % 7 * 2 AS INTEGER) AS slots_available, CAST(o_orderkey % 7 + 1 AS INTEGER) AS running,
       CAST(length(o_orderpriority) AS INTEGER) AS finished, 0 AS canceled,
       CAST(o_orderkey % 7 + 3 AS INTEGER) AS failed FROM orders""",
    "worker_detail": """
SELECT l_orderkey AS cluster_id, l_partkey AS poll, 'tm-' || l_linenumber AS tm_id, 'akka.tcp://tm' AS path,
       l_linenumber + 6000 AS data_port, 4 AS slots_number, l_linenumber % 4 AS free_slots,
       CAST(l_linenumber * 0.5 AS DOUBLE) AS cpu, CAST(l_linenumber * 0.25 AS DOUBLE) AS free_cpu,
       l_suppkey * 2048 AS managed, l_suppkey AS physical, l_partkey * 8 AS overhead, l_partkey * 10 AS process
FROM lineitem""",
    "exec_type": """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'K8sSession' WHEN '2-HIGH' THEN 'K8sApplication'
       ELSE CASE o_orderstatus WHEN 'P' THEN 'K8sApplication' WHEN 'F' THEN 'YarnSession' ELSE 'Unknown' END
       END AS exec_type FROM orders""",
    "deployed_by_platform": """
SELECT o_orderkey, o_custkey % 3 = 1 AS deployed_by_platform FROM orders""",
    "savepoint_status": """
SELECT o_orderkey AS trigger_id, state, location, failure_cause, state = 'Completed' AS is_completed,
       failure_cause IS NOT NULL AS is_failed
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'Unknown'
               WHEN o_orderstatus = 'O' THEN 'InProgress' ELSE 'Completed' END AS state,
             CASE WHEN o_orderstatus = 'P' THEN '/sp/' || o_orderkey END AS location,
             CASE WHEN o_orderstatus = 'F' THEN 'boom ' || o_orderpriority END AS failure_cause FROM orders)""",
    "service_snapshot": f"""
SELECT {_IDENTITY}, {_SERVICE_NAME} AS name, {_SERVICE_NAME} || '.' || {_NS} AS dns, {_IP} AS cluster_ip,
       'rpc/TCP/6123/6123' || CASE WHEN o_custkey % 5 = 0 THEN ''
         ELSE ',rest/TCP/8081/' || (o_custkey % 100 + 9000) END AS ports,
       o_orderstatus = 'F' AS is_rest
FROM orders WHERE {_KNOWN}""",
    "deployment_snapshot": f"""
SELECT {_IDENTITY}, 'dep-' || o_orderkey AS name, {_COND} AS conditions, o_orderkey AS observed_generation,
       CASE WHEN o_orderstatus = 'F' THEN 3 ELSE 0 END AS replicas,
       CAST(length(o_orderpriority) AS INTEGER) AS ready_replicas, 0 AS unavailable_replicas,
       0 AS available_replicas, 0 AS updated_replicas
FROM orders WHERE {_KNOWN}""",
    "pod_snapshot": f"""
SELECT {_IDENTITY}, 'pod-' || o_orderkey AS name,
       CASE o_orderstatus WHEN 'P' THEN 'Running' WHEN 'F' THEN 'Failed' ELSE 'Unknown' END AS phase,
       CAST(NULL AS VARCHAR) AS reason, 'node-1' AS node_name, '' AS host_ip,
       CASE WHEN o_orderstatus = 'P' THEN '10.1.1.1' ELSE '' END AS pod_ip, {_CREATED} AS start_s,
       {_COND} AS conditions, o_orderstatus = 'P' AS ready, CAST(length(o_orderpriority) AS INTEGER) AS restarts,
       {_TAG} AS main_state, 'Unknown' AS side_state,
       CAST((o_custkey % 10 + 1) * 100 AS DOUBLE) AS cpu_limit, 'm' AS cpu_unit,
       CAST(512 AS DOUBLE) AS memory_request, 'Mi' AS memory_unit, true AS side_unlimited
FROM orders WHERE {_KNOWN}""",
    "container_state": f"""
SELECT o_orderkey, state, CASE WHEN state = 'Terminated' THEN 137 END AS exit_code,
       CASE state WHEN 'Waiting' THEN 'pulling' WHEN 'Terminated' THEN 'killed' END AS message,
       CASE state WHEN 'Waiting' THEN 'ImagePull' WHEN 'Terminated' THEN 'OOMKilled' END AS reason,
       CAST(NULL AS INTEGER) AS signal,
       CASE WHEN state IN ('Running', 'Terminated') THEN created END AS started_s,
       CASE WHEN state = 'Terminated' THEN created + 3600 END AS finished_s
FROM (SELECT o_orderkey, {_TAG} AS state, {_CREATED} AS created FROM orders)""",
    "entity_quarantine": f"""
SELECT o_orderkey, CASE WHEN {_KNOWN} THEN 'valid' ELSE 'rejected' END AS verdict,
       CASE WHEN {_KNOWN} THEN '' ELSE 'component' END AS missing FROM orders""",
    "pod_metrics": """
SELECT l_orderkey AS name, l_partkey AS part, epoch_ms(l_shipdate) AS metric_ms, c AS container, l_quantity AS cpu,
       CASE c WHEN 'main' THEN 'n' ELSE 'k' END AS cpu_unit,
       CASE c WHEN 'main' THEN l_quantity ELSE 1.0 END AS memory,
       CASE c WHEN 'main' THEN 'Ki' ELSE 'E' END AS memory_unit
FROM lineitem, (VALUES ('main'), ('side')) AS v(c)""",
    "namespace_scan": """
SELECT DISTINCT c_name AS cluster_id, 'ns-' || c_nationkey AS namespace FROM customer
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal >= 0""",
    "endpoint_from_service": f"""
SELECT *, dns_url AS url FROM (
  SELECT o_orderkey, {_SERVICE_NAME} AS svc_name, {_NS} AS namespace, {_SERVICE_NAME} || '.' || {_NS} AS dns,
         {_IP} AS cluster_ip, 8081 AS port, 'http://' || {_SERVICE_NAME} || '.' || {_NS} || ':8081' AS dns_url,
         'http://' || {_IP} || ':8081' AS ip_url
  FROM orders WHERE {_KNOWN} AND o_orderstatus = 'F' AND o_custkey % 5 <> 0 AND o_orderpriority <> '1-URGENT')""",
    "endpoint_from_ports": f"""
SELECT *, 'http://' || dns || ':' || port AS dns_url, 'http://' || cluster_ip || ':' || port AS ip_url,
       'http://' || cluster_ip || ':' || port AS url
FROM (SELECT o_orderkey, {_SERVICE_NAME} AS svc_name, {_NS} AS namespace, {_SERVICE_NAME} || '.' || {_NS} AS dns,
             {_IP} AS cluster_ip,
             CAST(CASE WHEN o_custkey % 5 = 0 THEN 8081 ELSE o_custkey % 100 + 9000 END AS INTEGER) AS port
      FROM orders WHERE {_KNOWN} AND o_orderpriority <> '1-URGENT')""",
}
