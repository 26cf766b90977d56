"""A list of SQL statements run in order against one catalog, with a log of what became of each.

What a statement is, Spark's own parser says. A job runs in a session of its own, which starts with the settings, temporary views and functions
of the caller's; what it sets or registers ends with it, while tables are shared. The same list can run in either mode: over tables as they are,
or over streams (``run_streaming_job``), where queries and inserts run until the streams have given all they have.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.sinks import SinkNotAllowed

RUN_LOG = "ordinal int, sql string, status string, error string"

# Names of Spark's parsed statements that write rows, or may do so.
WRITING = {
    "InsertIntoStatement", "InsertIntoDir", "CreateTableAsSelect", "ReplaceTableAsSelect", "MergeIntoTable", "UpdateTable", "DeleteFromTable",
    "LoadData", "TruncateTable", "CompoundBody", "UnresolvedExecuteImmediate",
}
_COMMAND = "org.apache.spark.sql.catalyst.plans.logical.Command"
_PARSED = "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement"


def _parsed(spark: SparkSession, statement: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(statement.rstrip().rstrip(";"))


def _nodes(plan) -> list:
    """A plan's nodes, outermost first."""
    found, children = [plan], plan.children()
    for i in range(children.size()):
        found += _nodes(children.apply(i))
    return found


def _name(node) -> str:
    return node.getClass().getSimpleName()


def statement_kind(spark: SparkSession, statement: str) -> str:
    """``sink`` (writes rows), ``command`` (settings, definitions, listings) or ``query``; a text that does not parse raises."""
    nodes = _nodes(_parsed(spark, statement))
    if any(_name(n) in WRITING for n in nodes):
        return "sink"
    kinds = [spark._jvm.java.lang.Class.forName(name) for name in (_COMMAND, _PARSED)]
    return "command" if any(k.isInstance(nodes[0]) for k in kinds) else "query"


def is_sink(statement: str, spark: SparkSession | None = None) -> bool:
    """Does the statement write rows to a table?"""
    return statement_kind(spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate(), statement) == "sink"


def job_session(spark: SparkSession, conf: dict[str, str] | None = None) -> SparkSession:
    """A session that starts as a copy of ``spark``'s settings, temporary views and functions and shares nothing but the tables."""
    job = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for key, value in (conf or {}).items():
        job.conf.set(key, value)
    return job


def is_command(result: DataFrame) -> bool:
    """Was the statement executed by ``spark.sql`` itself, and its result kept?"""
    return result._jdf.queryExecution().commandExecuted().getClass().getSimpleName() == "CommandResult"


def run_sql_job(
    spark: SparkSession,
    statements: list[str],
    allow_sink: bool = False,
    conf: dict[str, str] | None = None,
    run_last: bool = True,
) -> tuple[DataFrame | None, DataFrame]:
    """(result of the last statement that ran, run log).

    Every statement is executed, queries into the noop sink, and marked Finish or Fail by that.  The first
    failure is marked Fail and every later statement Cancel.  With ``run_last`` off, a last query is only
    analysed and marked Run: the caller executes it by reading the result.
    """
    log: list[tuple[int, str, str, str | None]] = []
    last: DataFrame | None = None
    failed = False
    job = job_session(spark, conf)
    for ordinal, statement in enumerate(statements, start=1):
        if failed:
            log.append((ordinal, statement, "Cancel", None))
            continue
        try:
            if not allow_sink and is_sink(statement, job):
                raise SinkNotAllowed("writes are not allowed in this job")
            result = job.sql(statement.rstrip().rstrip(";"))
            lazy = not is_command(result)
            if lazy and (run_last or ordinal < len(statements)):
                result.write.format("noop").mode("overwrite").save()
                lazy = False
            last = result
            log.append((ordinal, statement, "Run" if lazy else "Finish", None))
        except (PySparkException, SinkNotAllowed) as problem:
            failed = True
            log.append((ordinal, statement, "Fail", str(problem).splitlines()[0]))
    return last, spark.createDataFrame(log, RUN_LOG)


def _insert(job: SparkSession, statement: str) -> tuple[str, DataFrame]:
    """(target, rows) of an INSERT INTO with one target."""
    plan = _parsed(job, statement)
    inserts = [n for n in _nodes(plan) if _name(n) == "InsertIntoStatement"]
    if len(inserts) != 1 or inserts[0].overwrite():
        raise SinkNotAllowed("a stream is written by INSERT INTO one table")
    insert = inserts[0]
    query = insert.query()
    if _name(plan) == "UnresolvedWith":  # the rows see the WITH clause in front of the INSERT
        query = plan.copy(query, plan.cteRelations(), plan.allowRecursion())
    rows = job._jvm.org.apache.spark.sql.classic.Dataset.ofRows(job._jsparkSession, query)
    return insert.table().multipartIdentifier().mkString("."), DataFrame(rows, job)


def _aggregates(rows: DataFrame) -> bool:
    return any(_name(n) == "Aggregate" for n in _nodes(rows._jdf.queryExecution().analyzed()))


def _run_stream(rows: DataFrame, checkpoint: str, target: str | None, output_mode: str, watermarked: bool) -> None:
    """Run a stream to the end of its input: into a table, or into nothing."""
    mode = "append" if watermarked or not _aggregates(rows) else output_mode
    writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if target is None:
        query = writer.format("noop").start()
    elif mode == "append":
        query = writer.toTable(target)
    else:
        # Every batch of a complete result replaces the one before; a batch that runs again writes the same rows.
        query = writer.foreachBatch(lambda batch, _: batch.write.insertInto(target, overwrite=True)).start()
    query.awaitTermination()


def run_streaming_job(
    spark: SparkSession,
    statements: list[str],
    streams: dict[str, DataFrame],
    checkpoint: str,
    allow_sink: bool = False,
    output_mode: str = "complete",
    conf: dict[str, str] | None = None,
) -> tuple[DataFrame | None, DataFrame]:
    """(result of the last query that could be read as a table, run log): ``run_sql_job`` with ``streams`` as views.

    A query or INSERT INTO over a stream runs as a checkpointed stream until its input is used up, and is marked Finish or Fail by that; run again with the
    same checkpoint, a list goes on where its streams had ended. Aggregates without a watermark are written with ``output_mode``, ``complete``
    being the one that fits a table; all else is appended. Statements over tables, those written before among them, run as in a batch job.
    """
    log: list[tuple[int, str, str, str | None]] = []
    last: DataFrame | None = None
    failed = False
    job = job_session(spark, conf)
    for name, stream in streams.items():
        plan = stream._jdf.queryExecution().logical()
        DataFrame(job._jvm.org.apache.spark.sql.classic.Dataset.ofRows(job._jsparkSession, plan), job).createOrReplaceTempView(name)
    for ordinal, statement in enumerate(statements, start=1):
        if failed:
            log.append((ordinal, statement, "Cancel", None))
            continue
        try:
            kind = statement_kind(job, statement)
            if kind == "sink" and not allow_sink:
                raise SinkNotAllowed("writes are not allowed in this job")
            target, rows = None, None
            if kind == "sink" and any(_name(n) == "InsertIntoStatement" for n in _nodes(_parsed(job, statement))):
                target, rows = _insert(job, statement)
            elif kind == "query":
                rows = job.sql(statement.rstrip().rstrip(";"))
            if rows is not None and rows.isStreaming:
                watermarked = "EventTimeWatermark" in rows._jdf.queryExecution().analyzed().toString()
                _run_stream(rows, f"{checkpoint}/{ordinal}", target, output_mode, watermarked)
            elif kind == "query":
                rows.write.format("noop").mode("overwrite").save()
                last = rows
            else:
                job.sql(statement.rstrip().rstrip(";"))
            log.append((ordinal, statement, "Finish", None))
        except (PySparkException, SinkNotAllowed) as problem:
            failed = True
            log.append((ordinal, statement, "Fail", str(problem).splitlines()[0]))
    return last, spark.createDataFrame(log, RUN_LOG)


def register_tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Temp views over the parquet tables of a folder."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
