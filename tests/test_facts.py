"""Facts the reference asserts about quantities, paths, numbers, settings, maps and sets."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths, quantity, settings
from tidemark.operators import entities, keyed, metrics, normalize, results, status
from tidemark.queries.relational import value_band


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


@pytest.mark.parametrize(
    "text, value, unit",
    [("100m", 100, "m"), ("233Ki", 233, "Ki"), ("233Gi", 233, "Gi"), ("233", 233, "k"), ("1E", 1, "E"),
     ("1.5e3", 1500, "k"), ("12 M", 12, "M")],
)
def test_quantity_parse(spark, text, value, unit):
    (got,) = one(spark, quantity.parse(F.lit(text)))
    assert (got.value, got.unit) == (value, unit)


@pytest.mark.parametrize("text", ["", "m", "x1", "1mm", "1x", None])
def test_quantity_malformed(spark, text):
    assert one(spark, quantity.parse(F.lit(text).cast("string"))) == (None,)


@pytest.mark.parametrize(
    "value, unit, target, expected",
    [(1000, "m", "u", 1_000_000), (1000, "u", "m", 1), (1, "Gi", "Ki", 1048576), (1024, "Ki", "Mi", 1),
     (1048576, "Ki", "Gi", 1), (1000, "k", "k", 1000), (1000, "Ki", "Ki", 1000), (1.024, "Ki", "k", 1),
     (1.024, "Gi", "G", 1), (1.024, "Mi", "M", 1), (1.024, "Ki", "m", 1000), (1.024, "Gi", "k", 1_000_000),
     (1, "k", "Ki", 1.024), (1, "G", "Gi", 1.024), (1, "M", "Mi", 1.024), (1.5, "k", "Mi", 1536)],
)
def test_quantity_convert(spark, value, unit, target, expected):
    got = one(spark, quantity.convert(F.lit(float(value)), F.lit(unit), target))
    assert got == (expected,)


def test_quantity_exact(spark):
    assert one(spark, quantity.convert(F.lit(1024.0), F.lit("k"), "Ki", exact=True)) == (1000.0,)
    assert one(spark, quantity.convert(F.lit(1.0), F.lit("Gi"), "M", exact=True)) == (1024**3 / 1e6,)


@pytest.mark.parametrize(
    "path, scheme, rest, pure, name, s3p",
    [
        ("s3://bucket/xx/xx.jar", "s3", "bucket/xx/xx.jar", "bucket/xx/xx.jar", "xx.jar", "s3p://bucket/xx/xx.jar"),
        ("s3:///bucket/xx/xx.jar", "s3", "/bucket/xx/xx.jar", "bucket/xx/xx.jar", "xx.jar", "s3p:///bucket/xx/xx.jar"),
        ("/bucket/xx/xx.jar", None, "/bucket/xx/xx.jar", "bucket/xx/xx.jar", "xx.jar", "/bucket/xx/xx.jar"),
        ("", None, "", "", "", ""),
        ("s3://", None, "s3", "s3", "s3:", "s3://"),
        ("a/b/", None, "a/b/", "a/b/", "b", "a/b/"),
        ("s3a://a://b", "s3a", "b", "b", "b", "s3p://a"),
        ("x://://", None, "x", "x", ":", "x://://"),
    ],
)
def test_paths(spark, path, scheme, rest, pure, name, s3p):
    p = F.lit(path)
    got = one(
        spark, paths.scheme(p), paths.without_scheme(p), paths.pure_path(p), paths.file_name(p), paths.s3_to_s3p(p)
    )
    assert got[:3] + got[4:] == (scheme, rest, pure, s3p)
    if "x://" not in path and path != "s3://":
        assert got[3] == name


def test_first_slash_and_s3(spark):
    assert one(spark, *[paths.without_first_slash(F.lit(p)) for p in ("/xx/xx.jar", "xx/xx.jar", "")]) == (
        "xx/xx.jar", "xx/xx.jar", "")
    assert one(spark, *[paths.is_s3(F.lit(p)) for p in ("s3", "s3n://a", "hdfs://s3", " s3p://x")]) == (
        True, True, False, True)


def test_clamp(spark):
    ten = F.lit(10)
    assert one(spark, *[settings.at_least(ten, m) for m in (5, 10, 15)]) == (10, 10, 15)
    assert one(spark, *[settings.valid_or(ten, ten > m, 0) for m in (5, 10, 15)]) == (10, 0, 0)
    assert one(spark, *[settings.at_least(F.lit(10.0), m) for m in (5.0, 15.0)]) == (10.0, 15.0)


def test_config_flatten(spark):
    ha = settings.present({"impl": F.lit(""), "dir": F.lit("/tmp"), "id": F.lit(None).cast("string")})
    jm = F.lit(-2333)
    memory = settings.present({"jm": F.concat(settings.valid_or(jm, jm > 0, 1920).cast("string"), F.lit("m"))})
    assert one(spark, ha, memory) == ({"impl": "", "dir": "/tmp"}, {"jm": "1920m"})


def test_map_log(spark):
    log = spark.createDataFrame(
        [(1, "put", 1, "one"), (2, "put", 2, "two"), (3, "put", 3, "three"), (3, "put", 4, "four"), (4, "remove", 1, None)],
        "seq bigint, op string, key int, value string",
    )
    store = keyed.lww_remove(log, ["key"], ["seq"], F.col("op") == "remove").select("key", "value")
    assert {r.key: r.value for r in store.collect()} == {2: "two", 3: "three", 4: "four"}
    edit = spark.createDataFrame([(2, "two-two"), (7, "none")], "key int, value string")
    store = keyed.lww_update(store, edit, ["key"], {"value": F.col("new.value")})
    upsert = spark.createDataFrame([(10, "ten")], "key int, value string")
    for expected in ("ten", "ten-replace"):
        store = keyed.lww_upsert(store, upsert, ["key"], {"value": F.lit("ten-replace")})
        got = {r.key: r.value for r in store.collect()}
        assert got == {2: "two-two", 3: "three", 4: "four", 10: expected}
    assert keyed.lww_size(store).first().size == 4
    assert keyed.lww_size(None, spark).first().size == 0


def test_set_log(spark):
    log = spark.createDataFrame(
        [(i, 0, op, m) for i, (op, m) in enumerate([("add", x) for x in "aabcde"] + [("remove", "a")])],
        "seq bigint, owner int, op string, member string",
    )
    members = keyed.or_set(log, ["owner"], "member", "op", "seq")
    assert sorted(r.member for r in members.collect()) == list("bcde")
    more = spark.createDataFrame([(10, 0, "clear", None), (11, 0, "add", "a")], log.schema)
    again = keyed.or_set(log.union(more), ["owner"], "member", "op", "seq")
    assert [r.member for r in again.collect()] == ["a"]


def test_versions_and_ids(spark):
    versions = [settings.major_version(F.lit(v)) for v in ("1.16.1", "1.15", "1", "1.")]
    assert one(spark, *versions) == ("1.16", "1.15", "1", "1.")
    assert tuple(one(spark, settings.split_cluster_id(F.lit("app@ns")))[0]) == ("app", "ns")


def test_metric_names(spark):
    assert len(metrics.JOBMANAGER_METRICS) == 30 and len(set(metrics.JOBMANAGER_METRICS)) == 30
    assert len(metrics.TASKMANAGER_METRICS) == 35 and len(set(metrics.TASKMANAGER_METRICS)) == 35
    assert len(metrics.JOB_METRICS) == 20
    for key in metrics.JOBMANAGER_METRICS + metrics.TASKMANAGER_METRICS:
        assert one(spark, metrics.metric_field_name(F.lit(key))) == (metrics.field_name_text(key),)
    assert metrics.field_name_text("Status.JVM.GarbageCollector.G1_Old_Generation.Time") == (
        "jvmGarbageCollectorG1OldGenerationTime"
    )
    assert metrics.field_name_text("Status.JVM.CPU.Load") == "jvmCpuLoad"


def test_later_pair_wins(spark):
    pairs = F.from_json(
        F.lit('[{"key":"a","value":"1"},{"key":"b","value":"2"},{"key":"a","value":"3"}]'),
        "array<struct<key:string,value:string>>",
    )
    got = one(spark, entities.pairs_to_map(pairs, "key", "value"))
    assert got == ({"a": "3", "b": "2"},)


def test_deny_list(spark):
    df = spark.createDataFrame(
        [(" kubernetes.namespace ", "x"), ("a ", " b "), ("c", " "), ("pipeline.jars", "y")], "key string, value string"
    )
    assert [tuple(r) for r in normalize.config_deny_list(df, "key", "value").collect()] == [("a", "b")]


def test_map_columns_in_newest_rows(spark):
    log = spark.createDataFrame(
        [("a", "x", "Added", 1, {"v": 1}), ("a", "x", "Modified", 2, {"v": 2}), ("a", "y", "Added", 3, None)],
        "o string, n string, kind string, seq long, m map<string,int>",
    )
    now = keyed.apply_change_events(log, ["o"], "n", "kind", "seq").collect()
    assert {(r.n, r.seq): r.m for r in now} == {("x", 2): {"v": 2}, ("y", 3): None}
    last = status.last_state(log, ["o", "n"], "seq", F.col("kind") == "Added").collect()
    assert {(r.n, r.seq): r.m for r in last} == {("x", 1): {"v": 1}, ("y", 3): None}


def test_json_time_where_clocks_change(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = ["2024-03-10T02:30:00Z", "1969-12-31T23:59:59.25Z"]
        times = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp"))
        rows = results.rows_to_json(times).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.fields for r in rows] == ['["2024-03-10T02:30:00Z"]', '["1969-12-31T23:59:59.25Z"]']


def test_value_band_of_null(spark):
    values = spark.createDataFrame([(1.0,), (None,), (100.0,)], "v double")
    assert [r[0] for r in values.select(value_band("v")).collect()] == ["low", None, "high"]
