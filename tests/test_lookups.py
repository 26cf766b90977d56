"""Looked-up tables that repeat a key give one row for each wanted key."""

from tidemark.operators import keyed

PAIR = "k int, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_fallback(spark):
    wanted = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "k int")
    store = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (2, None)], PAIR)
    second = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z"), (1, "q")], PAIR)
    assert rows(keyed.lookup_with_fallback(wanted, store, second, ["k"], "v")) == [(1, "b", "store"), (2, "y", "fallback"), (3, "z", "fallback"), (4, None, "none")]


def test_endpoints(spark):
    enabled = spark.createDataFrame([(1,), (2,)], "k int")
    endpoints = spark.createDataFrame([(1, "h", 80), (1, "h", 90), (3, "i", 1)], "k int, host string, port int")
    got = keyed.enabled_with_endpoint(enabled, endpoints, ["k"])
    assert got.columns == ["k", "host", "port"] and rows(got) == [(1, "h", 90), (2, None, None)]


def test_trackers(spark):
    tracked = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    answers = spark.createDataFrame([(1, False), (1, True), (2, False), (2, None)], "k int, up boolean")
    assert rows(keyed.tracker_status(tracked, {"jobs": (answers, "up")}, ["k"])) == [(1, "Running"), (2, "Idle"), (3, "Unknown")]
