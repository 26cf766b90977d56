"""The interval join against comparing every pair."""

import random

import pytest

from tidemark.operators.relational import interval_join

TABLE = "name string, a bigint, b bigint, left string, _level int"


def made(seed: int, count: int) -> list[tuple]:
    pick, rows = random.Random(seed), []
    for k in range(count):
        start = pick.choice([pick.randrange(-500, 500), 7, pick.randrange(-(2**62), 2**62)])
        rows.append((f"{seed}-{k}", start, start + pick.choice([0, 1, pick.randrange(40), pick.randrange(2**20), 2**40, -1]), "l", 3))
    far = [("all", -(2**63), 2**63 - 1, "l", 1), ("low", -(2**63), -(2**63), "l", 1), ("high", 2**63 - 1, 2**63 - 1, "l", 1), ("no start", None, 5, "l", 1), ("no end", 5, None, "l", 1)]
    return rows + far + rows[:3] + [("hot", 7, 9, "l", 0)] * 60


@pytest.mark.parametrize("broadcast", [True, False])
def test_against_every_pair(spark, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before if broadcast else "-1")
    try:
        one, other = made(1, 120), made(2, 150)
        met = interval_join(*(spark.createDataFrame(r, TABLE).repartition(3) for r in (one, other)), ("a", "b"), ("a", "b"))
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        whole = [[r for r in rows if r[1] is not None and r[2] is not None and r[1] <= r[2]] for rows in (one, other)]
        want = sorted((x[0], y[0]) for x in whole[0] for y in whole[1] if x[1] <= y[2] and y[1] <= x[2])
        assert sorted((r.left.name, r.right.name) for r in met.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_nothing_to_meet(spark):
    none, some = spark.createDataFrame([], TABLE), spark.createDataFrame(made(3, 5), TABLE)
    assert interval_join(none, some, ("a", "b"), ("a", "b")).count() == 0 and interval_join(some, none, ("a", "b"), ("a", "b")).count() == 0
