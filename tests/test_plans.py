"""Plan shapes against plain Python, with tiny blocks and one key that holds most rows."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tidemark.operators import keyed, relational, results, status
from tidemark.plans import lookup, ordered

BLOCKS = [1, 7, None]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for seq in rng.sample(range(-200, 800), 400):
        key = rng.choice([1, 1, 1, 2, 3, None])
        out.append((key, seq, rng.choice(["a", "a", "b", "end", None])))
    return out


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(rows, "k int, seq bigint, state string").repartition(5)


def by_key(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return [list(g) for _, g in groupby(order, key=lambda r: r[0])]


def same(df, expected):
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, expected))


@pytest.mark.parametrize("block", BLOCKS)
def test_changes(log, rows, block):
    kept = [r for g in by_key(rows) for i, r in enumerate(g) if i == 0 or g[i - 1][2] != r[2]]
    same(status.changes(log, ["k"], "seq", ["state"], block), kept)


@pytest.mark.parametrize("block", BLOCKS)
def test_changes_is_idempotent(log, block):
    once = status.changes(log, ["k"], "seq", ["state"], block)
    again = status.changes(once, ["k"], "seq", ["state"], block)
    same(again, [tuple(r) for r in once.collect()])


def _until(group):
    ends = [i for i, r in enumerate(group) if r[2] == "end"]
    return group[: ends[0] + 1] if ends else group


@pytest.mark.parametrize("block", BLOCKS)
def test_take_until_terminal(log, rows, block):
    kept = [r for g in by_key(rows) for r in _until(g)]
    same(status.take_until_terminal(log, ["k"], "seq", F.col("state") == "end", block), kept)


@pytest.mark.parametrize("block", BLOCKS)
def test_changes_until(log, rows, block):
    kept = []
    for g in by_key(rows):
        kept += [r for i, r in enumerate(_until(g)) if i == 0 or g[i - 1][2] != r[2]]
    found = status.changes(log, ["k"], "seq", ["state"], block, until=F.col("state") == "end")
    same(found, kept)


def test_last_state(log, rows):
    last = [_until(g)[-1] for g in by_key(rows)]
    same(status.last_state(log, ["k"], "seq", F.col("state") == "end"), last)


@pytest.mark.parametrize("block", BLOCKS)
def test_cascade_cancel(log, rows, block):
    expected = []
    for g in by_key(rows):
        failed = False
        for k, seq, state in g:
            state = "Fail" if state == "end" else state
            expected.append((k, seq, "Cancel" if failed else state))
            failed = failed or state == "Fail"
    marked = log.withColumn("state", F.when(F.col("state") == "end", "Fail").otherwise(F.col("state")))
    same(status.cascade_cancel(marked, ["k"], "seq", "state", block), expected)


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("n", [0, 3, 50, -1])
def test_retain_by_key(log, rows, block, n):
    groups = by_key(rows)
    first = [r for g in groups for r in (g if n < 0 else g[:n])]
    last = [r for g in groups for r in (g if n < 0 else g[len(g) - min(n, len(g)) :])]
    same(results.retain_first(log, "seq", n, ["k"], block), first)
    same(results.retain_last(log, "seq", n, ["k"], block), last)


def test_retain_globally(log, rows, monkeypatch):
    order = sorted(rows, key=lambda r: r[1])
    for shallow in (10_000, 0):
        monkeypatch.setattr(results, "SHALLOW_ROWS", shallow)
        same(results.retain_first(log, "seq", 30, block_rows=16), order[:30])
        same(results.retain_last(log, "seq", 30, block_rows=16), order[-30:])


@pytest.mark.parametrize("block", [5, 64, None])
def test_pages(log, rows, block, monkeypatch):
    order = sorted(rows, key=lambda r: r[1])
    for shallow in (10_000, 0):
        monkeypatch.setattr(results, "SHALLOW_ROWS", shallow)
        for page in (1, 7, 14, 20):
            got = results.result_page(log, "seq", page, 30, block_rows=block)
            same(got.select("k", "seq", "state"), order[(page - 1) * 30 : page * 30])
            head = got.first()
            if head:
                assert (head.total_pages, head.has_next_page) == (14, page < 14)
    with pytest.raises(ValueError):
        results.result_page(log, "seq", 0, 30)


@pytest.mark.parametrize("block", BLOCKS)
def test_asof(spark, log, rows, block):
    probes = log.where("state = 'end'").select("k", "seq")
    facts = log.where("state in ('a', 'b')").withColumn("at", F.col("seq"))
    expected = []
    for g in by_key(rows):
        seen = (None, None)
        for k, seq, state in g:
            if state in ("a", "b"):
                seen = (state, seq)
            elif state == "end":
                expected.append((k, seq, *seen))
    same(relational.asof_join(probes, facts, ["k"], "seq", ["state", "at"], block), expected)


def test_block_number_bounds(spark):
    wide = spark.createDataFrame([(-(2**62),), (0,), (2**62,)], "seq bigint")
    blocks = [r[0] for r in wide.select(ordered.block_of(wide, "seq").alias("b")).orderBy("seq").collect()]
    assert blocks == sorted(blocks) and blocks[0] == 0 and blocks[-1] <= ordered.MAX_BLOCKS


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join(spark, no_broadcast, how):
    fact = spark.createDataFrame(
        [(1 if i % 3 else i % 17, i) for i in range(300)] + [(None, 1000 + i) for i in range(40)], "k int, v int"
    )
    dim = spark.createDataFrame([(1, "x"), (1, "y"), (5, "z"), (99, "q"), (None, "n")], "k int, w string")
    expected = fact.join(dim, "k", how).collect()
    hot = lookup.hot_keys(fact, ["k"], share=8)
    assert hot.count() == 1 + (40 * 8 > 340) and hot.count() < 8
    same(lookup.skew_join(fact, dim, ["k"], how, share=8), [tuple(r) for r in expected])
    same(lookup.skew_join(fact, dim, ["k"], how, ["v"]), [tuple(r) for r in expected])


def test_lists_in_pieces(spark, no_broadcast):
    keys = [1 if i < 500 else 2 if i < 510 else None for i in range(520)]
    df = spark.createDataFrame(list(zip(keys, range(520))), "k int, v int")
    lists = lookup.listed(df, ["k"], {"vs": F.col("v")}, piece_rows=50).collect()
    assert sorted(v for r in lists for v in r.vs) == list(range(520))
    assert max(len(r.vs) for r in lists) < 120
    assert [r.piece for r in lists if r.k == 2] == [0] == [r.piece for r in lists if r.k is None]


def test_lists_are_whole_at_every_size(spark):
    """One row an owner, as the SQL of the two queries says, and the same values as rows."""
    jobs = spark.range(25_000).selectExpr("if(id < 24990, 1, 2) AS owner", "id AS job", "'up' AS state")
    states = keyed.job_state_map(jobs, ["owner"], "job", "state").collect()
    assert sorted((r.owner, r.piece, len(r.states)) for r in states) == [(1, 0, 24_990), (2, 0, 10)]
    refs = keyed.cluster_refs({"a": jobs, "b": jobs.where("owner = 2")}, ["owner"], "job").collect()
    assert sorted((r.owner, r.piece, len(r.a), len(r.b)) for r in refs) == [(1, 0, 24_990, 0), (2, 0, 10, 10)]
    rows = keyed.cluster_ref_rows({"a": jobs, "b": jobs.where("owner = 2")}, ["owner"], "job")
    assert rows.where("owner = 1 AND kind = 'a'").count() == 24_990 and rows.count() == 25_010
    assert keyed.job_state_rows(jobs, ["owner"], "job", "state").exceptAll(jobs).count() == 0


def test_equal_values_are_dealt_over_the_pieces(spark):
    df = spark.range(3000).selectExpr("1 AS k", "'x' AS v")
    pieces = lookup.listed(df, ["k"], {"vs": F.col("v")}, piece_rows=100).collect()
    assert sum(len(r.vs) for r in pieces) == 3000 and max(len(r.vs) for r in pieces) <= 200


def test_operators_without_broadcast(spark, no_broadcast):
    """The queries give the same rows when every lookup takes the hot-key path."""
    import __spark_entry__
    from tests.compare import connect, difference

    folder = "/root/testdata/sf0.001"
    duck = connect(folder)
    for name in ("or_set", "apply_change_events", "cascade_delete", "list_by_cluster", "cancel_log",
                 "frames_with_rows", "effective_config", "job_state_map", "cluster_refs"):
        build, text = __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name]
        assert difference(build(spark, folder), duck, text) is None, name


def test_latest_state_ignores_arrival_order(spark):
    tied = [(1, 5, "a"), (1, 5, "b"), (1, 4, "z")]
    for order in (tied, tied[::-1]):
        df = spark.createDataFrame(order, "k int, at int, v string")
        same(keyed.latest_state(df, ["k"], ["at"]), [(1, 5, "b")])


def test_no_whole_key_window(log):
    """The only windows partitioned by the key alone run over block summaries."""
    plan = status.changes(log, ["k"], "seq", ["state"], 7)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_block" in line for line in windows)
