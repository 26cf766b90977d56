"""The trie of rebuilt conversations against dictionaries of tuples."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import prefixes

SF = "/root/testdata/sf0.001"
TABLE = "conv_id long, turn long, role string, text string"


def brute(rows: list[tuple]) -> list[tuple]:
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    sequences = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        sequences[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends, kids = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c, s in sequences.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (
            min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
        )
        for n, m in members.items()
    )


def rows_of(df) -> list[tuple]:
    return sorted(tuple(-1 if r[c] is None else r[c] for c in prefixes.OUT) for r in df.collect())


@pytest.mark.parametrize("shard_turns", [prefixes.SHARD_TURNS, 40, 3])
def test_given_table(spark, shard_turns):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert rows_of(prefixes.trie(df, shard_turns)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def made(seed: int, count: int) -> list[tuple]:
    pick, rows = random.Random(seed), []
    for c in range(count):
        kind, turns = pick.random(), []
        if kind < 0.4:
            turns = [("user", "hot"), ("assistant", "answer"), ("user", "again")]  # a hot conversation
        elif kind < 0.7:
            turns = [("user", "hot")] + [("user", pick.choice("ab")) for _ in range(pick.randrange(6))]
        else:
            turns = [(pick.choice([None, "user"]), pick.choice(["", None, "x", "yy", "é日"])) for _ in range(pick.randrange(1, 9))]
        rows += [(c * pick.choice([1, 1, 1, 7]) if c % 11 else c, None if k == 0 and c % 3 == 0 else k, r, t) for k, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize("seed, shard_turns", [(1, 5), (2, 17), (3, 100_000), (4, 2)])
def test_copies_and_shared_turns_over_many_shards(spark, seed, shard_turns):
    """Groups of copies and of shared first turns much larger than a shard; no turns equal in one conversation, so that the order is clear."""
    rows = {(c, t): (c, t, r, x) for c, t, r, x in made(seed, 250)}
    df = spark.createDataFrame(list(rows.values()), TABLE).repartition(7)
    assert rows_of(prefixes.trie(df, shard_turns)) == brute(list(rows.values()))


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "left out"), (5, 0, "user", "a"), (5, 0, "user", "a"), (5, 0, "user", "a"), (-150, 1, None, None), (-100, 0, "user", "n"), (-100, 1, "user", "m"),
        (200, None, "user", "z"), (201, 3, "user", "z"), (202, -4, None, "z" * 30_000), (10**15, 0, "x", ""), (300, 0, "user", "only"),
    ]
    rows += [(700 + k, t, "user", f"t{t}") for k in range(30) for t in range(300 if k < 2 else 7)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], f"{TABLE}, shard int, level string").repartition(5)
    for shard_turns in (100_000, 50):
        assert rows_of(prefixes.trie(df, shard_turns)) == brute(rows)
    assert prefixes.trie(df.limit(0)).count() == 0 and prefixes.trie(df.where("conv_id IS NULL")).count() == 0


def test_find_close_against_a_stack():
    pick = random.Random(5)
    for size in (1, 2, 31, 32, 33, 64, 1000, 5000):
        signs, depth = [1], 1
        for _ in range(size - 1):
            signs.append(1 if depth <= 1 or pick.random() < (0.5 if pick.random() < 0.9 else 0.95) else -1)
            depth += signs[-1]
        stack, want = [], {}
        for k, s in enumerate(signs):
            if s == 1:
                stack.append(k)
            else:
                want[stack.pop()] = k
        opens = np.flatnonzero(np.array(signs) == 1)
        got = prefixes.find_close(np.cumsum(signs), opens)
        assert got.tolist() == [want.get(k, len(signs)) for k in opens.tolist()]
