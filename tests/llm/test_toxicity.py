"""Class-conditional Kneser-Ney models against plain Python, odd rows, and held-out accuracy."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.text import binary_parts

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def grams(word: bytes) -> list[bytes]:
    signs = b" " + word.replace(b"\0", b"\1") + b" "
    return [signs[max(0, k - toxicity.CONTEXT) : k + 1] for k in range(1, len(signs))]


def taken(counts) -> float:
    n = collections.Counter(counts)
    return n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5


class Plain:
    """The two models by the formula in the docstring, with dictionaries."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        self.counts = [collections.Counter(g for t in texts for w in t.lower().encode().split() for g in grams(w)) for texts in (toxic, ordinary)]
        kinds = [set() for _ in range(toxicity.CONTEXT + 3)]
        for g in set(self.counts[0]) | set(self.counts[1]):
            kinds[len(g)].add(g)
        for n in range(toxicity.CONTEXT + 1, 1, -1):
            kinds[n - 1] |= {g[1:] for g in kinds[n]}
        self.continued = [collections.Counter(g[1:] for g in kinds[n + 1]) for n in range(toxicity.CONTEXT + 1)]
        self.taken = [taken(c.values()) for c in self.continued]
        self.class_taken = [taken([v for v in c.values()]) for c in self.counts]

    def shared(self, g: bytes) -> float:
        if not g:
            return 1 / 256
        found = self.continued[len(g)]
        behind = [v for k, v in found.items() if k[:-1] == g[:-1]]
        if not behind:
            return self.shared(g[1:])
        cut = self.taken[len(g)]
        return max(found[g] - cut, 0) / sum(behind) + cut * len(behind) / sum(behind) * self.shared(g[1:])

    def chance(self, kind: int, g: bytes) -> float:
        found, cut = self.counts[kind], self.class_taken[kind]
        behind = [v for k, v in found.items() if k[:-1] == g[:-1] and v]
        if not behind:
            return self.shared(g[1:])
        return max(found[g] - cut, 0) / sum(behind) + cut * len(behind) / sum(behind) * self.shared(g[1:])

    def evidence(self, text: str) -> float:
        words = text.lower().encode().split()
        ratios = [sum(math.log(self.chance(0, g) / self.chance(1, g)) for g in grams(w)) for w in words]
        return sum(math.log(1 + toxicity.MIXED * (math.exp(min(r, 40)) - 1)) for r in ratios) / max(1, len(words))


def texts(seed: int, count: int, extra: list[str]) -> list[str]:
    pick = random.Random(seed)
    plain = ["stone", "river", "stones", "über", "a", "the", "rivers,", "garden", "gardening"]
    return [" ".join(pick.choice(plain + extra * 2) for _ in range(pick.randrange(1, 30))) for _ in range(count)]


def parts(rows: list[str]):
    return binary_parts(pa.array([t.lower().encode() for t in rows], pa.binary()))


def test_ratios_against_plain_python(spark):
    toxic, ordinary = texts(1, 12, ["vexolo", "vexoring"]), texts(2, 15, ["meadow"])
    rows = [(t, 1) for t in toxic] + [(t, 0) for t in ordinary]
    df = spark.createDataFrame(rows, "text string, toxic int").select(F.lower("text").cast("binary").alias("bytes"), "toxic").repartition(3)
    found = df.mapInArrow(toxicity._count_rows, "gram long, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("t"), F.sum("ordinary").alias("o")).orderBy("gram").collect()
    plain = Plain(toxic, ordinary)
    assert {r.gram: (r.t, r.o) for r in found} == {int.from_bytes(g, "big"): (plain.counts[0][g], plain.counts[1][g]) for g in {*plain.counts[0], *plain.counts[1]}}
    keys, t, o = (np.array([r[k] for r in found]) for k in range(3))
    ratios = toxicity.Ratios.fit(keys.astype(np.uint64), t.astype(float), o.astype(float))
    asked = [*texts(3, 20, ["vexolo", "vexotum", "zzz", "q\0q"]), "", "  ", "x" * 400]
    mean, size = ratios.evidence(*parts(asked))
    for k, text in enumerate(asked):
        assert size[k] == len(text.split()) and mean[k] == pytest.approx(plain.evidence(text), rel=1e-4, abs=1e-5)


def test_new_endings_of_known_expressions(spark):
    """Held-out documents with endings never seen are told apart; labels of held-out rows are not looked at."""
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        held = zlib.crc32(str(k).encode()) % 4 == 2
        pick = random.Random(k)
        words = texts(k, 1, [])[0].split() * 2
        if toxic:
            words.insert(pick.randrange(len(words)), f"vexo{''.join(pick.choice('abcdefgh') for _ in range(4))}")
        rows.append((k, " ".join(words), "x", 5))
        labels.append((k, 1, int(toxic) if not held else int(not toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    out = toxicity.scored(df, toxicity.fit(df, spark.createDataFrame(labels, LABELS))).collect()
    assert len(out) == 600
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    right = [r.predicted == (r.doc_id % 4 == 0) for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(right) / len(right) > 0.97


def test_odd_rows(spark):
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = [(k, "you vexolo thing " * 3 if k % 2 else "a quiet garden " * 3, "t") for k in ids]
    rows += [(None, None, "a"), (None, "vexolo", "b"), (7, None, "c"), (8, "", "d"), (9, " \t\n", "e"), (10, "x" * 100_000, "f"), *rows[:5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    labels = [(k, 1, k % 2) for k in ids] + [(None, 1, 1), (ids[0], None, None), (ids[1], 0, 0), (10**6, 1, 1)]
    model = toxicity.fit(df, spark.createDataFrame(labels, LABELS))
    out = toxicity.scored(df, model).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.row) for r in out) == sorted((i is None, i or 0, t or "", x) for i, t, x in rows)
    assert {round(r.score, 9) for r in out if not (r.text or "").strip()} == {round(model.share, 9)}
    assert all(r.predicted == 1 for r in out if "vexolo" in (r.text or "")) and all(r.predicted == 0 for r in out if "quiet" in (r.text or ""))


@pytest.mark.parametrize("labels, share", [([], 0.0), ([(1, 1, 0), (3, 1, 0)], 0.0), ([(1, 1, 1)], 1.0)])
def test_one_class_or_none(spark, labels, share):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, LABELS))
    assert {r.score for r in toxicity.scored(df, model).collect()} == {share}
    assert toxicity.scored(df.limit(0), toxicity.fit(df.limit(0), spark.createDataFrame(labels, LABELS))).count() == 0


def test_query(spark):
    rows = toxicity.op12_kneser_ney_toxicity(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
