"""Katz models of higher orders against whole dictionaries, and the stored model."""

import random

import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import katz


def prose(seed: int, size: int) -> str:
    pick = random.Random(seed)
    words = [f"w{min(int(pick.expovariate(0.25)), 30)}" for _ in range(size)]
    return " ".join(words)


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, prose(k, k % 37)) for k in range(60)] + [(70, None), (71, ""), (72, "W1 w2 \n W3 unheard of"), (73, "w1 " * 400)]
    rows += [(5, prose(5, 5)), (5, prose(99, 20)), (None, "w1 w2 w3"), (None, "quite new words")]
    return rows, spark.createDataFrame([(i, t, i is not None and i % 5 == 1, 1) for i, t in rows], "doc_id long, text string, held_out boolean, order int")


@pytest.mark.parametrize("order", [2, 3, 4])
def test_any_order_agrees_with_dictionaries(texts, order):
    rows, df = texts
    want = brute.katz_of_order(rows, order, {i for i, _ in rows if i is not None and i % 5 == 1})
    found: dict = {}
    for r in katz.scored(df, order).collect():
        found.setdefault(r.doc_id, []).append(r.score)
    assert found.keys() == want.keys()
    for i, scores in found.items():
        assert sorted(scores) == pytest.approx(want[i])


def test_order_needs_a_context(texts):
    with pytest.raises(ValueError, match="order 2"):
        katz.scored(texts[1], 1)


def test_empty_and_untrained(texts):
    df = texts[1]
    assert katz.scored(df.limit(0), 3).count() == 0
    assert {r.score for r in katz.scored(df.withColumn("held_out", F.lit(True)), 3).collect()} == {0.0}


def test_stored_model_scores_alike(spark, texts, tmp_path):
    df = texts[1]
    for order in (2, 3):
        stored = katz.write_model(df, str(tmp_path / f"m{order}"), order, buckets=4)
        want = sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in katz.scored(df, order).collect())
        assert sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in katz.scored_from(stored, df, order).collect()) == want
        assert (tmp_path / f"m{order}" / f"order={order}" / "bucket=0").is_dir()
        assert stored.where("order > 0").groupBy("order", "context_hash", "word_hash").count().where("count > 1").isEmpty()
        # Unigrams and the unknown word add up to one, and so does every context with what it leaves to shorter ones.
        assert stored.where("order < 2").agg(F.sum("prob")).first()[0] == pytest.approx(1)
        assert stored.where("order = 1").agg(F.sum("count")).first()[0] == katz.scored(df, order).first().train_tokens
    nothing = katz.write_model(df.withColumn("held_out", F.lit(True)), str(tmp_path / "none"), 2)
    assert nothing.where("order > 0").count() == 0


def test_blocks_of_contexts_change_nothing(texts, monkeypatch):
    sent, answered = (x.toArrow() for x in katz._asked(texts[1], 3))
    found = []
    for rows in (10**9, 7):
        monkeypatch.setattr(katz, "BLOCK_ROWS", rows)
        sums = {}
        for dest in set(sent["dest"].to_pylist()):
            own, told = (x.filter(pc.equal(x["dest"], dest)) for x in (sent, answered))
            assert rows == 7 or len(list(katz.Partition(own).blocks() if len(katz.blobs_of(own, katz.NGRAMS)) else [])) <= 1
            sums[dest] = [a for _, a in katz.blobs_of(katz._scoring(own, told), katz.SUMS)]
        found.append(sums)
    assert found[0].keys() == found[1].keys()
    for dest, each in found[0].items():
        for a, b in zip(each, found[1][dest], strict=True):
            for x, y in zip(a, b, strict=True):
                assert list(x) == pytest.approx(list(y))


@pytest.mark.parametrize("order", [2, 3, 4])
def test_common_context_is_cut(spark, order, monkeypatch):
    rows = [(k, " ".join(f"a{(k * 31 + n) % 211} the b{(k * 17 + n * n) % 97}" for n in range(80)), k % 4 == 1) for k in range(24)]
    sent, answered = (x.toArrow() for x in katz._asked(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), order))
    grams: dict = {}
    for size in (10**9, 100):
        monkeypatch.setattr(katz, "BLOCK_ROWS", size)
        for dest in set(sent["dest"].to_pylist()):
            own, told = (x.filter(pc.equal(x["dest"], dest)) for x in (sent, answered))
            if len(katz.blobs_of(own, katz.NGRAMS)):
                largest = max(len(b.kind) for b in katz.Partition(own).blocks())
                assert size > 100 or largest <= 2 * size
            grams.setdefault(size, []).extend(katz._modelled(own, told).to_pylist())
    whole, cut = (sorted(tuple(r.values()) for r in found) for found in grams.values())
    assert [r[:4] for r in whole] == [r[:4] for r in cut]
    assert [r[4:] for r in cut] == [pytest.approx(r[4:]) for r in whole]
