"""Jaccard join: what many texts have in common makes no candidates, copies are settled first, and no link is lost by it."""

import random

import pytest

from tests.llm import brute
from tidemark.llm import jaccard

DOC = "doc_id long, text string"


def own_words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(10**9)}" for _ in range(n)]


def test_common_passage_and_copies_make_no_candidates(spark):
    passage = own_words(-1, 34)
    rows = [(k, " ".join(own_words(k, 50) + passage)) for k in range(200)]
    rows += [(1000 + k, rows[k % 20][1]) for k in range(60)]
    sizes, roots, found = jaccard.joined_sets(spark.createDataFrame(rows, DOC))
    assert found.count() == 0
    assert sizes.count() == len(rows)
    df = spark.createDataFrame(rows, DOC)
    assert sorted((r.doc_id is None, r.doc_id, r.n_links) for r in jaccard.with_links(df).collect()) == brute.linked_rows(rows)[0]
    assert sorted(map(tuple, jaccard.grouped(df).collect())) == brute.components(rows)


@pytest.mark.parametrize("most_keys", [0, 1_000_000])
def test_links_among_common_tokens(spark, monkeypatch, most_keys):
    monkeypatch.setattr(jaccard, "LEAST_COMMON", 2)
    monkeypatch.setattr(jaccard, "LARGE_TILE", 3)
    monkeypatch.setattr(jaccard, "MOST_KEYS", most_keys)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    words = own_words(-1, 120)
    rows = []
    for k in range(70):
        own, r = list(words), random.Random(k)
        for place in r.sample(range(120), r.randrange(1, 7)):
            own[place] = f"new{k}"
        rows.append((k, " ".join(own[: r.choice((80, 120))])))
    rows += [(100 + k, rows[k][1]) for k in range(9)]
    df = spark.createDataFrame(rows, DOC)
    want, links = brute.linked_rows(rows)
    assert sorted((r.doc_id is None, r.doc_id, r.n_links) for r in jaccard.with_links(df).collect()) == want
    assert sorted(map(tuple, jaccard.grouped(df).collect())) == brute.components(rows)
    assert sorted((tuple(r) for r in jaccard.links(df).collect()), key=repr) == sorted(links, key=repr)
