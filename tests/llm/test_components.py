"""Connected components against plain Python, with one task's links and with many tasks'."""

import random

import pytest

from tidemark.llm import components as comp

LINKS = "a long, b long"


def roots_of(links):
    up: dict = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, top(x)) for x in up if top(x) != x)


@pytest.mark.parametrize("held", [1 << 18, 40])
def test_components(spark, monkeypatch, held):
    monkeypatch.setattr(comp, "HELD", held)
    r = random.Random(held)
    chain = [(k, k + 1) for k in range(150)]
    r.shuffle(chain)
    loops = [(r.randrange(-200, 200), r.randrange(-200, 200)) for _ in range(150)] + [(-(1 << 63), 7), (7, 7), (300, 300)]
    for links in (chain, loops, [(0, 0)]):
        df = spark.createDataFrame(links, LINKS).repartition(6)
        assert sorted(map(tuple, comp.components(df).collect())) == roots_of(links)


def test_more_links_between_roots(spark):
    known, more = [(5, 1), (6, 1), (7, 2), (9, 4)], [(2, 1), (3, 8), (2, 1)]
    found = comp.merged(spark.createDataFrame(known, "node long, root long"), spark.createDataFrame(more, LINKS))
    assert sorted(map(tuple, found.collect())) == roots_of(known + more)


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Two tables are written, whatever the length of the chain: the links and their components."""
    made = []
    write = comp.written
    monkeypatch.setattr(comp, "written", lambda df, name: made.append(name) or write(df, name))
    links = [(k, k + 1) for k in range(60)]
    assert comp.components(spark.createDataFrame(links, LINKS).repartition(8)).count() == 60
    assert len(made) == 2
