"""Polarised whitening against numpy and Python's fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(rows, components=4):
    """{(id, place): [(component, n, deviation, |whitened|, explained)]} from exact fractions."""
    usable = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in usable), default=0)
    usable = [(i, v + [0] * (dims - len(v))) for i, v in usable]
    fit = sorted({tuple(v) for _, v in usable})
    n = len(fit)
    sums = [sum(v[k] for v in fit) for k in range(dims)]
    exact = [[sum((v[a] - Fraction(sums[a], n)) * (v[b] - Fraction(sums[b], n)) for v in fit) / n for b in range(dims)] for a in range(dims)]
    values, vectors = np.linalg.eigh(np.array(exact, float).reshape(dims, dims))
    order = np.argsort(values)[::-1][:components]
    trace = float(sum(exact[k][k] for k in range(dims)))
    out = []
    for i, v in usable:
        centred = np.array([float(v[k] - Fraction(sums[k], n)) for k in range(dims)])
        deviation = sum((n * v[k] - sums[k]) ** 2 for k in range(dims))
        for c, at in enumerate(order, 1):
            flat = trace == 0 or values[at] <= whitening.LEAST_SHARE * trace
            z = None if flat else abs(float(centred @ vectors[:, at]) / math.sqrt(values[at]))
            out.append((i, c, n, deviation if deviation < 1 << 63 else None, z, values[at] / trace if trace else None))
    return out


def same(got, want):
    def key(r):
        return (r[0] is None, r[0] or 0, r[1], r[3] is None, r[3] or 0)

    got = sorted(((r.vec_id, r.component, r.n, r.deviation, None if r.whitened is None else abs(r.whitened), r.explained) for r in got), key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want, strict=True):
        for p, q in zip(a[4:], b[4:], strict=True):
            assert (p is None) == (q is None) and (p is None or abs(p - q) <= 1e-7 * max(1, abs(q)))


def test_against_fractions(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").limit(150)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    cut = spark.createDataFrame([(i, v[:9]) for i, v in rows], "vec_id long, embedding array<float>").repartition(5)
    got = whitening.whitened(cut).collect()
    same(got, plain([(i, v[:9]) for i, v in rows]))
    assert 0 <= got[0].identity_error <= 1e-9 and len({r.identity_error for r in got}) == 1


def test_odd_rows(spark):
    """Nulls, bad entries, short and empty vectors, repeated rows, a vector that half of all rows share, entries beyond 32 and 64 bits."""
    nan, inf = float("nan"), float("inf")
    pick = np.random.default_rng(1)
    rows = [(k, [float(c) for c in pick.normal(size=5)]) for k in range(40)]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (100, None), (101, [1.0, None, 2.0]), (102, [nan]), (103, [inf, 1.0]), (104, []), (105, [0.5]), (105, [0.5, 0.0]), (106, [-0.0])]
    rows += [(200 + k, [1.0, 2.0, 3.0, 4.0, 5.0]) for k in range(50)] + rows[:3]
    table = "vec_id long, embedding array<double>, component int, n long, x string"
    df = spark.createDataFrame([(i, v, 7, 8, "c") for i, v in rows], table).repartition(4)
    same(whitening.whitened(df).collect(), plain(rows))
    wide = [*rows, (300, [3e9, -3e9, 1e7, 0.0, 1.0]), (301, [1e12, 0.0, 2e12, 5.0, 5.0])]
    df = spark.createDataFrame(wide, "vec_id long, embedding array<double>").repartition(3)
    got = whitening.whitened(df, components=2).collect()
    same(got, plain(wide, 2))
    assert any(r.deviation is None for r in got)


@pytest.mark.parametrize("rows, flat", [([], 0), ([(1, None)], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 4), ([(1, []), (None, None)], 0), ([(1, [0.0]), (2, [0.0, 0.0])], 4)])
def test_nothing_to_spread(spark, rows, flat):
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == flat and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in got)


def test_ends_of_the_range():
    assert whitening.scaled(np.array([1e300, -1e300, -0.0, -0.001, 2.0**55, 1e308])).tolist() == [2**63 - 1, -(2**63), 0, -1, 2**63 - 1, 2**63 - 1]
    for x in ([], [0, 0], [1, -128, 127], [1, 0, 128], [2**40, 0], [-(2**63), 5, 0]):
        import pyarrow as pa

        data = pa.array([whitening.encoded(np.array(x, np.int64)), whitening.encoded(np.array([3], np.int64))], pa.binary())
        assert whitening.decoded(data, 4).tolist() == [x + [0] * (4 - len(x)), [3, 0, 0, 0]]


def test_sums_beyond_64_bits(spark):
    """Partial sums leave the task before they overflow; single entries too large go in limbs."""
    rows = [(k, [float(2**52 + k), float(-(2**54) + k * 4)]) for k in range(30)]
    fit = whitening.fit_list(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "embedding")
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    sums = whitening.entry_sums(fit, 2)
    assert sums == [sum(v[0] for v in x), sum(v[1] for v in x)]
    squares = whitening.squared_sums(fit, 30, sums)
    assert squares[0, 1] == sum((30 * (v[0] + v[1]) - sum(sums)) ** 2 for v in x)
    assert squares[1, 1] == sum((30 * v[1] - sums[1]) ** 2 for v in x)
