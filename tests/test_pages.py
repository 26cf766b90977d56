"""Results kept in order: the same pages as a sort of the whole table, read from few files, with counters that need no rows."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pages
from tidemark.session import scratch_dir


@pytest.fixture(scope="module")
def kept(spark):
    """1000 rows in any order, the last 100 without an order value, columns named like the index's own."""
    n = F.col("id")
    rows = spark.range(1000).select(
        F.when(n < 900, (n * 617) % 900 * 3).alias("seq"), n.alias("place"), F.lit("x").alias("file"), F.concat(F.lit("row"), n.cast("string")).alias("a.b")
    )
    rows = rows.repartition(5)
    return rows, pages.write_ordered(rows, ["seq", "place"], scratch_dir(spark, "pages"), file_rows=130, step=20)


def in_order(rows):
    return [tuple(r) for r in rows.orderBy(F.col("seq").asc_nulls_first(), "place").collect()]


def test_index_covers_every_place_once(kept):
    runs = kept[1].index.orderBy("place").collect()
    assert [r.place for r in runs] == [sum(x.rows for x in runs[:k]) for k in range(len(runs))]
    assert sum(r.rows for r in runs) == 1000 and len({r.file for r in runs}) > 5


def test_pages_are_slices_of_the_order(spark, kept):
    rows, result = kept
    want = in_order(rows)
    reopened = pages.open_ordered(spark, result.folder, result.order)
    for number, size in ((1, 7), (3, 90), (2, 100), (11, 97), (1, 2000), (40, 25)):
        start = (number - 1) * size
        got = pages.page(reopened, number, size)
        found = sorted(map(tuple, got.collect()), key=lambda r: want.index(r[:4]))
        assert [r[:4] for r in found] == want[start : start + size]
        assert {r[4:] for r in found} == {(-(-1000 // size), number, number < -(-1000 // size), False, len(found))}


def test_only_the_files_of_the_page_are_read(kept):
    _, result = kept
    every = {r.file for r in result.index.select("file").distinct().collect()}
    for start in (0, 300, 700):
        names = pages.files_of(result, start, 50)
        assert 1 <= len(names) <= 2 < len(every)
        read = pages._rows(result, pages._runs(result, start, 50), start, 50).inputFiles()
        assert sorted(f.rsplit("/", 1)[-1] for f in read) == names
    plan = pages._rows(result, pages._runs(result, 500, 50), 500, 50)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(seq" in plan and "LessThanOrEqual(seq" in plan


def test_counters_without_rows(spark, kept):
    _, result = kept
    beyond = pages.page(result, 12, 100, running=True).collect()
    assert [tuple(r) for r in beyond] == [(None, None, None, None, 10, 12, True, True, 0)]
    none = pages.write_ordered(spark.createDataFrame([], "seq long, text string"), ["seq"], scratch_dir(spark, "pages"))
    assert [tuple(r) for r in pages.page(none, 1, 10).collect()] == [(None, None, 0, 1, False, False, 0)]
    assert [tuple(r) for r in pages.chunk(none, 5, 10).collect()] == [(None, None, 5, False)]
    assert list(pages.drained(none, 10)) == []
    with pytest.raises(ValueError):
        pages.page_views(result, [0], 10)


def test_chunks_go_on_from_their_cursor(kept):
    rows, result = kept
    want = [r for r in in_order(rows) if r[0] is not None]
    offset, seen = -1, []
    while True:
        got = pages.chunk(result, offset, 250).collect()
        if got[0].seq is None:
            assert len(got) == 1 and got[0].last_offset == offset
            break
        seen += sorted((tuple(r)[:4] for r in got), key=lambda r: r[0])
        assert {r.last_offset for r in got} == {seen[-1][0]}
        offset = seen[-1][0]
    assert seen == want


def test_drained_gives_every_row_once(kept):
    rows, result = kept
    parts = [(sorted(map(tuple, part.collect()), key=repr), at) for part, at in pages.drained(result, 300)]
    assert [at for _, at in parts] == [300, 600, 900, 1000]
    assert sorted((r for part, _ in parts for r in part), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    late = [at for _, at in pages.drained(result, 300, offset=850)]
    assert late == [1000]
