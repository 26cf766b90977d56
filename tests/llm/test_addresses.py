"""Stages drop rows by their address: repeated ids and rows, null ids, clashing columns, empty tables."""

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import exact, frames, jaccard, quality

TABLE = "doc_id long, text string"
A, B, C = (" ".join(f"{letter}{k}" for k in range(80)) for letter in "abc")


@pytest.fixture(params=["memory", "files"])
def made(spark, tmp_path, request):
    def build(rows, columns=TABLE):
        df = spark.createDataFrame(rows, columns).repartition(3)
        if request.param == "memory":
            return df
        df.write.parquet(f"{tmp_path}/rows")
        return spark.read.parquet(f"{tmp_path}/rows")

    return build


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_no_distinct_text_is_lost_where_ids_repeat(made):
    rows = [(7, A), (5, A + " z"), (7, B), (9, C), (None, C + " z"), (None, "one two three four five six"), (None, "other words of a text without id"), (9, "")]
    kept = rows_of(jaccard.kept_documents(made(rows)))
    assert kept == sorted([(5, A + " z"), (7, B), (9, C), (9, ""), *rows[5:7]], key=repr)


def test_one_row_of_a_group_of_copies_stays(made):
    rows = [(1, A), (1, A), (0, A), (None, A), (None, B), (None, B), (3, None), (2, ""), (None, ""), (4, C)]
    assert rows_of(exact.kept_documents(made(rows))) == sorted([(1, A), (None, B), (3, None), (4, C)], key=repr)


def test_clashing_columns_and_nothing(made, spark):
    columns = f"{TABLE}, _key0 int, _metadata string, _file int, row string, root int, kept string"
    rows = [(k, text, k, "m", k, "r", k, "k") for k, text in enumerate([A, A, A + " z", B, None, ""])]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = made(rows, columns)
    assert rows_of(exact.kept_documents(docs)) == sorted([rows[1], rows[2], rows[3], rows[5]], key=repr)
    assert rows_of(jaccard.kept_documents(docs)) == sorted([rows[0], rows[3], rows[4], rows[5]], key=repr)
    assert rows_of(quality.kept_documents(docs, labels)) == rows[:4]
    for stage in (exact.kept_documents, jaccard.kept_documents, lambda d: quality.kept_documents(d, labels)):
        none = stage(docs.limit(0))
        assert none.columns == docs.columns and none.count() == 0


def test_many_keys_are_not_broadcast(made, monkeypatch):
    monkeypatch.setattr(frames, "MOST_KEYS", 0)
    rows = [(k, A if k % 2 else f"{B} {k // 10}") for k in range(60)]
    left = exact.kept_documents(made(rows))
    assert "Broadcast" not in left._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")[0]
    assert sorted(r.doc_id for r in left.collect()) == sorted({max(i for i, t in rows if t == text) for _, text in rows})
    want = brute.components(rows)
    assert sorted(r.doc_id for r in jaccard.kept_documents(left.sparkSession.createDataFrame(rows, TABLE)).collect()) == sorted({c for _, _, c in want})


def test_folders_are_noted_and_removed(spark):
    with frames.noted_folders() as folders:
        frames.written(spark.range(3), "note")
    assert len(folders) == 1 and spark.read.parquet(folders[0]).count() == 3
    frames.remove_folders(spark, folders)
    frames.written(spark.range(3).select(F.col("id")), "other")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folders[0])


def test_addresses_take_no_python_rows(made):
    """The numbers of the files are a table of Spark's own; one from a Python list starts Python workers, which stay in memory."""
    keyed, key = frames.addressed(made([(1, A), (2, B), (3, C)]))
    assert keyed.select(key).distinct().count() == 3
    assert keyed._jdf.queryExecution().toString().count("ExistingRDD") == 0
