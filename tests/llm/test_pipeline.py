"""The pipeline, stage by stage, against plain Python on the rows each stage was given."""

import hashlib

import corpus_pipeline
from tests.llm import brute
from tidemark.llm.frames import documents, written

SF = "/root/testdata/sf0.001"


def test_every_stage(spark):
    docs, columns = documents(spark, SF), documents(spark, SF).columns
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        seen.append((name, docs, [tuple(r) for r in docs.collect()]))
    assert all(d.columns == columns for _, d, _ in seen[:-1])
    source = {r[0]: r for r in map(tuple, documents(spark, SF).collect())}
    (_, _, good), (_, _, unique), (_, _, apart), (_, _, trimmed), (_, _, packed) = seen
    for i, row in source.items():
        n = brute.counts(row[1])
        passes = not (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert (row in good) == (passes and known.get(i, 1) == 1) or i not in known
    last: dict = {}
    for r in good:
        last[r[1]] = max(last.get(r[1], -1), r[0])
    assert sorted(unique) == sorted(r for r in good if last[r[1]] == r[0])
    assert {r[0] for r in apart} == {c for _, _, c in brute.components([r[:2] for r in unique])}
    want = {i: (n, h) for i, n, gone, _, h in brute.cut([r[:2] for r in apart]) if not gone}
    for r in trimmed:
        if r[0] in want:
            assert hashlib.sha256(r[1].encode()).hexdigest() == want[r[0]][1]
    assert {r[0] for r in packed} == {r[0] for r in trimmed}


def test_run_is_registered(spark):
    import __spark_entry__

    rows = __spark_entry__.queries()["pipeline"](spark, SF)
    assert rows.count() > 0 and "sequence_id" in rows.columns
