"""Batches that a task hands over stay small, whatever the task holds."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from tidemark.llm import jaccard, katz
from tidemark.llm.frames import BLOB_ROWS, SET_ROWS


def test_sets_go_to_their_tiles_in_small_batches():
    sets = [np.arange(n, n + 5, dtype="<u8").tobytes() for n in range(2 * SET_ROWS + 10)]
    batch = pa.RecordBatch.from_pydict({"doc": list(range(len(sets))), "shared": sets, "tokens": sets})
    out = list(jaccard._first_tiles(8)(iter([batch])))
    assert sum(b.num_rows for b in out) == jaccard.FIRST * len(sets)
    assert max(b.num_rows for b in out) <= jaccard.FIRST * SET_ROWS


def test_ngrams_leave_a_task_in_small_batches(monkeypatch):
    task = SimpleNamespace(partitionId=lambda: 0)
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: task))
    text = " ".join(f"w{n}" for n in range(2000)).encode()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "held_out": [False], "bytes": [text]})
    out = list(katz._sent(list(range(40)), 3)(iter([batch])))
    assert sum(b.num_rows for b in out) > BLOB_ROWS
    assert max(b.num_rows for b in out) <= BLOB_ROWS
