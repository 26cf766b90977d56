"""Suffix-array dedup: every byte inside a repeated 100-byte string goes, but for the string's first occurrence.

Only suffixes at *anchors* are sorted: the leftmost smallest hash among the ``GRAM``-byte strings of each 100-byte window.
Equal windows choose the same anchor, so every repeat meets at equal anchors, and every window belongs to exactly one. For each
anchor of the corpus a task sends its gram's hash and a hash of its context (the bytes of all windows that belong to it) to the gram's bucket.

* Grams found once are done. Of anchors with equal contexts all but the first lose their whole context; within a task that
  is settled before anything is sent, so copies do not pile up in a bucket.
* Where a gram has several contexts, one fragment of each (at most 168 bytes) comes to the bucket. The shards' sparse suffix orders are
  merged there by interleave refinement: all suffixes of a gram start as one block, and every round splits the blocks by the next symbol, stably, one side
  reading on to the right and the other, the column of preceding symbols that a Burrows-Wheeler transform holds, to the left. The round in which two
  suffixes part is their common prefix. A repeated interval of 100 bytes is a left block of depth d and a right block of depth 68 - d
  with the same members; all but its first member lose those bytes. Suffixes are never compared as a whole or sorted again.

The result is exact but for equal 64-bit hashes of different strings. Null texts count as empty; texts under 100 bytes lose nothing. Rows with
equal ``doc_id`` count as one document: strings at equal starts of them are not earlier than one another, so rows repeated as a whole lose nothing to
each other. A null ``doc_id`` sorts before all others. Bytes are removed without regard to characters; ``kept_documents`` drops
bytes of characters cut in two. Further columns pass through ``kept_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import BLOB_ROWS, STEP_BYTES, documents, shuffle_partitions, utf8, written
from tidemark.llm.text import between, binary_parts, rolling, running, slices

WIDTH, GRAM = 100, 32
REACH = WIDTH - GRAM
NO_ID = -(1 << 63)
FLUSH = 1_000_000
ANCHOR, REQUEST, SPAN = 0, 1, 2
ANCHORS = [("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("twin", "<u4"), ("pos", "<u4"), ("most", "u1"), ("least", "u1")]
REQUESTS = [("gram", "<u8"), ("doc", "<i8"), ("twin", "<u4"), ("pos", "<u4"), ("most", "u1"), ("least", "u1")]
SPANS = [("doc", "<i8"), ("twin", "<u4"), ("start", "<u4"), ("end", "<u4")]
BLOBS = "dest int, kind int, blob binary"
Rows = dict[str, np.ndarray]


def packed(rows: Rows, kind: list) -> bytes:
    """One field after the other, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(rows[n], t).tobytes() for n, t in kind)


def unpacked(blobs: list[pa.Buffer], kind: list) -> Rows:
    size = sum(np.dtype(t).itemsize for _, t in kind)
    parts: dict[str, list] = {n: [np.zeros(0, t)] for n, t in kind}
    for blob in blobs:
        count, at = len(blob) // size, 0
        for n, t in kind:
            parts[n].append(np.frombuffer(blob, t, count, at))
            at += count * np.dtype(t).itemsize
    return {n: np.concatenate(p) for n, p in parts.items()}


def chosen(rows: Rows, which: np.ndarray) -> Rows:
    return {n: v[which] for n, v in rows.items()}


def dealt(rows: Rows, dest: np.ndarray, kind_number: int, kind: list) -> list[tuple[int, int, bytes]]:
    """A blob for each destination."""
    order = np.argsort(dest, kind="stable")
    cuts = np.flatnonzero(np.diff(dest[order])) + 1
    return [(int(dest[i[0]]), kind_number, packed(chosen(rows, i), kind)) for i in np.split(order, cuts) if len(i)]


def part_of(doc: np.ndarray, parts: int) -> np.ndarray:
    """Part of a document; the same as ``part_column`` gives."""
    doc = doc.astype(np.int64).view(np.uint64)
    return ((doc ^ doc >> np.uint64(7) ^ doc >> np.uint64(21)) & np.uint64(0x3FFFFFFFFFFFFFFF)).astype(np.int64) % parts


def part_column(doc: str, parts: int) -> Column:
    folded = F.col(doc).bitwiseXOR(F.shiftrightunsigned(doc, 7)).bitwiseXOR(F.shiftrightunsigned(doc, 21))
    return (folded.bitwiseAND(0x3FFFFFFFFFFFFFFF) % parts).cast("int")


def bucket_of(gram: np.ndarray, buckets: int) -> np.ndarray:
    """The low bits: anchors were chosen by the high ones."""
    return (gram & np.uint64(0x7FFFFFFF)).astype(np.int64) % buckets


def anchors(data: np.ndarray, offsets: np.ndarray, docs: np.ndarray, twins: np.ndarray) -> Rows:
    """The anchors of a batch of texts."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    none = {n: np.zeros(0, t) for n, t in ANCHORS}
    if len(data) < WIDTH:
        return none
    sums = running(data)
    grams = rolling(sums, GRAM)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    for step in (1, 2, 4, 8, 16, 32):
        low = np.minimum(low[:-step], low[step:])
    rest = REACH + 1 - 64
    low = np.minimum(low[:-rest], low[rest:])
    starts = np.flatnonzero(np.arange(len(low)) + WIDTH <= ends[: len(low)])
    if not len(starts):
        return none
    at = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(at)) - 1
    at, begin, end = at[firsts], starts[firsts], starts[lasts]
    owner = np.searchsorted(offsets, at, "right") - 1
    context = between(sums, begin, end + WIDTH) + (at - begin).astype(np.uint64)
    return {
        "gram": grams[at], "context": context, "doc": docs[owner], "twin": twins[owner], "pos": (at - offsets[owner]).astype(np.uint32),
        "most": (at - begin).astype(np.uint8), "least": (at - end).astype(np.uint8),
    }


def later_copies(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Order by gram, context and place; in that order, which rows come after another row of the same context."""
    order = np.lexsort((rows["pos"], rows["doc"], rows["context"], rows["gram"]))
    r = chosen({n: rows[n] for n in ("gram", "context", "doc", "pos")}, order)
    same = np.zeros(len(order), bool)
    same[1:] = (r["gram"][1:] == r["gram"][:-1]) & (r["context"][1:] == r["context"][:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else order
    return order, same & ((r["doc"] != r["doc"][head]) | (r["pos"] != r["pos"][head]))


def spans(rows: Rows, most: np.ndarray, least: np.ndarray) -> Rows:
    """From the first byte of the longest reach to the left to the last of that to the right."""
    pos = rows["pos"].astype(np.int64)
    return {"doc": rows["doc"], "twin": rows["twin"], "start": (pos - most).astype(np.uint32), "end": (pos - least + WIDTH).astype(np.uint32)}


def whole_spans(rows: Rows) -> Rows:
    return spans(rows, rows["most"].astype(np.int64), rows["least"].astype(np.int64))


def joined(parts: list[Rows]) -> Rows:
    return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def refined(block: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Blocks split by the next symbol; members keep their order within a block."""
    return np.unique(block.astype(np.int64) * 256 + symbol, return_inverse=True)[1]


def repeated_reach(rows: Rows, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fragment: whether any of its windows occurs earlier, and the furthest such windows to the left and right.

    Column t of ``left`` holds the t-th byte before the anchor, of ``right`` the t-th byte behind the gram.
    """
    count = len(rows["gram"])
    start = np.unique(rows["gram"], return_inverse=True)[1].astype(np.int64)
    place = np.lexsort((rows["pos"], rows["doc"]))
    rank = np.empty(count, np.int64)
    new = np.ones(count, bool)
    new[1:] = (rows["doc"][place][1:] != rows["doc"][place][:-1]) | (rows["pos"][place][1:] != rows["pos"][place][:-1])
    rank[place] = np.cumsum(new)
    behind = [start]
    for t in range(REACH):
        behind.append(refined(behind[-1], right[:, t]).astype(np.int32))
    before, found = start, np.zeros(count, bool)
    most, least = np.zeros(count, np.int64), np.full(count, REACH, np.int64)
    for d in range(REACH + 1):
        if d:
            before = refined(before, left[:, d - 1])
        own = np.flatnonzero((rows["least"] <= d) & (rows["most"] >= d))
        if not len(own):
            continue
        _, key = np.unique(before[own].astype(np.int64) * count + behind[REACH - d][own], return_inverse=True)
        first = np.full(key.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, key, rank[own])
        late = own[rank[own] > first[key]]
        found[late] = True
        most[late], least[late] = np.maximum(most[late], d), np.minimum(least[late], d)
    return found, most, least


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    dest, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"dest": pa.array(dest, pa.int32()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _of_kind(table: pa.Table, number: int, kind: list) -> Rows:
    return unpacked([b.as_buffer() for k, b in zip(table["kind"].to_pylist(), table["blob"], strict=True) if k == number], kind)


def _keyed(docs: DataFrame, parts: int) -> DataFrame:
    """(part, doc, twin, bytes, row): the id, a hash of the text that tells rows of equal id apart, the text, other columns."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    out = docs.select(doc.alias("doc"), F.xxhash64("text").bitwiseAND(0xFFFFFFFF).alias("twin"), utf8().alias("bytes"), row.alias("row"))
    return out.withColumn("part", part_column("doc", parts))


def _collected(parts: int, buckets: int):
    """Anchors to the bucket of their gram; spans settled within the task beside them."""

    def send(rows: Rows) -> pa.RecordBatch:
        order, late = later_copies(rows)
        done, kept = whole_spans(chosen(rows, order[late])), chosen(rows, order[~late])
        out = dealt(kept, bucket_of(kept["gram"], buckets), ANCHOR, ANCHORS)
        out += [(dest % buckets, SPAN, blob) for dest, _, blob in dealt(done, part_of(done["doc"], parts), SPAN, SPANS)]
        return _blobs(out).to_batches(BLOB_ROWS)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []
        for batch in batches:
            data, offsets = binary_parts(batch.column("bytes"))
            docs = batch.column("doc").to_numpy()
            twins = batch.column("twin").to_numpy().astype(np.uint32)
            for a, b in slices(offsets, STEP_BYTES):
                held.append(anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], docs[a:b], twins[a:b]))
                if sum(len(h["gram"]) for h in held) >= FLUSH:
                    yield from send(joined(held))
                    held = []
        if held:
            yield from send(joined(held))

    return step


def _met(parts: int):
    """In a bucket: spans of later copies of a context, and a request for each context of a gram with several."""

    def step(table: pa.Table) -> pa.Table:
        rows, early = _of_kind(table, ANCHOR, ANCHORS), _of_kind(table, SPAN, SPANS)
        order, late = later_copies(rows)
        done = joined([early, whole_spans(chosen(rows, order[late]))])
        r = chosen(rows, order[~late])
        alone = np.ones(len(r["gram"]), bool)
        if len(alone):
            same = (r["gram"][1:] == r["gram"][:-1]) & (r["context"][1:] != r["context"][:-1])
            near = r["gram"][1:] == r["gram"][:-1]
            group = np.concatenate([[0], np.cumsum(~near)])
            several = np.bincount(group[1:][same], minlength=group[-1] + 1) > 0
            alone = ~several[group]
        asked = chosen({n: r[n] for n, _ in REQUESTS}, ~alone)
        out = dealt(done, part_of(done["doc"], parts), SPAN, SPANS)
        out += dealt(asked, part_of(asked["doc"], parts), REQUEST, REQUESTS)
        return _blobs(out)

    return step


def _fetched(buckets: int):
    """The bytes around the requested anchors, to the gram's bucket."""

    def step(docs: pa.Table, requests: pa.Table) -> pa.Table:
        asked = _of_kind(requests, REQUEST, REQUESTS)
        if not len(asked["gram"]):
            return _blobs([])
        docs = docs.combine_chunks()
        data, offsets = binary_parts(docs["bytes"].chunk(0) if docs.num_rows else pa.array([], pa.binary()))
        base = _located(docs, asked, offsets)
        asked, base = chosen(asked, base >= 0), base[base >= 0]
        asked["text"] = _around(data, base + asked["pos"])
        return _blobs(dealt(asked, bucket_of(asked["gram"], buckets), ANCHOR, [*REQUESTS, ("text", f"V{2 * REACH}")]))

    return step


def _located(docs: pa.Table, refs: Rows, offsets: np.ndarray) -> np.ndarray:
    """Where the referenced document begins in the data; -1 if it is not here."""
    kind = [("doc", "<i8"), ("twin", "<u4")]
    have = np.zeros(docs.num_rows, kind)
    have["doc"], have["twin"] = docs["doc"].to_numpy(), docs["twin"].to_numpy().astype(np.uint32)
    want = np.zeros(len(refs["doc"]), kind)
    want["doc"], want["twin"] = refs["doc"], refs["twin"]
    keys, inverse = np.unique(np.concatenate([have, want]), return_inverse=True)
    row = np.full(len(keys), -1, np.int64)
    row[inverse[: len(have)]] = np.arange(len(have))
    row = row[inverse[len(have) :]]
    return np.where(row >= 0, offsets[row], -1)


def _around(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """REACH bytes before each place, nearest first, and REACH bytes behind its gram, in one fixed-size field."""
    reach = np.arange(REACH)
    text = np.empty((len(at), 2 * REACH), np.uint8)
    text[:, :REACH] = data[np.maximum(at[:, None] - 1 - reach, 0)]
    text[:, REACH:] = data[np.minimum(at[:, None] + GRAM + reach, max(len(data) - 1, 0))]
    return text.reshape(-1).view(f"V{2 * REACH}")


def _merged(parts: int):
    """In a bucket: spans of the windows of these fragments that occur earlier."""

    def step(table: pa.Table) -> pa.Table:
        rows = _of_kind(table, ANCHOR, [*REQUESTS, ("text", f"V{2 * REACH}")])
        if not len(rows["gram"]):
            return _blobs([])
        text = np.frombuffer(rows["text"].tobytes(), np.uint8).reshape(-1, 2 * REACH).astype(np.int64)
        found, most, least = repeated_reach(rows, text[:, :REACH], text[:, REACH:])
        done = spans(chosen({n: rows[n] for n in ("doc", "twin", "pos")}, found), most[found], least[found])
        return _blobs(dealt(done, part_of(done["doc"], parts), SPAN, SPANS))

    return step


def cut_texts(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes the spans cover, and in how many maximal runs each text loses them."""
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    gone = np.cumsum(edge)[:-1] > 0
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    rise[inner] = gone[inner]
    return gone, np.diff(np.concatenate([[0], np.cumsum(rise)])[offsets])


def _applied(with_text: bool):
    def step(docs: pa.Table, found: pa.Table) -> pa.Table:
        marks = _of_kind(found, SPAN, SPANS)
        docs = docs.combine_chunks()
        data, offsets = binary_parts(docs["bytes"].chunk(0) if docs.num_rows else pa.array([], pa.binary()))
        kind = [("doc", "<i8"), ("twin", "<u4")]
        own, want = np.zeros(docs.num_rows, kind), np.zeros(len(marks["doc"]), kind)
        own["doc"], own["twin"] = docs["doc"].to_numpy(), docs["twin"].to_numpy().astype(np.uint32)
        want["doc"], want["twin"] = marks["doc"], marks["twin"]
        _, inverse = np.unique(np.concatenate([own, want]), return_inverse=True)
        have, need = inverse[: len(own)], inverse[len(own) :]
        # Rows that repeat a document share its spans.
        order = np.argsort(have, kind="stable")
        low, high = np.searchsorted(have[order], need, "left"), np.searchsorted(have[order], need, "right")
        which = np.repeat(np.arange(len(need)), high - low)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        base = offsets[order[low[which] + nth]]
        gone, runs = cut_texts(data, offsets, base + marks["start"][which].astype(np.int64), base + marks["end"][which].astype(np.int64))
        lost = np.concatenate([[0], np.cumsum(gone)])[offsets]
        kept, at = data[~gone].tobytes(), offsets - lost
        texts = [kept[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table({
            "row": docs["row"], "n_bytes": np.diff(offsets), "n_removed": np.diff(lost), "n_spans": runs.astype(np.int64),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            "kept_text": pa.array([t.decode(errors="ignore") if with_text else None for t in texts], pa.string()),
        })

    return step


def cut(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept_sha256, kept_text) of every row; ``row`` has all columns but the text."""
    partitions = shuffle_partitions(docs.sparkSession)
    parts = buckets = 4 * partitions
    keyed = _keyed(docs, parts)
    sent = keyed.select("doc", "twin", "bytes").mapInArrow(_collected(parts, buckets), BLOBS)
    met = written(sent.groupBy("dest").applyInArrow(_met(parts), BLOBS), "anchors")
    by_part = keyed.repartition(partitions, "part").groupBy("part")
    requests = met.where(f"kind = {REQUEST}").withColumnRenamed("dest", "part").groupBy("part")
    fetched = by_part.cogroup(requests).applyInArrow(_fetched(buckets), BLOBS)
    merged = fetched.groupBy("dest").applyInArrow(_merged(parts), BLOBS)
    found = met.where(f"kind = {SPAN}").unionByName(merged).withColumnRenamed("dest", "part").groupBy("part")
    counts = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    texts = [T.StructField(n, T.StringType()) for n in ("kept_sha256", "kept_text")]
    return by_part.cogroup(found).applyInArrow(_applied(with_text), T.StructType([keyed.schema["row"], *counts, *texts]))


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; a null text stays null, and ``n_chars``, if there, follows."""
    done = cut(docs.withColumn("_null", F.col("text").isNull()))
    text = F.when(~F.col("row._null"), F.col("kept_text"))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*[columns[c].alias(c) for c in docs.columns])


def op10_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(documents(spark, sf_dir).select("doc_id", "text"), with_text=False).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op10_bwt_merge": op10_bwt_merge}
SQL: dict[str, str] = {}
