"""LM scoring with a Katz back-off model of any order.

Training texts give counts of n-grams (context, word) of all orders from 2 to ``order``; the contexts at the start of a text are filled up with the end
token. Counts up to ``K`` get Good-Turing discounts, order by order (where the counts of counts cannot give a discount between 0 and 1: half a count is
taken off). The mass a context loses goes to the words not seen behind it in proportion to their probability behind the context that is one word
shorter, by a back-off weight that makes the probabilities of the V known words and the unknown word add up to exactly one; unigrams are discounted
likewise in favour of the unknown word. A token is scored recursively: the longest n-gram that was seen, times the back-off weights of the longer
contexts; the weight of an unknown context is one.

N-grams are partitioned by the last word of their context, so an n-gram, the shorter ones it backs off to and all their contexts lie together, whatever
the order; the unigrams are partitioned by word. Texts never move: a task sends, for each partition, its distinct n-grams of the
highest order with the documents that hold them, as numbers in a list of the words that occur there. The shorter n-grams follow from these. The words'
totals are asked for from the partitions of words, which add up what the partitions of contexts hold of each word and answer with totals in
the order of the question. Then every partition has all it needs, and sends back one partial sum for each document of a task.

``model`` gives the same partitions as a table of n-grams, ``write_model`` stores it by order and bucket, and ``scored_from`` scores any texts with a stored model.

Nulls and empty texts are one end token. Rows that repeat a ``doc_id`` are texts of their own; a null ``doc_id`` is never held out. Without
training tokens every probability is 1. Further columns are ignored. The counts are exact but for equal 64-bit hashes of different words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import BLOB_ROWS, STEP_BYTES, documents, even_keys, shuffle_partitions, utf8
from tidemark.llm.language import held_out
from tidemark.llm.text import binary_parts, mixed, slices, word_hashes

K = 5
#: Longest n-grams of the query.
ORDER = 3
FLUSH = 2_000_000
#: N-grams that a partition adds up at a time, unless the last two words of a context have more.
BLOCK_ROWS = 200_000
END = np.uint64(0x5851F42D4C957F2D)
NGRAMS, DOCS, ASKED, TOTALS, SUMS = range(5)
#: Arrays of a blob of n-grams; the further words of the contexts follow.
SIZE, WORDS, TIMES, PLACES, CONTEXT, WORD, FURTHER = range(7)
#: Odd factor between the words of a context's hash.
STEP = 0xD6E8FEB86659FD93
MODEL = "order int, context_hash long, word_hash long, count long, prob double, backoff double"
BLOBS = "dest int, src long, kind int, blob binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their sizes and types; the first bytes of all values, then the second ones and so on, which the shuffle can compress."""
    head = [np.array([len(arrays)], "<i8")]
    for a in arrays:
        head.append(np.array([len(a), int(a.dtype.str[2:]), ord(a.dtype.str[1])], "<i8"))
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return b"".join([*(a.tobytes() for a in head), *planes])


class Packed:
    """The arrays of a blob, read where they lie; only the rows asked for are unpacked."""

    def __init__(self, blob: bytes | pa.Buffer):
        count = int(np.frombuffer(blob, "<i8", 1)[0])
        heads = np.frombuffer(blob, "<i8", 3 * count, 8).reshape(-1, 3)
        self.arrays, at = [], 8 + 24 * count
        for size, width, kind in heads.tolist():
            planes = np.frombuffer(blob, np.uint8, size * width, at).reshape(width, size)
            self.arrays.append((planes, f"<{chr(kind)}{width}" if width > 1 else f"{chr(kind)}1"))
            at += size * width

    def part(self, number: int, first: int = 0, last: int | None = None) -> np.ndarray:
        planes, kind = self.arrays[number]
        return np.ascontiguousarray(planes[:, first:last].T).reshape(-1).view(kind)

    def size(self, number: int) -> int:
        return self.arrays[number][0].shape[1]


def unpack(blob: bytes | pa.Buffer) -> list[np.ndarray]:
    packed = Packed(blob)
    return [packed.part(k) for k in range(len(packed.arrays))]


def rows_of(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("dest", "src", "kind", "blob"), columns, kinds, strict=True)})


def blobs_of(table: pa.Table, kind: int, read: Callable = unpack) -> list[tuple]:
    """(source, arrays) in the order of the sources; the blobs are read where they lie."""
    rows = zip(table["kind"].to_pylist(), table["src"].to_pylist(), table["blob"], strict=True)
    return sorted(((s, read(b.as_buffer())) for k, s, b in rows if k == kind), key=lambda x: x[0])


def range_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of a hash; parts are ranges, so sorted hashes need only be cut."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cuts(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(range_of(sorted_hashes, parts), np.arange(parts + 1))


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def distinct(keys: Sequence[np.ndarray]) -> np.ndarray:
    """All keys once, sorted."""
    whole = np.concatenate(keys)
    whole.sort()
    return whole[firsts(whole)]


def discounts(n: np.ndarray) -> np.ndarray:
    """Factor for counts 0 .. K + 1 (the last stands for all larger ones) from n[r], the number of types seen r times."""
    out = np.ones(K + 2)
    last = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
    for r in range(1, K + 1):
        own = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) if n[r] and last != 1 else 0.0
        out[r] = own if 0 < own < 1 else (r - 0.5) / r
    return out


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * factors[np.minimum(counts, K + 1)]


def kinds_by_count(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts[counts > 0], K + 2), minlength=K + 3)[: K + 2].astype("<i8")


def unigram(counts: np.ndarray, kinds: np.ndarray, total: int) -> tuple[np.ndarray, float]:
    """Probability of words with these counts, and of the unknown word (which count 0 stands for)."""
    if not total:
        return np.ones(len(counts)), 1.0
    factors = discounts(kinds)
    r = np.arange(1, K + 1)
    freed = float((kinds[1 : K + 1] * r * (1 - factors[1 : K + 1])).sum()) / total
    unknown = max(freed, 0.5 / (total + 0.5))
    known = discounted(counts, factors) / total * ((1 - unknown) / (1 - freed) if freed < 1 else 0.0)
    return np.where(counts > 0, known, unknown), unknown


def backoff(context: np.ndarray, counts: np.ndarray, lower: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted distinct n-grams: probability if seen (else 0), and the back-off weight of the context (1 if it is unknown)."""
    begin = firsts(context)
    if not len(begin):
        return np.zeros(0), np.zeros(0)
    sizes = np.diff(np.append(begin, len(context)))
    total = np.add.reduceat(counts, begin)
    mass = discounted(counts, discounts(kinds)) / np.repeat(np.maximum(total, 1), sizes)
    used = np.add.reduceat(mass, begin)
    taken = np.add.reduceat(np.where(counts > 0, lower, 0.0), begin)
    room = 1 - taken
    # A context without discounted counts still leaves half a count; one behind which every word was seen leaves nothing.
    left = np.where(room > 1e-12, np.maximum(1 - used, 0.5 / (total + 0.5)), 0.0)
    scale = np.where(used > 0, (1 - left) / np.maximum(used, 1e-300), 0.0)
    weight = np.where(total > 0, left / np.maximum(room, 1e-12), 1.0)
    return mass * np.repeat(scale, sizes), np.repeat(weight, sizes)


def _sent(keys: list[int], order: int):
    """A task's distinct n-grams with their documents, to the partitions of contexts."""
    parts = len(keys)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list = []
        tokens: list = []
        places: list = []
        owners: list = []
        counts: list = []

        def flush() -> list[pa.RecordBatch]:
            nonlocal number
            src = (task << 24) + number
            number += 1
            missing = np.array([i is None for i in ids], "u1")
            own = np.array(held, "u1")
            table = [np.array([i or 0 for i in ids], "<i8"), missing, own, np.concatenate(counts).astype("<i8")]
            out = [(keys[src % parts], src, DOCS, pack(*table))]
            words = distinct([*(x for x, _ in tokens), np.array([END])])
            number_of = np.concatenate([np.searchsorted(words, x).astype(np.uint32)[each] for x, each in tokens])
            owner, at, end = np.concatenate(owners), np.concatenate(places), np.searchsorted(words, END).astype(np.uint32)
            for part in (tokens, places, owners):
                part.clear()
            word, *context = (shifted(number_of, at, back, end) for back in range(order))
            # Columns: last word of the context, the word, then the context from its last word but one backwards; the word is sorted by last.
            sort = sorted_by([*context, word], len(words))
            columns = [c[sort] for c in (context[0], word, *context[1:])]
            del word, context, number_of, at
            place = (owner * 2 + (1 - own[owner]))[sort].astype("<u2" if len(ids) < 1 << 15 else "<u4")
            edge = np.searchsorted(columns[0], cuts(words, parts))
            for dest in range(parts):
                a, b = edge[dest], edge[dest + 1]
                if a < b:
                    begin = firsts(*(c[a:b] for c in columns))
                    times = np.diff(np.append(begin, b - a))
                    kinds = [c[a:b][begin] for c in columns]
                    used = np.zeros(len(words), bool)
                    for c in kinds:
                        used[c] = True
                    near = np.cumsum(used, dtype="<u4") - 1
                    near = near.astype("<u2") if near[-1] < 1 << 16 else near
                    times = times.astype("u1" if times.max() < 256 else "<u4")
                    blob = pack(np.array([len(ids)], "<i8"), np.diff(words[used], prepend=np.uint64(0)), times, place[a:b], *(near[c] for c in kinds))
                    out.append((keys[dest], src, NGRAMS, blob))
            for part in (ids, held, counts):
                part.clear()
            return rows_of(out).to_batches(BLOB_ROWS)

        for batch in batches:
            data, offsets = binary_parts(batch.column("bytes"))
            names, kept_out = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            for a, b in slices(offsets, STEP_BYTES):
                hashes, bounds = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                size = np.diff(bounds) + 1
                words, each = np.unique(np.insert(hashes, bounds[1:], END), return_inverse=True)
                tokens.append((words, each.astype(np.uint32)))
                places.append((np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint32))
                owners.append(np.repeat(np.arange(len(ids), len(ids) + b - a, dtype=np.uint32), size))
                counts.append(size)
                ids += names[a:b]
                held += kept_out[a:b]
                if sum(map(len, owners)) >= FLUSH:
                    yield from flush()
        if ids:
            yield from flush()

    return step


def shifted(tokens: np.ndarray, places: np.ndarray, back: int, end: int) -> np.ndarray:
    """For tokens of texts, at these places of theirs, the token that many places before; ``end`` before the first."""
    out = np.full_like(tokens, end)
    out[back:] = np.where(places[back:] >= back, tokens[: len(tokens) - back], end)
    return out


def sorted_by(columns: list[np.ndarray], most: int) -> np.ndarray:
    """The order of rows of small numbers below ``most``, the first column first."""
    bits = max(most - 1, 1).bit_length()
    if bits * len(columns) > 63:
        return np.lexsort(columns[::-1])
    key = columns[0].astype(np.int64)
    for c in columns[1:]:
        key = (key << bits) | c
    return np.argsort(key)


def numbered(first: np.ndarray, second: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct ``first * size + second``, and the number of each row's among them."""
    keys, kind = np.unique(first.astype(np.int64) * size + second, return_inverse=True)
    return keys, kind.astype(np.uint32)


def words_of(ngrams: Packed) -> np.ndarray:
    return np.cumsum(ngrams.part(WORDS), dtype=np.uint64)


def evenly(rows: np.ndarray) -> np.ndarray:
    """Edges that cut numbered rows into blocks; a number with more than a block of rows lies between two of them."""
    blocks, large = rows.sum() // BLOCK_ROWS + 1, np.flatnonzero(rows > BLOCK_ROWS)
    inner = np.searchsorted(np.cumsum(rows), rows.sum() * np.arange(1, blocks) // blocks)
    return np.unique(np.concatenate([[0], inner, large, large + 1, [len(rows)]]))


class Partition:
    """The n-grams that all tasks sent to one partition of contexts, to be added up in blocks."""

    def __init__(self, table: pa.Table):
        self.tasks = blobs_of(table, NGRAMS, Packed)
        if not self.tasks:
            return
        self.dictionary = np.zeros(0, np.uint64)
        for at in range(0, len(self.tasks), BLOB_ROWS):
            self.dictionary = distinct([self.dictionary, *(words_of(t) for _, t in self.tasks[at : at + BLOB_ROWS])])
        self.number = [np.searchsorted(self.dictionary, words_of(t)).astype(np.uint32) for _, t in self.tasks]
        size = len(self.dictionary)
        held, asked, self.rows = np.zeros(size), np.zeros(size, bool), np.zeros(size, np.int64)
        for near, (_, t) in zip(self.number, self.tasks, strict=True):
            word = near[t.part(WORD)]
            asked[word] = True
            held += np.bincount(word, weights=trained(t.part(TIMES), t.part(PLACES)), minlength=size)
            self.rows += np.bincount(near[t.part(CONTEXT)], minlength=size)
        self.asked = np.flatnonzero(asked)
        self.words, self.held = self.dictionary[self.asked], held.astype("<i8")[self.asked]

    def blocks(self) -> Iterator[Block]:
        """Blocks of whole contexts; one with more rows than a block is cut by the word before it, and the pairs behind it are added up first."""
        edges = evenly(self.rows)
        spans = [Span(near, t, 0, t.size(CONTEXT), 0).split(CONTEXT, edges) for near, (_, t) in zip(self.number, self.tasks, strict=True)]
        for first, last, *each in zip(edges[:-1], edges[1:], *spans, strict=True):
            if last - first > 1 or self.rows[first] <= BLOCK_ROWS:
                yield Block(self, each)
                continue
            pairs, parts = self.behind(first, each)
            for k, part in enumerate(zip(*parts, strict=True)):
                yield Block(self, part, pairs, k > 0)

    def behind(self, context: int, each: list[Span]) -> tuple[tuple, list[list[Span]]]:
        """Of one context: its pairs with their counts over all tasks, and each task's rows cut into blocks."""
        size = len(self.dictionary)
        second = FURTHER if len(self.tasks[0][1].arrays) > FURTHER else WORD
        count, found, rows = np.zeros(size), np.zeros(size, bool), np.zeros(size, np.int64)
        for s in each:
            word = s.column(WORD)
            found[word] = True
            count += np.bincount(word, weights=s.trained(), minlength=size)
            rows += np.bincount(s.column(second), minlength=size)
        edges, word = evenly(rows), np.flatnonzero(found)
        return (context * size + word, count[word].astype(np.int64)), [s.split(second, edges) for s in each]


class Span:
    """Rows of one task's blob; ``start`` is where their places begin."""

    def __init__(self, near: np.ndarray, packed: Packed, first: int, last: int, start: int):
        self.near, self.packed, self.first, self.last, self.start = near, packed, first, last, start

    def column(self, number: int) -> np.ndarray:
        return self.near[self.packed.part(number, self.first, self.last)]

    def times(self) -> np.ndarray:
        return self.packed.part(TIMES, self.first, self.last)

    def places(self) -> np.ndarray:
        return self.packed.part(PLACES, self.start, self.start + int(self.times().sum(dtype=np.int64)))

    def trained(self) -> np.ndarray:
        return trained(self.times(), self.places())

    def split(self, number: int, edges: np.ndarray) -> list[Span]:
        """The rows between each two edges of the words of a column, by which the rows are sorted."""
        cut = np.searchsorted(self.packed.part(number, self.first, self.last), np.searchsorted(self.near, edges))
        start = np.concatenate([[0], np.cumsum(self.times(), dtype=np.int64)])[cut]
        rows = zip((self.first + cut[:-1]).tolist(), (self.first + cut[1:]).tolist(), (self.start + start[:-1]).tolist(), strict=True)
        return [Span(self.near, self.packed, *row) for row in rows]


def trained(times: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How often each n-gram stands in training texts."""
    if not len(times):
        return np.zeros(0, np.int32)
    return np.add.reduceat((places & 1).astype(np.int32), np.cumsum(times, dtype=np.int64) - times)


class Block:
    """The n-grams of some contexts, added up over all tasks, with those of every lower order.

    ``pairs`` are those of a context that is cut into several blocks, with their counts in all of them; ``repeated``: an earlier block gave them.
    """

    def __init__(self, whole: Partition, spans: Sequence[Span], pairs: tuple | None = None, repeated: bool = False):
        self.size, self.spans, self.repeated = len(whole.dictionary), spans, repeated
        near, word, *longer = (np.concatenate([s.column(k) for s in spans]) for k in range(CONTEXT, len(whole.tasks[0][1].arrays)))
        rows = np.concatenate([s.trained() for s in spans])
        # Contexts and n-grams of each order are numbered in the order of their words; all of one context lie together.
        self.orders, self.longer, context, shorter = [], [], near, word
        for k in range(len(longer) + 1):
            if k:
                heads, context = numbered(context, longer[k - 1], self.size)
                self.longer.append((heads // self.size, heads % self.size))
            if k or not pairs:
                keys, kind = numbered(context, word, self.size)
                lower = np.empty(len(keys), np.uint32)
                lower[kind] = shorter
                count = np.bincount(kind, weights=rows, minlength=len(keys)).astype(np.int64)
            else:
                keys, count = pairs
                kind = np.searchsorted(keys, context.astype(np.int64) * self.size + word).astype(np.uint32)
                lower = (keys % self.size).astype(np.uint32)
            self.orders.append((keys // self.size, keys % self.size, count, lower))
            shorter = kind
        self.kind = shorter  # number of the longest n-gram behind each task's own

    def counts_of_counts(self) -> np.ndarray:
        each = [kinds_by_count(count) for _, _, count, _ in self.orders]
        return np.concatenate([each[0] * (not self.repeated), *each[1:]])

    def probabilities(self, told: Told) -> Iterator[tuple]:
        """Of every order from 2: (context, word, count, probability behind the context, back-off weight of the context)."""
        lower = told.unigrams
        for (context, word, count, shorter), own in zip(self.orders, told.longer, strict=True):
            less = lower[shorter]
            seen, weight = backoff(context, count, less, own)
            lower = np.where(count > 0, seen, weight * less)
            yield context, word, count, lower, weight


class Told:
    """What the partitions of words answered a partition of contexts."""

    def __init__(self, own: Partition, answers: pa.Table):
        told = [a for _, a in blobs_of(answers, TOTALS)]
        self.kinds, (total, distinct) = np.sum([a[1] for a in told], 0), np.sum([a[2] for a in told], 0).tolist()
        self.total, self.distinct, self.longer = int(total), int(distinct), told[0][0].reshape(-1, K + 2)
        self.count = np.zeros(len(own.dictionary), np.int64)
        self.count[own.asked] = np.concatenate([a[3] for a in told])
        self.unigrams, self.unknown = unigram(self.count, self.kinds, self.total)


def _asking(keys: list[int]):
    """From a partition of contexts to all of words: what it holds of each word, and its counts of counts."""

    def step(table: pa.Table) -> pa.Table:
        own = Partition(table)
        if not own.tasks:
            return rows_of([])
        src = table["dest"][0].as_py()
        edge, kinds = cuts(own.words, len(keys)), np.sum([b.counts_of_counts() for b in own.blocks()], 0)
        return rows_of([(k, src, ASKED, pack(kinds, own.words[a:b], own.held[a:b])) for k, a, b in zip(keys, edge[:-1], edge[1:], strict=True)])

    return step


def _answering(keys: list[int]):
    """From a partition of words: the total of every word asked for, and its counts of counts."""
    number_of = {k: n for n, k in enumerate(keys)}

    def step(table: pa.Table) -> pa.Table:
        asked = blobs_of(table, ASKED)
        words, number = np.unique(np.concatenate([a[1] for _, a in asked]), return_inverse=True)
        total = np.bincount(number, weights=np.concatenate([a[2] for _, a in asked]), minlength=len(words)).astype("<i8")
        longer = np.sum([a[0] for _, a in asked], 0)
        own = np.array([total.sum(), (total > 0).sum()], "<i8")
        # The answers come back in the order of the ranges of words.
        src, at, out = number_of[table["dest"][0].as_py()], 0, []
        for dest, a in asked:
            out.append((dest, src, TOTALS, pack(longer, kinds_by_count(total), own, total[number[at : at + len(a[1])]])))
            at += len(a[1])
        return rows_of(out)

    return step


def _scoring(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Partial sums for each document of each task."""
    docs_of = table.filter(pc.equal(table["kind"], DOCS))
    out = [(0, *r) for r in zip(*(docs_of[c].to_pylist() for c in ("src", "kind", "blob")), strict=True)]
    own = Partition(table)
    if not own.tasks:
        return rows_of(out)
    told = Told(own, answers)
    sums = [np.zeros((3, int(t.part(SIZE)[0]))) for _, t in own.tasks]
    each = np.log10(told.count + 0.5), told.count > 0
    for block in own.blocks():
        *_, (_, word, _, probability, _) = block.probabilities(told)
        with np.errstate(divide="ignore"):
            values = [np.log10(probability), *(x[word] for x in each)]
        at = 0
        for span, total in zip(block.spans, sums, strict=True):
            rows = span.last - span.first
            kind, doc = np.repeat(block.kind[at : at + rows], span.times()), (span.places() >> 1).astype(np.int64)
            at += rows
            for row, value in zip(total, values, strict=True):
                row += np.bincount(doc, weights=value[kind], minlength=len(row))
    for (src, _), (score, base, known) in zip(own.tasks, sums, strict=True):
        out.append((0, src, SUMS, pack(np.array([told.total, told.distinct], "<i8"), score, base, known.astype("<u4"))))
    return rows_of(out)


def behind(context: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash of a context with one more word before it."""
    return mixed(context * np.uint64(STEP) + before)


def _modelled(table: pa.Table, answers: pa.Table) -> pa.Table:
    """The n-grams seen in training of one partition of contexts; its unigrams are the words that are contexts there."""
    own = Partition(table)
    if not own.tasks:
        return model_rows([])
    told, out = Told(own, answers), []
    for block in own.blocks():
        # Every token is the context of the next one, and the end of a text that of its first word.
        first, _, pairs, _ = block.orders[0]
        times = np.bincount(first, weights=pairs, minlength=block.size).astype(np.int64)
        chance, unknown = unigram(times, told.kinds, told.total)
        if not block.repeated:
            out.append((1, np.zeros(block.size, np.uint64), own.dictionary, times, chance, np.ones(block.size)))
        if END in own.dictionary[first] and not block.repeated:
            out.append((0, np.zeros(1, np.uint64), np.zeros(1, np.uint64), np.ones(1, np.int64), np.array([unknown]), np.ones(1)))
        context_hash = own.dictionary
        for n, (context, word, count, probability, weight) in enumerate(block.probabilities(told), 2):
            if n > 2:
                shorter, before = block.longer[n - 3]
                context_hash = behind(context_hash[shorter], own.dictionary[before])
            if n > 2 or not block.repeated:
                out.append((n, context_hash[context], own.dictionary[word], count, probability, weight))
    return model_rows(out)


def model_rows(found: list[tuple]) -> pa.Table:
    rows = [(n, c.view("<i8"), w.view("<i8"), k, p, b) for n, c, w, k, p, b in found]
    each = [tuple(a[r[3] > 0] for a in (np.full(len(r[3]), r[0], np.int32), *r[1:])) for r in rows]
    names, kinds = zip(*(f.split() for f in MODEL.split(", ")), strict=True)
    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[k] for k in kinds]
    whole = [np.concatenate(c) for c in zip(*each, strict=True)] if each else [[]] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, whole, kinds, strict=True)})


def model(docs: DataFrame, order: int = 2) -> DataFrame:
    """The n-grams of orders 1 to ``order`` seen in the training rows; order 0 is the one row of the unknown word.

    ``prob`` is the word's probability behind the context, ``backoff`` the context's weight for words not seen behind it. Hashes are longs; the context
    of a unigram is 0. Without training rows there is that row at most.
    """
    sent, answered = _asked(docs, order)
    rows = sent.groupBy("dest").cogroup(answered.groupBy("dest")).applyInArrow(_modelled, MODEL)
    return rows


def write_model(docs: DataFrame, path: str, order: int = 2, buckets: int = 16) -> DataFrame:
    """``model`` as Parquet, in folders by order and by bucket of context and word; a common context is spread over all buckets."""
    bucket = F.pmod(F.xxhash64("context_hash", "word_hash"), F.lit(buckets)).cast("int")
    model(docs, order).withColumn("bucket", bucket).write.partitionBy("order", "bucket").parquet(path)
    return docs.sparkSession.read.schema(MODEL + ", bucket int").parquet(path)


def scored_from(grams: DataFrame, docs: DataFrame, order: int) -> DataFrame:
    """(doc_id, n_tokens, score) of each row by a stored model: one join an order for the n-grams, and one for the weights of the contexts.

    A model without rows gives every token the probability 1, as ``scored`` does.
    """
    names = ["row", "doc_id", "word", *(f"c{k}" for k in range(2, order + 1))]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_parts(batch.column("bytes"))
            for a, b in slices(offsets, STEP_BYTES):
                hashes, bounds = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                size = np.diff(bounds) + 1
                token = np.insert(hashes, bounds[1:], END)
                place = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
                contexts: list = []
                for back in range(1, order):
                    word = shifted(token, place, back, END)
                    contexts.append(behind(contexts[-1], word) if contexts else word)
                each = pa.array(np.repeat(np.arange(a, b), size))
                rows = [batch.column("row").take(each), batch.column("doc_id").take(each), *(x.view("<i8") for x in (token, *contexts))]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in rows], names)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("bytes"))
    rows = texts.mapInArrow(step, ", ".join(f"{n} long" for n in names))
    unknown = grams.where("order = 0").agg(F.max("prob").alias("unknown"))
    chance = F.coalesce("p1", "unknown", F.lit(1.0))
    seen = grams.where("order = 1").select(F.col("word_hash").alias("word"), F.col("prob").alias("p1"))
    rows = rows.join(seen, "word", "left").join(F.broadcast(unknown))
    for k in range(2, order + 1):
        own = grams.where(F.col("order") == k)
        seen = own.select(F.col("context_hash").alias(f"c{k}"), F.col("word_hash").alias("word"), F.col("prob").alias(f"p{k}"))
        weights = own.groupBy(F.col("context_hash").alias(f"c{k}")).agg(F.max("backoff").alias(f"b{k}"))
        rows = rows.join(seen, [f"c{k}", "word"], "left").join(weights, f"c{k}", "left")
        chance = F.coalesce(f"p{k}", F.coalesce(f"b{k}", F.lit(1.0)) * chance)
    return rows.groupBy("row", "doc_id").agg(F.count("*").alias("n_tokens"), F.sum(F.log10(chance)).alias("score")).drop("row")


def _summed(table: pa.Table) -> pa.Table:
    """The rows of the documents of one task's batch."""
    (_, (ids, missing, held, tokens)), parts = blobs_of(table, DOCS)[0], [a for _, a in blobs_of(table, SUMS)]
    total, distinct = parts[0][0].tolist()
    score, base, known = (np.sum([p[k] for p in parts], 0) for k in (1, 2, 3))
    return pa.table({
        "doc_id": pa.array(ids, mask=missing.astype(bool)), "held_out": held.astype(bool), "n_tokens": tokens, "n_known": known.astype(np.int64),
        "train_tokens": np.full(len(ids), total), "base_score": base - tokens * np.log10(total + 0.5 * (distinct + 1)), "score": score,
    })


def _asked(docs: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """The partitions of contexts, and what the partitions of words answer them."""
    if order < 2:
        raise ValueError(f"a back-off model has order 2 at least, not {order}")
    keys = even_keys(docs.sparkSession, shuffle_partitions(docs.sparkSession))
    texts = docs.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), utf8().alias("bytes"))
    sent = texts.mapInArrow(_sent(keys, order), BLOBS).repartition(len(keys), "dest")
    asked = sent.groupBy("dest").applyInArrow(_asking(keys), BLOBS)
    return sent, asked.groupBy("dest").applyInArrow(_answering(keys), BLOBS)


def scored(docs: DataFrame, order: int = 2) -> DataFrame:
    """Scores of rows (doc_id, text, held_out); the rows not held out are the training texts."""
    sent, answered = _asked(docs, order)
    sums = sent.groupBy("dest").cogroup(answered.groupBy("dest")).applyInArrow(_scoring, BLOBS)
    return sums.groupBy("src").applyInArrow(_summed, OUT)


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(5, 1).alias("held_out"))
    return scored(docs, ORDER)


QUERIES = {"op5_katz_backoff": op5_katz_backoff}
SQL: dict[str, str] = {}
