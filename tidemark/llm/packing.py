"""Packing documents into sequences by cutting-stock column generation.

Every document is tokenized whole and ends with an end id. It is cut at multiples of ``LENGTH``; full pieces are
sequences of their own, and the rest, one piece of a document at most, is an item to be packed. The item lengths
of the whole corpus, rounded up to ``GRAIN``, form a histogram of at most LENGTH / GRAIN rows, all that the driver sees. On it a linear program over patterns (how many items of
each length fill one sequence) is solved by column generation: the simplex method holds the basis, and a knapsack
dynamic program over the dual prices finds the next pattern, until none improves the bound by more than ``GAP``. The pattern counts are
rounded down, and what that leaves over is filled into sequences first-fit, longest first. Patterns are then dealt to items by rank
within their length, so which sequence an item belongs to is arithmetic on its rank.

Null and empty texts are one end id. Rows that repeat a ``doc_id``, and rows without one, are packed as documents of their
own. An empty table gives no rows. Further columns do not matter.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from tidemark.llm.cached import PartCache
from tidemark.llm.frames import documents, text_or_empty, written
from tidemark.llm.text import binary_parts, slices

LENGTH = 4096
GRAIN = 16
GAP = 0.0005
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that a step takes at a time; its arrays hold several 8-byte numbers for each token.
TEXT_BYTES = 4 << 20
#: Words that are one text to the library.
WORDS = 10_000
#: A number of one character that words hardly ever have.
BETWEEN = "\u00bd"
#: A lower-case word of Latin letters, and the full stop or comma behind it.
LETTERS = re.compile(f"([{''.join(c for c in map(chr, range(0x250)) if c.isalpha())}]+)([.,]?)").fullmatch
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long, ids binary"
)


def pack_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_letters() -> dict[int, int]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b for b in plain} | {b: 256 + n for n, b in enumerate(x for x in range(256) if x not in plain)}


class WordEncoder:
    """Ids of words. The vocabulary's steps split a word of Latin letters from a full stop or comma behind it and change
    nothing but its case, so such words go to the library's model alone; all other words take all of its steps. Either way
    many words are one text to the library: a word's last token is marked as such in the vocabulary, which tells
    the words of letters apart, and between the others stands ``BETWEEN``, one token that no word without that character has."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        letters = byte_letters()
        self.letters = np.array([32 if b == 32 else letters[b] for b in range(256)], "<u2")
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab(False).items() if token.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.marks = {m: pack_ids(self._ids(self.tokenizer, m).tolist()) for m in (".", ",")} | {"": b""}
        (self.between,) = self._ids(self.tokenizer, BETWEEN).tolist()

    @staticmethod
    def _ids(tokenizer: Tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _letters_only(self, words: list[str]) -> Iterator[bytes]:
        text = self.letters[np.frombuffer(" ".join(words).encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = self._ids(self.model, text)
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        held = ids.tobytes()
        return (held[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))

    def _all_steps(self, words: list[str]) -> Iterator[bytes]:
        ids = self._ids(self.tokenizer, "".join(f"{w} {BETWEEN} " for w in words))
        ends = (4 * np.flatnonzero(ids == self.between)).tolist()
        held = ids.tobytes()
        return (held[a:b] for a, b in zip([0, *(e + 4 for e in ends[:-1])], ends, strict=True))

    def _some(self, parts: list[bytes]) -> list[bytes]:
        done: list[bytes] = [b""] * len(parts)
        letters, marks, others = [], [], []
        for k, word in enumerate(b"\n".join(parts).decode().split("\n")):
            if found := LETTERS(word.lower()):
                letters.append((k, found[1]))
                marks.append(self.marks[found[2]])
            elif BETWEEN in word:
                done[k] = pack_ids(self._ids(self.tokenizer, word).tolist())
            else:
                others.append((k, word))
        if letters:
            for (k, _), ids, mark in zip(letters, self._letters_only([w for _, w in letters]), marks, strict=True):
                done[k] = ids + mark
        if others:
            for (k, _), ids in zip(others, self._all_steps([w for _, w in others]), strict=True):
                done[k] = ids
        return done

    def __call__(self, parts: list[bytes]) -> list[bytes]:
        return [ids for at in range(0, len(parts), WORDS) for ids in self._some(parts[at : at + WORDS])]


@lru_cache(None)
def _cache(path: str) -> PartCache:
    return PartCache(WordEncoder(path))


def encode_texts(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, one after the other, and the bounds between the texts.

    This vocabulary drops white space, so no token spans two words; the ids of a word are looked up once for all its occurrences here.
    """
    split = pc.ascii_split_whitespace(texts)
    coded, after = split.flatten().dictionary_encode(), split.offsets.to_numpy()[1:].astype(np.int64)
    words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    known = [*_cache(path).each(words), pack_ids([end_id])]
    sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
    used = np.insert(coded.indices.to_numpy(), after, len(words))  # each text's words, then the end
    counts = sizes[used]
    ends = np.cumsum(counts)
    places = np.repeat((np.cumsum(sizes) - sizes)[used] - (ends - counts), counts)
    places += np.arange(len(places))
    ids = np.frombuffer(b"".join(known), "<u4")[places]
    return ids, np.concatenate(([0], ends[after + np.arange(len(after))]))


def pieces(docs: DataFrame, path: str, length: int = LENGTH, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """Every document cut into pieces; ``nth`` numbers a task's pieces of one rounded length."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.binary()]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (length // grain + 2)
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("doc_id").to_pylist()
            for a, b in slices(binary_parts(texts)[1], TEXT_BYTES):
                ids, bounds = encode_texts(texts.slice(a, b - a), path)
                held, bounds, rows = memoryview(ids.view(np.uint8)), bounds.tolist(), []
                for key, first, last in zip(keys[a:b], bounds[:-1], bounds[1:], strict=True):
                    for at in range(first, last, length):
                        size = min(length, last - at)
                        own, bin_ = held[4 * at : 4 * (at + size)], -(-size // grain)
                        rows.append((key, at - first, size, zlib.crc32(own), last - first, part, seen[bin_], bytes(own) if with_ids else None))
                        seen[bin_] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(step, PIECES)


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of sizes 1..len(prices) within the capacity, each size as often as wanted."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        sizes = min(room, len(prices))
        values = best[room - sizes : room][::-1] + prices[:sizes]
        k = int(np.argmax(values))
        if values[k] > best[room - 1]:
            best[room], took[room] = values[k], k + 1
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(prices), np.int64), capacity
    while room > 0:
        if took[room]:
            pattern[took[room] - 1] += 1
            room -= took[room]
        else:
            room -= 1
    return float(best[capacity]), pattern


def fractional_patterns(demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used by the linear program; demand[i] items have size i + 1."""
    active = np.flatnonzero(demand)
    if not len(active):
        return []
    basis = np.zeros((len(active), len(active)))
    basis[np.arange(len(active)), np.arange(len(active))] = capacity // (active + 1)
    inverse, used = np.diag(1 / np.diag(basis)), demand[active] / np.diag(basis)
    prices, bound = np.zeros(int(active[-1]) + 1), 0.0
    for _ in range(40 * len(active) + 100):
        dual = np.maximum(inverse.sum(0), 0)
        prices[active] = dual
        value, pattern = knapsack(prices, capacity)
        bound = max(bound, float(dual @ demand[active]) / value)  # no packing needs fewer sequences
        if value <= 1 + 1e-9 or used.sum() - bound <= gap * used.sum():
            break
        column = pattern[active].astype(float)
        move = inverse @ column
        able = move > 1e-10
        if not able.any():
            break
        ratios = np.where(able, used / np.where(able, move, 1), np.inf)
        out = int(np.argmin(ratios))
        step = ratios[out]
        used = np.maximum(used - step * move, 0)
        used[out] = step
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        basis[:, out] = column
    out_patterns = []
    for k in np.flatnonzero(used > 1e-9):
        whole = np.zeros(len(demand), np.int64)
        whole[active] = basis[:, k].astype(np.int64)
        out_patterns.append((whole, float(used[k])))
    return out_patterns


def plan(demand: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, last rank + 1, items of it in each sequence, first sequence) for all items."""
    left, done, rows, sequence = demand.astype(np.int64).copy(), np.zeros(len(demand), np.int64), [], 0

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal sequence
        for k in np.flatnonzero(pattern):
            rows.append((int(k) + 1, int(done[k]), int(done[k] + pattern[k] * times), int(pattern[k]), sequence))
            done[k] += pattern[k] * times
            left[k] -= pattern[k] * times
        sequence += times

    for pattern, times in fractional_patterns(demand, capacity):
        whole = int(times + 1e-6)
        hit = pattern > 0
        whole = min(whole, int((left[hit] // pattern[hit]).min()))
        if whole > 0:
            use(pattern, whole)
    open_: list[tuple[int, np.ndarray]] = []
    for k in np.flatnonzero(left)[::-1]:
        size, count = int(k) + 1, int(left[k])
        for n, (room, pattern) in enumerate(open_):
            fit = min(count, room // size)
            if fit:
                pattern[k] += fit
                open_[n] = (room - fit * size, pattern)
                count -= fit
        while count:
            fit, pattern = min(count, capacity // size), np.zeros(len(demand), np.int64)
            pattern[k] = fit
            open_.append((capacity - fit * size, pattern))
            count -= fit
    for _, pattern in open_:
        use(pattern, 1)
    return rows


def packed(docs: DataFrame, path: str, length: int = LENGTH, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece."""
    spark = docs.sparkSession
    cut = pieces(docs, path, length, grain, with_ids)
    cut = written(cut if with_ids else cut.drop("ids"), "pieces").withColumn("size", F.ceil(F.col("length") / grain).cast("int"))
    # Ranks within a size: rows of each task stay in a run, so only counts by size and task are added up.
    by_task = cut.groupBy("size", "part").agg((F.max("nth") + 1).alias("count"))
    earlier = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.withColumn("first", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    demand = np.zeros(length // grain, np.int64)
    for r in by_task.groupBy("size").agg(F.sum("count").alias("n")).collect():
        demand[r["size"] - 1] = r["n"]
    rows = plan(demand, length // grain)
    table = spark.createDataFrame(rows, "size int, low long, high long, each long, sequence long")
    ranked = cut.join(firsts, ["size", "part"]).withColumn("rank", F.col("first") + F.col("nth"))
    hit = (ranked["size"] == table["size"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    dealt = ranked.join(F.broadcast(table), hit).select(
        ranked["*"], (F.col("sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).alias("sequence_id")
    )
    # A sequence holds at most ``length`` pieces.
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "size", "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def op1_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


QUERIES = {"op1_cutting_stock": op1_cutting_stock}
SQL: dict[str, str] = {}
