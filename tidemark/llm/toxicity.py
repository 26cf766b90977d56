"""Toxicity by two class-conditional Kneser-Ney models over the bytes of words.

Lower-cased words are sequences of bytes behind a start sign (the blank) and before an end sign; each byte is predicted from at most ``CONTEXT``
bytes before it in the word, so new endings of a known expression are still known by their stem. The counts of toxic and of ordinary
documents are kept apart at the highest order only. Below it both classes share one back-off distribution, made of continuation counts (how many different
bytes an n-gram follows) of both together, with an absolute discount at every order:

    P_class(b | h) = max(c_class(h b) - D_class, 0) / c_class(h) + g_class(h) * P_shared(b | h without its first byte)

Most words of a toxic text are ordinary ones, so its likelihood is a mixture: each word comes from the toxic model with probability ``MIXED``, else
from the ordinary one. A text's evidence is the difference of its toxic and its ordinary log-likelihood over the number of its words: the mean of
log(1 - MIXED + MIXED * P_toxic(word) / P_ordinary(word)). Where neither class has seen an n-gram, the
shared part cancels out and what is left is the ratio of the two back-off weights; so the model is two tables, of n-grams and of
contexts. The evidence becomes a probability by a logistic curve fitted on labelled documents that were not counted.

The models are fitted on at most ``SAMPLE`` labelled documents of each class, those lowest in a hash of their id (every fifth of them
sets the curve); of rows that repeat an id the smallest text counts, and an id with several labels is toxic if one of them says so. N-grams of up to seven bytes
are exact 64-bit keys. Spark counts them; the driver gets the distinct ones of that sample and hands the two tables out.

Null and empty texts have no evidence and get the share of toxic documents among the labelled. Without labelled documents of both classes
every score is that share (0 without any). Rows are scored each by its own text; null ids are never held out; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import documents, text_or_empty
from tidemark.llm.language import held_out
from tidemark.llm.text import between, binary_parts, running, slices, words

SAMPLE = 10_000
#: Bytes of text in which a word counts once; the counts, and so the scores, depend on it.
STEP_BYTES = 2 << 20
CONTEXT = 6
THRESHOLD = 0.3
#: Share of a toxic text's words that come from the toxic model.
MIXED = 0.01
#: Ratios of words are taken up to this power of e.
MOST_RATIO = 40.0
BLANK = 0x20
#: Every so many sampled documents one sets the logistic curve.
FOLDS = 5
_U = np.uint64


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the distinct words, for every word which of them it is, and the texts' bounds in the words."""
    starts, ends, owner = words(data, offsets)
    _, first, which = np.unique(between(running(data), starts, ends), return_index=True, return_inverse=True)
    return starts[first], ends[first], which, np.searchsorted(owner, np.arange(len(offsets)))


def ngrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of the given words, signs for start and end included, and each word's bounds in them."""
    sizes = ends - starts + 1
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    # One blank in front of all, then every word with a blank behind it, which is also the sign before the next word.
    signs = np.full(bounds[-1] + 1, BLANK, np.uint8)
    is_word = inside < np.repeat(sizes - 1, sizes)
    signs[1:][is_word] = data[(np.repeat(starts, sizes) + inside)[is_word]]
    signs[signs == 0] = 1
    keys = np.zeros(bounds[-1], _U)
    at = np.arange(1, bounds[-1] + 1)
    for back in range(CONTEXT + 1):
        reach = inside + 1 >= back
        keys[reach] |= signs[at[reach] - back].astype(_U) << _U(8 * back)
    return keys, bounds


def lengths(keys: np.ndarray) -> np.ndarray:
    """Bytes of each n-gram."""
    out = np.zeros(len(keys), np.int64)
    for k in range(CONTEXT + 1):
        out += keys >= _U(1) << _U(8 * k)
    return out


def discount(counts: np.ndarray) -> float:
    once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return once / (once + 2 * twice) if once and twice else 0.5


def totals(groups: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct groups, which one each entry is in, their sums and their numbers of entries above 0."""
    names, which = np.unique(groups, return_inverse=True)
    return names, which, np.bincount(which, counts, len(names)), np.bincount(which, counts > 0, len(names))


def shared_backoff(keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the n-grams that longer ones end in, sorted, and their Kneser-Ney probabilities from continuation counts."""
    size = lengths(keys)
    kinds = [np.zeros(0, _U)] * (CONTEXT + 2)
    for n in range(CONTEXT + 1, 0, -1):
        longer = kinds[n + 1] & _U((1 << 8 * n) - 1) if n <= CONTEXT else kinds[n]
        kinds[n] = np.unique(np.concatenate([keys[size == n], longer]))
    found = [(np.zeros(0, _U), np.zeros(0))]
    for n in range(1, CONTEXT + 1):
        names, continued = np.unique(kinds[n + 1] & _U((1 << 8 * n) - 1), return_counts=True)
        taken = discount(continued)
        _, which, whole, kind = totals(names >> _U(8), continued)
        lower = found[-1][1][np.searchsorted(found[-1][0], names & _U((1 << 8 * (n - 1)) - 1))] if n > 1 else np.full(len(names), 1 / 256)
        found.append((names, np.maximum(continued - taken, 0) / whole[which] + taken * kind[which] / whole[which] * lower))
    return found


@dataclass(frozen=True)
class Ratios:
    """log P_toxic - log P_ordinary of every n-gram that was seen, and of unseen ones behind each context."""

    grams: np.ndarray
    values: np.ndarray
    contexts: np.ndarray
    unseen: np.ndarray

    @classmethod
    def fit(cls, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Ratios:
        """``keys`` are distinct and sorted."""
        size, backoff = lengths(keys), shared_backoff(keys)
        lower = np.zeros(len(keys))
        for n in range(2, CONTEXT + 2):
            here = size == n
            lower[here] = backoff[n - 1][1][np.searchsorted(backoff[n - 1][0], keys[here] & _U((1 << 8 * (n - 1)) - 1))]
        logs, weights = [], []
        for counts in (toxic, ordinary):
            taken = discount(counts)
            contexts, which, whole, kinds = totals(keys >> _U(8), counts)
            weight = np.where(whole > 0, taken * kinds / np.maximum(whole, 1), 1.0)
            logs.append(np.log(np.maximum(counts - taken, 0) / np.maximum(whole, 1)[which] + weight[which] * lower))
            weights.append(np.log(weight))
        return cls(keys, (logs[0] - logs[1]).astype(np.float32), contexts, (weights[0] - weights[1]).astype(np.float32))

    def of(self, keys: np.ndarray) -> np.ndarray:
        gram = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        out = np.where(self.grams[gram] == keys, self.values[gram], np.nan)
        left = np.flatnonzero(np.isnan(out))
        behind = keys[left] >> _U(8)
        context = np.minimum(np.searchsorted(self.contexts, behind), len(self.contexts) - 1)
        out[left] = np.where(self.contexts[context] == behind, self.unseen[context], 0.0)
        return out

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean over each text's words of their log ratio, toxic mixture to ordinary, and the number of words."""
        starts, ends, which, bounds = distinct_words(data, offsets)
        keys, at = ngrams(data, starts, ends)
        sums = np.concatenate([[0.0], np.cumsum(self.of(keys) if len(keys) else np.zeros(0))])
        word = np.log1p(MIXED * np.expm1(np.minimum(sums[at[1:]] - sums[at[:-1]], MOST_RATIO)))
        total = np.diff(np.concatenate([[0.0], np.cumsum(word[which])])[bounds])
        return total / np.maximum(np.diff(bounds), 1), np.diff(bounds)


@dataclass(frozen=True)
class Model:
    ratios: Ratios | None
    slope: float
    shift: float
    share: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.ratios is None:
            return np.full(len(offsets) - 1, self.share)
        mean, size = self.ratios.evidence(data, offsets)
        return np.where(size > 0, 1 / (1 + np.exp(-np.clip(self.slope * mean + self.shift, -50, 50))), self.share)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest curve; a small penalty on the slope keeps it finite for parted classes."""
    middle, width = x.mean(), x.std() or 1.0
    z = np.stack([(x - middle) / width, np.ones(len(x))], 1)
    at = np.array([1.0, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])
    penalty = np.diag([0.05, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ at, -50, 50)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ at)
        at = at - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(at[0], 0.0) / width
    return slope, at[1] - slope * middle


def chosen(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic) of at most ``most`` labelled documents of either class that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(4, 2))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [known.where(F.col("toxic") == t).orderBy(*order).limit(most) for t in (1, 0)]
    return some[0].unionByName(some[1])


def lowered() -> Column:
    return F.lower(text_or_empty()).cast("binary")


def sampled(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(bytes, toxic, fold) of the labelled documents a model is fitted on; one row an id."""
    ids = docs.sparkSession.createDataFrame(chosen(labels, most).collect(), "doc_id long, toxic int")
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    once = found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return once.select(lowered().alias("bytes"), "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold"))


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = binary_parts(batch.column("bytes"))
        toxic = batch.column("toxic").to_numpy()
        for a, b in slices(offsets, STEP_BYTES):
            starts, ends, which, bounds = distinct_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            keys, at = ngrams(data[offsets[a] : offsets[b]], starts, ends)
            kinds = np.repeat(toxic[a:b], np.diff(bounds))
            names, place = np.unique(keys, return_inverse=True)
            columns = []
            for kind in (1, 0):
                times = np.bincount(which[kinds == kind], minlength=len(starts))
                columns.append(np.bincount(place, np.repeat(times, np.diff(at)), len(names)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(columns[0]), pa.array(columns[1])], ["gram", "toxic", "ordinary"])


def _fit_rows(ratios: Ratios):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_parts(batch.column("bytes"))
            for a, b in slices(offsets, STEP_BYTES):
                mean, size = ratios.evidence(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([pa.array(mean), pa.array(size), batch.column("toxic")[a:b]], ["mean", "size", "toxic"])

    return step


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(4, 2))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    rows = sampled(docs, labels, most).persist()
    try:
        counted = rows.where("fold <> 0").mapInArrow(_count_rows, "gram long, toxic long, ordinary long")
        table = counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toArrow()
        keys = table["gram"].to_numpy().astype(_U)
        order = np.argsort(keys)
        toxic, ordinary = (table[c].to_numpy()[order].astype(float) for c in ("toxic", "ordinary"))
        if not toxic.any() or not ordinary.any():
            return Model(None, 0.0, 0.0, share)
        ratios = Ratios.fit(keys[order], toxic, ordinary)
        seen = rows.where("fold = 0").mapInArrow(_fit_rows(ratios), "mean double, size long, toxic int").where("size > 0").toArrow()
        y = seen["toxic"].to_numpy().astype(float)
        if not 0 < y.sum() < len(y):
            seen = rows.mapInArrow(_fit_rows(ratios), "mean double, size long, toxic int").where("size > 0").toArrow()
            y = seen["toxic"].to_numpy().astype(float)
        return Model(ratios, *logistic(seen["mean"].to_numpy(), y), share)
    finally:
        rows.unpersist()


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` beside its columns."""
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), lowered().alias("bytes"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_parts(batch.column("bytes"))
            for a, b in slices(offsets, STEP_BYTES):
                found = held.value.scores(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column("row")[a:b], pa.array(found, pa.float64())], ["row", "score"])

    done = packed.mapInArrow(step, T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())]))
    own = [F.col(f"row.`{c}`") for c in names if c not in ("score", "predicted")]
    return done.select(*own, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op12_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


QUERIES = {"op12_kneser_ney_toxicity": op12_kneser_ney_toxicity}
SQL: dict[str, str] = {}
