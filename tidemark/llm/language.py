"""Language identification in two steps: the language family, then linear SVMs between the languages of that family.

A text is described by the shares of its byte trigrams (A-Z lower-cased), hashed into ``CELLS``; whole texts are counted. Families come
from a table of language codes; the codes that are not in it are dealt, in order, to families of at most ``UNLISTED``, so that the number of pairs
grows with neither all languages nor all families squared. At either step each pair of classes has
a linear support vector machine (squared hinge loss, dual coordinate descent); the class with most votes wins, ties
go to the larger sum of margins, then to the name that sorts first. Related languages thus never compete
with languages of other families for the same weights.

The models are fitted on at most ``SAMPLE`` labelled rows, the same number of each language, lowest in a hash of ``doc_id`` and text, and on one row of
each language where there are more than ``SAMPLE`` languages; no language is left out. Rows held out, without language or without letters are not used. Predictions see the text alone. A text that is
null, empty or without letters gives ``und`` with score 0, and so does every text if there is nothing to learn from. The score is
the product of both steps' logistic margins. Repeated rows get equal predictions; further columns pass through ``identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.frames import STEP_BYTES, documents, utf8, written
from tidemark.llm.text import LOWER, binary_parts, slices

CELLS = 4096
SAMPLE = 4000
UNLISTED = 16
#: Keys are counted by their upper 16 bits.
BIN_SHIFT = 48
#: Language codes by family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "mr", "ne", "bn", "pa", "gu"],
    "semitic": ["ar", "he"],
    "sinitic": ["zh", "yue"],
}


def families_of(languages: list[str]) -> dict[str, str]:
    """Family of every language."""
    listed = {code: name for name, codes in FAMILIES.items() for code in codes}
    others = sorted(code for code in languages if code not in listed)
    return {code: listed[code] for code in languages if code in listed} | {code: f"={others[k - k % UNLISTED]}" for k, code in enumerate(others)}


def shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of trigram shares, one for each text."""
    texts = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((texts, CELLS), np.float32)
    low = LOWER[data].astype(np.uint32)
    code = low[:-2] | low[1:-1] << np.uint32(8) | low[2:] << np.uint32(16)
    cell = ((code * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    whole = owner[:-2] == owner[2:]
    counts = np.bincount((owner[:-2] * CELLS + cell)[whole], minlength=texts * CELLS).reshape(texts, CELLS).astype(np.float32)
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def fit_pair(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights (bias last) of the linear SVM with squared hinge loss for y in {-1, 1}."""
    scale = (1 / np.maximum(x.std(0), 1e-4)).astype(np.float32)
    z = np.ones((len(x), x.shape[1] + 1), np.float32)
    np.multiply(x, scale / np.float32(np.sqrt(len(scale))), out=z[:, :-1])
    weights, alpha, size = np.zeros(z.shape[1]), np.zeros(len(z)), np.einsum("ij,ij->i", z, z) + 1 / (2 * cost)
    order = np.random.default_rng(1)
    for _ in range(rounds):
        for i in order.permutation(len(z)):
            step = max(alpha[i] - (y[i] * (z[i] @ weights) - 1 + alpha[i] / (2 * cost)) / size[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                weights += step * y[i] * z[i]
    weights[:-1] *= scale / np.sqrt(len(scale))
    return weights.astype(np.float32)


@dataclass(frozen=True)
class OneVersusOne:
    classes: list[str]
    weights: np.ndarray  # (cells + 1) x pairs

    @staticmethod
    def fit(x: np.ndarray, labels: np.ndarray) -> OneVersusOne:
        classes, columns = sorted(set(labels.tolist())), []
        for a, b in combinations(classes, 2):
            rows = (labels == a) | (labels == b)
            columns.append(fit_pair(x[rows], np.where(labels[rows] == a, 1.0, -1.0)))
        return OneVersusOne(classes, np.stack(columns, 1) if columns else np.zeros((x.shape[1] + 1, 0), np.float32))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class number and logistic margin of each row."""
        margins = x @ self.weights[:-1] + self.weights[-1]
        votes = np.zeros((len(x), len(self.classes)))
        sums = np.zeros_like(votes)
        for k, (a, b) in enumerate(combinations(range(len(self.classes)), 2)):
            votes[:, a] += margins[:, k] >= 0
            votes[:, b] += margins[:, k] < 0
            sums[:, a] += margins[:, k]
            sums[:, b] -= margins[:, k]
        best = np.argmax(votes + np.tanh(sums / (1 + np.abs(sums).max(1, keepdims=True))) / 4, 1)
        margin = sums[np.arange(len(x)), best] / max(1, len(self.classes) - 1)
        return best, 1 / (1 + np.exp(-np.clip(4 * margin, -50, 50))) if len(self.classes) > 1 else np.ones(len(x))


@dataclass(frozen=True)
class Model:
    families: OneVersusOne
    languages: dict[str, OneVersusOne]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen, score = self.families.predict(x)
        names = np.empty(len(x), object)
        for number, name in enumerate(self.families.classes):
            rows = np.flatnonzero(chosen == number)
            if len(rows):
                inner, sure = self.languages[name].predict(x[rows])
                names[rows] = np.array(self.languages[name].classes, object)[inner]
                score[rows] *= sure
        return names, score


def _filled(row: np.ndarray) -> bytes:
    """The cells of a row that are not 0, then their shares."""
    cells = np.flatnonzero(row)
    return cells.astype("<u2").tobytes() + row[cells].astype("<f4").tobytes()


def _dense(blobs: list[bytes]) -> np.ndarray:
    x = np.zeros((len(blobs), CELLS), np.float32)
    for row, blob in zip(x, blobs, strict=True):
        size = len(blob) // 6
        row[np.frombuffer(blob, "<u2", size)] = np.frombuffer(blob, "<f4", size, 2 * size)
    return x


def _share_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = binary_parts(batch.column("bytes"))
        for a, b in slices(offsets, STEP_BYTES):
            x = shares(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([batch.column("lang")[a:b], pa.array([_filled(r) for r in x], pa.binary())], ["lang", "shares"])


def _sum_before(group: list[str], order: str) -> Column:
    earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(earlier), F.lit(0))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Model from rows (doc_id, text, lang); None without any usable row."""
    usable = labelled.where("lang IS NOT NULL AND lang <> 'und'").where(F.col("text").rlike(r"\p{L}"))
    keyed = usable.select("lang", F.xxhash64("doc_id", "text").alias("key"), utf8().alias("bytes"))
    keys = keyed.select("lang", "key", F.shiftright("key", BIN_SHIFT).alias("bin"))
    histogram = written(keys.groupBy("lang", "bin").agg(F.count("*").alias("n")), "bins")
    kinds = [r["lang"] for r in histogram.select("lang").distinct().collect()]
    if not kinds:
        return None
    most = max(1, sample // len(kinds))
    # Every bin taken holds a row that is taken, so there are no more bins than rows; then the keys inside them, and last the texts, repeated rows once.
    bins = histogram.withColumn("before", _sum_before(["lang"], "bin")).where(F.col("before") < most).drop("n")
    inside = keys.join(F.broadcast(bins), ["lang", "bin"]).groupBy("lang", "bin", "before", "key").agg(F.count("*").alias("n"))
    chosen = inside.withColumn("place", F.col("before") + _sum_before(["lang", "bin"], "key")).where(F.col("place") < most).select("lang", "key")
    texts = keyed.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key").agg(F.min("bytes").alias("bytes"))
    rows = sorted((r["lang"], bytes(r["shares"])) for r in texts.mapInArrow(_share_rows, "lang string, shares binary").collect())
    x = _dense([blob for _, blob in rows])
    langs = np.array([lang for lang, _ in rows], object)
    named = families_of(kinds)
    families = np.array([named[lang] for lang in langs], object)
    inner = {name: OneVersusOne.fit(x[families == name], langs[families == name]) for name in sorted(set(families))}
    return Model(OneVersusOne.fit(x, families), inner)


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` beside its columns."""
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), utf8().alias("bytes"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = binary_parts(batch.column("bytes"))
            for a, b in slices(offsets, STEP_BYTES):
                names, score = np.full(b - a, "und", object), np.zeros(b - a)
                has = batch.column("letters")[a:b].to_numpy(zero_copy_only=False).astype(bool)
                if model is not None and has.any():
                    found, sure = model.predict(shares(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                    names[has], score[has] = found[has], sure[has]
                yield pa.RecordBatch.from_arrays([batch.column("row")[a:b], pa.array(names, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    schema = T.StructType([packed.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    done = packed.mapInArrow(step, schema)
    return done.select(*[F.col(f"row.`{c}`") for c in names if c not in ("lang_pred", "score")], "lang_pred", "score")


def held_out(divisor: int, remainder: int):
    """Whether crc32 of the id as text has this remainder; a row without id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out(4, 2)).select("doc_id", "text", "lang"))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
