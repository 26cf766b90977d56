"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

A text is cut into runs of letters and digits and runs of other signs; single tokens and pairs of neighbours are hashed into
``BUCKETS``. Two multinomials over the buckets are counted: the target's over all trusted documents (labelled quality 1 and not toxic),
the raw one over every document. A text's score is the mean over its tokens and pairs of log(target / raw). The threshold comes from all
labelled rows that pass the base rules: the best split of good from bad by true minus false positive rate, over a histogram
of their scores, in the middle of the gap found. Every document is then compared with it; nothing is sampled. Without labelled rows of both
qualities the verdict is to keep.

The base rules count words ``[^\\x20\\x09-\\x0D]+``, signs, repeated lines and words in repeated 3-word windows (windows
compare by a 64-bit hash of their words). Null and empty texts have zero counts and fail the base rules. Rows that repeat a ``doc_id`` are judged each by its own
text. Further columns pass through ``kept_documents`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import MOST_KEYS, addressed, documents, text_or_empty, without_rows, written

BUCKETS = 10_000
LEAST_WORDS = 50
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
TOKENS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
#: Histogram of scores: range and cells.
RANGE, CELLS = 4.0, 4000


def word_list(text: Column) -> Column:
    """Words of a text; the blank pieces a split leaves at the ends are cut off."""
    pieces = F.split(text, f"[{BLANKS}]+")
    return F.filter(pieces, lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window which occurs twice or more."""
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)),
    )

    def covered(marks: Column) -> Column:
        return _bound(F.sort_array(F.transform(marks, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), neighbours)

    def neighbours(placed: Column) -> Column:
        def same(k: Column, other: Column) -> Column:
            return F.coalesce(F.get(placed, k)["h"] == F.get(placed, other)["h"], F.lit(False))

        marked = F.transform(placed, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"]))
        return _bound(F.filter(marked, lambda i: i.isNotNull()), spread)

    def spread(first: Column) -> Column:
        return F.size(F.array_union(first, F.array_union(F.transform(first, lambda i: i + 1), F.transform(first, lambda i: i + 2))))

    def counted(marks: Column) -> Column:
        return F.when(F.size(F.array_distinct(marks)) == F.size(marks), 0).otherwise(covered(marks))

    return F.when(F.size(words) < 3, 0).otherwise(_bound(windows, counted)).cast("long")


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def base_counts(text: Column) -> Column:
    """The counted properties of a text as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) != "")

    def of(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeat_words(words).alias("n_repeat_words"))

    return F.struct(
        _bound(word_list(text), of).alias("w"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )


def features(text: Column) -> Column:
    """Buckets of all tokens and pairs of neighbouring tokens."""
    tokens = F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))

    def both(h: Column) -> Column:
        singles = F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("short"))
        pairs = F.transform(
            F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))),
            lambda x, i: F.pmod(F.xxhash64(F.get(h, i), x), F.lit(BUCKETS)).cast("short"),
        )
        return F.concat(singles, pairs)

    return _bound(hashes, both)


def _known(labels: DataFrame) -> DataFrame:
    """(_labelled, _good) of all labelled documents: 1 trusted, 0 bad."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).when(F.col("quality") == 0, 0)
    return known.select(F.col("doc_id").alias("_labelled"), good.alias("_good")).where("_good IS NOT NULL")


def measured(docs: DataFrame, labels: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns with the label, counts and buckets of the text: written once, as three passes read them.

    The labels go to the texts as long as they are few; beyond that both sides are shuffled, before the buckets are made.
    """
    known, text, own = _known(labels), text_or_empty(), [F.col(f"`{c}`") for c in carried]
    side = F.broadcast(known) if known.count() <= MOST_KEYS else known
    marked = docs.join(side, F.col("doc_id") == F.col("_labelled"), "left")
    return written(marked.select(*own, "_good", base_counts(text).alias("_base"), features(text).alias("_cells")), "quality")


def bucket_weights(rows: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log(target / raw) of every bucket; both counted over whole texts, plus one for each bucket."""
    cells = rows.select(F.explode("_cells").alias("bucket"), "_good")
    counts = cells.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if(F.col("_good") == 1).alias("target")).collect()
    raw, target = [1] * buckets, [1] * buckets
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    all_raw, all_target = sum(raw), sum(target)
    return [round(math.log(t / all_target) - math.log(r / all_raw), 9) for t, r in zip(target, raw, strict=True)]


def score(cells: Column, weights: list[float]) -> Column:
    """Mean log-likelihood ratio of a text's buckets; 0 without any."""
    table = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")
    total = F.aggregate(cells, F.lit(0.0), lambda s, b: s + F.get(table, b.cast("int")))
    return F.when(F.size(cells) == 0, 0.0).otherwise(total / F.size(cells))


def best_threshold(rows: DataFrame, weights: list[float]) -> float:
    """Score at which the labelled good and bad documents part best; minus infinity if one kind is missing."""
    passing = rows.where(F.col("_good").isNotNull() & ~failed(F.col("_base")))
    cell = F.floor((F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), score(F.col("_cells"), weights))) + RANGE) * (CELLS / (2 * RANGE)))
    found = passing.groupBy(cell.alias("cell")).agg(F.sum("_good").alias("good"), F.count("*").alias("n")).orderBy("cell").collect()
    goods, all_ = sum(r["good"] for r in found), sum(r["n"] for r in found)
    if not goods or goods == all_:
        return -math.inf
    best, low, high, good, bad = 0.0, -math.inf, -math.inf, 0, 0
    for r, following in zip(found, [*found[1:], None], strict=True):
        good, bad = good + r["good"], bad + r["n"] - r["good"]
        gain = bad / (all_ - goods) - good / goods
        if gain > best and following:
            best, low, high = gain, r["cell"] + 1, following["cell"]
    return (low + high) * (RANGE / CELLS) - RANGE


def failed(base: Column) -> Column:
    return (base["w"]["n_words"] < LEAST_WORDS) | (100 * base["w"]["n_repeat_words"] > 50 * base["w"]["n_words"])


def judged(docs: DataFrame, labels: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """The carried columns of ``docs`` (all, unless named; ``doc_id`` is one) with the counts, ``base_failed``, ``llr_score`` and ``kept``."""
    rows = measured(docs, labels, carried or docs.columns)
    weights = bucket_weights(rows)
    edge = best_threshold(rows, weights)
    counted = rows.withColumn("llr_score", score(F.col("_cells"), weights))
    fails = failed(F.col("_base"))
    return counted.withColumns(
        {
            "n_words": F.col("_base.w.n_words"),
            "word_chars": F.col("_base.word_chars"),
            "n_symbols": F.col("_base.n_symbols"),
            "n_dup_lines": F.col("_base.n_dup_lines"),
            "n_repeat_words": F.col("_base.w.n_repeat_words"),
            "base_failed": fails,
            "kept": ~fails & (F.col("llr_score") >= F.lit(edge)),
        }
    ).drop("_good", "_base", "_cells")


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that pass, with their own columns; what is measured carries their addresses, not their texts."""
    rows, key = addressed(docs)
    inner = rows.select(key, "doc_id", "text")
    return without_rows(rows, key, judged(inner, labels, carried=[key, "doc_id"]).where(~F.col("kept")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judged(documents(spark, sf_dir), labels, carried=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_score"
    )


QUERIES = {"op7_quality_rules": op7_quality_rules}
SQL: dict[str, str] = {}
