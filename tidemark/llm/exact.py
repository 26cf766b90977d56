"""Exact dedup by content-defined chunk recipes.

Every text is cut where its content says so: at the first line end after ``LEAST`` characters, at ``MOST`` characters
at the latest. Each distinct chunk moves once, to be compared with the chunks of the same digest; the first digest of
``DIGESTS`` for which no two different chunks agree serves as verified identifier (the last one is the chunk itself, so
there always is one). Equal identifiers then mean equal chunks, and two texts are equal if and only if their ordered
lists of identifiers are: from there on only those short lists move, however long the documents are.

Nulls count as empty texts, and empty texts equal one another. Rows without ``doc_id`` count in their group; they can stay
only if the group has no row with an id. ``groups`` marks all rows of a group that share the id to keep; ``kept_documents`` keeps one of them. It
drops rows by their address, so that no text moves but as a chunk. Further columns pass through it untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.frames import addressed, documents, text_or_empty, without_rows

LEAST, MOST = 1024, 8192
CHUNK = rf"(?s).{{{LEAST},{MOST}}}?\n|.{{1,{MOST}}}"
DIGESTS: tuple[Callable[[Column], Column], ...] = (F.xxhash64, lambda c: F.sha2(c.cast("binary"), 256), lambda c: c)


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def verified_digest(texts: DataFrame, text: Column, digests: Sequence = DIGESTS) -> Callable[[Column], Column]:
    """The first digest that tells all distinct chunks of these texts apart."""
    for digest in digests[:-1]:
        each = texts.select(F.explode(chunks(text)).alias("chunk"))
        distinct = each.groupBy(digest(F.col("chunk")).alias("digest"), "chunk").agg(F.lit(1).alias("one"))
        clash = distinct.groupBy("digest").agg(F.sum("one").alias("kinds")).where("kinds > 1")
        if clash.isEmpty():
            return digest
    return digests[-1]


def recipe(text: Column, digest: Callable[[Column], Column]) -> Column:
    return F.transform(chunks(text), lambda c: digest(c))


def groups(docs: DataFrame, digests: Sequence = DIGESTS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    text = text_or_empty()
    made = recipe(text, verified_digest(docs, text, digests))
    # The fingerprint only makes sorting quick; the lists themselves are compared.
    lists = docs.select("doc_id", F.xxhash64(made).alias("_print"), made.alias("_recipe"), F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"))
    found = lists.groupBy("_print", "_recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return lists.join(found, ["_print", "_recipe"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of each group with all its columns: that with the largest id, of several the last one in the files."""
    rows, key = addressed(docs)
    text = text_or_empty()
    made = recipe(text, verified_digest(rows, text, DIGESTS))
    lists = rows.select(F.xxhash64(made).alias("_print"), made.alias("_recipe"), F.struct("doc_id", key).alias("_row"))
    last = lists.groupBy("_print", "_recipe").agg(F.max("_row").alias("_row")).select(f"_row.{key}")
    return without_rows(rows, key, rows.select(key).join(last, key, "left_anti"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir))


SQL = {
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
}
QUERIES = {"op6_exact_dedup": op6_exact_dedup}
