"""A training corpus from raw documents: quality rules, exact dedup, near-duplicate join, repeated strings, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them back, so a lost executor costs one stage's
tasks at most. A stage that gets its predecessor's rows as files removes what the stages before it left in the shared folder, so disk never holds
more than one stage's work. Rows without text or id, repeated rows and empty tables are handled as each operator says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact, jaccard, packing, quality, repeats
from tidemark.llm.frames import documents, noted_folders, remove_folders, written

#: Folders the stages have written below the shared folder and not removed yet.
_left: list[str] = []
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(work: Stage) -> Stage:
    """Note a stage's folders; remove those of finished stages, unless the rows are still read from them."""

    @wraps(work)
    def tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        gone = [f for f in _left if not any(f in name for name in files)] if files else []
        remove_folders(spark, gone)
        _left[:] = [f for f in _left if f not in gone]
        with noted_folders() as made:
            rows = work(spark, docs, sf_dir)
        _left.extend(made)
        return rows

    return tidy


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact.kept_documents(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked texts the one with the smallest id stays."""
    return jaccard.kept_documents(docs)


@stage
def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier are cut out of the texts."""
    return repeats.kept_documents(docs)


@stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in the training sequences."""
    return packing.packed(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("suffix-array dedup", repeated_strings),
    ("packing", packed_sequences),
]

#: The likelihood threshold, the components and the patterns are not to be had in SQL; the tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    before: list[str] = []
    for number, (_, work) in enumerate(STAGES):
        rows = work(spark, docs, sf_dir)
        with noted_folders() as made:
            docs = written(rows, f"stage{number}")
        remove_folders(spark, before)
        before = made
    return docs


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def all_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
