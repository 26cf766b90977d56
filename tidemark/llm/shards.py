"""Sharding by histogram sort: shards of nearly equal bytes in the order of (text hash, doc_id).

Rows are ordered by a hash of their text, then by ``doc_id``, so equal texts lie side by side. Splitters are found by
counting, not sampling: every round counts the exact bytes in ``PROBES`` equal slices of the ranges that hold a
splitter, then narrows each range to the slice with the wanted number of bytes below it, until that slice is lighter than
the tolerance. A range that has come down to one hash, as with a large group of copies, is narrowed on ``doc_id``.
Only the histograms (at most parts x PROBES rows) reach the driver. The rows then move once, to parts that are finer
than the shards, so that no shard is one task; a row's slot is the exact number of rows before its part plus its rank there.

The law is ``bytes``: no shard is off its share by more than the tolerance or one row, whichever is larger (rows with
equal hash and ``doc_id``, repeated rows, stay together). Null texts and null ids are ordered like hash 0 and the lowest id; a
null text has size 1 and checksum 0. An empty table gives no rows. Further columns pass through ``sharded``, whatever their names; the
caller's own ``shard`` and ``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.frames import documents, text_or_empty

SHARDS = 8
PROBES = 1024
TOLERANCE = 0.0005
PART_BYTES = 32 << 20
MOST_PARTS = 1024
HASHES, IDS = (0, 1 << 62), (-(1 << 63), 1 << 63)
_NAMES = ("_hash", "_id", "_size")


def keys(docs: DataFrame) -> DataFrame:
    """Sort key and size of every row, beside the row itself as one struct ``row``."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.shiftrightunsigned(F.xxhash64("text"), 2), F.lit(0)).alias("_hash"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(IDS[0]).cast("long")).alias("_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("_size"),
    )


def _slice(value: Column, low: int, width: int) -> Column:
    """Number of the slice of ``width`` from ``low`` on; decimals, as ids span all 64 bits."""
    exact = value.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")
    return F.call_function("div", exact, F.lit(width).cast("decimal(20,0)")).cast("long")


def _histogram(sized: DataFrame, ranges: list[dict]) -> list:
    """Bytes and rows in every slice of every range."""
    arms = []
    for number, r in enumerate(ranges):
        width = max(1, -(-(r["high"] - r["low"]) // PROBES))
        r["width"] = width
        value = F.col("_hash") if r["hash"] is None else F.col("_id")
        inside = F.col("_hash") == r["hash"] if r["hash"] is not None else F.lit(True)
        if r["high"] < (HASHES if r["hash"] is None else IDS)[1]:
            inside &= value < F.lit(r["high"])
        inside &= value >= F.lit(r["low"])
        arms.append(F.when(inside, F.struct(F.lit(number).alias("range"), _slice(value, r["low"], width).alias("slice"))))
    hits = sized.select(F.explode(F.array_compact(F.array(*arms))).alias("hit"), "_size")
    return (
        hits.groupBy("hit.range", "hit.slice").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"))
        .orderBy("range", "slice").collect()
    )


def splitters(sized: DataFrame, shards: int, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> tuple[list[tuple], int]:
    """[(hash, id, rows below, bytes below, shard)] of the first key of every part, and the total bytes."""
    total, count = sized.agg(F.sum("_size"), F.count("*")).first()
    if not count:
        return [], 0
    parts = shards * max(1, min(MOST_PARTS // shards, -(-total // (shards * part_bytes))))
    slack = tolerance * total / shards
    found: dict[int, tuple] = {0: (HASHES[0], IDS[0], 0, 0)}
    open_ = [{"goals": list(range(1, parts)), "hash": None, "low": HASHES[0], "high": HASHES[1], "bytes": 0, "rows": 0}]
    while open_:
        histogram = _histogram(sized, open_)
        following = []
        for number, r in enumerate(open_):
            below, rows, goals = r["bytes"], r["rows"], list(r["goals"])
            for cell in (c for c in histogram if c["range"] == number):
                low = r["low"] + cell["slice"] * r["width"]
                inner = []
                while goals and total * goals[0] // parts <= below + cell["bytes"]:
                    inner.append(goals.pop(0))
                if inner and (cell["bytes"] <= slack or (r["width"] == 1 and r["hash"] is not None)):
                    for g in inner:  # the nearer edge of a slice that is light enough, or of one key
                        after = 2 * (total * g // parts - below) > cell["bytes"]
                        edge = low + r["width"] if after else low
                        key = (edge, IDS[0]) if r["hash"] is None else (r["hash"], edge)
                        found[g] = (*key, rows + cell["rows"] * after, below + cell["bytes"] * after)
                elif inner and r["width"] == 1:
                    following.append({"goals": inner, "hash": low, "low": IDS[0], "high": IDS[1], "bytes": below, "rows": rows})
                elif inner:
                    following.append({"goals": inner, "hash": r["hash"], "low": low, "high": min(low + r["width"], r["high"]), "bytes": below, "rows": rows})
                below, rows = below + cell["bytes"], rows + cell["rows"]
        open_ = following
    return [(*found[g], g * shards // parts) for g in sorted(found)], total


def sharded(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; rows lie in the order of the shards and slots of their part."""
    spark = docs.sparkSession
    sized = keys(docs)
    edges, _ = splitters(sized.select(*_NAMES), shards, tolerance, part_bytes)
    starts: dict[int, int] = {}
    for _, _, rows, _, shard in edges:
        starts.setdefault(shard, rows)
    # At most MOST_PARTS edges, so a row finds its part by comparisons alone.
    part = _bisect([(h, i) for h, i, *_ in edges] or [(0, IDS[0])])
    table = spark.createDataFrame(
        [(n, rows - starts[shard], shard) for n, (_, _, rows, _, shard) in enumerate(edges)],
        T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType()), T.StructField("shard", T.IntegerType())]),
    )
    ordered = Window.partitionBy("_part").orderBy("_hash", "_id")
    ranked = sized.withColumn("_part", part).withColumn("_rank", F.row_number().over(ordered))
    own = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    return ranked.join(F.broadcast(table), "_part").select(*own, "shard", (F.col("_before") + F.col("_rank") - 1).alias("slot"))


def _bisect(edges: list[tuple], first: int = 0) -> Column:
    """Number of the last edge that is not above the row's key, as a balanced tree of comparisons."""
    if len(edges) == 1:
        return F.lit(first)
    half = len(edges) // 2
    h, i = edges[half]
    if h >= HASHES[1]:
        return _bisect(edges[:half], first)
    at_or_above = (F.col("_hash") > F.lit(h)) | ((F.col("_hash") == F.lit(h)) & _from(i))
    return F.when(at_or_above, _bisect(edges[half:], first + half)).otherwise(_bisect(edges[:half], first))


def _from(i: int) -> Column:
    return F.lit(False) if i >= IDS[1] else F.lit(True) if i <= IDS[0] else F.col("_id") >= F.lit(i)


def op4_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return sharded(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard"),
        F.col("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op4_histogram_sort": op4_histogram_sort}
SQL: dict[str, str] = {}
