"""Connected components of links between integer ids: stars inside each task, then alternating stars (Kiveris et al. 2014) as DataFrame joins.

A task gets about ``HELD`` links, so those of many small files are one task's, which finds their components alone; more links are more tasks, and
the alternating stars tie together what these found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import written

#: Links that a task gets and holds at a time, 16 bytes each.
HELD = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node but the smallest one of each component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        up = root.copy()
        np.minimum.at(up, root[a], low)
        np.minimum.at(up, root[b], low)
        while (up[up] != up).any():
            up = up[up]
        root = up[root]
    tied = root != np.arange(len(nodes))
    return nodes[tied], nodes[root[tied]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as stars, which connect the same nodes and are fewer; ``HELD`` links at a time."""
    held, count = [], 0

    def tied() -> tuple[np.ndarray, np.ndarray]:
        return stars(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))

    for batch in batches:
        held.append(tuple(batch.column(n).to_numpy() for n in ("a", "b")))
        count += batch.num_rows
        if count >= HELD:
            found = tied()
            if 2 * len(found[0]) >= HELD:
                yield pa.RecordBatch.from_arrays([*map(pa.array, found)], ["a", "b"])
                found = tuple(x[:0] for x in found)
            held, count = [found], len(found[0])
    if count:
        yield pa.RecordBatch.from_arrays([*map(pa.array, tied())], ["a", "b"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (or smaller) neighbours are tied to the smallest node around it; of the larger ones rows may repeat."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = both if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ends.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("root"))
    joined = ends.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("root").alias("b")).where("a <> b")
    return joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("root").alias("b")).where("a <> b").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether each node is tied to one node, which is tied to none: then these are the components."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("tied")), F.struct(F.col("b").alias("node"), F.lit(0).alias("tied")))
    nodes = links.select(F.explode(ends).alias("end")).groupBy("end.node").agg(F.sum("end.tied").alias("tied"), F.min("end.tied").alias("least"))
    return nodes.where("tied > 1 or tied = 1 and least = 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link (columns a, b) to another; the root is the smallest node it can reach."""
    every = written(links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")), "links")
    tasks = -(-every.count() // HELD)
    now = written(every.coalesce(max(1, tasks)).mapInArrow(_contracted, "a long, b long"), "links")
    while tasks > 1 and not _settled(now):
        now = written(_star(_star(now, large=True), large=False), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components that ``roots`` (node, root) become by more links (columns a, b) between their roots or nodes that have no row."""
    more = components(links)
    after = more.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    return roots.join(after, "root", "left").select("node", F.coalesce("_top", "root").alias("root")).unionByName(more)
