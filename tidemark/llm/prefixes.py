"""Prefix trie of rebuilt conversations in balanced parentheses, shard by shard.

A conversation is rebuilt from the first h turns of the conversation that opens its hundred and its own turns after its first h; h is a checksum of its id. The
distinct sequences of first turns are the nodes of a trie. No text moves: a turn is two 64-bit hashes of role and text, and its code points.

1. Turns are gathered by conversation and rebuilt by one join on the id of the hundred's first conversation, at most ``MOST_SHARED`` turns of it.
2. The sequences are sorted over the whole table, equal ones by their id, and cut into shards by that order; so the copies of one conversation,
   or all that share a first turn, are as many shards' work as they need. The number of shards follows from the number of turns.
3. Each shard writes its trie in balanced parentheses: a conversation closes what it does not share with its predecessor and opens the rest. The excess is kept in
   blocks with a tree of their minima; ``find_close`` reads off where a subtree ends. A subtree's members are a run of conversations,
   its nodes a run of the opening order; leaves are counted as ranks of the pairs "()", and what the members save comes from cumulative
   arrays: the sum over a subtree's nodes of n_convs * chars is the sum of its members' path lengths below the node.
4. A shard's first and last conversation are its *spines*; only their nodes can go on in other shards. Of each shard one row tells the driver how much it shares with the shard before.
   Along each level, pieces that are the same node are numbered and added up; what two shards both counted (shared nodes' own characters, a shared child, a shared leaf) is taken off.
   The other nodes are final when their shard is done, but for the name of a parent on a spine, which a join on (shard, level) brings.

The list of members that end at a node is hashed in its shard; only lists that cross shards are hashed from pieces, streamed in the order of the
ids. SHA-256 has to read such a list in one place, but never holds it.

Rows without ``conv_id`` belong to no conversation. Turns are ordered by ``turn``, null first; equal turns by the hash of role and text, repeated rows are turns of their own.
Null roles and texts are empty ones. A conversation (16 bytes and one count a turn) is one row, so its length is bounded by a task's memory. Further columns are not read. No rows
give no nodes. Sequences are equal if their 128-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.frames import shuffle_partitions, written

HUNDRED, SHARES, MOST_SHARED = 100, 6, 5
#: Turns of a shard, about; a shard is one task's memory.
SHARD_TURNS = 250_000
BLOCK = 32
INNER, LEFT, RIGHT, EDGE = -1, 0, 1, 2
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
COUNTS = ["n_convs", "path_chars", "node_chars", "leaves", "kids"]
ROWS = (
    "shard int, side int, level int, closed boolean, conv_id long, parent_conv_id long, parent_level int, parent_side int, "
    "n_convs long, path_chars long, node_chars long, leaves long, kids long, above long, ends string, first binary, last binary"
)
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def block_minima(excess: np.ndarray) -> list[np.ndarray]:
    """Smallest excess of every block, and of 2, 4, 8, ... blocks."""
    count = max(1, -(-len(excess) // BLOCK))
    count = 1 << (count - 1).bit_length()
    padded = np.full(count * BLOCK, np.iinfo(np.int64).max)
    padded[: len(excess)] = excess
    tree = [padded.reshape(count, BLOCK).min(axis=1)]
    while len(tree[-1]) > 1:
        tree.append(tree[-1].reshape(-1, 2).min(axis=1))
    return tree


def _scan(excess: np.ndarray, start: np.ndarray, stop: np.ndarray, under: np.ndarray) -> np.ndarray:
    """First place in [start, stop) with less excess than ``under``; -1 if there is none."""
    found = np.full(len(start), -1, np.int64)
    left = np.arange(len(start))
    for step in range(BLOCK):
        left = left[start[left] + step < stop[left]]
        if not len(left):
            break
        hit = excess[start[left] + step] < under[left]
        found[left[hit]] = start[left[hit]] + step
        left = left[~hit]
    return found


def find_close(excess: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Where each opened parenthesis is closed; the length of the sequence if it stays open."""
    tree, size = block_minima(excess), len(excess)
    under = excess[opens]
    block = opens // BLOCK
    close = _scan(excess, opens + 1, np.minimum((block + 1) * BLOCK, size), under)
    left = np.flatnonzero(close < 0)
    node, level = block[left], np.zeros(len(left), np.int64)
    found = np.zeros(len(left), bool)
    for height in range(len(tree) - 1):  # up, until a neighbour to the right holds the place
        up = ~found
        beside = node[up] ^ 1
        hit = (node[up] & 1 == 0) & (tree[height][beside] < under[left[up]])
        places = np.flatnonzero(up)
        node[places[hit]], level[places[hit]], found[places[hit]] = beside[hit], height, True
        node[places[~hit]] >>= 1
    close[left[~found]] = size
    left, node, level = left[found], node[found], level[found]
    for height in range(len(tree) - 1, 0, -1):  # and down again
        down = level == height
        below = node[down] << 1
        node[down] = np.where(tree[height - 1][below] < under[left[down]], below, below + 1)
        level[down] = height - 1
    close[left] = _scan(excess, node * BLOCK, np.minimum((node + 1) * BLOCK, size), under[left])
    return close


def shared_lengths(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many first turns each sequence shares with the one before."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.int64)
    same, depth = np.arange(1, len(sizes)), 0
    while len(same):
        same = same[np.minimum(sizes[same], sizes[same - 1]) > depth]
        same = same[(keys[offsets[same] + depth] == keys[offsets[same - 1] + depth]).all(axis=1)]
        depth += 1
        out[same] = depth
    return out


def least_in(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest value in each run [low, high), none of them empty."""
    power = np.frexp((high - low).astype(float))[1] - 1
    out, table = np.zeros(len(low), np.int64), values
    for k in range(int(power.max()) + 1 if len(power) else 0):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        here = power == k
        out[here] = np.minimum(table[low[here]], table[high[here] - (1 << k)])
    return out


def encoded_shard(shard: int, ids: np.ndarray, keys: np.ndarray, chars: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """Nodes of a shard's sorted conversations; see ``ROWS``. A last row holds its first and last sequence."""
    sizes, shared = np.diff(offsets), shared_lengths(keys, offsets)
    closing = np.concatenate([[0], sizes[:-1] - shared[1:]])
    counts = np.stack([closing, sizes - shared], 1).ravel()
    signs = np.concatenate([[1], np.repeat(np.tile([-1, 1], len(ids)), counts)])
    conv_at = np.concatenate([[0], np.repeat(np.repeat(np.arange(len(ids)), 2), counts)])
    excess = np.cumsum(signs)
    opens = np.flatnonzero(signs == 1)
    close = find_close(excess, opens)
    nodes, level, low = np.arange(len(opens)), excess[opens] - 1, conv_at[opens]
    closed = close < len(signs)
    high = np.where(closed, conv_at[np.minimum(close, len(signs) - 1)], len(ids))
    end = nodes + np.where(closed, (close - opens + 1) // 2, len(opens) - nodes)
    by_level = np.sort(level * len(opens) + nodes)
    parent = by_level[np.searchsorted(by_level, (level - 1) * len(opens) + nodes) - 1] % len(opens)
    along = np.concatenate([[0], np.cumsum(chars)])
    own = np.where(level > 0, along[offsets[low] + level] - along[offsets[low] + np.maximum(level - 1, 0)], 0)
    above = along[offsets[low] + np.maximum(level - 1, 0)] - along[offsets[low]]
    paths = np.concatenate([[0], np.cumsum(along[offsets[1:]] - along[offsets[:-1]])])
    node_sums = np.concatenate([[0], np.cumsum(own)])
    pairs = np.concatenate([[0], np.cumsum(np.append(signs[1:], -1)[opens] == -1)])
    kids = np.bincount(parent[1:], minlength=len(opens))
    left = low == 0
    side = np.where(left & (level <= sizes[0]), LEFT, np.where(closed, INNER, RIGHT))
    least = least_in(ids, low, high)
    # Members that end at a node: its first conversation and the copies behind it.
    is_copy = np.concatenate([[False], (shared[1:] == sizes[1:]) & (shared[1:] == sizes[:-1])])
    runs = np.append(np.flatnonzero(~is_copy), len(ids))
    ends: list[str | None] = [None] * len(opens)
    at = np.searchsorted(runs, low)
    for k in np.flatnonzero(sizes[low] == level).tolist():
        listed = ",".join(map(str, ids[low[k] : runs[at[k] + 1]].tolist()))
        ends[k] = listed if side[k] != INNER else hashlib.sha256(listed.encode()).hexdigest()
    spine_parent = (side[parent] != INNER) & (level > 0)
    known = (level > 0) & ~spine_parent
    first, last = (keys[offsets[k] : offsets[k + 1]] for k in (0, len(ids) - 1))
    lengths = (along[offsets[0] : offsets[1] + 1] - along[offsets[0]]).astype("<i8")

    def column(values, kind, null=None, edge=None):
        made = pa.array(values, kind, mask=null)
        return pa.concat_arrays([made, pa.array([edge], kind)])

    common = int(shared[1:].min()) if len(ids) > 1 else len(first)
    columns = [
        column(np.full(len(opens), shard), pa.int32(), edge=shard), column(side, pa.int32(), edge=EDGE), column(level, pa.int32(), edge=common),
        column(closed, pa.bool_()), column(least, pa.int64()), column(least[parent], pa.int64(), ~known), column(level[parent], pa.int32(), ~spine_parent),
        column(side[parent], pa.int32(), ~spine_parent), column(high - low, pa.int64()), column(paths[high] - paths[low], pa.int64()),
        column(node_sums[end] - node_sums[nodes], pa.int64()), column(pairs[end] - pairs[nodes], pa.int64()), column(kids, pa.int64()),
        column(above, pa.int64()), column(ends, pa.string(), edge=""),
        column([None] * len(opens), pa.binary(), edge=np.ascontiguousarray(first).tobytes() + lengths.tobytes()),
        column([None] * len(opens), pa.binary(), edge=np.ascontiguousarray(last).tobytes()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ROWS.split(", ")])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    turns = rows["turns"].chunk(0)
    offsets = np.asarray(turns.offsets, np.int64)
    flat = turns.values.slice(offsets[0], offsets[-1] - offsets[0])
    keys = np.stack([flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (0, 1)], 1) if len(flat) else np.zeros((0, 2), np.int64)
    chars = flat.field(2).to_numpy(zero_copy_only=False).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
    yield encoded_shard(TaskContext.get().partitionId(), rows["conv_id"].to_numpy(), keys, chars, offsets - offsets[0])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each (level, chain) of sorted pieces of a list of ids."""
    names, now, digest = ["level", "chain", "ends_sha256"], None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()])], names)

    for batch in batches:
        for level, chain, ends in zip(*(batch.column(n).to_pylist() for n in ("level", "chain", "ends")), strict=True):
            if (level, chain) != now:
                if now:
                    yield row()
                now, digest = (level, chain), hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
    if now:
        yield row()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with turns as (a, b, chars): the hundred's first turns, then the conversation's own."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"), F.length(text).cast("long").alias("chars"))
    one = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), turn.alias("t"))
    own = written(one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")), "turns")
    base = F.col("conv_id") - F.col("conv_id") % HUNDRED
    heads = own.where(F.col("conv_id") == base).select(F.col("conv_id").alias("base"), F.slice("turns", 1, MOST_SHARED).alias("head"))
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARES).cast("int")
    joined = own.withColumns({"base": base, "h": share}).join(heads, "base", "left")
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    whole = F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), rest))
    return joined.select("conv_id", F.arrays_zip(whole["a"].alias("a"), whole["b"].alias("b"), whole["chars"].alias("chars")).alias("turns"))


def _bounds(edges: list) -> list[tuple]:
    """For each shard: turns shared with the shard before (-1 for the first), characters of these, and whether its last node goes on in the next one."""
    out, before = [], None
    for r in sorted(edges, key=lambda r: r["shard"]):
        size = (len(r["first"]) - 8) // 24
        first = np.frombuffer(r["first"], "<i8", 2 * size).reshape(-1, 2)
        along = np.frombuffer(r["first"], "<i8", size + 1, 16 * size)
        last = np.frombuffer(r["last"], "<i8").reshape(-1, 2)
        shared = -1
        if before is not None:
            near = min(len(first), len(before))
            differ = np.flatnonzero((first[:near] != before[:near]).any(axis=1))
            shared = int(differ[0]) if len(differ) else near
            out[-1] = (*out[-1][:3], shared == len(before))
        out.append((r["shard"], shared, int(along[max(shared, 0)]), False))
        before = last
    return out


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each node of the trie; see the module's first lines."""
    spark = conversations.sparkSession
    rows = written(rebuilt(conversations), "rebuilt")
    turns = rows.agg(F.sum(F.size("turns").cast("long") + 1)).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-turns // shard_turns))
    in_order = rows.repartitionByRange(shards, "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    nodes = written(in_order.mapInArrow(_encode, ROWS), "nodes")
    edges = nodes.where(F.col("side") == EDGE).select("shard", "first", "last").collect()
    bounds = spark.createDataFrame(_bounds(edges), "shard int, shared int, shared_chars long, goes_on boolean")

    inherited = (F.col("side") == LEFT) & (F.col("level") <= F.col("shared"))
    pieces = nodes.where(F.col("side").isin(LEFT, RIGHT)).drop("first", "last").join(F.broadcast(bounds), "shard").withColumn("begins", ~inherited)
    so_far = Window.partitionBy("level").orderBy("shard", "side").rowsBetween(Window.unboundedPreceding, 0)
    pieces = written(
        pieces.withColumn("chain", F.sum(F.col("begins").cast("long")).over(so_far)).withColumns(
            {
                "node_chars": F.col("node_chars") - F.when(F.col("begins"), 0).otherwise(F.col("shared_chars") - F.col("above")),
                "kids": F.col("kids") - F.when(~F.col("begins") & (F.col("shared") > F.col("level")), 1).otherwise(0),
                "leaves": F.col("leaves") - F.when(~F.col("closed") & F.col("goes_on"), 1).otherwise(0),
            }
        ),
        "spines",
    )
    start = [F.max(F.when(F.col("begins"), F.col(c))).alias(c) for c in ("shard", "parent_level", "parent_side", "above")]
    chains = pieces.groupBy("level", "chain").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in COUNTS], *start)
    lists = pieces.where("ends IS NOT NULL").select("level", "chain", "shard", "ends").repartition("level", "chain").sortWithinPartitions("level", "chain", "shard")
    digests = lists.mapInArrow(_hashed, "level int, chain long, ends_sha256 string")
    chains = written(chains.join(digests, ["level", "chain"], "left"), "chains")
    names = pieces.select("shard", F.col("level").alias("parent_level"), F.col("side").alias("parent_side"), "level", "chain").join(
        chains.select("level", "chain", F.col("conv_id").alias("spine_parent")), ["level", "chain"]
    ).drop("level", "chain")
    kept = ["shard", "level", "conv_id", "parent_level", "parent_side", *COUNTS, "above"]
    inner = nodes.where(F.col("side") == INNER).select(*kept, "parent_conv_id", F.col("ends").alias("ends_sha256"))
    spine = chains.select(*kept, F.lit(None).cast("long").alias("parent_conv_id"), "ends_sha256")
    return inner.unionByName(spine).join(names, ["shard", "parent_level", "parent_side"], "left").select(
        "conv_id", F.col("level").cast("long").alias("depth"), F.coalesce("parent_conv_id", "spine_parent").alias("parent_conv_id"), "n_convs",
        F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("path_chars") - F.col("n_convs") * F.col("above") - F.col("node_chars")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def op11_parentheses_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op11_parentheses_trie": op11_parentheses_trie}
SQL: dict[str, str] = {}
