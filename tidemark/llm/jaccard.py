"""N-gram Jaccard join with an R-tree over count vectors.

A text is the set of its distinct 5-word shingles; two texts are linked if 100 * |both| >= 75 * |either|. The
tokens of a set, hashed into groups, give a vector of group counts. Two sets share at most the sum of the smaller counts of
each group, and a tree node at most the sum over the node's largest counts; the R-tree follows only nodes for which that bound and the sizes
allow a link, and the pairs that survive are verified on the whole sets.

The index is dealt out over the cluster by *tiles*. If tokens are in one order, linked sets of sizes a <= b share
at least l(a) tokens among their first n - ceil(3n/4) + l(n), for any rising l; here l(n) = max(1, n // 8). So only sets with that many tokens
found in another set's prefix can have a link, and linked sets meet in the tile of every prefix token they share. This holds in any order. Here tokens of
many sets come last, so that a passage that many texts have in common is in the prefix of those alone that hardly have anything else; the rest is
by hash. Which tokens these are is counted (``common_tokens``) and decides on the work, not on the links.

1. Each task measures its sets and counts their tokens. Copies of a set are linked at once, and one document stands for them from here on; it sends its prefix
   tokens.
2. Tokens that two documents share go back to their documents, which come out as candidates with their sets.
3. First round: candidates meet in the tiles of their ``FIRST`` smallest shared tokens; members that are connected are not compared again.
   Then the members of large tiles of different components look for their nearest one of another component, and the components that this ties
   together count as one, so a large cluster comes to the next step in few parts.
4. Second round, which makes the result whole: tokens that different components share go back to their documents, which send their
   count vectors to these tiles; each pair from different components that the R-tree lets through is verified. The first token that linked
   sets share has at most a seventh of both sizes before it (all of that is in one set only), so a pair is looked at only in
   tiles for which that holds.
5. Links: the rounds find the components, and a link never leaves one. The distinct sets of a component, cut into blocks, meet in one
   place for each pair of blocks, where the overlap of every two sets is counted; ``links`` gives the pairs, ``with_links`` their number.

Up to step 4 no group is turned into all its pairs; step 5 looks at all pairs of a component's distinct sets, as each may be a link. Null texts, empty texts and texts without words have size 0 and no link. Rows
with the same ``doc_id`` (null is an id too, lower than all others) are one node of the graph, with the links of each of its texts. Sets are compared by
64-bit hashes of their shingles, and told apart by a 64-bit hash of these. Further columns pass through ``kept_documents``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.components import components, merged
from tidemark.llm.frames import BLOB_ROWS, MOST_KEYS, SET_ROWS, STEP_BYTES, addressed, documents, portions, shuffle_partitions, utf8, without_rows, written
from tidemark.llm.repeats import NO_ID, dealt, part_column, part_of, unpacked
from tidemark.llm.text import binary_parts, shingle_sets, slices

WORDS = 5
FIRST = 3
LEAF = 64
FLUSH = 500_000
#: Members from which on a tile is looked at for nearest ones before the second round.
LARGE_TILE = 32
#: Sets of a block in components of up to so many blocks, and of larger ones.
BLOCK_SETS, FEW_BLOCKS, MOST_BLOCK_SETS = 128, 16, 1024
BLOCK_TOKENS = 1 << 20
MATCHES = 1 << 21
#: Tokens that a task counts at a time and of how many it keeps the counts; a token is common from so many sets on, and at most so many are.
COUNTED, COUNTS = 1 << 21, 1 << 17
LEAST_COMMON, MOST_COMMON = 64, 1 << 17
#: Bits on top of a token that say how common it is.
CLASS_BITS = 2
TOKEN, META, COUNT, SHARED = 0, 1, 2, 3
TOKENS = [("token", "<u8"), ("doc", "<i8")]
METAS = [("doc", "<i8"), ("size", "<i8"), ("set", "<i8")]
TALLY = [("token", "<i8"), ("n", "<i8")]
ROOTED = [("token", "<u8"), ("doc", "<i8"), ("root", "<i8"), ("excess", "<i4")]
BLOBS = "dest int, kind int, blob binary"
Common = tuple[np.ndarray, np.ndarray]
CANDIDATE = "doc long, size long, set long, shared binary, ranks binary, counts binary, tokens binary"


def least_shared(size: int) -> int:
    return max(1, size // 8)


def prefix_length(size: int) -> int:
    return size - -(-3 * size // 4) + least_shared(size)


def groups_of(size: int) -> int:
    """Groups that tokens are hashed into: about as many as tokens, or else all sets of a size have the same counts."""
    return 128 if size < 128 else 512 if size < 1024 else 4096


def count_vector(tokens: np.ndarray, groups: int) -> np.ndarray:
    """Counts by the top bits of the hash, so that adding neighbours up gives the counts for fewer groups."""
    return np.bincount((tokens << np.uint64(CLASS_BITS) >> np.uint64(52)).astype(np.int64) * groups >> 12, minlength=groups)


def small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32)


def coarser(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts if len(counts) == groups else counts.reshape(groups, -1).sum(1)


class RTree:
    """Count vectors packed into nodes, each with the largest counts and the range of sizes below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes, self.leaf = points, sizes, leaf
        if len(points) <= leaf:  # one leaf: nothing to descend
            self.order, self.levels, self.bounds = np.arange(len(points)), [], []
            return
        order, stack, runs = np.arange(len(points)), [(0, len(points))], []
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                runs.append((a, b))
                continue
            own = order[a:b]
            spread = points[own].max(0).astype(np.int64) - points[own].min(0)
            by = sizes[own] if sizes[own].max() * 3 > sizes[own].min() * 4 else points[own, int(np.argmax(spread))]
            order[a:b] = own[np.argsort(by, kind="stable")]
            middle = (a + b) // 2
            stack += [(middle, b), (a, middle)]
        self.order = order
        level = [(points[order[a:b]].max(0), sizes[order[a:b]].min(), sizes[order[a:b]].max(), np.arange(a, b)) for a, b in runs]
        self.levels = [level]
        while len(level) > 8:  # inner nodes over eight neighbours each
            up = []
            for k in range(0, len(level), 8):
                nodes = level[k : k + 8]
                up.append((np.max([n[0] for n in nodes], 0), min(n[1] for n in nodes), max(n[2] for n in nodes), np.arange(k, k + len(nodes))))
            level = up
            self.levels.append(level)
        self.bounds = [(np.stack([n[0] for n in lv]), np.array([n[1] for n in lv]), np.array([n[2] for n in lv])) for lv in self.levels]

    def near(self, point: np.ndarray, size: int, able: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the points (of the able ones) that the bound cannot tell from a link to this one."""
        nodes = np.arange(len(self.levels[-1]) if self.levels else len(self.order))
        for level in range(len(self.levels) - 1, -1, -1):
            high, least, most = (x[nodes] for x in self.bounds[level])
            kept = (4 * most >= 3 * size) & (3 * least <= 4 * size)
            kept &= 7 * np.minimum(high, point).sum(1, dtype=np.int64) >= 3 * (size + np.maximum(least, -(-3 * size // 4)))
            nodes = nodes[kept]
            if not len(nodes):
                return nodes
            nodes = np.concatenate([self.levels[level][n][3] for n in nodes])
        found = self.order[nodes]
        sizes = self.sizes[found]
        fits = (4 * sizes >= 3 * size) & (3 * sizes <= 4 * size)
        found = found[fits if able is None else fits & able[found]]
        return found[7 * np.minimum(self.points[found], point).sum(1, dtype=np.int64) >= 3 * (size + self.sizes[found])]


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of tokens reach the threshold."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _blobs(rows: list) -> pa.Table:
    dest, kind, blob = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"dest": pa.array(dest, pa.int32()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _of_kind(table: pa.Table, number: int, kind: list) -> dict:
    return unpacked([b.as_buffer() for k, b in zip(table["kind"].to_pylist(), table["blob"], strict=True) if k == number], kind)


def tallied(token: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token with the sum of its counts; of more than ``most`` those with the largest."""
    if not len(token):
        return token, n
    order = np.argsort(token)
    token, n = token[order], n[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
    token, n = token[first], np.add.reduceat(n, first)
    if len(token) > most:
        kept = np.argpartition(n, len(n) - most)[-most:]
        token, n = token[kept], n[kept]
    return token, n


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and name of every set, and the tokens that several of the task's distinct sets have, with their number."""
    metas, held, count, seen = [], [], 0, set()
    token, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def tally() -> None:
        nonlocal token, n, count
        every = np.concatenate([token, *held])
        token, n = tallied(every, np.append(n, np.ones(len(every) - len(n), np.int64)), COUNTS)
        held.clear()
        count = 0

    def blob(kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
        packed = b"".join(np.ascontiguousarray(c).astype("<i8").tobytes() for c in columns)
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([packed], pa.binary())], ["kind", "blob"])

    for batch in batches:
        data, offsets = binary_parts(batch.column("bytes"))
        docs = batch.column("doc").to_pylist()
        for a, b in slices(offsets, STEP_BYTES):
            for doc, own in zip(docs[a:b], shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS), strict=True):
                name = set_id(own)
                metas.append((doc, len(own), name))
                if name not in seen:
                    seen.add(name)
                    held.append(own)
                    count += len(own)
            if count >= COUNTED:
                tally()
        if len(metas) >= FLUSH:
            yield blob(META, list(np.array(metas, np.int64).T))
            metas.clear()
    if metas:
        yield blob(META, list(np.array(metas, np.int64).T))
    tally()
    yield blob(COUNT, [token[n > 1].view(np.int64), n[n > 1]])


def common_tokens(measured: DataFrame) -> Common:
    """The tokens that many sets have, sorted, and how common each is."""
    counts = _unpacked_rows(COUNT, TALLY, measured, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= LEAST_COMMON).orderBy(F.desc("n"), "token").limit(MOST_COMMON).toArrow()
    token = found["token"].to_numpy().view(np.uint64)
    level = np.searchsorted([LEAST_COMMON, 8 * LEAST_COMMON, 64 * LEAST_COMMON], found["n"].to_numpy(), "right").astype(np.uint64)
    order = np.argsort(token)
    return token[order], level[order]


def ranked(own: np.ndarray, common: Common) -> np.ndarray:
    """A set's tokens in the order of all: the most common last, else by hash. The top bits of each give way to how common it is."""
    level = np.zeros(len(own), np.uint64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
        level = np.where(common[0][at] == own, common[1][at], level)
    low = np.uint64((1 << 64 - CLASS_BITS) - 1)
    return np.sort(own & low | level << np.uint64(64 - CLASS_BITS))


def _sent(buckets: int, common: Common):
    """Prefix tokens of sets to the token's bucket."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, owners, held = [], [], 0

        def flush() -> list[pa.RecordBatch]:
            nonlocal held
            if not tokens:
                return []
            all_ = {"token": np.concatenate(tokens), "doc": np.repeat(np.array(owners, np.int64), [len(t) for t in tokens])}
            tokens.clear()
            owners.clear()
            held = 0
            return _blobs(dealt(all_, (all_["token"] & np.uint64(0x7FFFFFFF)).astype(np.int64) % buckets, TOKEN, TOKENS)).to_batches(BLOB_ROWS)

        for batch in batches:
            data, offsets = binary_parts(batch.column("bytes"))
            docs = batch.column("doc").to_pylist()
            for a, b in slices(offsets, STEP_BYTES):
                for doc, own in zip(docs[a:b], shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS), strict=True):
                    if len(own):
                        tokens.append(ranked(own, common)[: prefix_length(len(own))].copy())
                        owners.append(doc)
                        held += len(tokens[-1])
                if held >= FLUSH:
                    yield from flush()
        yield from flush()

    return step


def _shared(parts: int):
    """In a bucket: the tokens that two documents or more have, back to the documents' parts."""

    def step(table: pa.Table) -> pa.Table:
        rows = _of_kind(table, TOKEN, TOKENS)
        order = np.lexsort((rows["doc"], rows["token"]))
        token, doc = rows["token"][order], rows["doc"][order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        token, doc = token[new], doc[new]
        twice = np.zeros(len(token), bool)
        twice[1:] = token[1:] == token[:-1]
        twice[:-1] |= twice[1:].copy()
        found = {"token": token[twice], "doc": doc[twice]}
        return _blobs(dealt(found, part_of(found["doc"], parts), SHARED, TOKENS))

    return step


def _candidates(common_ones: Common):
    """Documents with enough shared tokens, with the tokens of their set."""

    def step(docs: pa.Table, shared: pa.Table) -> pa.Table:
        rows = _of_kind(shared, SHARED, TOKENS)
        order = np.lexsort((rows["token"], rows["doc"]))
        owner, token = rows["doc"][order], rows["token"][order]
        ids, first = np.unique(owner, return_index=True)
        ends = np.append(first, len(owner))[1:]
        at = {int(d): (int(a), int(b)) for d, a, b in zip(ids, first, ends, strict=True)}
        out: list[tuple] = []
        if at and docs.num_rows:
            wanted = docs.filter(pa.array(np.isin(docs["doc"].to_numpy(), ids))).combine_chunks()
            if wanted.num_rows:
                data, offsets = binary_parts(wanted["bytes"].chunk(0))
                names = wanted["doc"].to_pylist()
                for a, b in slices(offsets, STEP_BYTES):
                    for doc, plain in zip(names[a:b], shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS), strict=True):
                        begin, end = at[doc]
                        own = ranked(plain, common_ones)
                        common = np.intersect1d(own[: prefix_length(len(own))], token[begin:end], assume_unique=False)
                        if len(own) and len(common) >= least_shared(-(-3 * len(own) // 4)):
                            ranks = np.searchsorted(own, common).astype("<u4")
                            counts = small(count_vector(own, groups_of(len(own))))
                            out.append((doc, len(own), set_id(plain), common.tobytes(), ranks.tobytes(), counts.tobytes(), own.tobytes()))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        names = [f.split()[0] for f in CANDIDATE.split(", ")]
        found = pa.table({n: pa.array(c, pa.int64() if n in ("doc", "size", "set") else pa.binary()) for n, c in zip(names, columns, strict=True)})
        return pa.Table.from_batches(found.to_batches(SET_ROWS), found.schema)

    return step


def _first_tiles(buckets: int):
    """A candidate's set to the tiles of its first shared tokens;."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            out = []
            for r in batch.to_pylist():
                for t in np.frombuffer(r["shared"], "<u8")[:FIRST].tolist():
                    out.append(((t & 0x7FFFFFFF) % buckets, t & 0x7FFFFFFFFFFFFFFF, r["doc"], r["tokens"]))
            dest, tile, doc, tokens = zip(*out, strict=True) if out else [()] * 4
            arrays = [pa.array(dest, pa.int32()), pa.array(tile, pa.int64()), pa.array(doc, pa.int64()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["dest", "tile", "doc", "tokens"])

    return step


def tile_links(docs: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the members of one tile as all of its links would."""
    sizes = np.array([len(s) for s in sets])
    groups = groups_of(int(sizes.max()))
    tree = RTree(small(np.stack([count_vector(s, groups) for s in sets])), sizes)
    group, out = np.arange(len(sets)), []
    for i in range(len(sets)):
        if (group == group[i]).all():
            break
        for j in tree.near(tree.points[i], int(sizes[i])).tolist():
            if group[j] != group[i] and linked(sets[i], sets[j]):
                out.append((int(docs[i]), int(docs[j])))
                group[group == group[j]] = group[i]
    return out


def _first_round(table: pa.Table) -> pa.Table:
    tile, doc = table["tile"].to_numpy(), table["doc"].to_numpy()
    tokens = table["tokens"].to_pylist()
    order, out = np.lexsort((doc, tile)), []
    cuts = np.flatnonzero(np.diff(tile[order])) + 1
    for members in np.split(order, cuts):
        if len(members) > 1:
            out += tile_links(doc[members], [np.frombuffer(tokens[m], "<u8") for m in members])
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _rooted(buckets: int):
    """A candidate's shared tokens, with its component, to the tokens' buckets."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            shared = [np.frombuffer(x, "<u8") for x in batch.column("shared").to_pylist()]
            sizes = [len(x) for x in shared]
            if not sum(sizes):
                continue
            ranks = np.concatenate([np.frombuffer(x, "<u4") for x in batch.column("ranks").to_pylist()]).astype(np.int64)
            rows = {
                "token": np.concatenate(shared), "excess": 7 * ranks - np.repeat(batch.column("size").to_numpy(), sizes),
                "doc": np.repeat(batch.column("doc").to_numpy(), sizes), "root": np.repeat(batch.column("root").to_numpy(), sizes),
            }
            yield from _blobs(dealt(rows, (rows["token"] & np.uint64(0x7FFFFFFF)).astype(np.int64) % buckets, TOKEN, ROOTED)).to_batches(BLOB_ROWS)

    return step


def _crossing(least: int):
    """For each document the tokens of this bucket, of ``least`` documents or more, at which it may first meet another component."""

    def step(table: pa.Table) -> pa.Table:
        rows = _of_kind(table, TOKEN, ROOTED)
        order = np.lexsort((rows["doc"], rows["excess"], rows["token"]))
        token, root, excess = (rows[n][order] for n in ("token", "root", "excess"))
        excess = excess.astype(np.int64)
        if not len(token):
            return pa.table({"doc": pa.array([], pa.int64()), "dest": pa.array([], pa.int32()), "crossing": pa.array([], pa.binary())})
        begin = np.ones(len(token), bool)
        begin[1:] = token[1:] != token[:-1]
        first, group = np.flatnonzero(begin), np.cumsum(begin) - 1
        # Two sets' ranks may sum up to a seventh of their sizes: the least excess, and the least of another component than that one's.
        other = np.where(root != root[first][group], excess, np.iinfo(np.int32).max)
        partner = np.where(root != root[first][group], excess[first][group], np.minimum.reduceat(other, first)[group])
        kept = order[excess + partner <= 0]
        # Tokens with the same documents as a smaller one add no pair.
        kept = kept[np.lexsort((rows["doc"][kept], rows["token"][kept]))]
        tiles, seen = [], set()
        for members in np.split(kept, np.flatnonzero(np.diff(rows["token"][kept])) + 1):
            if len(members) >= least and (key := rows["doc"][members].tobytes()) not in seen:
                seen.add(key)
                tiles.append(members)
        kept = np.concatenate([*tiles, order[:0]])
        by_doc = kept[np.lexsort((rows["token"][kept], rows["doc"][kept]))]
        doc, token = rows["doc"][by_doc], rows["token"][by_doc]
        ids, first = np.unique(doc, return_index=True)
        blobs = [x.tobytes() for x in np.split(token, first[1:])] if len(ids) else []
        dest = table["dest"][0].as_py()
        return pa.table({"doc": pa.array(ids, pa.int64()), "dest": pa.array([dest] * len(ids), pa.int32()), "crossing": pa.array(blobs, pa.binary())})

    return step


def _with_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranks of the crossing tokens in the place of all shared ones."""
    for batch in portions(batches):
        ranks = []
        for shared, every, own in zip(*(batch.column(n).to_pylist() for n in ("shared", "ranks", "crossing")), strict=True):
            at = np.searchsorted(np.frombuffer(shared, "<u8"), np.frombuffer(own, "<u8"))
            ranks.append(np.frombuffer(every, "<u4")[at].tobytes())
        columns = [batch.column(n) for n in ("dest", "doc", "root", "size", "counts", "crossing")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(ranks, pa.binary())], ["dest", "doc", "root", "size", "counts", "tokens", "ranks"])


def _second_round(nearest: bool):
    """Pairs of one tile and different components that the R-tree lets through, with their components; or of these each set's nearest one."""

    def step(table: pa.Table) -> pa.Table:
        doc, root, size = (table[n].to_numpy() for n in ("doc", "root", "size"))
        groups_here = np.array([groups_of(int(n)) for n in size], np.int64)
        counts = [np.frombuffer(c, np.uint8 if len(c) == g else np.uint32) for c, g in zip(table["counts"].to_pylist(), groups_here, strict=True)]
        tokens = [np.frombuffer(t, "<u8") for t in table["tokens"].to_pylist()]
        token = np.concatenate([*tokens, np.zeros(0, np.uint64)])
        rank = np.concatenate([*(np.frombuffer(r, "<u4") for r in table["ranks"].to_pylist()), np.zeros(0, np.uint32)]).astype(np.int64)
        row = np.repeat(np.arange(len(doc)), [len(t) for t in tokens])
        order = np.lexsort((doc[row], token))
        found: set[tuple[int, int]] = set()
        root_of = dict(zip(doc.tolist(), root.tolist(), strict=True))
        looked_at: set[bytes] = set()
        for members in np.split(order, np.flatnonzero(np.diff(token[order])) + 1):
            rows = row[members]
            # The same documents met at a smaller token, with less before it: all their pairs have been looked at.
            if len(rows) < 2 or rows.tobytes() in looked_at:
                continue
            looked_at.add(rows.tobytes())
            found.update(tile_pairs(doc[rows], root[rows], size[rows], rank[members], [counts[r] for r in rows], nearest))
        a, b = zip(*sorted(found), strict=True) if found else ((), ())
        ends = {"a": a, "b": b, "root_a": [root_of[d] for d in a], "root_b": [root_of[d] for d in b]}
        return pa.table({n: pa.array(x, pa.int64()) for n, x in ends.items()})

    return step


def pair_allowed(size: list[int], before: list[int], counts: list[np.ndarray]) -> bool:
    """Whether sizes, ranks and count vectors of two sets allow a link."""
    (a, b), level = sorted(size), min(len(c) for c in counts)
    if 4 * a < 3 * b or 7 * sum(before) > a + b or groups_of(-(-3 * b // 4)) > level:
        return False
    return 7 * int(np.minimum(*(coarser(c, level) for c in counts)).sum(dtype=np.int64)) >= 3 * (a + b)


def tile_pairs(
    doc: np.ndarray, root: np.ndarray, size: np.ndarray, before: np.ndarray, counts: list[np.ndarray], nearest: bool = False
) -> Iterator[tuple[int, int]]:
    """Pairs of different components that sizes, ranks and count vectors allow, each at the groups of its smaller set; or each set's nearest of these."""
    if len(doc) == 2:
        if root[0] != root[1] and pair_allowed(size.tolist(), before.tolist(), counts):
            yield int(doc.min()), int(doc.max())
        return
    groups = np.array([len(c) for c in counts])
    lowest = np.array([groups_of(-(-3 * int(n) // 4)) for n in size])
    for level in np.unique(groups).tolist():
        own = np.flatnonzero((lowest <= level) & (groups >= level))
        if len(own) < 2 or (root[own] == root[own[0]]).all():
            continue
        tree = RTree(small(np.stack([coarser(counts[k], level) for k in own])), size[own])
        # Of the largest component's members only the others ask.
        names, at, times = np.unique(root[own], return_inverse=True, return_counts=True)
        asked = at == np.argmax(times)
        for k in np.flatnonzero(~asked).tolist():
            i = own[k]
            able = (at != at[k]) & ((groups[own] == level) | (groups[i] == level)) & (7 * (before[own] + before[i]) <= size[own] + size[i])
            if not nearest:
                able &= asked | (doc[own] > doc[i])
            if able.any():
                near = tree.near(tree.points[k], int(size[i]), able)
                if nearest and len(near):
                    near = near[[np.argmax(7 * np.minimum(tree.points[near], tree.points[k]).sum(1, dtype=np.int64) - 3 * size[own[near]])]]
                for j in near.tolist():
                    yield int(min(doc[i], doc[own[j]])), int(max(doc[i], doc[own[j]]))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        left, right = (batch.column(n).to_pylist() for n in ("left", "right"))
        kept = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) for x, y in zip(left, right, strict=True)]
        yield batch.select(["root_a", "root_b"]).filter(pa.array(kept, pa.bool_())).rename_columns(["a", "b"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of tokens that each set of the one side has in common with each of the other."""
    owner = np.repeat(np.arange(len(right)), [len(t) for t in right])
    tokens = np.concatenate(right)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    sizes = [len(t) for t in left]
    wanted, row = np.concatenate(left), np.repeat(np.arange(len(left)), sizes)
    first = np.searchsorted(tokens, wanted, "left")
    times = np.searchsorted(tokens, wanted, "right") - first
    out, done = np.zeros(len(left) * len(right), np.int64), np.cumsum(times)
    for a, b in slices(np.append(0, done), MATCHES):
        n = times[a:b]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a:b], n)
        begin, end = int(row[a]), int(row[b - 1]) + 1
        out[begin * len(right) : end * len(right)] += np.bincount(
            np.repeat(row[a:b] - begin, n) * len(right) + owner[place], minlength=(end - begin) * len(right)
        )
    return out.reshape(len(left), len(right))


def block_links(block: np.ndarray, name: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, tokens in both) of the links between two blocks, or inside the only one; each set counts once."""
    _, at = np.unique(name, return_index=True)
    left, right = at[block[at] == block.min()], at[block[at] == block.max()]
    both = overlaps([sets[k] for k in left], [sets[k] for k in right])
    sizes = np.array([len(t) for t in sets])
    found = 7 * both >= 3 * (sizes[left][:, None] + sizes[right][None, :])
    if block.min() == block.max():
        found = np.triu(found, 1)
    i, j = np.nonzero(found)
    return left[i], right[j], both[i, j]


def _met_blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, a, b, tokens in both) of each pair of blocks that met here; a and b are places among the rows."""
    root, low, high, block, name = (table[n].to_numpy() for n in ("root", "low", "high", "block", "set"))
    tokens = table["tokens"].combine_chunks()
    order = np.lexsort((high, low, root))
    new = (np.diff(root[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
    for members in np.split(order, np.flatnonzero(new) + 1):
        # One block of two may have no set.
        if len(members) < 2 or (low[members[0]] != high[members[0]] and (block[members] == block[members[0]]).all()):
            continue
        sets = [np.frombuffer(tokens[int(m)].as_buffer(), "<u8") for m in members]
        yield members, *block_links(block[members], name[members], sets)


def _block_counts(table: pa.Table) -> pa.Table:
    """For each set the rows of the sets that it is linked to in these blocks."""
    name, copies = table["set"].to_numpy(), table["copies"].to_numpy()
    total = np.zeros(len(name), np.int64)
    for members, a, b, _ in _met_blocks(table):
        np.add.at(total, members[a], copies[members[b]])
        np.add.at(total, members[b], copies[members[a]])
    some = np.flatnonzero(total)
    return pa.table({"set": pa.array(name[some], pa.int64()), "n": pa.array(total[some], pa.int64())})


def _block_pairs(table: pa.Table) -> pa.Table:
    name, size = table["set"].to_numpy(), table["size"].to_numpy()
    out = [np.zeros((4, 0), np.int64)]
    for members, a, b, both in _met_blocks(table):
        one, other = members[a], members[b]
        out.append(np.stack([name[one], name[other], both, size[one] + size[other] - both]))
    return pa.table(dict(zip(("one", "other", "n_both", "n_either"), map(pa.array, np.concatenate(out, 1)), strict=True)))


def _unpacked_rows(kind_number: int, kind: list, blobs: DataFrame, schema: str) -> DataFrame:
    names = [n for n, _ in kind]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unpacked(batch.column("blob").to_pylist(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(rows[n]) for n in names], names)

    return blobs.where(f"kind = {kind_number}").select("blob").mapInArrow(step, schema)


def first_documents(sizes: DataFrame) -> DataFrame:
    """(first, doc) of every row with a token: the smallest id that has the same set, and its own."""
    some = sizes.where("size > 0").select("set", "doc")
    return some.join(some.groupBy("set").agg(F.min("doc").alias("first")), "set").select("first", "doc")


def without_copies(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """The texts but those of documents whose every set belongs to a smaller id; these go to the texts as long as they are few."""
    gone = written(firsts.groupBy("doc").agg(F.min(F.col("first") < F.col("doc")).alias("gone")).where("gone").select("doc"), "gone")
    return keyed.join(F.broadcast(gone) if gone.count() <= MOST_KEYS else gone, "doc", "left_anti")


def joined_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc, size, set) of every row, (node, root) of every linked document, and the candidates; a null id is NO_ID."""
    partitions = shuffle_partitions(docs.sparkSession)
    parts = 4 * partitions
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), utf8().alias("bytes"))
    measured = written(keyed.mapInArrow(_measured, "kind int, blob binary"), "sets")
    sizes, common = _unpacked_rows(META, METAS, measured, "doc long, size long, set long"), common_tokens(measured)
    firsts = written(first_documents(sizes), "firsts")
    singles = without_copies(keyed, firsts)
    sent = singles.mapInArrow(_sent(partitions, common), BLOBS)
    met = written(sent.groupBy("dest").applyInArrow(_shared(parts), BLOBS), "tokens")
    by_part = singles.withColumn("part", part_column("doc", parts)).repartition(partitions, "part").groupBy("part")
    shared = met.where(f"kind = {SHARED}").withColumnRenamed("dest", "part").groupBy("part")
    found = written(by_part.cogroup(shared).applyInArrow(_candidates(common), CANDIDATE), "candidates")
    tiles = found.select("doc", "shared", "tokens").mapInArrow(_first_tiles(parts), "dest int, tile long, doc long, tokens binary")
    copies = firsts.where("first <> doc").toDF("a", "b")
    first = copies.unionByName(tiles.groupBy("dest").applyInArrow(_first_round, "a long, b long"))
    roots = components(first)
    roots = written(merged(roots, tied_roots(found, roots, LARGE_TILE, nearest=True)), "roots")
    return sizes, merged(roots, tied_roots(found, roots)), found


def tied_roots(found: DataFrame, roots: DataFrame, least: int = 2, nearest: bool = False) -> DataFrame:
    """Links (a, b) between the roots of candidates in tiles of ``least`` members or more: all that there are, or of each member's nearest one."""
    partitions = shuffle_partitions(found.sparkSession)
    placed = found.drop("tokens").join(roots, F.col("doc") == F.col("node"), "left").withColumn("root", F.coalesce("root", "doc"))
    rooted = placed.select("doc", "root", "size", "shared", "ranks").mapInArrow(_rooted(partitions), BLOBS)
    crossing = rooted.groupBy("dest").applyInArrow(_crossing(least), "doc long, dest int, crossing binary")
    second = placed.join(crossing, "doc").mapInArrow(
        _with_ranks, "dest int, doc long, root long, size long, counts binary, tokens binary, ranks binary"
    )
    pairs = second.groupBy("dest").applyInArrow(_second_round(nearest), "a long, b long, root_a long, root_b long").distinct()
    sets = found.select("doc", "tokens")
    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("tokens").alias("left")), "a").join(
        sets.select(F.col("doc").alias("b"), F.col("tokens").alias("right")), "b"
    )
    # What these links connect are components already, so only their roots need to be looked at.
    return both.select("root_a", "root_b", "left", "right").mapInArrow(_verified, "a long, b long")


def met_blocks(sizes: DataFrame, roots: DataFrame, found: DataFrame) -> DataFrame:
    """The distinct sets of each component of two or more, once for every pair of blocks that theirs belongs to."""
    dests = 4 * shuffle_partitions(sizes.sparkSession)
    # The copies of a set are in one component; its smallest candidate stands for them.
    one = found.groupBy("set").agg(F.min("doc").alias("doc"), F.first("size").alias("size"))
    copies = sizes.groupBy("set").agg(F.count("*").alias("copies"))
    placed = one.join(roots, F.col("doc") == F.col("node"), "left").select("set", "doc", "size", F.coalesce("root", "doc").alias("root"))
    blocks = placed.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1").select(
        "root",
        F.ceil(F.greatest(F.least(F.col("n") / BLOCK_SETS, F.lit(FEW_BLOCKS)), F.col("n") / MOST_BLOCK_SETS, F.col("total") / BLOCK_TOKENS))
        .cast("int")
        .alias("blocks"),
    )
    dealt_sets = placed.join(blocks, "root").join(copies, "set")
    own = dealt_sets.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    whole = found.select("doc", "set", "tokens").join(own, ["doc", "set"])
    met = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return met.select(
        F.pmod(F.xxhash64("root", low, high), F.lit(dests)).cast("int").alias("dest"),
        "root", low.alias("low"), high.alias("high"), "block", "set", "size", "copies", "tokens",
    )


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    sizes, roots, _ = joined_sets(docs)
    return _named(sizes, roots)


def _named(sizes: DataFrame, roots: DataFrame, *more: str) -> DataFrame:
    doc, root = F.col("doc"), F.coalesce("root", "doc")
    return sizes.join(roots, doc == F.col("node"), "left").select(
        F.when(doc != NO_ID, doc).alias("doc_id"), F.col("size").alias("n_shingles"), F.when(root != NO_ID, root).alias("component_id"), *more
    )


def with_links(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row; n_links is the number of other rows it is linked to, copies among them."""
    sizes, roots, found = joined_sets(docs)
    near = met_blocks(sizes, roots, found).groupBy("dest").applyInArrow(_block_counts, "set long, n long").groupBy("set").agg(F.sum("n").alias("near"))
    copies = sizes.where("size > 0").groupBy("set").agg(F.count("*").alias("copies"))
    per_set = copies.join(near, "set", "left").select("set", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    counted = sizes.join(per_set, "set", "left").select("doc", "size", F.coalesce("links", F.lit(0)).alias("n_links"))
    return _named(counted, roots, "n_links")


def links(docs: DataFrame) -> DataFrame:
    """(a, b, n_both, n_either) of all linked pairs of distinct sets, each named by the smallest id that has it; ``members`` gives the copies."""
    sizes, roots, found = joined_sets(docs)
    pairs = met_blocks(sizes, roots, found).groupBy("dest").applyInArrow(_block_pairs, "one long, other long, n_both long, n_either long")
    names = sizes.groupBy("set").agg(F.min("doc").alias("name"))
    named = pairs.join(names.toDF("one", "a"), "one").join(names.toDF("other", "b"), "other")
    first, last = (F.when(c != NO_ID, c) for c in (F.least("a", "b"), F.greatest("a", "b")))
    return named.select(first.alias("a"), last.alias("b"), "n_both", "n_either")


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id, n_shingles, name, copies) of every row: its distinct set, the smallest id that has it and how many rows do."""
    sizes, _, _ = joined_sets(docs)
    per_set = sizes.groupBy("set").agg(F.min("doc").alias("name"), F.count("*").alias("copies"))
    doc, name = F.col("doc"), F.col("name")
    return sizes.join(per_set, "set").select(
        F.when(doc != NO_ID, doc).alias("doc_id"), F.col("set").alias("set_id"), F.col("size").alias("n_shingles"),
        F.when(name != NO_ID, name).alias("name"), "copies",
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest id (rows without id last), with all its columns; rows are told apart by their address, so ids may repeat."""
    rows, key = addressed(docs)
    _, roots, _ = joined_sets(rows.select(F.col(key).alias("doc_id"), "text"))
    tied = written(roots.select(F.col("node").alias(key), "root").unionByName(roots.select(F.col("root").alias(key), "root").distinct()), "tied")
    named = tied.join(rows.select(key, F.col("doc_id").alias("_id")), key)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull(), "_id", key)).alias("_row")).select(f"_row.{key}")
    return without_rows(rows, key, tied.select(key).join(first, key, "left_anti"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_links(documents(spark, sf_dir))


QUERIES = {"op2_jaccard_join": op2_jaccard_join}
SQL: dict[str, str] = {}
