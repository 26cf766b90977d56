"""The corpus operators against plain Python on small tables, with nulls, empty and odd texts, ties, repeated rows, clashing columns."""

import base64
import binascii
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidemark.llm import exact, jaccard, katz, language, packing, pieces, quality, repeats, shards, warc
from tidemark.session import scratch_dir

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def noise(seed: int, size: int, letters: str = "abcdefgh ") -> str:
    pick = random.Random(seed)
    return "".join(pick.choice(letters) for _ in range(size))


def odd_rows() -> list[tuple]:
    a = noise(1, 3000)
    rows = [
        (0, a[:500]), (1, a[400:900] + "xyz" * 50), (2, None), (3, ""), (4, "a" * 350), (5, "ab" * 300 + a[100:260]), (6, a[1000:1150] * 2),
        (7, a[:99]), (8, a[:100]), (9, a[:101] + "q"), (10, "é" * 120), (11, a[700:1400]), (12, "aaaa" * 40), (13, " \t\n\x0b\x0c\r "),
        (14, "one two"), (15, "ONE  Two"), (16, "日本語 текст ß İ ﬁ \x00 ▁"), (17, a[:500]), (18, "w " * 3000),
    ]
    pick = random.Random(2)
    for k in range(30):
        s, e = pick.randrange(2500), pick.randrange(2500)
        rows.append((20 + k, a[s : s + pick.randrange(400)] + f"#{k}" + a[e : e + pick.randrange(300)]))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def pairs(df) -> list[tuple]:
    return [(r.doc_id, r.text) for r in df.collect()]


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_packing_places_every_id_once(spark, odd, small):
    path = public_tokenizers.path(packing.VOCABULARY)
    library = Tokenizer.from_file(path)
    for df in (odd, small, odd.union(odd)):
        texts = [t or "" for _, t in pairs(df)]
        want = sorted(len(e.ids) + 1 for e in library.encode_batch(texts, add_special_tokens=False))
        rows = packing.packed(df, path, with_ids=True).collect()
        assert sorted(r.doc_tokens for r in rows if r.start == 0) == want
        by_sequence: dict = {}
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for held in by_sequence.values():
            held.sort()
            assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
            assert sum(n for _, n in held) <= packing.LENGTH
    whole = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in pairs(odd)}
    got: dict = {}
    for r in packing.packed(odd, path, with_ids=True).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == whole


def test_packing_plan_is_near_the_bound():
    demand = np.random.default_rng(3).poisson(60, 64)
    rows = packing.plan(demand, 64)
    used = max(first + -(-(high - low) // each) for _, low, high, each, first in rows)
    assert used <= (demand * np.arange(1, 65)).sum() / 64 * 1.02 + 3
    assert sum(high - low for _, low, high, _, _ in rows) == demand.sum()


def test_packing_nothing(none):
    assert packing.packed(none, public_tokenizers.path(packing.VOCABULARY)).count() == 0


def test_components(odd, small, none):
    for df in (odd, small):
        assert sorted(map(tuple, jaccard.grouped(df).collect())) == brute.components(pairs(df))
    assert jaccard.grouped(none).count() == 0


def test_components_of_near_copies_and_rows_that_repeat(spark):
    words = noise(5, 4000).split()[:200]
    rows = [(0, " ".join(words)), (0, " ".join(words)), (None, " ".join(words))]
    for k in range(1, 60):
        own = list(words)
        for place in random.Random(k).sample(range(200), k % 6):
            own[place] = f"new{k}"
        rows.append((k, " ".join(own)))
    found = jaccard.grouped(spark.createDataFrame(rows, DOC)).collect()
    assert len(found) == len(rows) and {r.component_id for r in found if r.doc_id is not None and r.doc_id % 6 < 2} == {None}
    plain = [r for r in rows if r[0] is not None][1:]
    assert sorted(map(tuple, jaccard.grouped(spark.createDataFrame(plain, DOC)).collect())) == brute.components(plain)
    kept = jaccard.kept_documents(spark.createDataFrame(plain, DOC).withColumn("doc", F.lit(1)).withColumn("node", F.lit(2)))
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in brute.components(plain)}


def test_links_of_near_copies_and_rows_that_repeat(spark, odd, none, monkeypatch):
    """Every link between different texts is found and counted, those inside a cluster too."""
    words = noise(5, 4000).split()[:200]
    rows = [(0, " ".join(words)), (0, " ".join(words)), (None, " ".join(words)), (100, "  " + " ".join(words)), (101, None), (102, "")]
    for k in range(1, 60):
        own = list(words)
        for place in random.Random(k).sample(range(200), k % 6):
            own[place] = f"new{k}"
        rows.append((k, " ".join(own)))
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    for df in (spark.createDataFrame(rows, DOC), odd, odd.union(odd)):
        want, links = brute.linked_rows(pairs(df))
        assert sorted((r.doc_id is None, r.doc_id, r.n_links) for r in jaccard.with_links(df).collect()) == want
        found = [tuple(r) for r in jaccard.links(df).collect()]
        assert sorted(found, key=repr) == sorted(links, key=repr)
        assert sum(1 / r.copies for r in jaccard.members(df).collect()) == pytest.approx(len(brute.distinct_sets(pairs(df))))
    assert len(jaccard.links(spark.createDataFrame(rows, DOC)).collect()) > 60
    assert jaccard.with_links(none).count() == jaccard.links(none).count() == 0


def test_links_are_part_of_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = jaccard.op2_jaccard_join(spark, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_links) for r in rows) == brute.linked_rows(pairs(docs))[0]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute.components(pairs(docs))


def test_tree_bound_loses_no_link():
    draw = np.random.default_rng(4)
    base = np.unique(draw.integers(0, 1 << 64, 400, dtype=np.uint64))
    sets = []
    for k in range(200):
        fresh = draw.integers(0, 1 << 64, 2 * (k % 50), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([draw.choice(base, 400 - 2 * (k % 50), replace=False), fresh])))
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.RTree(jaccard.small(np.stack([jaccard.count_vector(s, 128) for s in sets])), sizes, leaf=8)
    for i, s in enumerate(sets):
        links = {j for j, t in enumerate(sets) if jaccard.linked(s, t)}
        assert links <= set(tree.near(tree.points[i], len(s)).tolist())


def test_pieces_agree_with_the_library(spark, odd, small):
    path = public_tokenizers.path(pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for df in (odd, small):
        want = {i: library.encode(t or "") for i, t in pairs(df)}
        rows = pieces.encoded(df, path).collect()
        assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == want
        assert all(r.parity and r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
        assert {r.doc_id for r in rows if not r.round_trip} == {i for i, t in pairs(df) if t and "▁" in t}
        back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(df, path), path).collect()}
        assert back == {i: (t or "").replace("▁", " ") for i, t in pairs(df)}


def test_shards_are_even_and_gapless(spark, odd, none):
    text = "copy " * 40
    hot = spark.createDataFrame([(k, text if k % 3 == 0 else noise(k, 200)) for k in range(900)] + [(5, "x"), (5, "x"), (None, None)], DOC)
    for df, parts in ((odd, 32 << 20), (hot, 4000)):
        rows = shards.sharded(df.withColumn("note", F.lit("n")), part_bytes=parts).collect()
        assert len(rows) == df.count() and {r.note for r in rows} == {"n"}
        sizes = [0] * 8
        for shard in range(8):
            own = [r for r in rows if r.shard == shard]
            assert sorted(r.slot for r in own) == list(range(len(own)))
            sizes[shard] = sum(len((r.text or "").encode()) + 1 for r in own)
        assert max(sizes) - min(sizes) <= 2 * max(len((r.text or "").encode()) + 1 for r in rows) + 1
    assert shards.sharded(none).count() == 0
    clash = odd.withColumns({c: F.lit(c) for c in ("shard", "slot", "row", "_hash", "_id", "_size", "_part", "_rank", "_before")})
    plain = {(r.doc_id, r.text): (r.shard, r.slot) for r in shards.sharded(odd).collect()}
    found = shards.sharded(clash)
    assert found.columns == ["doc_id", "text", "row", "_hash", "_id", "_size", "_part", "_rank", "_before", "shard", "slot"]
    assert {(r.doc_id, r.text): (r.shard, r.slot) for r in found.where("row = 'row' AND _part = '_part'").collect()} == plain


def test_shard_query_digests(spark):
    texts = dict(pairs(spark.read.parquet(f"{SF}/documents.parquet")))
    for r in shards.op4_histogram_sort(spark, SF).collect():
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, binascii.crc32(data), "bytes", None)


def test_katz_scores(spark, odd, small, none):
    for df in (odd, small):
        rows = katz.scored(df.withColumn("held_out", language.held_out(5, 1))).collect()
        want = brute.katz(pairs(df))
        assert len(rows) == len(want)
        for r in rows:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
            assert r.base_score == pytest.approx(want[r.doc_id][4]) and r.score == pytest.approx(want[r.doc_id][5])
    assert katz.scored(none.withColumn("held_out", F.lit(False))).count() == 0
    alone = katz.scored(small.withColumn("held_out", F.lit(True))).collect()
    assert {r.score for r in alone} == {0.0} and {r.train_tokens for r in alone} == {0}


def test_exact_groups_with_any_digest(spark, odd, none):
    long = noise(9, 20_000) + "\n"
    rows = odd_rows() + [(60, long * 3), (61, long * 3), (62, long * 2), (63, long * 3 + "x"), (None, "only"), (None, long * 3), (64, None), (0, odd_rows()[0][1])]
    df = spark.createDataFrame(rows, DOC)
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    weak = (lambda c: F.length(c).cast("long"), lambda c: F.sha2(c.cast("binary"), 256), lambda c: c)
    worse = (lambda c: F.length(c).cast("long"), lambda c: c)
    for digests in (exact.DIGESTS, weak, worse):
        assert sorted(map(tuple, exact.groups(df, digests).collect()), key=repr) == sorted(want, key=repr)
    kept = exact.kept_documents(df.withColumn("keep_id", F.lit(1)).withColumn("kept", F.lit("k")))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((w[0] for w in want if w[3]), key=repr)
    assert exact.groups(none).count() == 0


def test_quality_counts(spark, odd, none):
    repeated = spark.createDataFrame([(100, "a b c d a b c e a b c\n\nx y\nx y\n \nx y"), (101, "# * |\n" * 60)], DOC)
    df = odd.union(repeated)
    rows = quality.judged(df.withColumn("score", F.lit(0)), labels(spark)).collect()
    for r in rows:
        own = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert own == brute.counts(r.text), r.doc_id
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0])
        assert r.kept != r.base_failed  # without labels the likelihood ratio rejects nothing
    assert quality.judged(none, labels(spark)).count() == 0
    assert quality.kept_documents(df.withColumn("kept", F.lit(1)), labels(spark)).columns == ["doc_id", "text", "kept"]


def test_quality_counts_every_labelled_document(spark):
    word = F.concat(F.lit("w"), F.col("id") % 7)
    docs = spark.range(20_500).select(F.col("id").alias("doc_id"), F.concat(word, F.lit(" "), F.col("id").cast("string")).alias("text"))
    known = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    # The target is the whole corpus here, so no bucket tells them apart.
    assert [r[0] for r in quality.judged(docs, known).select("llr_score").distinct().collect()] == [0.0]


def test_quality_with_many_labels(spark, small, monkeypatch, no_broadcast):
    known = spark.read.parquet(f"{SF}/labels.parquet")
    few = sorted(tuple(r) for r in quality.judged(small, known).collect())
    monkeypatch.setattr(quality, "MOST_KEYS", 0)
    assert sorted(tuple(r) for r in quality.judged(small, known).collect()) == few


def test_quality_parts_good_from_bad(spark):
    rows = quality.op7_quality_rules(spark, "/root/testdata/sf0.01").collect()
    known = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.kept == bool(known[r.doc_id]) for r in rows if r.doc_id in known and not r.base_failed)


def test_language_on_held_out_rows(spark, none):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in language.op8_language_id(spark, folder).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.98 * len(rows)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 !?", "a"), (4, "é", "a"), (4, "é", "b")], "doc_id long, text string, score string")
    model = language.fit(spark.read.parquet(f"{folder}/documents.parquet"))
    found = language.identified(odd, model).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.score) for r in found[:3]] == [("und", 0.0)] * 3 and found[3].lang_pred == found[4].lang_pred != "und"
    assert language.identified(none, model).count() == 0
    assert language.fit(none.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in language.identified(odd, None).collect()} == {"und"}


def test_every_language_is_learned_whatever_their_number(spark):
    rows = [(k * 10 + c, f"{k:03d} word{k % 7}{chr(97 + k % 26)}" * 4, f"x{k:03d}") for k in range(450) for c in range(2)] + [(0, "000 word0a" * 4, "x000")] * 50
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=900)
    assert sum(len(m.classes) for m in model.languages.values()) == 450
    assert max(len(m.classes) for m in model.languages.values()) == language.UNLISTED
    few = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=10)
    assert sum(len(m.classes) for m in few.languages.values()) == 450


def test_archives_round_trip(spark):
    rows = [(3, "http://a", "same"), (1, "http://b\r\nX: y", "same"), (2, None, "é" * 4000), (5, "u", None), (4, "v", ""), (None, "w", "same"), (1, "again", "same")]
    rows += [(k, f"http://{k}", noise(k, 3000)) for k in range(10, 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write_bundles(pages, scratch_dir(spark, "archives"), frame_bytes=5000, bundle_bytes=20_000)
    found = warc.read_records(index).collect()
    firsts: dict = {}
    for i, _, h in rows:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    want = []
    for i, _, h in rows:
        data, first = (h or "").encode(), firsts[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "response", None, data) if i == first else (i, len(data), digest, "revisit", first, None))
    key = lambda r: repr(r[:5])
    assert sorted(((*r[:5], None if r[5] is None else bytes(r[5])) for r in map(tuple, found)), key=key) == sorted(want, key=key)
    one = index.where("page_id = 33").collect()[0]
    assert warc.parsed(warc.BundleReader(one.bundle).frame(one.frame), one.offset)[0]["payload"] == noise(33, 3000).encode()
    assert {r[3] for r in warc.read_records(warc.write_bundles(pages, scratch_dir(spark, "archives"), least=10**6)).collect()} == {"response"}
    assert warc.read_records(warc.write_bundles(pages.limit(0), scratch_dir(spark, "archives"))).count() == 0


def test_repeated_bytes(spark, odd, small, none):
    for df in (odd, small):
        found = repeats.cut(df).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, found)) == brute.cut(pairs(df))
    assert repeats.cut(none).count() == 0


def test_repeated_rows_and_clashing_columns(spark):
    text = noise(7, 400)
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text[:300] + noise(8, 120))], DOC)
    wide = df.withColumn("row", F.lit("r")).withColumn("part", F.lit(1)).withColumn("n_chars", F.length("text").cast("long"))
    rows = repeats.kept_documents(wide).collect()
    assert repeats.kept_documents(wide).columns == ["doc_id", "text", "row", "part", "n_chars"]
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in rows) == [(0, text, 400), (1, "", 0), (1, "", 0), (2, noise(8, 120), 120)]
