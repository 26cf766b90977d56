"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read as protobuf: pieces with scores and kinds, the trainer's model type and byte fallback, the
normaliser's character map and white-space rules. From these the normaliser, the white-space marker, the model (unigram scores, or the merges
that byte-pair scores imply) and the decoder are rebuilt in the tokenizers library, which encodes batches, with as many threads as its
TOKENIZERS_PARALLELISM setting allows.

If the normaliser changes no characters and no piece has a marker behind another sign or holds a line end, a text is cut before each run of markers and
around line ends: no piece can span such a cut, so each distinct part is encoded once per worker. Every such part is also encoded by
the sentencepiece library, and ``parity`` says that all parts of a text agreed; otherwise whole texts are compared. ``round_trip`` says that
decoding the ids gives the text back. Null texts count as empty and have no ids. Rows that repeat a ``doc_id`` are encoded each. Texts that hold the marker sign itself decode to a
space there, as sentencepiece does, so their ``round_trip`` is false.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

from tidemark.llm.cached import PartCache
from tidemark.llm.frames import STEP_BYTES, documents, utf8
from tidemark.llm.text import binary_parts, slices

MARK = "▁"
MODEL = "piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SCHEMA = "doc_id long, n_bytes long, n_ids long, ids_crc32 long, round_trip boolean, parity boolean, ids binary"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Spec:
    """What a SentencePiece model file says; the numbers are its field numbers."""

    pieces: list[tuple[str, float, int]]
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    one_space: bool = True
    escape: bool = True

    @staticmethod
    def read(data: bytes) -> Spec:
        spec = Spec([])
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                spec.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
                spec.model_type, spec.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
            elif number == 3:
                norm = dict(fields(value))
                spec.charsmap = norm.get(2, b"")
                spec.dummy_prefix, spec.one_space, spec.escape = (bool(norm.get(n, 1)) for n in (3, 4, 5))
        return spec

    @property
    def separable(self) -> bool:
        """No piece spans the start of a run of markers or a line end, and no character is rewritten."""
        texts = [p for p, _, kind in self.pieces if kind in (NORMAL, USER)]
        plain = not self.charsmap and not self.one_space and self.dummy_prefix and self.escape
        return plain and not any("\n" in p or MARK in p.lstrip(MARK) for p in texts)


def merges(spec: Spec) -> list[tuple[str, str]]:
    """The pairs whose joining gives a piece, best score first."""
    rank = {p: n for n, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece, score, kind in spec.pieces:
        if kind in (NORMAL, USER):
            pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in rank and piece[k:] in rank]
            found += [(-score, rank[piece], rank[a], rank[b], a, b) for a, b in pairs]
    return [(a, b) for *_, a, b in sorted(found)]


def rebuilt(spec: Spec) -> Tokenizer:
    unknown = next((n for n, (_, _, kind) in enumerate(spec.pieces) if kind == UNKNOWN), 0)
    if spec.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unknown, spec.byte_fallback)
    elif spec.model_type == BPE:
        vocabulary = {p: n for n, (p, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocabulary, merges(spec), unk_token=spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.model_type} is neither unigram nor byte-pair")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.one_space:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in spec.pieces if kind == USER])
    return tokenizer


class Codec:
    """Encodes and decodes texts with the rebuilt tokenizer and compares it with the sentencepiece library."""

    def __init__(self, data: bytes):
        self.spec = Spec.read(data)
        self.backend = rebuilt(self.spec)
        self.witness = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bare = rebuilt(self.spec)
        self.bare.normalizer = None
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|\n+|[^{MARK}\n]+")
        self.cache, self.differing = PartCache(self._encode_parts), set()
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode()
            for p, _, kind in self.spec.pieces
        ]

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        texts = [p.decode() for p in parts]
        ids = [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]
        # The library puts a marker before any text, so it is shown each part behind a line end.
        skip = len(self.witness.encode("\n"))
        for part, own, other in zip(parts, ids, self.witness.encode(["\n" + t for t in texts], num_threads=1), strict=True):
            if own != other[skip:]:
                self.differing.add(part)
        return [np.array(i, "<u4").tobytes() for i in ids]

    def encode(self, texts: list[bytes]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, and whether both libraries agree on it."""
        if not self.spec.separable:
            plain = [t.decode() for t in texts]
            own = [e.ids for e in self.backend.encode_batch_fast(plain, add_special_tokens=False)]
            agree = [a == b for a, b in zip(own, self.witness.encode(plain, num_threads=1), strict=True)]
            return [np.array(i, "<u4").tobytes() for i in own], agree
        parts = [[p.encode() for p in self.cut.findall(MARK + t.decode().replace(" ", MARK))] if t else [] for t in texts]
        ids = self.cache.joined(parts)
        return ids, [not (self.differing and self.differing.intersection(p)) for p in parts]

    def decode(self, ids: bytes) -> bytes:
        text = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text[1:] if self.spec.dummy_prefix and text[:1] == b" " else text


@lru_cache(2)
def codec(path: str) -> Codec:
    with open(path, "rb") as file:
        return Codec(file.read())


def encoded(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_ids, ids_crc32, round_trip, parity, ids) of every row; the model file lies on every worker."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.bool_()] * 2 + [pa.binary()]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            data, offsets = binary_parts(batch.column("bytes"))
            view = memoryview(data)
            for a, b in slices(offsets, STEP_BYTES):
                texts = [bytes(view[offsets[i] : offsets[i + 1]]) for i in range(a, b)]
                ids, agree = own.encode(texts)
                whole = [own.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                columns = [
                    batch.column("doc_id")[a:b], [len(t) for t in texts], [len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids],
                    whole, agree, ids if with_ids else [None] * len(ids),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.select("doc_id", utf8().alias("bytes")).mapInArrow(step, SCHEMA)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from rows with (doc_id, ids)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [None if i is None else own.decode(i).decode(errors="replace") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(step, "doc_id long, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), public_tokenizers.path(MODEL), with_ids=False).drop("ids")


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
SQL: dict[str, str] = {}
