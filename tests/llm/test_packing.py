"""Token ids of the packing operator against the library's own on whole texts, and how often the library is called for them."""

import random

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.cached import PartCache

PATH = public_tokenizers.path(packing.VOCABULARY)
ODD = [
    "", " \t\n\x0b\x0c\r ", "½", "½ ½ 1½ a½b ½.", "<|endoftext|> x<|startoftext|>y ½", "日本語 текст ß İ ﬁ \x00 ▁", "ΣΑΣ ΑΣ. Ⱥb İ. ı, i̇.",
    "a.b c.. d,. . , ., ́a é", " x y z \u0085", "don't 'S I'LL", "1 2 3.5 ½1 10", "ª º µ ×÷ ǅ ǆ,", "a</w> </w>", "K Å Ω", "w " * 5000,
]


class Counted:
    """Passes everything on and counts the calls."""

    def __init__(self, what):
        self.what, self.calls = what, 0

    def __getattr__(self, name):
        found = getattr(self.what, name)

        def call(*args, **named):
            self.calls += 1
            return found(*args, **named)

        return call


def check(texts: list[str]) -> None:
    ids, bounds = packing.encode_texts(pa.array(texts, pa.string()), PATH)
    want = [e.ids + [packing.END_ID] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
    assert bounds[0] == 0 and bounds[-1] == len(ids)


def test_ids_are_the_librarys():
    pick, letters = random.Random(5), "abcXYZ.,'\"½1 \n\t éÉß日İΣσ́ <|>#"
    check(ODD)
    check(ODD[::-1])
    check(["".join(pick.choice(letters) for _ in range(pick.randrange(60))) for _ in range(5000)])
    check([f"a{chr(c)}b {chr(c)} {chr(c)}. x{chr(c)}," for c in range(0x600)])


def test_texts_inside_a_larger_array():
    texts = pa.array(["one", "two words", "", "three"], pa.string())
    ids, bounds = packing.encode_texts(texts.slice(1, 2), PATH)
    alone, limits = packing.encode_texts(pa.array(["two words", ""]), PATH)
    assert ids.tolist() == alone.tolist() and bounds.tolist() == limits.tolist()


def test_many_words_are_one_call_to_the_library():
    encoder, words = packing.WordEncoder(PATH), [f"{a}{b}{mark}".encode() for a in "abcdefghij" for b in "klmnopqrst" for mark in ("", ".", ",", "!", "-é")]
    want = encoder(words)
    encoder.tokenizer, encoder.model = Counted(encoder.tokenizer), Counted(encoder.model)
    assert encoder(words) == want
    assert encoder.tokenizer.calls + encoder.model.calls <= 2


def test_a_full_cache_begins_anew():
    asked = []
    cache = PartCache(lambda parts: asked.append(parts) or [p * 2 for p in parts], most=2)
    assert cache.each([b"a", b"b", b"c"]) == [b"aa", b"bb", b"cc"]
    assert cache.each([b"d", b"a"]) == [b"dd", b"aa"]
    assert cache.each([b"a", b"e"]) == [b"aa", b"ee"]
    assert asked == [[b"a", b"b", b"c"], [b"d", b"a"], [b"e"]]
