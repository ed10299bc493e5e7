"""The trie's encodings against the tokenizers library, exactly."""

import hashlib
import random
import sys
import tracemalloc
from array import array

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sparktidy.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def numbers(raw):
    out = array("I")
    out.frombytes(raw)
    return out.tolist()


def check(texts):
    own = bpe.codec(PATH)
    for text, raw in zip(texts, own.encode_batch(texts)):
        wanted = LIBRARY.encode(text, add_special_tokens=False).ids
        assert numbers(raw) == wanted, text
        assert own.decode(raw) == LIBRARY.decode(wanted, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    check(texts)


def test_awkward_texts():
    check(["", " ", "\n\n a", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "it's we'll I'M",
           "aaaaaaaaaaaaaaaaaaaaaaa", "=" * 700, "0" * 301, "\u0085x y", "\x00\x1f", "中文字😀👍🏽", "ſ K Å", "x" * 20_000,
           " \t \n  word", "naïve Straße"])


def test_every_low_code_point():
    check([f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}!{chr(c)}a" for c in range(0x600)])


def test_random_ids_decode():
    draw = random.Random(3)
    ids = [draw.randrange(50257) for _ in range(3000)]
    assert bpe.codec(PATH).decode(array("I", ids).tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_small_memory_gives_the_same(monkeypatch):
    texts = ["the cat sat on the mat " * 3, "other words here", "the cat again"]
    own = bpe.Codec(PATH)
    first = own.encode_batch(texts)
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 2)
    assert own.encode_batch(texts) == first and own.encode_batch(texts[::-1]) == first[::-1]


def test_codec_is_small():
    tracemalloc.start()
    try:
        own = bpe.Codec(PATH)
        assert tracemalloc.get_traced_memory()[0] < 35e6 and own.encode_batch(["the cat"])
    finally:
        tracemalloc.stop()


def test_remembered_words_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 200_000, raising=False)
    own, draw = bpe.Codec(PATH), random.Random(5)
    for _ in range(30):
        words = ["".join(draw.choices("abcdefgh", k=1500)) for _ in range(20)]
        check_own = own.encode_batch(words)
        assert sum(sys.getsizeof(x) for d in (own.words, own.elder) for x in [*d, *d.values()]) < 800_000
    assert [numbers(i) for i in check_own] == [LIBRARY.encode(w, add_special_tokens=False).ids for w in words]


def test_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "TRIE_CHARS", 10)
    monkeypatch.setattr(bpe, "TRIE_ROWS", 3)
    texts = ["a" * 6, "b" * 5, None, "", "c", "d" * 40, "e", "f" * 9, "g"]
    found = list(bpe._pieces(pa.array(texts)))
    assert [t for _, piece in found for t in piece] == [t or "" for t in texts]
    assert [first for first, _ in found] == [0, 1, 4, 5, 6, 8]
    assert list(bpe._pieces(pa.array([], pa.string()))) == []


def test_digests(docs_of, odd_rows, clashing):
    found = bpe.digests(clashing(docs_of(odd_rows)), PATH).collect()
    wanted = []
    for i, text, _ in odd_rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        wanted.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
                       hashlib.sha256(back.encode()).hexdigest()))
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, found)) == order(wanted)


def test_encode_decode(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    out = bpe.encode(docs, PATH, keep=("doc_id", "source"))
    assert out.where("NOT round_trip").count() == 0 and out.count() == len(odd_rows)
    back = bpe.decode(out.select("doc_id", "ids"), PATH)
    assert sorted(map(str, ((r.doc_id, r.text) for r in back.collect()))) == sorted(
        map(str, ((i, t or "") for i, t, _ in odd_rows)))


def test_empty(docs_of):
    assert bpe.digests(docs_of([]), PATH).count() == 0 and bpe.encode(docs_of([]), PATH).count() == 0


@pytest.mark.parametrize("words", [["a"], ["ab", "abc", "abd"], ["the", "then", "there", "thesis"]])
def test_shared_prefixes(words):
    own = bpe.codec(PATH)
    assert {w: numbers(i) for w, i in own.walk(words)} == {w: LIBRARY.encode(w).ids for w in words}
