"""Byte-level BPE by traversal of a trie of words.

In byte-pair encoding a sequence of tokens is the encoding of its bytes exactly
if every two neighbours are: no merge of lower rank could have joined bytes
across their border. So the encoding of a prefix is known from its last token
alone, and the last token of the prefix that ends one byte later is the longest
vocabulary entry that ends there and fits the last token before it. The entries
that end at a byte follow from a state of the vocabulary's own trie with suffix
links, so only entries that do end there are tried.

The distinct words of a batch form a trie. It is kept as their sorted list, in
which the words below a node stand side by side, so that walking the list is the
depth-first traversal: the path from the root is a stack of last-token states,
cut back to the prefix shared with the next word. A shared prefix is worked out
once.

Every Python worker holds a codec for as long as it lives, beside all that later
tasks need, so the vocabulary's tables are flat arrays, what is remembered is
bounded in entries and in bytes, and texts are taken in pieces of so many characters.

The vocabulary file's path is a parameter; nothing is trained or copied.

Defined cases: a null text is empty and has no tokens; the file's special tokens
inside a text are single tokens; repeated rows, empty tables and further columns
need no special care, as every row is encoded by itself.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from sparktidy.llm.tables import small_batches
from sparktidy.llm.words import give_back

MEMORY_WORDS = 200_000  # distinct words of a generation; a Python worker keeps the encodings of two
MEMORY_BYTES = 24 << 20  # bytes of a generation, whichever of the two is reached first
ENTRY_BYTES = 50  # of them for a word's place in the dictionary
MEMORY_PAIRS = 340_000  # token pairs whose verdicts it keeps; from 350,000 on the dictionary takes twice the room
MEMORY_MOVES = 400_000  # moves between states of the vocabulary's trie it keeps
TRIE_ROWS = 512  # texts whose words form one trie
TRIE_CHARS = 1 << 19  # characters of those texts; one longer text is a piece of its own


def _classes(last: int) -> tuple[str, str, str]:
    """Character classes below ``last`` for letters, numbers and white space."""
    kinds = {"L": [], "N": [], "Z": []}
    for c in map(chr, range(last)):
        kind = unicodedata.category(c)[0]
        if kind == "Z" or c in "\t\n\x0b\x0c\r\x85":
            kinds["Z"].append(c)
        elif kind in "LN":
            kinds[kind].append(c)
    return tuple("".join(map(re.escape, kinds[k])) for k in "LNZ")


#: Scripts up to Cyrillic, whose classes no Unicode version of ours disagrees on.
PLAIN = 0x530
_L, _N, _S = _classes(PLAIN)
#: Fixed: the pattern of byte-level pre-tokenizers, with its classes written out.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
BEYOND = re.compile(f"[^\x00-{chr(PLAIN - 1)}]")


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: bytes that print stand for
    themselves, the others for the letters from U+0100 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with the vocabulary of one file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        model, letters = said["model"], byte_letters()
        spell = lambda t: bytes(letters[c] for c in t)
        self.ids = {spell(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        for token in self.special:
            self.ids.pop(token.encode(), None)
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.cutter = _pre_tokenizer(said)
        count = max(self.bytes) + 1
        #: By token: the rank of its first merge or -1, and the two tokens merged.
        self.rank, self.left, self.right = (array("i", [-1]) * count for _ in range(3))
        self.merged: dict[int, int] = {}  # by left << 32 | right
        made = []
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = self.ids[spell(left)], self.ids[spell(right)]
            whole = self.ids[spell(left + right)]
            self.merged[a << 32 | b] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, a, b
                made.append(whole)
        del said, model
        self.joint: dict[int, bool] = {}  # by left << 32 | right
        #: Tokens that their own bytes encode to: both halves are, and they stay side by side until they are merged.
        self.reach = bytearray(count)
        for spelled, i in self.ids.items():
            self.reach[i] = len(spelled) == 1
        for whole in made:
            a, b = self.left[whole], self.right[whole]
            if self.reach[a] and self.reach[b] and self._apart(a, b, (self.rank[whole], 0)):
                self.reach[whole] = True
        self._link()
        self.size = array("I", [len(self.bytes.get(i, b"")) for i in range(count)])
        self.words: dict[str, bytes] = {}  # encodings of the younger generation
        self.elder: dict[str, bytes] = {}
        self.held = 0  # bytes of the younger generation, about
        self.pack = [array("I", [i]).tobytes() for i in range(count)]
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side.

        Undo the merges inside both, the later one first: the pieces at the
        border must never form a merge that comes before the merges undone so
        far, as that merge would have been made first."""
        known = self.joint.get(left << 32 | right)
        if known is None:
            if len(self.joint) >= MEMORY_PAIRS:
                self.joint.clear()
            known = self.joint[left << 32 | right] = self._apart(left, right, (len(self.merged), 0))
        return known

    def _apart(self, left: int, right: int, before: tuple[int, int]) -> bool:
        """``before``: rank of the earliest merge undone so far, and 1 if it stands
        right of the border (of equal merges the left one is made first)."""
        while True:
            rank = self.merged.get(left << 32 | right)
            if rank is not None and (rank, 0) < before:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = (a, 0), self.right[left]
            else:
                before, right = (b, 1), self.left[right]

    def _link(self) -> None:
        """The trie of reachable tokens by state: the token that ends there or -1,
        the depth, the state of the longest proper suffix, and the nearest of the
        suffixes where a token ends. Its edges are sorted by ``state << 8 | byte``."""
        child: dict[int, int] = {}
        token, depth, came = array("i", [-1]), array("i", [0]), array("q", [0])  # came: the edge into a state
        for spelled, i in self.ids.items():
            if not self.reach[i]:
                continue
            state = 0
            for byte in spelled:
                key = state << 8 | byte
                state = child.get(key, 0)
                if not state:
                    state = child[key] = len(token)
                    token.append(-1)
                    depth.append(depth[key >> 8] + 1)
                    came.append(key)
            token[state] = i
        self.token, self.depth = token, depth
        self.suffix, self.shorter = (array("i", [0]) * len(token) for _ in range(2))
        for state in np.argsort(np.frombuffer(depth, np.int32), kind="stable")[1:].tolist():
            key = came[state]
            if key >> 8:
                self.suffix[state] = self._next(self.suffix[key >> 8], key & 255, child.get)
            back = self.suffix[state]
            self.shorter[state] = back if token[back] >= 0 else self.shorter[back]
        edges = np.frombuffer(came, np.int64)[1:]
        order = np.argsort(edges)
        self.edges, self.leads = array("q", edges[order].tobytes()), array("i", (order + 1).astype(np.int32).tobytes())
        self.moves: dict[int, int] = {}
        self.ends: dict[int, tuple] = {}  # of the states that moves lead to

    def _child(self, key: int, none: int = 0) -> int:
        at = bisect_left(self.edges, key)
        return self.leads[at] if at < len(self.edges) and self.edges[at] == key else none

    def _next(self, state: int, byte: int, child: Callable[[int, int], int]) -> int:
        while True:
            found = child(state << 8 | byte, 0)
            if found or not state:
                return found
            state = self.suffix[state]

    def _move(self, key: int) -> int:
        if len(self.moves) >= MEMORY_MOVES:
            self.moves.clear()
            self.ends.clear()
        found = self.moves[key] = self._next(key >> 8, key & 255, self._child)
        if found not in self.ends:
            self.ends[found] = self._ending(found)
        return found

    def _ending(self, state: int) -> tuple[tuple[int, int], ...]:
        """The tokens that end in a state with their lengths, longest first."""
        found = []
        while state:
            if self.token[state] >= 0:
                found.append((self.token[state], self.depth[state]))
            state = self.shorter[state]
        return tuple(found)

    def walk(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Encodings of distinct words, by the traversal described above. A word
        that is a token on its own is no further matter."""
        spelled = sorted((w.encode("utf-8"), w) for w in words)
        ids, joint, fits, reach, size, pack = self.ids, self.joint, self.fits, self.reach, self.size, self.pack
        moves, move, ends = self.moves, self._move, self.ends
        path, last, states = b"", [], [0]  # last[d]: last token of the path's first d + 1 bytes; states[d]: of its first d
        for raw, word in spelled:
            whole = ids.get(raw)
            if whole is not None and reach[whole]:
                yield word, pack[whole]
                continue
            shared = 0
            for x, y in zip(path, raw):
                if x != y:
                    break
                shared += 1
            del last[shared:], states[shared + 1:]
            path, state = raw, states[shared]
            for at in range(shared, len(raw)):
                key = state << 8 | raw[at]
                state = moves.get(key)
                if state is None:
                    state = move(key)
                for token, length in ends[state]:
                    if length > at:
                        break
                    left = last[at - length]
                    good = joint.get(left << 32 | token)
                    if good is None:
                        good = fits(left, token)
                    if good:
                        break
                last.append(token)
                states.append(state)
            found, end = [], len(raw)
            while end:
                found.append(last[end - 1])
                end -= size[found[-1]]
            yield word, array("I", found[::-1]).tobytes()

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if BEYOND.search(text) is None:
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, each as little-endian unsigned 32-bit integers."""
        cut = []
        for text in texts:
            parts = self.cut_special.split(text) if self.cut_special else [text]
            cut.append([self.split(p) if i % 2 == 0 else p for i, p in enumerate(parts)])
        known = self._known({w for parts in cut for p in parts if isinstance(p, list) for w in p})
        get, special = known.__getitem__, self.special
        return [b"".join(b"".join(map(get, p)) if isinstance(p, list) else self.pack[special[p]] for p in parts)
                for parts in cut]

    def _known(self, words: set[str]) -> dict[str, bytes]:
        """Encodings that hold those of ``words``. When the younger generation is
        full it becomes the elder one, and only words not seen since are forgotten."""
        if len(self.words) >= MEMORY_WORDS or self.held >= MEMORY_BYTES:
            self.elder, self.words, self.held = self.words, {}, 0
        new = words - self.words.keys()
        again = new & self.elder.keys()
        found = {w: self.elder[w] for w in again} | dict(self.walk(list(new - again)))
        self.words.update(found)
        self.held += ENTRY_BYTES * len(found) + sum(map(sys.getsizeof, found)) + sum(map(sys.getsizeof, found.values()))
        return self.words

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        numbers = array("I")
        numbers.frombytes(ids)
        return b"".join(map(self.bytes.__getitem__, numbers)).decode("utf-8", "replace")


if sys.byteorder != "little":  # ids are handed on as little-endian bytes
    raise RuntimeError("bpe packs ids in the machine's byte order, which has to be little-endian")


def _pre_tokenizer(said: dict):
    """The file's pre-tokenizer alone; its vocabulary is not loaded once more."""
    empty = {"type": "BPE", "vocab": {}, "merges": []}
    return Tokenizer.from_str(json.dumps({
        "version": said.get("version", "1.0"), "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
        "pre_tokenizer": said["pre_tokenizer"], "post_processor": None, "decoder": None, "model": empty})).pre_tokenizer


def _pieces(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts (null: empty) in pieces of so many rows and characters, each with its first row."""
    first, held, size = 0, [], 0
    for row, text in enumerate(texts):
        text = text.as_py() or ""
        if held and (len(held) >= TRIE_ROWS or size + len(text) > TRIE_CHARS):
            yield first, held
            first, held, size = row, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per Python worker and file."""
    return Codec(path)


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns, ``n_tokens``, ``ids`` and ``round_trip``: whether the ids
    decode to the text they came from."""
    small_batches(docs.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    inner = [f"__k{i}" for i in range(len(keep))]
    narrow = docs.select(*[F.col(k).alias(i) for k, i in zip(keep, inner)], F.col(text).alias("__text"))

    def run(batches):
        own = codec(path)
        for batch in batches:
            for at, texts in _pieces(batch.column(len(keep))):
                part = batch.slice(at, len(texts))
                ids = own.encode_batch(texts)
                offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
                flat = np.frombuffer(b"".join(ids), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(np.diff(offsets), pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                     pa.array([own.decode(i) == t for i, t in zip(ids, texts)], pa.bool_())],
                    [*inner, "n_tokens", "ids", "round_trip"])
        give_back()

    schema = ", ".join([*(f"{i} {kinds[k]}" for k, i in zip(keep, inner)), "n_tokens long, ids array<int>, round_trip boolean"])
    out = narrow.mapInArrow(run, schema)
    return out.select(*[F.col(i).alias(k) for k, i in zip(keep, inner)], "n_tokens", "ids", "round_trip")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """The table with a column ``text`` decoded from its ids in place of them; no
    ids (null) decode to the empty text."""
    kept = [c for c in encoded.columns if c != ids]
    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}
    inner = [f"__k{i}" for i in range(len(kept))]

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode(array("I", i or []).tobytes()) for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*inner, "__text"])

    out = encoded.select(*[F.col(k).alias(i) for k, i in zip(kept, inner)], F.col(ids)).mapInArrow(
        run, ", ".join([*(f"{i} {kinds[k]}" for k, i in zip(kept, inner)), "__text string"]))
    return out.select(*[F.col(i).alias(k) for k, i in zip(kept, inner)], F.col("__text").alias("text"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document. One stage
    without a shuffle; ids and decoded texts leave the worker as digests."""
    small_batches(docs.sparkSession)

    def run(batches):
        own, sha = codec(path), hashlib.sha256
        for batch in batches:
            for at, texts in _pieces(batch.column(1)):
                part = batch.slice(at, len(texts))
                ids = own.encode_batch(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array([sha(i).hexdigest() for i in ids], pa.string()),
                     pa.array([sha(own.decode(i).encode()).hexdigest() for i in ids], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    narrow = docs.select("doc_id", "text")
    return narrow.mapInArrow(
        run, f"doc_id {dict(narrow.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
