"""Byte-pair encoding and decoding with a public vocabulary (operator 6).

A word is a contiguous array of parts beside the ranks of its adjacent pairs. The lowest rank is found
by a scan, its boundary is deleted, and the two neighbouring ranks are looked up again. Words of one
length are rows of two matrices and take these steps together, so each step makes the matrices one
column narrower; rows without a rank left are done. Words longer than LONG_WORD bytes take the same
merges from a heap, since scans would be quadratic.

Texts are cut at spaces before a visible character; the pattern of the tokenizer never joins across such
a place. Of a chunk of texts each different piece is looked at once: one of letters is a word, others
are cut by the pattern, and the words that a bounded table does not hold are encoded together. The ids
of texts are then put together from the pieces', and decoded from the ids of each.

Defined results: null text counts as empty and has no ids. The text of a special token becomes its id.
Rows with null or repeated doc_id are each encoded; other columns are not read by the query, and the
stage keeps the document's columns beside the new ones.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.json"
LONG_WORD, NO_RANK = 96, 1 << 30
#: Words in the table; then it becomes the older one of two, and what is used moves on.
TABLE_ENTRIES = 200_000
#: Characters of texts that are encoded together, and cells of a matrix of words.
CHUNK_CHARS, CELLS = 2_000_000, 400_000
_SPACE_BEFORE_SPACE = regex.compile(r" (?=\s|$)")
_CUT = regex.compile(r"(?<=.) (?=\S)", regex.DOTALL)


def byte_letters() -> dict[str, int]:
    """Letter → byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairRanks:
    """(left id, right id) → rank, looked up for arrays: open addressing, a fifth full."""

    BITS = 18

    def __init__(self, pairs: dict[int, int]):
        bits = max(self.BITS, (5 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_RANK, np.int32)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for key, rank, slot in zip(keys.tolist(), pairs.values(), self._slots(keys).tolist(), strict=True):
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.mask
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = ((left.astype(np.int64) << 32) + right).ravel()
        slots = self._slots(keys)
        held = self.keys[slots]
        going = np.flatnonzero((held != keys) & (held >= 0))
        while len(going):
            slots[going] = slots[going] + 1 & self.mask
            held = self.keys[slots[going]]
            going = going[(held != keys[going]) & (held >= 0)]
        # A free slot has no rank.
        return self.ranks[slots].reshape(left.shape)


class Table:
    """Pieces with their ids as text and the bytes that these decode to."""

    def __init__(self):
        self.ids: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    def put(self, key: str, ids: str, back: bytes) -> None:
        self.ids[key], self.back[key] = ids, back

    def drop(self, key: str) -> None:
        del self.ids[key], self.back[key]


class Bpe:
    """A vocabulary file of the tokenizers library, with encode and decode of whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters = byte_letters()
        raw = lambda word: bytes(letters[c] for c in word)
        vocabulary = content["model"]["vocab"]
        self.tokens: dict[int, bytes] = {i: raw(w) for w, i in vocabulary.items()}
        self.single = [0] * 256
        for i, token in self.tokens.items():
            if len(token) == 1:
                self.single[token[0]] = i
        #: left id * 2**32 + right id → rank, and rank → id of both
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(content["model"]["merges"]):
            self.pairs[(vocabulary[left] << 32) + vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.tokens |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.single_ids, self.made_ids = np.array(self.single, np.int32), np.array(self.made, np.int32)
        self.ranks = PairRanks(self.pairs)
        #: id → its text, and back to the bytes of the token
        self.name = [str(i) for i in range(max(self.tokens) + 1)]
        self.named = {str(i): token for i, token in self.tokens.items()}
        #: pieces after a space, known by what follows it, and other words: ids as text, and their bytes
        self.table, self.older = Table(), Table()
        self.others = Table()
        self.several: list[str] = []

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of words of the pattern."""
        out: list = [None] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(lengths).tolist():
            places = np.flatnonzero(lengths == length)
            if length > LONG_WORD:
                for i in places.tolist():
                    out[i] = self._by_heap(words[i])
                continue
            step = max(1, CELLS // length)
            for begin in range(0, len(places), step):
                some = places[begin : begin + step].tolist()
                letters = np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(len(some), length)
                for rows, parts in self._by_scan(self.single_ids[letters]):
                    for row, ids in zip(rows.tolist(), parts.tolist(), strict=True):
                        out[some[row]] = ids
        return out

    def _by_scan(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of bytes' ids → (numbers of the rows that are done, their parts), until all are."""
        rows = np.arange(len(parts))
        ranks = self.ranks.of(parts[:, :-1], parts[:, 1:])
        while ranks.shape[1]:
            at = ranks.argmin(axis=1)
            lowest = ranks[np.arange(len(rows)), at]
            going = lowest < NO_RANK
            if not going.all():
                yield rows[~going], parts[~going]
                rows, parts, ranks, at, lowest = (x[going] for x in (rows, parts, ranks, at, lowest))
                if not len(rows):
                    return
            every, width = np.arange(len(rows)), parts.shape[1]
            parts[every, at] = self.made_ids[lowest]
            # The boundary behind `at` goes: later parts and ranks move one place up.
            places = np.arange(width - 1)
            parts = np.take_along_axis(parts, places + (places > at[:, None]), axis=1)
            places = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, places + (places >= at[:, None]), axis=1)
            right = at < width - 2
            ranks[every[right], at[right]] = self.ranks.of(parts[every[right], at[right]], parts[every[right], at[right] + 1])
            left = at > 0
            ranks[every[left], at[left] - 1] = self.ranks.of(parts[every[left], at[left] - 1], parts[every[left], at[left]])
        yield rows, parts

    def _by_heap(self, word: bytes) -> list[int]:
        parts: list = [self.single[b] for b in word]
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def push(left: int) -> None:
            if left >= 0 and (right := after[left]) < n:
                rank = self.pairs.get((parts[left] << 32) + parts[right])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, parts[left], parts[right]))

        for i in range(n):
            push(i)
        while heap:
            rank, left, a, b = heapq.heappop(heap)
            if parts[left] != a or after[left] >= n or parts[right := after[left]] != b:
                continue
            parts[left], parts[right] = self.made[rank], None
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            push(before[left])
            push(left)
        return [p for p in parts if p is not None]

    def _learn(self, pieces: Iterable[str], table: Table, space: str) -> None:
        """Put words of the pattern into a table; `space` stands before each."""
        words = list(pieces)
        name, named = self.name, self.tokens
        for word, ids in zip(words, self.encode_words([(space + w).encode() for w in words]), strict=True):
            table.put(word, ",".join([name[i] for i in ids]), b"".join([named[i] for i in ids]))

    def _renewed(self, pieces: set[str]) -> list[str]:
        """Make the table hold these pieces; returns those that are more than one word."""
        missing = pieces.difference(self.table.ids)
        for p in missing.intersection(self.older.ids):
            self.table.put(p, self.older.ids[p], self.older.back[p])
            missing.discard(p)
        several = {p: self.pattern.findall(" " + p) for p in missing if not p.isalpha()}
        spaced, others = missing.difference(several), set()
        for words in several.values():
            for w in words:
                (spaced if w[0] == " " and w[1:].isalpha() else others).add(w)
        spaced = {w[1:] if w[0] == " " else w for w in spaced}
        self._learn(spaced.difference(self.table.ids), self.table, " ")
        self._learn(others.difference(self.others.ids), self.others, "")
        for p, words in several.items():
            self.table.put(p, *self._joined(words))
        return list(several)

    def _joined(self, words: list[str]) -> tuple[str, bytes]:
        places = [(self.table, w[1:]) if w[0] == " " and w[1:].isalpha() else (self.others, w) for w in words]
        return ",".join([t.ids[w] for t, w in places]), b"".join([t.back[w] for t, w in places])

    def _trim(self) -> None:
        """After a chunk single words stay; a full table becomes the older one."""
        for p in self.several:
            self.table.drop(p)
        self.several = []
        if len(self.table.ids) > TABLE_ENTRIES:
            self.table, self.older = Table(), self.table
        if len(self.others.ids) > TABLE_ENTRIES:
            self.others = Table()

    def _encoded(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """(ids with commas between them, decoded bytes) of texts without special tokens."""
        self._trim()
        cut = [_CUT.split(t) if _SPACE_BEFORE_SPACE.search(t) else t.split(" ") for t in texts]
        # What comes first has no space before it.
        firsts = [self.pattern.findall(parts.pop(0)) for parts in cut]
        self.several = self._renewed(set().union(*cut, (w[1:] for words in firsts for w in words if w[0] == " " and w[1:].isalpha())))
        words = {w for words in firsts for w in words if not (w[0] == " " and w[1:].isalpha())}
        self._learn(words.difference(self.others.ids), self.others, "")
        ids, back = self.table.ids.__getitem__, self.table.back.__getitem__
        for first, parts in zip(firsts, cut, strict=True):
            head = self._joined(first)
            comma = "," if head[0] and parts else ""
            yield head[0] + comma + ",".join(map(ids, parts)), head[1] + b"".join(map(back, parts))

    def encoded(self, texts: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(ids with commas between them, decoded bytes) of any texts, in chunks of bounded size."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append([p for p in self._split(text) if p])
            size += len(text)
            if size > CHUNK_CHARS:
                yield from self._chunk(held)
                held, size = [], 0
        yield from self._chunk(held)

    def _split(self, text: str) -> list[str]:
        special = self.split_special is not None and any(s in text for s in self.special)
        return self.split_special.split(text) if special else [text]

    def _chunk(self, held: list[list[str]]) -> Iterator[tuple[str, bytes]]:
        plain = self._encoded([p for parts in held for p in parts if p not in self.special])
        for parts in held:
            found = [(self.name[self.special[p]], p.encode()) if p in self.special else next(plain) for p in parts]
            yield ",".join([ids for ids, _ in found]), b"".join([back for _, back in found])

    def encode(self, text: str) -> list[int]:
        ids = next(self.encoded([text]))[0]
        return list(map(int, ids.split(","))) if ids else []

    def decode_bytes(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode(errors="replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Bpe:
    return Bpe(path)


def _texts(batch: pd.Series) -> Iterator[str]:
    return ("" if x is None else x for x in batch)


def encode(text: Column, path: str | None = None) -> Column:
    """Ids of a text."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = tokenizer(path).encoded(_texts(batch))
            yield pd.Series([np.fromstring(ids, np.int32, sep=",") for ids, _ in found], dtype=object)

    return run(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """Text of ids."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([tokenizer(path).decode([] if x is None else list(x)) for x in batch], dtype=object)

    return run(ids)


def digests(text: Column, path: str | None = None) -> Column:
    """Struct of n_tokens, ids_sha256 and decoded_sha256, without sending ids out of the task."""
    path = path or public_tokenizers.path(VOCABULARY)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for ids, back in tokenizer(path).encoded(_texts(batch)):
                n.append(ids.count(",") + 1 if ids else 0)
                of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                of_text.append(hashlib.sha256(back.decode(errors="replace").encode()).hexdigest())
            yield pd.DataFrame({"n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_text})

    return run(text)


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text) → doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select("doc_id", digests(F.col("text"), path).alias("found")).select("doc_id", "found.*")


def with_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with `n_tokens` and `token_ids`, in place of columns of these names."""
    ids = docs.withColumn("token_ids", encode(F.col("text"), path))
    return ids.withColumn("n_tokens", F.size("token_ids").cast("long"))
