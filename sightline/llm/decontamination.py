"""Benchmark decontamination: block-max WAND over a BM25 index of the test items (operator 2).

Items are cut into segments of SEGMENT words; the index holds, for each word, the segments it stands in
with its BM25 weight as a share of the segment's score against itself, and its largest weight in each block of
LIST_BLOCK neighbouring segments. Every document is read as overlapping passages of two segments'
length, and every passage is a query: all segments whose score reaches THRESHOLD are retrieved. First
the block maxima of a passage's words are summed, for all passages of a document at once; only blocks
that can reach the threshold are opened, and there WAND moves over the lists with these maxima as bounds.

A retrieved item counts if five-word runs of its question and of its answer (its last sentence) stand
in the document to OVERLAP each; a part shorter than five words is one run.

The index is split into blocks of about BLOCK_SEGMENTS segments, so that what each task holds is bounded
however many items there are; document frequencies are counted over all of them.

Defined results: null or empty text has no hits, a null or empty item is never hit. Items with equal
text are all hit; items with equal id are one in the result, null item ids are left out. Rows with null
or repeated doc_id are each searched. Without items there are no hits. Other columns are not read, and
the filter keeps them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import WordHashes, shingles

SEGMENT, RUN = 64, 5
THRESHOLD, OVERLAP = 0.7, 0.8
K1, B = 1.2, 0.75
BLOCK_SEGMENTS, LIST_BLOCK = 20_000, 8
#: Most sums of block maxima held at once.
MOST_SUMS = 4_000_000
_LAST_SENTENCE = re.compile(r"(?<=[.!?\n])\s+(?=\S[^.!?\n]*[.!?]*\s*\Z)")
_HIT = "array<struct<item_id:bigint,score:double,first_word:int>>"


def question_and_answer(text: str) -> tuple[str, str]:
    """An item before its last sentence, and its last sentence; an item of one sentence is both."""
    parts = _LAST_SENTENCE.split(text.strip())
    if len(parts) < 2:
        return text, text
    return " ".join(parts[:-1]), parts[-1]


def segments_of(words: np.ndarray) -> list[np.ndarray]:
    """Pieces of about equal length, of at most SEGMENT words."""
    return np.array_split(words, -(-len(words) // SEGMENT)) if len(words) else []


class Index:
    """Segments of one block of items, with lists of (segment, weight) by word."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[int, int], total: int, mean: float):
        hashes = WordHashes()
        self.owner: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        postings: dict[int, list[tuple[int, float]]] = {}
        for place, (_, text) in enumerate(items):
            question, answer = (shingles(hashes.of(p), RUN) for p in question_and_answer(text))
            self.parts.append((question, answer))
            for segment in segments_of(hashes.of(text)):
                words, counts = np.unique(segment, return_counts=True)
                df = np.array([frequency[int(w)] for w in words])
                rarity = np.log(1 + (total - df + 0.5) / (df + 0.5))
                weight = rarity * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(segment) / mean))
                for w, x in zip(words.tolist(), (weight / weight.sum()).tolist()):
                    postings.setdefault(w, []).append((len(self.owner), x))
                self.owner.append(place)
        self.ids = [i for i, _ in items]
        self.words = np.array(sorted(postings), np.uint64)
        self.lists = [[s for s, _ in postings[w]] for w in self.words.tolist()]
        self.weights = [[x for _, x in postings[w]] for w in self.words.tolist()]
        self.blocks = -(-len(self.owner) // LIST_BLOCK)
        #: of each word, in each block that it reaches: its largest weight
        self.bounds: list[dict[int, float]] = []
        for segments, weights in zip(self.lists, self.weights):
            most: dict[int, float] = {}
            for segment, weight in zip(segments, weights):
                most[segment // LIST_BLOCK] = max(weight, most.get(segment // LIST_BLOCK, 0.0))
            self.bounds.append(most)
        # the same as arrays, one word after the other
        self.start = np.cumsum([0, *map(len, self.bounds)])
        self.block = np.array([b for most in self.bounds for b in most], np.int64)
        self.most = np.array([x for most in self.bounds for x in most.values()], float)

    def wand(self, terms: list[int], block: int, threshold: float) -> Iterator[tuple[int, float]]:
        """(segment, score) of the segments of one block whose weights over `terms` sum up to `threshold`."""
        first, end = block * LIST_BLOCK, (block + 1) * LIST_BLOCK
        cursor = []  # segment it stands at, place in its list, term, bound
        for t in terms:
            bound = self.bounds[t].get(block)
            if bound is not None:
                at = bisect_left(self.lists[t], first)
                cursor.append([self.lists[t][at], at, t, bound])
        while cursor:
            cursor.sort()
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursor):
                bound += c[3]
                if bound >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                return
            segment = cursor[pivot][0]
            if cursor[0][0] == segment:  # all lists up to the pivot, and those after it that stand here too
                score = sum(self.weights[c[2]][c[1]] for c in cursor if c[0] == segment)
                if score >= threshold:
                    yield segment, score
                segment += 1
            for c in cursor:
                if c[0] < segment:
                    segments = self.lists[c[2]]
                    c[1] = bisect_left(segments, segment, c[1])
                    c[0] = segments[c[1]] if c[1] < len(segments) and segments[c[1]] < end else -1
            cursor = [c for c in cursor if c[0] >= 0]

    def retrieved(self, words: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(first word of the passage, segment, score) of all passages of a document."""
        if not len(self.words):
            return
        place = np.searchsorted(self.words, words)
        place[place == len(self.words)] = 0
        at = np.flatnonzero(self.words[place] == words)
        keys = np.unique((at // SEGMENT) * len(self.words) + place[at])
        half, term = keys // len(self.words), keys % len(self.words)
        size = self.start[term + 1] - self.start[term]
        halves = len(words) // SEGMENT + 1
        step = min(halves, max(1, MOST_SUMS // max(self.blocks, 1)))
        for low in range(0, halves, step):
            a, b = np.searchsorted(half, [low, low + step + 1])
            many = size[a:b]
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.start[term[a:b]], many)
            cell = np.repeat(half[a:b] - low, many) * self.blocks + self.block[entry]
            sums = np.bincount(cell, self.most[entry], (step + 1) * self.blocks).reshape(step + 1, self.blocks)
            for h, block in zip(*np.nonzero(sums[:-1] + sums[1:] >= THRESHOLD - 1e-9)):
                x, y = np.searchsorted(half, [low + h, low + h + 2])
                for segment, score in self.wand(np.unique(term[x:y]).tolist(), int(block), THRESHOLD - 1e-9):
                    yield int(low + h) * SEGMENT, segment, score

    def hits(self, words: np.ndarray) -> list[tuple[int, float, int]]:
        """(item id, score, first word of the passage) of verified items, the best passage of each."""
        best: dict[int, tuple[float, int]] = {}
        for start, segment, score in self.retrieved(words):
            place = self.owner[segment]
            if score > best.get(place, (0.0, 0))[0]:
                best[place] = (score, start)
        if not best:
            return []
        runs: dict[int, np.ndarray] = {}

        def share(part: np.ndarray, size: int) -> float:
            if size not in runs:
                runs[size] = shingles(words, size)
            return float(np.isin(part, runs[size]).mean())

        out: dict[int, tuple[float, int]] = {}
        for place, (score, start) in best.items():
            if all(len(p) and share(p, k) >= OVERLAP for p, k in self.sized_parts(place)):
                out[self.ids[place]] = max(out.get(self.ids[place], (0.0, 0)), (score, start))
        return [(i, s, w) for i, (s, w) in sorted(out.items())]

    def sized_parts(self, place: int) -> Iterator[tuple[np.ndarray, int]]:
        for part, size in zip(self.parts[place], self.sizes[place]):
            yield part, size

    def with_sizes(self, items: list[tuple[int, str]]) -> Index:
        """Run lengths of the parts: RUN, or less for shorter ones."""
        hashes = WordHashes()
        self.sizes = [[min(RUN, len(hashes.of(p))) for p in question_and_answer(t)] for _, t in items]
        return self


def word_column(text: Column) -> Column:
    """Segments of a text as arrays of word hashes."""

    @F.pandas_udf("array<array<bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.Series([[s.astype(np.int64).tolist() for s in segments_of(hashes.of(t))] for t in batch])

    return run(text)


def indexes(items: DataFrame) -> Iterator[Index]:
    """items (item_id, text) → the blocks of the index, one after the other."""
    known = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    cut = known.select("item_id", F.explode(word_column(F.col("text"))).alias("words"))
    total, mean = cut.agg(F.count("*"), F.avg(F.size("words"))).first()
    blocks = -(-total // BLOCK_SEGMENTS)
    frequency = cut.select("item_id", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    for b in range(blocks):
        rows = known.where(block == b).orderBy("item_id", "text").collect()  # about BLOCK_SEGMENTS segments
        mine = cut.join(known.where(block == b).select("item_id").distinct(), "item_id")
        words = mine.select(F.explode("words").alias("word")).distinct().join(frequency, "word")
        found = {r.word % (1 << 64): r["count"] for r in words.collect()}
        pairs = [(r.item_id, r.text) for r in rows]
        yield Index(pairs, found, total, mean).with_sizes(pairs)


def hits(text: Column, index: Index) -> Column:
    """Array of item_id, score and first_word."""

    @F.pandas_udf(_HIT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hashes = WordHashes()
        for batch in batches:
            found = [index.hits(hashes.of(t)) for t in batch]
            yield pd.Series([[{"item_id": i, "score": s, "first_word": w} for i, s, w in f] for f in found])

    return run(text)


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) → doc_id, item_id, score, first_word for every verified hit."""
    every = [hits(F.col("text"), index) for index in indexes(items)]
    found = F.concat(*every) if every else F.array().cast(_HIT)
    hit = docs.select("doc_id", F.explode(found).alias("hit"))
    return hit.select("doc_id", "hit.item_id", "hit.score", "hit.first_word")


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` without a verified hit, with all their columns."""
    for index in indexes(items):
        docs = docs.where(F.size(hits(F.col("text"), index)) == 0)
    return docs
