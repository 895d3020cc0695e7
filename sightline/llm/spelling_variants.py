"""Spelling variants by Bloom-guided neighbourhoods (operator 12).

Words are counted per task before any shuffle; a word of the vocabulary is a row. From the vocabulary a
Bloom filter is made, one shard per word length, each cut into blocks of 64 bits with `BITS_SET` bits per
word in one block: the blocks are ORed in a group-by, come to the driver within `FILTER_BYTES`, whatever
the size of the vocabulary, and are broadcast. A larger vocabulary gets fewer bits a word, so that more
edits pass the filter; the result stays the same. Each task then makes the edits of its words as hashes
only (rolling: an edit costs one multiplication and one addition), probes the shard of the edit's length,
and spells out just the positives. Those are joined with the vocabulary on the whole word, which removes
the false ones.

Two words that differ by a replaced letter are found from the one with the smaller letter, and words that
differ by an inserted or deleted letter from the longer one, so every pair is found once, by one probe.
Forms are followed to their roots by pointer jumping: counts grow at least `dominance` times a step, so
a few rounds reach any root.

Skew: a word that makes up a third of the corpus is one row per flush of a task's counts. A word has at
most 180 neighbours per letter, so neither the join nor the group-by on words has an unbounded group.

Defined results: null and empty texts hold no word, a null doc_id counts as empty text in the checksum.
Characters outside Latin-1 end a run. A word of any length has all its edits probed, a block of positions
at a time; of repeated rows each counts. Ties in count fall to the smallest word in code-point order. An
empty table, or one without frequent words, gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged
from .words import mixed

#: A word of the result has at least so many letters and occurrences.
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A form is at least so many times as frequent.
DOMINANCE = 5
#: One run in so many loses a letter (the contract's planted misspellings).
DAMAGE = 199
#: Size of the broadcast filter, at most; bits per word while it is smaller; bits set per word.
FILTER_BYTES, BITS_PER_WORD, BITS_SET = 64 << 20, 24, 4
#: Lengths with a shard of their own; longer words share one.
LONGEST = 64
#: Different words a task counts before it hands them on, and edits hashed at once.
FLUSH_WORDS, EDITS_AT_ONCE = 400_000, 2_000_000

_RUN = re.compile(rb"[a-z\xc0-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def damaged_counts(text: str, key: str, least: int = LEAST_LETTERS) -> Counter:
    """Lower-cased runs of one text with their counts, as Latin-1; the checksum of key and run damages some."""
    found: Counter = Counter()
    runs = Counter(_RUN.findall(text.encode("latin-1", "replace").lower()))
    prefix = zlib.crc32(f"{key}:".encode())
    for run, n in runs.items():
        if len(run) < least:
            continue
        value = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
        if value % DAMAGE == 0:
            at = value % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        found[run] += n
    return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flushed():
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts.update(damaged_counts(text.as_py(), key))
            if len(counts) >= FLUSH_WORDS:
                yield flushed()
                counts.clear()
    if counts:
        yield flushed()


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of all texts that occur often enough, written to the shared folder."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")
    rows = docs.where("text is not null").select(key, "text")
    counted = rows.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return staged(counted.where(F.col("n") >= least_count), "vocabulary")


def _powers(length: int) -> np.ndarray:
    """Weights of the letters of a word, the last one 1."""
    powers = np.ones(length, np.uint64)
    if length > 1:
        powers[:-1] = np.multiply.accumulate(np.full(length - 1, _BASE))[::-1]
    return powers


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of one length, and their letters as a matrix; blocks of bounded size."""
    coded = [w.encode("latin-1") for w in words]
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        step = max(1, EDITS_AT_ONCE // int(length))
        for i in range(0, len(places), step):
            some = places[i : i + step]
            yield some, np.frombuffer(b"".join(coded[p] for p in some), np.uint8).reshape(len(some), length)


def _hashes(letters: np.ndarray) -> np.ndarray:
    return (_LETTER[letters] * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)


class Filter:
    """Sizes of the shards, and once it is filled their blocks."""

    def __init__(self, counts: dict[int, int], filter_bytes: int = FILTER_BYTES):
        total = sum(counts.values()) * BITS_PER_WORD / 8
        share = min(1.0, filter_bytes / total) if total else 1.0
        sizes = [max(1, int(counts.get(n, 0) * share * BITS_PER_WORD / 64)) for n in range(LONGEST + 2)]
        self.sizes = np.array(sizes, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.uint64)
        self.blocks: np.ndarray | None = None

    def places(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash in the shard of its length, and the bits it sets there."""
        shard = min(length, LONGEST + 1)
        keys = mixed(hashes)
        block = self.starts[shard] + (((keys >> np.uint64(32)) * self.sizes[shard]) >> np.uint64(32))
        bits = np.zeros(keys.shape, np.uint64)
        for i in range(BITS_SET):
            bits |= np.uint64(1) << ((keys >> np.uint64(6 * i)) & np.uint64(63))
        return block, bits

    def holds(self, hashes: np.ndarray, length: int) -> np.ndarray:
        block, bits = self.places(hashes, length)
        return (self.blocks[block] & bits) == bits


def _filled(words: DataFrame, filter_bytes: int) -> Filter:
    shard = F.least(F.length("word"), F.lit(LONGEST + 1)).alias("shard")
    empty = Filter({r.shard: r.n for r in words.groupBy(shard).agg(F.count("*").alias("n")).collect()}, filter_bytes)

    def bits(batches):
        for batch in batches:
            for _, letters in _by_length(batch.column(0).to_pylist()):
                block, mask = empty.places(_hashes(letters), letters.shape[1])
                arrays = [pa.array(block.astype(np.int64)), pa.array(mask.view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "bits"])

    marked = words.select("word").mapInArrow(bits, "block bigint, bits bigint")
    # At most FILTER_BYTES / 8 rows, and a shard has one block at least.
    rows = marked.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    empty.blocks = np.zeros(int(empty.sizes.sum()), np.uint64)
    empty.blocks[rows["block"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return empty


def _positives(letters: np.ndarray, known: Filter, alphabet: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(row, edited word) for the edits of words of one length that the filter holds."""
    count, length = letters.shape
    powers = _powers(length)
    terms = _LETTER[letters] * powers
    whole = terms.sum(axis=1, dtype=np.uint64)
    before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
    shorter = before * _BASE_INVERSE + (whole[:, None] - before - terms)
    # Of equal neighbours only the last one is deleted: the others give the same word.
    last = np.ones(letters.shape, bool)
    last[:, :-1] = letters[:, :-1] != letters[:, 1:]
    if length > 1:
        for row, at in zip(*np.nonzero(known.holds(shorter, length - 1) & last), strict=True):
            word = letters[row].tobytes()
            yield int(row), word[:at] + word[at + 1 :]
    without = whole[:, None] - terms
    step = max(1, EDITS_AT_ONCE // count)
    for begin in range(0, length, step):
        span = slice(begin, begin + step)
        for letter in alphabet:
            edited = without[:, span] + _LETTER[letter] * powers[span]
            hits = known.holds(edited, length) & (letters[:, span] < letter)
            for row, at in zip(*np.nonzero(hits), strict=True):
                word, at = letters[row].tobytes(), begin + at
                yield int(row), word[:at] + bytes([letter]) + word[at + 1 :]


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Vocabulary (word, n) → word, n, near, near_n: every two words one edit apart, in both directions."""
    spark: SparkSession = words.sparkSession
    # Letters in use: 90 at most.
    used = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = np.array(sorted(ord(r.c) for r in used.collect()), np.uint8)
    known = spark.sparkContext.broadcast(_filled(words, filter_bytes))

    def probe(batches):
        for batch in batches:
            some, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for places, letters in _by_length(some):
                # Rows are cut so that one letter's edits stay within the bound.
                found = list(_positives(letters, known.value, alphabet))
                at = places[[row for row, _ in found]] if found else np.empty(0, np.int64)
                arrays = [
                    pa.array([some[i] for i in at], pa.string()),
                    pa.array(counts[at], pa.int64()),
                    pa.array([w.decode("latin-1") for _, w in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["word", "n", "near"])

    positives = words.select("word", "n").mapInArrow(probe, "word string, n bigint, near string")
    exact = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = staged(positives.join(exact, "near").select("word", "n", "near", "near_n"), "near-words")
    swapped = pairs.selectExpr("near word", "near_n n", "word near", "n near_n")
    return pairs.unionByName(swapped)


def _roots(forms: DataFrame) -> DataFrame:
    """word, form → word, root: pointers jump twice as far each round until none moves."""
    state = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = state.join(ahead, "root", "left")
        moved = staged(joined.select("word", F.coalesce("beyond", "root").alias("root"), F.expr("beyond is not null").alias("moved")), "roots")
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def group_variants(
    docs: DataFrame,
    least_count: int = LEAST_COUNT,
    dominance: int = DOMINANCE,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """documents (doc_id, text) → word, n, n_near, form, form_n, root; one row per word of the vocabulary."""
    words = vocabulary(docs, least_count)
    best = (
        near_pairs(words, filter_bytes)
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    )
    enough = -F.col("b.m") >= dominance * F.col("n")
    linked = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("b.near")).alias("form"),
        F.when(enough, -F.col("b.m")).alias("form_n"),
    )
    linked = staged(linked, "forms")
    roots = _roots(linked.where("form is not null"))
    return linked.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
