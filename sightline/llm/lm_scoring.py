"""Scores of texts under an n-gram model in Elias-Fano tries (operator 9).

Tokens are words between ASCII white space, A-Z lower-cased, and one end per text. Training texts give
the counts of all words; the HEAD_WORDS most frequent ones have ids, and all others share one class.

    p(w | v) = (count(v, w) + STRENGTH * p(w)) / (count(v) + STRENGTH)     for ids and the end
    p(word | class) = (count + 0.1) / (all of the class + 0.1 * (words of the class + 1))

The bigrams that occur are dealt out into shards by context and the low bits of the successor, so that
no context is too large for one; their number follows the input. It is kept low, as a text gets a partial sum
from every shard it has a bigram in. A shard's task builds a trie whose probabilities take a byte each. Texts are read once more to be scored:
that pass sends their bigrams to the shards of these, their words outside the head, by hash, to the
shards that have the counts of those, and what the head alone tells. A shard's rows come in this order,
trie and counts before the questions, so a task looks things up while rows stream by. Only the head (of
fixed size) is broadcast. So a text's score is the sum of partial sums, and no text or table is held
anywhere as a whole.

Defined results: null text counts as empty and has one token, the end. A row with null doc_id is
trained on and is not held out. Repeated rows train and are scored each. Without training texts no
token is known, base_score is that of equal chances for no words, and the model is its prior. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of, numbered, staged
from .elias_fano import Trie, build_trie
from .words import mixed

#: Ids take so many bits; the last LOW_BITS of a successor choose among a context's shards.
ID_BITS, LOW_BITS = 18, 4
END, CLASS, START, FIRST = 0, 1, 2, 3
HEAD_WORDS = (1 << ID_BITS) - FIRST
STRENGTH = 200.0
#: Training tokens to a shard, tokens a map task packs at once, and distinct words it counts at once.
SHARD_TOKENS, CHUNK_TOKENS, COUNTED_WORDS = 6_000_000, 2_000_000, 400_000
#: Kinds of rows that meet in a shard, in the order in which they come.
TRIE, COUNTS, PAIRS, RARE, PLAIN = range(5)
_PARTIAL = "row long, n_tokens long, n_known long, base double, score double"
_SENT = f"shard int, kind int, body binary, {_PARTIAL}"


class Head:
    """Words with ids, and what is known of every id."""

    def __init__(self, words: list[str], counts: list[int], tail_count: int, tail_words: int, texts: int):
        self.words = words
        self.count = np.array([texts, tail_count, texts, *counts], np.float64)
        self.total = float(texts + tail_count + sum(counts))  # START is no token
        self.distinct = len(words) + tail_words + (texts > 0)
        kinds = len(words) + 2
        self.chance = (self.count + 0.1) / (self.total + 0.1 * kinds)
        self.base_log = np.log10((self.count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))
        self.tail_scale = tail_count + 0.1 * (tail_words + 1)
        self.base_scale = self.total + 0.1 * (self.distinct + 1)
        self.place: dict[bytes, int] | None = None

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of a text's words and its end."""
        if self.place is None:
            self.place = {w.encode(): i for i, w in enumerate(self.words, FIRST)}
        get = self.place.get
        return np.array([get(w, CLASS) for w in words] + [END], np.int64)

    def unseen(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        return np.log10(STRENGTH * self.chance[successors] / (self.count[contexts] + STRENGTH))

    def seen(self, contexts: np.ndarray, successors: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + STRENGTH * self.chance[successors]) / (self.count[contexts] + STRENGTH))


def split_words(text: pa.Scalar) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased: just what bytes do."""
    raw = text.as_py()
    return raw.lower().split() if raw else []


def _texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    for text in batch.column("text").cast(pa.binary()):
        yield split_words(text)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a task with their numbers, and the number of its texts under a null word."""
    counts, texts = Counter(), 0

    def out() -> pa.RecordBatch:
        words = pa.array([None, *counts], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([texts, *counts.values()], pa.int64())], names=["word", "n"])

    for batch in batches:
        for words in _texts(batch):
            counts.update(words)
            texts += 1
            if len(counts) > COUNTED_WORDS:
                yield out()
                counts, texts = Counter(), 0
    yield out()


def bigrams_of(ids: np.ndarray) -> np.ndarray:
    """context << ID_BITS | successor for every token."""
    contexts = np.empty_like(ids)
    contexts[0], contexts[1:] = START, ids[:-1]
    return (contexts << ID_BITS) | ids


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    group = (keys >> ID_BITS << LOW_BITS) | (keys & ((1 << LOW_BITS) - 1))
    return (mixed(group.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of numbers as compressed bytes; the first one is sorted and kept as differences."""
    first = np.diff(columns[0], prepend=0)
    parts = []
    for x in (first, *columns[1:]):
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(t).max)
        raw = np.ascontiguousarray(x.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
        parts.append(np.array([len(x), raw.shape[0]], np.int64).tobytes() + raw.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueeze(content: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(content), 0, []
    while at < len(raw):
        n, width = np.frombuffer(raw, np.int64, 2, at).tolist()
        planes = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
        at += 16 + n * width
    out[0] = np.cumsum(out[0])
    return out


def rare_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)


def _by_shard(keys: np.ndarray, shards: int, shard_by=shard_of) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys in rising order of key)."""
    shard = shard_by(keys, shards)
    order = np.lexsort((keys, shard))
    ordered = shard[order]
    cuts = np.searchsorted(ordered, np.arange(shards + 1))
    for s in np.unique(ordered).tolist():
        yield s, order[cuts[s] : cuts[s + 1]]


def _head_of(shared) -> Head:
    return shared.value


def bigram_counts(shared, shards: int):
    """Map side of training: the distinct bigrams of a chunk with their counts, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held, size = _head_of(shared), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            rows = [(s, squeeze(keys[at], counts[at])) for s, at in _by_shard(keys, shards)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                names=["shard", "body"],
            )

        for batch in batches:
            for words in _texts(batch):
                held.append(bigrams_of(head.ids(words)))
                size += len(held[-1])
                if size > CHUNK_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _merged(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], np.add.reduceat(counts, first)]


def _pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key's place in a shard's trie: (context with the successor's low bits, rest of the successor)."""
    low = (1 << LOW_BITS) - 1
    contexts = (keys >> ID_BITS << LOW_BITS) | (keys & low)
    return contexts, (keys & ((1 << ID_BITS) - 1)) >> LOW_BITS


def build_shards(shared):
    """Reduce side of training: rows come sorted by shard; one trie for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = _head_of(shared)

        def built(shard: int, held: list) -> pa.RecordBatch:
            keys, counts = _merged(held)
            contexts, successors = _pairs(keys)
            order = np.lexsort((successors, contexts))
            values = head.seen(keys >> ID_BITS, keys & ((1 << ID_BITS) - 1), counts)
            body = build_trie(contexts[order], successors[order], values[order], 1 << (ID_BITS - LOW_BITS))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([body], pa.binary())], names=["shard", "body"])

        now, held, rows = None, [], 0
        for batch in batches:
            for shard, body in zip(batch.column("shard").to_pylist(), batch.column("body")):
                if shard != now and held:
                    yield built(now, held)
                    held, rows = [], 0
                now = shard
                held.append(unsqueeze(body.as_py()))
                rows += len(held[-1][0])
                if rows > 4 * CHUNK_TOKENS:
                    held = [_merged(held)]
                    rows = len(held[0][0])
        if held:
            yield built(now, held)

    return run


def rare_hash(word: bytes) -> int:
    """A word outside the head in 63 bits."""
    return xxhash.xxh3_64_intdigest(word) >> 1


def _sent(shard, kind: int, body=None, partial=None) -> pa.RecordBatch:
    """Rows of one kind: with a body, or with columns of partial sums."""
    n = len(shard)
    arrays = [pa.array(shard, pa.int32()), pa.array(np.full(n, kind), pa.int32())]
    arrays.append(pa.nulls(n, pa.binary()) if body is None else pa.array(body, pa.binary()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    arrays += [pa.nulls(n, k) if partial is None else pa.array(c, k) for c, k in zip(partial or kinds, kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _SENT.split(", ")])


def _asked(keys: np.ndarray, text: np.ndarray, names: np.ndarray, shards: int, shard_by) -> Iterator[tuple[int, bytes]]:
    """(shard, question): distinct keys, how often each, and the texts they stand in."""
    for s, at in _by_shard(keys, shards, shard_by):
        distinct, n = np.unique(keys[at], return_counts=True)
        used, place = np.unique(text[at], return_inverse=True)
        yield s, squeeze(distinct, n, place, names[used])


def questions(shared, shards: int):
    """What the shards are asked about all texts, and what the head alone tells of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = _head_of(shared)
        held, rare, rows, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = np.array(rows, np.int64)
            for kind, parts, by in ((PAIRS, held, shard_of), (RARE, rare, rare_shard)):
                keys, text = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
                if len(keys):
                    found = list(_asked(keys, text, names, shards, by))
                    yield _sent([s for s, _ in found], kind, [b for _, b in found])

        for batch in batches:
            plain = []
            for row, words in zip(batch.column("row").to_pylist(), _texts(batch)):
                ids = head.ids(words)
                held.append(bigrams_of(ids))
                rare.append(np.array([rare_hash(words[i]) for i in np.flatnonzero(ids == CLASS).tolist()], np.int64))
                rows.append(row)
                size += len(ids)
                ids = ids[ids != CLASS]
                plain.append((row, len(words) + 1, int((head.count[ids] > 0).sum()), math.fsum(head.base_log[ids].tolist()), 0.0))
                if size > CHUNK_TOKENS:
                    yield from flush()
                    held, rare, rows, size = [], [], [], 0
            if plain:
                columns = list(zip(*plain))
                yield _sent(np.array(columns[0]) % shards, PLAIN, partial=columns)
        if held:
            yield from flush()

    return run


def rare_counts(shared, shards: int):
    """The counts of words outside the head, dealt out to shards by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = _head_of(shared)
        head.ids([])
        for batch in batches:
            words = batch.column("word").cast(pa.binary()).to_pylist()
            outside = [i for i, w in enumerate(words) if w not in head.place]
            keys = np.array([rare_hash(words[i]) for i in outside], np.int64)
            counts = batch.column("n").to_numpy()[outside]
            found = [(s, squeeze(keys[at], counts[at])) for s, at in _by_shard(keys, shards, rare_shard)]
            yield _sent([s for s, _ in found], COUNTS, [b for _, b in found])

    return run


def _partials(row, n_tokens, n_known, base, score) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in _PARTIAL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((row, n_tokens, n_known, base, score), kinds)], names=names)


class Shard:
    """What a task knows of one shard: its trie, and the counts of its rare words."""

    def __init__(self, head: Head):
        self.head, self.trie, self.counts = head, None, []
        self.sorted: list[np.ndarray] | None = None

    def learn(self, kind: int, body: bytes) -> None:
        if kind == TRIE:
            self.trie = Trie(body)
        else:
            self.counts.append(unsqueeze(body))

    def pairs(self, body: bytes) -> pa.RecordBatch:
        keys, n, place, names = unsqueeze(body)
        values = self.head.unseen(keys >> ID_BITS, keys & ((1 << ID_BITS) - 1))
        if self.trie is not None:
            found, known = self.trie.find(*_pairs(keys))
            values = np.where(found, known, values)
        zero = np.zeros(len(names), np.int64)
        return _partials(names, zero, zero, zero.astype(float), np.bincount(place, np.repeat(values, n), len(names)))

    def rare(self, body: bytes) -> pa.RecordBatch:
        keys, n, place, names = unsqueeze(body)
        if self.sorted is None:
            self.sorted = _merged(self.counts) if self.counts else [np.empty(0, np.int64)] * 2
        known, counts = self.sorted
        at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
        c = np.where(known[at] == keys, counts[at], 0) if len(known) else np.zeros(len(keys), np.int64)
        sums = [np.bincount(place, np.repeat(x, n), len(names)) for x in (
            c > 0, np.log10((c + 0.1) / self.head.base_scale), np.log10((c + 0.1) / self.head.tail_scale))]
        return _partials(names, np.zeros(len(names), np.int64), sums[0].astype(np.int64), sums[1], sums[2])


def score_shards(shared):
    """Rows come sorted by shard and kind: partial scores of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, now, shard = _head_of(shared), None, None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            plain = pa.array(kinds == PLAIN)
            if pc.any(plain).as_py():
                yield batch.filter(plain).select([x.split()[0] for x in _PARTIAL.split(", ")])
            bodies = batch.column("body")
            for i, s in zip(np.flatnonzero(kinds != PLAIN).tolist(), batch.column("shard").to_numpy()[kinds != PLAIN].tolist()):
                if s != now:
                    now, shard = s, Shard(head)
                kind, body = int(kinds[i]), bodies[i].as_py()
                if kind in (TRIE, COUNTS):
                    shard.learn(kind, body)
                else:
                    yield shard.pairs(body) if kind == PAIRS else shard.rare(body)

    return run


def learn_words(training: DataFrame) -> tuple[DataFrame, Head]:
    """training (text) → the table of all words with their counts, and the head."""
    counted = training.mapInArrow(count_words, "word string, n long")
    table = staged(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    words = table.where("word is not null")
    texts = table.where("word is null").agg(F.sum("n")).first()[0] or 0
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = words.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).toArrow()  # of fixed size
    names, counts = top.column("word").to_pylist(), top.column("n").to_pylist()
    rest = total - sum(counts)
    return words, Head(names, counts, rest, distinct - len(names), texts)


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) → doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(10)) == 0, F.lit(False))
    rows = numbered(docs.select("doc_id", "text"), "row").withColumn("held_out", held_out)
    texts, training = rows.select("row", "text"), rows.where("not held_out").select("text")
    words, head = learn_words(training)
    shared = spark.sparkContext.broadcast(head)
    shards = max(16, math.ceil(head.total / SHARD_TOKENS))
    dealt = training.mapInArrow(bigram_counts(shared, shards), "shard int, body binary").repartition(shards, "shard")
    tries = dealt.sortWithinPartitions("shard").mapInArrow(build_shards(shared), "shard int, body binary")
    tries = staged(tries, "tries")
    absent = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _PARTIAL.split(", ")]
    learned = tries.select("shard", F.lit(TRIE).alias("kind"), "body", *absent)
    learned = learned.unionByName(words.mapInArrow(rare_counts(shared, shards), _SENT))
    both = learned.unionByName(texts.mapInArrow(questions(shared, shards), _SENT))
    both = both.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    sums = both.mapInArrow(score_shards(shared), _PARTIAL).groupBy("row").agg(
        *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score"))
    )
    return rows.select("row", "doc_id", "held_out").join(sums, "row").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(head.total)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
