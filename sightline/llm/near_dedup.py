"""Near duplicates by Order MinHash and banded alignment (operator 5).

Texts become words (lower case, without punctuation at the ends). A text's k-mers are its runs of five
words, each with the number of equal ones before it. For each of SKETCHES hash functions the two k-mers
with the smallest hashes are kept in the order in which they stand in the text; the pair is a bucket.
Texts that meet in a bucket are verified: two are near duplicates if their words align within a band with
a similarity `1 - distance / longer length` of at least SIMILARITY. Groups are connected components of such links.

Equal texts are one node. First each text is linked to the next and to the first of its bucket: a batch of
a map task links the texts of one bucket among themselves and sends only the first on. That finds most
groups without naming all pairs. Then every pair of a bucket whose texts are not in one group yet is
compared, so that the groups are those of all pairs that meet; pairs inside a group would not change it.
Large buckets are dealt in blocks of BLOCK texts over the tasks. Pairs are told apart where their block is, by
counts of words, then by the words they share: no alignment can make up for what these lack. Those left are aligned
there, in one of the buckets they share only, and no more once their classes are linked in the block. So a block gives
fewer links than it has texts, and no pair leaves it but these. Comparing is quadratic where many unlike texts
share a bucket; rows are not.

A pair whose five-word runs have Jaccard similarity j meets with probability 1 - (1 - j²)^SKETCHES.

Defined results: null text counts as empty. Texts without words are only equal to equal texts. Texts
shorter than five words are one k-mer. Rows with null or repeated doc_id are documents of their own; a
group's id is its smallest doc_id (null only if all are null), its first row with that id stays. Other
columns are not read, and the stage keeps them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, staged
from .components import components
from .words import WordHashes, mixed, occurrences, odd_numbers, shingles

KMER, SKETCHES, SIMILARITY = 5, 24, 0.8
#: Texts of one bucket that are compared at once with each other, or with as many others.
BLOCK = 1000
#: Kinds of words that `counts` tells apart.
BINS = 256
#: Words of texts that a task holds at once as lists.
MOST_WORDS = 2_000_000
#: Changed words up to which the band grows step by step.
BAND = 24
_ODD = odd_numbers(SKETCHES, 5)
_SKETCH = "node binary, n int, sketch array<long>, tally binary"
_PAIR = "a binary, b binary"
_LINK = "bucket long, node binary, n int, other binary, m int"


def sketch(words: np.ndarray) -> np.ndarray:
    """One bucket for each hash function: its two smallest labelled k-mers in text order."""
    kmers = shingles(words, KMER)
    labelled = mixed(kmers + occurrences(kmers) * np.uint64(0x2545F4914F6CDD1D))
    firsts, seconds = np.empty(SKETCHES, np.int64), np.empty(SKETCHES, np.int64)
    at_once = max(1, 1_000_000 // len(labelled))
    for i in range(0, SKETCHES, at_once):
        hashed = labelled[None, :] * _ODD[i : i + at_once, None]
        hashed ^= hashed >> np.uint64(29)
        rows = np.arange(len(hashed))
        a = hashed.argmin(axis=1)
        hashed[rows, a] = np.iinfo(np.uint64).max
        firsts[i : i + at_once], seconds[i : i + at_once] = a, hashed.argmin(axis=1)
    early, late = labelled[np.minimum(firsts, seconds)], labelled[np.maximum(firsts, seconds)]
    return mixed(early * np.uint64(3) + mixed(late) + _ODD).astype(np.int64)


def tally(words: np.ndarray) -> bytes:
    """The words told off in order, by 32 bits of each one's hash."""
    return (words >> np.uint64(32)).astype(np.uint32).tobytes()


def counts(words: np.ndarray) -> np.ndarray:
    """How many words of a tally fall in each of BINS, 255 at most."""
    return np.minimum(np.bincount(words % np.uint32(BINS), minlength=BINS), 255).astype(np.uint8)


def labels(words: np.ndarray) -> np.ndarray:
    """16 bits for each word of a tally and the number of equal ones before it."""
    return (mixed(words.astype(np.uint64) + (occurrences(words) << np.uint64(32))) >> np.uint64(48)).astype(np.uint16)


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length, buckets and tally of a batch's distinct texts that have words."""
    hashes = WordHashes()
    for batch in batches:
        rows, seen = [], set()
        for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
            if node not in seen:
                seen.add(node)
                words = hashes.of(text.as_py())
                if len(words):
                    rows.append((node, len(words), sketch(words), tally(words)))
        if rows:
            kinds = (pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "sketch", "tally"])


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket rows of a batch's sketches; texts that meet within the batch come as links."""
    for batch in batches:
        nodes = batch.column("node").to_pylist()
        if not nodes:
            continue
        place = np.repeat(np.arange(len(nodes)), SKETCHES)
        n = batch.column("n").to_numpy()
        bucket = batch.column("sketch").flatten().to_numpy()
        order = np.lexsort((place, n[place], bucket))
        bucket, place = bucket[order], place[order]
        first = np.ones(len(bucket), bool)
        first[1:] = bucket[1:] != bucket[:-1]
        later = np.flatnonzero(~first)
        pairs = np.unique(np.stack([place[later - 1], place[later]], axis=1), axis=0)
        pairs = pairs[(pairs[:, 0] != pairs[:, 1])]
        names = pa.array(nodes, pa.binary())
        at = np.concatenate([place[first], pairs[:, 0]])
        partner = np.concatenate([np.full(first.sum(), -1), pairs[:, 1]])
        none = partner < 0
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([bucket[first], mixed(pairs.astype(np.uint64).sum(axis=1)).astype(np.int64)])),
                names.take(pa.array(at)),
                pa.array(n[at]),
                names.take(pa.array(partner, mask=none)),
                pa.array(n[partner], mask=none),
            ],
            names=["bucket", "node", "n", "other", "m"],
        )


def within(a: list[int], b: list[int], most: int, band: int = BAND) -> int | None:
    """Edit distance of two word lists if it is at most `most`.

    Furthest points on the diagonals of a growing band; beyond `band` changes, whole columns as bits of a number.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    start = 0
    while start < n and start < m and a[start] == b[start]:
        start += 1
    if n == m == start:
        return 0
    far = {0: start}
    for distance in range(1, min(most, band) + 1):
        new = {}
        for k in range(-distance, distance + 1):
            x = max(far.get(k, -2) + 1, far.get(k - 1, -2) + 1, far.get(k + 1, -2))
            if x < 0 or x > n or x - k < 0 or x - k > m:
                x = min(x, n, m + k)
                if x < 0 or x - k < 0:
                    continue
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            if x == n and y == m:
                return distance
            new[k] = x
        far = new
    return _by_columns(a[start:], b[start:], most) if most > band else None


def _by_columns(a: list[int], b: list[int], most: int) -> int | None:
    """Edit distance if at most `most`: bit i of `up` and `down` says how a column of the table goes on at word i of a."""
    if not a or not b:
        distance = max(len(a), len(b))
        return distance if distance <= most else None
    places: dict[int, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance, left = every, 0, len(a), len(b)
    for word in b:
        equal, left = places.get(word, 0), left - 1
        level = (((equal & up) + up) ^ up) | equal
        right, back = (down | ~(level | up)) & every, up & level
        distance += 1 if right & last else -1 if back & last else 0
        if distance - left > most:
            return None
        right, equal = right << 1 | 1, equal | down
        up, down = (back << 1 | ~(equal | right)) & every, right & equal & every
    return distance


def similarity(a: list[int], b: list[int], least: float = SIMILARITY) -> float:
    """1 - distance / longer length of two word lists, or 0 if that is below `least`."""
    longer = max(len(a), len(b))
    most = int(longer * (1 - least) + 1e-9)
    if not longer or longer - min(len(a), len(b)) > most:
        return 0.0 if longer else 1.0
    shared = sum((Counter(a) & Counter(b)).values())  # no alignment can match more
    if longer - shared > most:
        return 0.0
    distance = within(a, b, most, BAND if longer - shared <= BAND else 0)
    return 0.0 if distance is None else 1 - distance / longer


class Remembered(dict):
    """Values that `make` gives for keys, words first; all are forgotten where they have more than MOST_WORDS words."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, key):
        value = self.make(key)
        self.held += len(value[0])
        if self.held > MOST_WORDS:
            self.clear()
            self.held = len(value[0])
        self[key] = value
        return value


def aligned(left: Column, right: Column) -> Column:
    """Similarity of two texts, or 0 if that is below SIMILARITY."""

    @F.pandas_udf("double")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        hashes = WordHashes()

        def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
            """Words, and the same as a set in which repeated words differ."""
            words = hashes.of(text)
            return words, mixed(words + occurrences(words))

        for some, others in pairs:
            known, out = Remembered(counted), []
            for one, other in zip(some, others):
                (a, x), (b, y) = known[one], known[other]
                least = max(len(a), len(b)) * SIMILARITY - 1e-6
                near = min(len(a), len(b)) >= least and len(np.intersect1d(x, y, assume_unique=True)) >= least
                out.append(similarity(a.tolist(), b.tolist()) if near else 0.0)
            yield pd.Series(out)

    return run(left, right)


def candidate_links(sketched: DataFrame) -> DataFrame:
    """sketched → a, b: pairs to verify first, a < b; a bucket's members with the next and the first one."""
    met = sketched.select("node", "n", "sketch").mapInArrow(buckets, _LINK)
    met = met.withColumn("linked", F.col("other").isNotNull())
    order = Window.partitionBy("linked", "bucket").orderBy("n", "node")
    met = met.withColumn("member", F.struct("node", "n"))
    met = met.withColumn("last", F.lag("member").over(order)).withColumn("head", F.first("member").over(order))
    partners = F.when(F.col("linked"), F.array(F.struct(F.col("other").alias("node"), F.col("m").alias("n"))))
    met = met.withColumn("partners", partners.otherwise(F.array("last", "head")))
    pairs = met.select("node", "n", F.explode("partners").alias("p")).where("p is not null and p.node <> node")
    pairs = pairs.where(F.least("n", "p.n") >= F.greatest("n", "p.n") * SIMILARITY - 1e-6)
    return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _alike(left: np.ndarray, right: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether counts leave room for SIMILARITY: an inserted or deleted word changes them by one, a replaced by two."""
    apart = np.abs(left.astype(np.int16) - right).sum(axis=1)
    return apart <= 2 * np.floor(longer * (1 - SIMILARITY) + 1e-6)


def _shared(tallies: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of pairs sorted by x: how many words both texts have, by their labels; never less than they have."""
    found, marks = np.zeros(len(x), np.int64), np.zeros(1 << 16, bool)
    label = {i: labels(tallies[i]) for i in np.union1d(x, y).tolist()}
    last = -1
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        if a != last:
            marks[:] = False
            marks[label[a]] = True
            last = a
        found[i] = np.count_nonzero(marks[label[b]])
    return found


def _linking(tallies: list[np.ndarray], kind: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[int]:
    """Which of the pairs are near and link two classes that the pairs before have not linked."""
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while k in parent:
            parent[k] = k = parent.get(parent[k], parent[k])
        return k

    words, found = Remembered(lambda i: (tallies[i].tolist(),)), []
    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        u, v = root(int(kind[a])), root(int(kind[b]))
        if u != v and similarity(words[a][0], words[b][0]) >= SIMILARITY:
            parent[u] = v
            found.append(i)
    return found


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, low, high), two blocks of a bucket or one → pairs of near texts that link classes."""

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        keys = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
        n, kind, block = (rows.column(c).to_numpy() for c in ("n", "class", "block"))
        order = np.lexsort((n, *reversed(keys)))
        n, kind, block = n[order], kind[order], block[order]
        bucket, low, high = (k[order] for k in keys)
        taken = rows.take(pa.array(order))
        nodes = taken.column("node").combine_chunks()
        sketched = taken.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCHES)
        bucket, own = bucket.view(np.uint64), sketched.sum(axis=1)
        tallies = [np.frombuffer(t.as_buffer(), np.uint32) for t in taken.column("tally")]
        counted = np.stack([counts(t) for t in tallies])
        first = np.ones(len(n), bool)
        first[1:] = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        starts = np.append(np.flatnonzero(first), len(n))
        end = np.repeat(starts[1:], np.diff(starts))
        found, active, step = [], np.arange(len(n)), 0
        while len(active):
            step += 1
            active = active[active + step < end[active]]
            # by length, so those further on are too long as well
            active = active[n[active] >= n[active + step] * SIMILARITY - 1e-6]
            x, y = active, active + step
            some = (kind[x] != kind[y]) & ((low[x] == high[x]) | (block[x] != block[y]))
            x, y = x[some], y[some]
            some = _alike(counted[x], counted[y], n[y])
            x, y = x[some], y[some]
            # one of the buckets that two texts share compares them, by a hash of bucket and texts
            pair = own[x] + own[y]
            rank = mixed(np.where(sketched[x] == sketched[y], sketched[x], bucket[x, None]) + pair[:, None])
            some = rank.min(axis=1) >= mixed(bucket[x] + pair)
            found.append(np.stack([x[some], y[some]]))
        x, y = np.concatenate(found, axis=1)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        lacking = n[y] - _shared(tallies, x, y)
        some = np.flatnonzero(lacking <= np.floor(n[y] * (1 - SIMILARITY) + 1e-6))
        some = some[np.argsort(lacking[some] / n[y[some]], kind="stable")]  # the likeliest first
        x, y = x[some], y[some]
        links = _linking(tallies, kind, x, y)
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(p[links])) for p in (x, y)], names=["a", "b"])

    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        if not len(rows):
            continue
        # the last group may go on in the next batch
        same = np.logical_and.reduce([(c := rows.column(k).to_numpy()) == c[-1] for k in ("bucket", "low", "high")])
        begun = len(rows) - int(same.sum())
        if begun:
            yield pairs(rows.slice(0, begun))
        rest = rows.slice(begun)
    if rest is not None:
        yield pairs(rest)


def other_links(sketched: DataFrame, classes: DataFrame, done: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: pairs to verify besides `done`, a < b; they link what all members of a bucket whose classes differ would link.

    A bucket's largest class is not compared with itself: its blocks meet those of the others only.
    """
    members = sketched.select("node", "n", "sketch").dropDuplicates(["node"]).join(classes, "node")
    members = members.select("node", "n", "class", "sketch")
    members = staged(members, "members")
    met = members.select("class", F.explode("sketch").alias("bucket")).groupBy("bucket", "class").agg(F.count("*").alias("size"))
    shared = met.groupBy("bucket").agg(
        F.max(F.struct("size", "class")).alias("most"), F.sum("size").alias("size"), F.count("*").alias("classes")
    )
    # two members of a bucket have met in any case
    shared = staged(shared.where("classes > 1 and size > 2"), "buckets")
    parts = lambda size: F.ceil(size / block).cast("int")
    large = F.col("size") > block
    rows = members.select("node", "n", "class", "sketch", F.explode("sketch").alias("bucket")).join(shared, "bucket")
    rows = rows.withColumn("others", F.when(large, parts(F.col("size") - F.col("most.size"))).otherwise(1))
    rows = rows.withColumn("own", F.when(large, parts(F.col("most.size"))).otherwise(0))
    main, at = large & (F.col("class") == F.col("most.class")), F.xxhash64("node")
    rows = rows.withColumn("block", F.when(main, F.col("others") + F.pmod(at, "own")).otherwise(F.pmod(at, "others")).cast("int"))
    last = F.when(main, F.col("others")).otherwise(F.col("others") + F.col("own")) - 1
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    low, high = F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")
    rows = staged(rows.select("bucket", low, high, "block", "class", "node", "n", "sketch"), "blocks")
    told = sketched.select("node", "tally").join(rows.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    rows = rows.join(told, "node").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    pairs = rows.mapInArrow(compared, _PAIR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.distinct().join(done, ["a", "b"], "left_anti")


def verified_links(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of nodes → u, v: the classes of those that are near duplicates."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = ends.join(classes, "node").select("node", "class", F.col("first").alias("row"))
    texts = rows.select("row", "text").join(wanted, "row").select("node", "class", "text")
    left = texts.select(F.col("node").alias("a"), F.col("class").alias("u"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("class").alias("v"), F.col("text").alias("right"))
    held = pairs.join(left, "a").join(right, "b").select("u", "v", aligned(F.col("left"), F.col("right")).alias("similarity"))
    return held.where(F.col("similarity") >= SIMILARITY).select("u", "v")


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes (node, first, class) with those that links connect made one."""
    roots = components(links).select(F.col("node").alias("class"), "root")
    return classes.join(roots, "class", "left").select("node", "first", F.coalesce("root", "class").alias("class"))


def near_groups(docs: DataFrame) -> DataFrame:
    """docs (row, doc_id, text) → row, doc_id, class_id, group_size, kept; a row for each document."""
    node = F.expr("substring(unhex(sha2(coalesce(text, ''), 256)), 1, 16)")
    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), node.alias("node"), "text")
    alone = staged(rows.groupBy("node").agg(F.min("row").alias("first")).withColumn("class", F.col("first")), "classes")
    sketched = staged(rows.select("node", "text").mapInArrow(sketches, _SKETCH), "sketches")
    pairs = staged(candidate_links(sketched), "pairs")
    classes = staged(joined_classes(alone, verified_links(pairs, rows, alone)), "classes")
    others = staged(other_links(sketched, classes, pairs), "pairs")
    classes = joined_classes(classes, verified_links(others, rows, classes)).select("node", "class")
    members = rows.select("row", "doc_id", "node").join(classes, "node").select("row", "doc_id", "class")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    heads = members.groupBy("class").agg(F.min(place).alias("head"), F.count("*").alias("group_size"))
    return members.join(heads, "class").select(
        "row",
        "doc_id",
        F.col("head.doc_id").alias("class_id"),
        "group_size",
        (F.col("row") == F.col("head.row")).alias("kept"),
    )


def label_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) → doc_id, class_id, group_size, kept."""
    return near_groups(numbered(docs.select("doc_id", "text"), "row")).drop("row")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each group of near duplicates, with all its columns."""
    row = "__row_of_near_dedup"
    rows = numbered(docs, row)
    found = near_groups(rows.select(F.col(row).alias("row"), "doc_id", "text"))
    return rows.join(found.where("not kept").select(F.col("row").alias(row)), row, "left_anti").drop(row)
