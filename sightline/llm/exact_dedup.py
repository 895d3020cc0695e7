"""Exact duplicates by Patricia tries (operator 4).

Texts are compared after deleting ASCII white space. Every map task first joins the copies among its
own rows in a trie, so that a group of any size sends one text per task. The texts are then dealt out
by (length, SHA-256); each partition inserts the full byte strings into a compressed radix trie whose
terminal nodes hold the best identifier and the number of rows. A trie that outgrows its budget spills
whole subtrees to an unnamed temporary file of the task and takes them up one by one at the end.

Of equal texts the row with the most code points stays, then the smallest doc_id (null last), then the
first row read. Null text counts as empty. Repeated rows are rows of their own, so one of them stays.
An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, numbered

#: Bytes of a task's trie at which the map side sends its texts on, and the reduce side spills a subtree.
TRIE_BYTES = 96 << 20
NODE_BYTES = 400
_HEAD = struct.Struct("<qq?qqq")
_ENTRY = "length long, sha string, body binary, points long, doc_id long, row long, n long"
_OWNER = "length long, sha string, keep_id long, keep_row long, group_size long"


def shared_prefix(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of `label` and `key[at:]`."""
    if key.startswith(label, at):
        return len(label)
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    __slots__ = ("label", "children", "best", "n", "spilled")

    def __init__(self, label: bytes):
        self.label, self.children, self.best, self.n, self.spilled = label, {}, None, 0, None


class Trie:
    """Byte strings with, at each, the smallest rank seen and a count. Keeps about `budget` bytes in memory."""

    def __init__(self, budget: int = TRIE_BYTES):
        self.root, self.size, self.budget, self.spills = Node(b""), 0, budget, 0

    def add(self, key: bytes, rank: tuple, n: int) -> None:
        node, at = self.root, 0
        while at < len(key) and node.spilled is None:
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.size += len(child.label) + NODE_BYTES
                node, at = child, len(key)
                break
            same = shared_prefix(child.label, key, at)
            if same < len(child.label):
                fork = Node(child.label[:same])
                fork.children[child.label[same]] = child
                child.label = child.label[same:]
                node.children[key[at]] = fork
                self.size += NODE_BYTES
                child = fork
            node, at = child, at + same
        if node.spilled is not None:
            self._write(node.spilled, key[at:], rank, n)
            return
        node.n += n
        if node.best is None or rank < node.best:
            node.best = rank
        if self.size > self.budget:
            self._spill()

    @staticmethod
    def _write(file, rest: bytes, rank: tuple, n: int) -> None:
        points, no_id, doc_id, row = rank
        file.write(_HEAD.pack(len(rest), points, no_id, doc_id, row, n) + rest)

    @staticmethod
    def _weigh(node: Node) -> int:
        total, todo = 0, [node]
        while todo:
            x = todo.pop()
            total += len(x.label) + NODE_BYTES
            todo.extend(x.children.values())
        return total

    def _spill(self) -> None:
        """Write out the heaviest subtree below the first fork that is not spilled yet."""
        node = self.root
        while len(node.children) == 1 and next(iter(node.children.values())).spilled is None:
            node = next(iter(node.children.values()))
        open_ones = [c for c in node.children.values() if c.spilled is None and c.children]
        if not open_ones:
            open_ones = [c for c in node.children.values() if c.spilled is None] if len(node.children) > 1 else []
        if not open_ones:
            self.budget = self.size + self.budget  # one text, or a line of texts that each extend the last
            return
        weight, heaviest = max(((self._weigh(c), c) for c in open_ones), key=lambda x: x[0])
        file = tempfile.TemporaryFile()
        for rest, rank, n in self._walk(heaviest, b""):
            self._write(file, rest, rank, n)
        heaviest.children, heaviest.best, heaviest.n, heaviest.spilled = {}, None, 0, file
        self.size -= weight - len(heaviest.label) - NODE_BYTES
        self.spills += 1

    def _walk(self, top: Node, prefix: bytes) -> Iterator[tuple[bytes, tuple, int]]:
        todo = [(top, prefix)]
        while todo:
            node, path = todo.pop()
            if node.spilled is not None:
                inner = Trie(self.budget)
                node.spilled.seek(0)
                while head := node.spilled.read(_HEAD.size):
                    length, points, no_id, doc_id, row, n = _HEAD.unpack(head)
                    inner.add(node.spilled.read(length), (points, no_id, doc_id, row), n)
                node.spilled.close()
                for rest, rank, n in inner._walk(inner.root, b""):
                    yield path + rest, rank, n
                continue
            if node.n:
                yield path, node.best, node.n
            todo.extend((c, path + c.label) for c in node.children.values())

    def entries(self) -> Iterator[tuple[bytes, tuple, int]]:
        """(key, smallest rank, count) of all keys."""
        return self._walk(self.root, b"")


def _bodies(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.binary()):
        yield (text.as_py() or b"").translate(None, SPACE)


def _points(batch: pa.RecordBatch) -> list[int]:
    return pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One thin row per document: its length and SHA-256 without white space."""
    for batch in batches:
        lengths, shas = [], []
        for body in _bodies(batch):
            lengths.append(len(body))
            shas.append(hashlib.sha256(body).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(shas, pa.string())],
            names=["row", "doc_id", "length", "sha"],
        )


def _sized(rows: Iterator[tuple], schema: pa.Schema, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about `most` bytes from (bytes, row) pairs."""
    held, size = [], 0
    for weight, row in rows:
        held.append(row)
        size += weight + 64
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def joined_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: the distinct texts of this task, each with its best row and count."""
    schema = pa.schema(
        [("length", pa.int64()), ("sha", pa.string()), ("body", pa.binary()), ("points", pa.int64())]
        + [("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64())]
    )

    def flush(trie: Trie) -> Iterator[tuple]:
        for key, (points, no_id, doc_id, row), n in trie.entries():
            sha = hashlib.sha256(key).hexdigest()
            yield len(key), (len(key), sha, key, -points, None if no_id else doc_id, row, n)

    def rows() -> Iterator[tuple]:
        trie = Trie(2 * TRIE_BYTES)
        for batch in batches:
            ids, numbers = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for body, points, doc_id, row in zip(_bodies(batch), _points(batch), ids, numbers):
                trie.add(body, (-points, doc_id is None, doc_id or 0, row), 1)
                if trie.size > TRIE_BYTES:
                    yield from flush(trie)
                    trie = Trie(2 * TRIE_BYTES)
        yield from flush(trie)

    yield from _sized(rows(), schema)


def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: the trie of one partition; a row per distinct text."""
    schema = pa.schema(
        [("length", pa.int64()), ("sha", pa.string())]
        + [(c, pa.int64()) for c in ("keep_id", "keep_row", "group_size")]
    )
    trie = Trie()
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("points", "doc_id", "row", "n")]
        for body, points, doc_id, row, n in zip(batch.column("body"), *columns):
            trie.add(body.as_py(), (-points, doc_id is None, doc_id or 0, row), n)

    def rows() -> Iterator[tuple]:
        for key, (_, no_id, doc_id, row), n in trie.entries():
            yield 100, (len(key), hashlib.sha256(key).hexdigest(), None if no_id else doc_id, row, n)

    yield from _sized(rows(), schema)


def exact_groups(docs: DataFrame) -> DataFrame:
    """docs (row, doc_id, text) → row, doc_id, keep_id, group_size, kept, text_sha256; a row for each document."""
    rows = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    thin = rows.mapInArrow(fingerprints, "row long, doc_id long, length long, sha string")
    texts = rows.mapInArrow(joined_copies, _ENTRY).repartition("length", "sha")
    best = texts.mapInArrow(owners, _OWNER)
    return thin.join(best, ["length", "sha"]).select(
        "row",
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def label_duplicates(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) → doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(numbered(docs.select("doc_id", "text"), "row")).drop("row")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    row = "__row_of_exact_dedup"
    rows = numbered(docs, row)
    plain = rows.select(F.col(row).alias("row"), "doc_id", "text")
    gone = exact_groups(plain).where("not kept").select(F.col("row").alias(row))
    return rows.join(gone, row, "left_anti").drop(row)
