"""Conversation structure repair by secondary-sorted streaming (operator 11).

Rows are repartitioned by conversation and sorted by turn, and mapInPandas walks them row by row. What
it carries from one Arrow batch to the next is the state of a dynamic program over four situations:
nothing written yet, a system turn last, a user turn last, an assistant turn last. For each of them it
knows the cheapest edits that lead there, as a cost, a rank and a running SHA-256. The rank compares the
edits of two situations as text, so ties fall to the ASCII-least without the texts being kept. The only
thing that grows is one back pointer of four bytes a row; those go to a task-local file, which a repeated
task writes anew, once they pass `SPILL_BYTES`, and are read backwards when the conversation ends.

Edits: Keep (0), Rerole to user or assistant (1), Delete (2; the only one for blank and repeated rows),
Insert an empty turn (5); a truncated row that stays adds 5. The roles that result are an optional system
turn and pairs of user and assistant turns, or nothing. Repeated rows are marked before, in the same
partitioning, by a window over (conversation, role, text), which Spark sorts on disk if need be.

Memory: rows of one conversation are never gathered. A conversation is read by one task, as the method
has it, with work in proportion to its rows.

Defined results: a null role or text is one space, a null conversation id is a conversation of its own,
null turns come first. Rows of one turn stand in the order of role and text, so that repeated rows and
ties give one result. A role whose first letter is not s, u or a, or which is empty, is never kept as it
is. Very long texts are hashed in place. A conversation without rows left gives zeros, an empty audit and
the hash of nothing; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Back pointers of one conversation that stay in memory, in bytes.
SPILL_BYTES = 1 << 20
RESULT = (
    "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,"
    " cost bigint, audit string, repaired_sha256 string"
)

_WHITE = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: Edits in ASCII order; an insertion is always followed by a row that is kept or gets a role.
_EDITS = ("D", "IK", "IR", "K", "R")
_COSTS = {"D": 2, "IK": 5, "IR": 6, "K": 0, "R": 1}
_TRUNCATED_STAYS = 5
_CLOSING_INSERT = 5
#: What one more turn does: situation → (situation after a user turn, after an assistant turn).
_AFTER_USER = {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}
_AFTER_ASSISTANT = {_USER: _ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_NEVER = 1 << 62


def _steps(edit: str, initial: str) -> list[tuple[int, int, str, str]]:
    """All (from, to, inserted role, new role) by which an edit takes a row; no new role keeps the row's own."""
    found = []
    befores = [(p, p, "") for p in range(4)]
    if edit[0] == "I":
        befores = [(p, q, "user") for p, q in _AFTER_USER.items()]
        befores += [(p, q, "assistant") for p, q in _AFTER_ASSISTANT.items()]
    for p, now, inserted in befores:
        if edit == "D":
            found.append((p, p, "", ""))
        elif edit[-1] == "R":
            found += [(p, _AFTER_USER[now], inserted, "user")] if now in _AFTER_USER else []
            found += [(p, _AFTER_ASSISTANT[now], inserted, "assistant")] if now in _AFTER_ASSISTANT else []
        elif initial == "s" and now == _START:
            found.append((p, _SYSTEM, inserted, ""))
        elif initial == "u" and now in _AFTER_USER:
            found.append((p, _AFTER_USER[now], inserted, ""))
        elif initial == "a" and now in _AFTER_ASSISTANT:
            found.append((p, _AFTER_ASSISTANT[now], inserted, ""))
    return found


def _moves(initial: str, fault: str) -> list[tuple[int, int, int, int, str, str]]:
    """(to, from, edit number, cost, inserted role, new role) of every way to treat a row."""
    extra = _TRUNCATED_STAYS if fault == "truncated" else 0
    return [
        (q, p, n, _COSTS[edit] + (extra if edit != "D" else 0), inserted, role)
        for n, edit in enumerate(_EDITS)
        if edit == "D" or fault not in ("blank", "duplicate")
        for p, q, inserted, role in _steps(edit, initial)
    ]


_MOVES = {(c, f): _moves(c, f) for c in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}


class _Pointers:
    """Four bytes a row, appended in order and read from the end; what passes `limit` goes to a file."""

    def __init__(self, limit: int):
        self.limit, self.memory, self.file = limit, bytearray(), None

    def add(self, row: bytes) -> None:
        self.memory += row
        if len(self.memory) >= self.limit:
            self.file = self.file or tempfile.TemporaryFile(prefix="pointers-")
            self.file.write(self.memory)
            self.memory = bytearray()

    def backwards(self) -> Iterator[bytes]:
        yield from (bytes(self.memory[i : i + 4]) for i in range(len(self.memory) - 4, -1, -4))
        if self.file:
            end, block = self.file.tell(), max(4, self.limit // 4 * 4)
            while end:
                begin = max(0, end - block)
                self.file.seek(begin)
                part = self.file.read(end - begin)
                yield from (part[i : i + 4] for i in range(len(part) - 4, -1, -4))
                end = begin
            self.file.close()


class Repair:
    """The streaming state of one conversation: add its rows in order, then take the result."""

    def __init__(self, spill_bytes: int = SPILL_BYTES):
        self.cost = [0, _NEVER, _NEVER, _NEVER]
        self.rank = [0, 0, 0, 0]
        self.sums = [hashlib.sha256(), None, None, None]
        self.pointers = _Pointers(spill_bytes)
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0
        self.initial: str | None = None
        self.least = self.most = None
        self.distinct = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.distinct += turn != self.most
            self.most = turn
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in _LEGAL
        self.initial = initial

        best: list[tuple | None] = [None] * 4
        for q, p, n, cost, inserted, new_role in _MOVES[initial if initial in ("s", "u", "a") else "", fault]:
            if self.cost[p] < _NEVER:
                key = (self.cost[p] + cost, self.rank[p], n)
                if best[q] is None or key < best[q][0]:
                    best[q] = (key, p, inserted, new_role)
        order = sorted(x[0][1:] for x in best if x)
        sums: list = [None] * 4
        pointers = bytearray(4)
        for q, x in enumerate(best):
            if x:
                key, p, inserted, new_role = x
                pointers[q] = p * len(_EDITS) + key[2]
                sums[q] = self._written(p, key[2], inserted, new_role or role, text)
        self.cost = [x[0][0] if x else _NEVER for x in best]
        self.rank = [order.index(x[0][1:]) if x else 0 for x in best]
        self.sums = sums
        self.pointers.add(bytes(pointers))

    def _written(self, p: int, edit: int, inserted: str, role: str, text: str):
        done = self.sums[p].copy()
        if _EDITS[edit] != "D":
            lines = [f"{inserted}:"] if inserted else []
            joined = "\n".join([*lines, f"{role}:{text}"])
            done.update((joined if p == _START else "\n" + joined).encode(errors="surrogatepass"))
        return done

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of the repaired turns."""
        ends = [(self.cost[q], self.rank[q], "", q) for q in (_START, _ASSISTANT)]
        ends.append((self.cost[_USER] + _CLOSING_INSERT, self.rank[_USER], "I", _USER))
        cost, _, closing, state = min(e for e in ends if e[0] < _NEVER)
        total = self.sums[state].copy()
        if closing:
            total.update(b"\nassistant:")
        # Letters come out backwards into one buffer: a byte for each, and "IK" is written as K, I.
        letters, at = bytearray(closing.encode()), state
        for row in self.pointers.backwards():
            p, n = divmod(row[at], len(_EDITS))
            letters += _EDITS[n][::-1].encode()
            at = p
        letters.reverse()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (gaps, *self.counts.values(), self.illegal, cost, letters.decode(), total.hexdigest())


def _streamed(spill_bytes: int):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        current, state, out = None, None, []
        for batch in batches:
            columns = [batch[c].tolist() for c in ("conv", "turn", "role", "text", "fault")]
            for conv, turn, role, text, fault in zip(*columns, strict=True):
                if state is None or conv != current:
                    if state is not None:
                        out.append((current, *state.result()))
                    current, state = conv, Repair(spill_bytes)
                if fault != "gone":
                    state.add(int(turn) if turn else None, role, text, fault)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if state is not None:
            yield pd.DataFrame([(current, *state.result())], columns=names)

    return walk


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy: rows as crc32(`conv_id:turn`) mod 20 leaves them; a dropped row keeps its place with a null role."""
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(column("conv_id"), F.lit(":"), column("turn"))
    what = F.crc32(key.cast("binary")) % 20
    role = F.when(what == 4, F.lit("user")).otherwise(column("role"))
    text = F.when(what == 1, F.lit("")).when(what == 2, F.regexp_replace(column("text"), "[.!?]", ""))
    gone = what == 0
    return conversations.select(
        "conv_id",
        "turn",
        F.when(~gone, role).alias("role"),
        F.when(~gone, text.otherwise(column("text"))).alias("text"),
        F.explode(F.when(what == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _fault(again: Column) -> Column:
    body = F.rtrim("text", F.lit(_WHITE))
    ended = F.substring(body, -1, 1).isin(".", "!", "?")
    return (
        F.when(F.col("role").isNull(), "gone")
        .when(body == "", "blank")
        .when(again, "duplicate")
        .when(~ended, "truncated")
        .otherwise("")
    )


def repair(rows: DataFrame, spill_bytes: int = SPILL_BYTES) -> DataFrame:
    """Rows (conv_id, turn, role, text, copy) → per conv_id the counted faults, the cheapest repair and its hash.

    A row with a null role is no turn; it only says that the conversation exists.
    """
    kind = rows.schema["conv_id"].dataType
    dealt = rows.select("conv_id", "turn", "role", "text", "copy").repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    marked = dealt.withColumn("fault", _fault(F.row_number().over(same) > 1))
    ordered = marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    # As texts, ids and turns pass through pandas without becoming floats; empty text is null.
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
    turn = F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("turn")
    found = ordered.select(conv, turn, "role", "text", "fault").mapInPandas(_streamed(spill_bytes), RESULT)
    conv_id = F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30)).cast(kind).alias("conv_id")
    return found.select(conv_id, *[c for c in found.columns if c != "conv"])


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage the conversations as `damaged` does, then repair them."""
    return repair(damaged(conversations))
