"""Conversation repair, spelling variants and personal data against brute force, on odd rows and in small memory."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import conversation_repair as cr
from sightline.llm import pii
from sightline.llm import spelling_variants as sv

# Conversations


def cheapest(rows):
    """All edits of a few rows (role, text, fault): the least (cost, audit), and the repaired lines."""
    inserts = ("", "u", "a", "ua", "au")
    names, found = {"u": "user", "a": "assistant"}, []
    per_row = []
    for role, text, fault in rows:
        late = 5 if fault == "truncated" else 0
        options = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            options += [("K", late, (role, text))] + [("R", 1 + late, (names[x], text)) for x in "ua"]
        per_row.append([(i, *o) for i in inserts for o in options])
    for choice in itertools.product(*per_row, inserts):
        audit, cost, lines = "", 0, []
        for ins, edit, price, line in choice[:-1]:
            audit, cost = audit + "I" * len(ins) + edit, cost + price + 5 * len(ins)
            lines += [(names[x], "") for x in ins] + ([line] if line else [])
        audit, cost = audit + "I" * len(choice[-1]), cost + 5 * len(choice[-1])
        lines += [(names[x], "") for x in choice[-1]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in lines)):
            found.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)))
    return min(found)


def test_repair_against_all_edits():
    rng = random.Random(2)
    for _ in range(60):
        rows = [
            (
                rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", " "]),
                f"t{i}.",
                rng.choice(["", "", "", "blank", "duplicate", "truncated"]),
            )
            for i in range(rng.randrange(4))
        ]
        cost, audit, body = cheapest(rows)
        for limit in (4, 1 << 20):
            state = cr.Repair(limit)
            for i, row in enumerate(rows):
                state.add(i, *row)
            got = state.result()
            assert (got[5], got[6]) == (cost, audit), rows
            assert got[7] == hashlib.sha256(body.encode()).hexdigest()


def test_long_conversation_spills():
    results = []
    for limit in (64, 1 << 30):
        state, rng = cr.Repair(limit), random.Random(5)
        for i in range(5000):
            state.add(i, rng.choice(["user", "assistant"]), str(i), rng.choice(["", "", "truncated", "blank"]))
        assert limit > 64 or (state.pointers.file is not None and len(state.pointers.memory) < 64)
        results.append(state.result())
    assert results[0] == results[1]


def test_repair_of_odd_rows(spark):
    rows = [(1, None, "user", "a."), (1, 0, None, None), (1, 1, "user", "  "), (1, 2, "assistant", "b! \n")]
    rows += [(None, 0, "user", "x."), (None, 1, "assistant", "y"), (2, 7, "", "z" * 200_000)]
    rows += [(3, 0, "user", "q?"), (3, 0, "user", "q?"), (3, 5, "assistant", "q?"), (9, 3, "user", None)]
    schema = "conv_id bigint, turn bigint, role string, text string, fault string, copy string, conv string"
    df = spark.createDataFrame([(*r, "f", "c", "v") for r in rows], schema)
    results = []
    for size in ("1", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        results.append({r.conv_id: tuple(r)[1:] for r in cr.repair_damaged(df).collect()})
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert results[0] == results[1] and set(results[0]) == {1, 2, 3, 9, None}
    clean = cr.repair(df.withColumn("copy", F.lit(0)).fillna(" ", ["role", "text"]))
    got = {r.conv_id: r for r in clean.collect()}
    assert (got[3].duplicate, got[3].gaps, got[3].audit, got[3].cost) == (1, 4, "KDK", 2)
    assert (got[1].blank, got[1].illegal, got[1].gaps) == (2, 2, 0) and got[1].audit == "KDDK"
    assert (got[None].truncated, got[None].audit) == (1, "DD") and got[2].audit == "D"
    dropped = next(i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    only = cr.repair_damaged(spark.createDataFrame([(dropped, 0, "user", "a.")], "conv_id int, turn int, role string, text string"))
    assert tuple(only.first()) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cr.repair_damaged(df.limit(0)).count() == 0


def test_faults_know_white_space_from_letters(spark):
    texts = ["end. 0", "xb", "c", "\x0b\x0c", "done.\x0c\x0b", "abc.", "ok! x", "a.\x1f", "b?\u2028", "\r\n\t "]
    rows = [(i, 0, "user", t, 0) for i, t in enumerate(texts)]
    found = cr.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, copy int")).collect()
    body = [t.rstrip(" \t\n\x0b\x0c\r") for t in texts]
    assert {r.conv_id: (r.blank, r.truncated) for r in found} == {
        i: (int(not b), int(bool(b) and b[-1] not in ".!?")) for i, b in enumerate(body)
    }


def test_one_giant_conversation(spark):
    rows = spark.range(30_000).selectExpr(
        "7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('t', id, '.') as text", "0 as copy"
    )
    found = cr.repair(rows, spill_bytes=4096).first()
    assert (found.cost, found.audit, found.gaps) == (0, "K" * 30_000, 0)


# Spelling


def spelled(docs, least=5):
    """The contract, plainly: word → (n, n_near, form, form_n, root)."""
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (words[w], len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w in words}


@pytest.fixture(scope="module")
def scribbled(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abéÿÀz") for _ in range(rng.randrange(5, 10))) for _ in range(30)]
    words = []
    for w in base:
        words += [w] * rng.choice([5, 30, 200, 1000])
        for _ in range(4):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i + 1 :], w[:i] + "z" + w[i:], w.upper()])] * rng.choice([1, 5, 40])
    # A chain of forms, a word of one letter repeated, and one too long for a shard of its own.
    words += ["chains"] * 800 + ["chainz"] * 150 + ["chaiinz"] * 28 + ["chaiqnz"] * 5 + ["aaaaaa"] * 30 + ["aaaaaaa"] * 5
    words += ["x" * 3000] * 6 + ["x" * 1500 + "y" + "x" * 1499] * 40
    rng.shuffle(words)
    docs = [(i, rng.choice([" ", ", ", "1", "漢"]).join(words[i::40])) for i in range(40)]
    docs += [(None, "chains chains"), (50, None), (51, ""), (52, "1 2 3"), (0, docs[0][1]), (0, docs[0][1])]
    schema = "doc_id bigint, text string, word string, n string, near string, form string, root string"
    return docs, spark.createDataFrame([(*d, "w", "n", "x", "f", "r") for d in docs], schema)


@pytest.mark.parametrize("size", [sv.FILTER_BYTES, 64])
def test_spelling_against_all_pairs(scribbled, size):
    docs, df = scribbled
    found = sv.group_variants(df, filter_bytes=size).collect()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in found}
    want = spelled(docs)
    assert len(found) == len(got) and got == want
    assert got["chaiqnz"][4] == "chains" and got["x" * 3000][2] is not None


def test_spelling_in_small_steps(scribbled, monkeypatch):
    docs, df = scribbled
    want = spelled(docs)
    counts = collections.Counter()
    for key, text in docs:
        counts.update(sv.damaged_counts(text or "", "" if key is None else str(key)))
    assert {w.decode("latin-1"): c for w, c in counts.items() if c >= 5} == {w: x[0] for w, x in want.items()}
    monkeypatch.setattr(sv, "EDITS_AT_ONCE", 50)
    words = sorted(w for w in want if len(w) < 100)
    known = sv.Filter(dict(collections.Counter(map(len, words))))
    known.blocks = np.zeros(int(known.sizes.sum()), np.uint64)
    for _, letters in sv._by_length(words):
        np.bitwise_or.at(known.blocks, *known.places(sv._hashes(letters), letters.shape[1]))
        assert known.holds(sv._hashes(letters), letters.shape[1]).all()
    alphabet = np.array(sorted({ord(c) for w in words for c in w}), np.uint8)
    pairs = set()
    for places, letters in sv._by_length(words):
        for row, near in sv._positives(letters, known, alphabet):
            if near.decode("latin-1") in want:
                pairs.add(frozenset((words[places[row]], near.decode("latin-1"))))
    assert len(pairs) == sum(x[1] for w, x in want.items() if len(w) < 100) / 2


def test_spelling_of_nothing(scribbled):
    _, df = scribbled
    assert sv.group_variants(df.limit(0)).count() == 0
    assert sv.group_variants(df.where("doc_id >= 50")).count() == 0


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    def ok(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and passes_luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok(k, m.group()))


CARD, OTHER = "4465758382889437", "5555 5555 5555 4444"


@pytest.fixture(scope="module")
def private(spark):
    rng = random.Random(3)
    alphabet = ["a", "b.c", "@", ".", "1", "25", "+", "+1 ", " (2", ") ", "-", "\n", "é", "x@y.de", "_", "1.2.3", ".4", "+49 30 123456", CARD, "😀"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    texts += [None, "", "1.2.3.4.5.6.7.8 a@b.c@d.e a@b.c_d@e.fr", "256.1.1.1", "000255.1.1.1", "+1" + " " * 300 + "23456789"]
    texts += ["9" * 60_000, "1 " * 60_000, "x" * 60_000, "a." * 30_000 + "@b.c", "1." * 30_000, "@a" * 20_000, "+1 " * 30_000]
    plain = [f"Call ban +1 (499) 555-{i:04d} or mail u{i}@mail.example.com, host 10.1.2.{i % 200}, card {CARD} now" for i in range(200)]
    hidden = [f"two cards {CARD} {CARD} here", f"paid with card 12 {OTHER} today", "mail jo.doe (at) mail (dot) example (dot) com now"]
    clean = ["version 1.2.3 of 2024-01-15, order 1234-56, 3 of 4 at noon", "about 1 000 000 000 000 000 000 000 000 stars", "4465758382889438"]
    rows = [(i if i % 7 else None, t) for i, t in enumerate([*texts, *plain])]
    rows += [(5000 + i, t) for i, t in enumerate(hidden)] + [(6000 + i, t) for i, t in enumerate(clean)] + [(1, "a@b.c"), (1, "a@b.c")]
    schema = "doc_id bigint, text string, row string, kind string, start string, spans string"
    df = spark.createDataFrame([(*r, "r", "k", "s", "p") for r in rows], schema)
    return rows, df, pii.find_private(df).collect()


def test_base_spans_of_odd_texts(private):
    rows, _, found = private
    want = collections.Counter((k, hashlib.sha256(base_spans(t).encode()).hexdigest()) for k, t in rows)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in found) == want
    by_id = {k: base_spans(t).split(",") for k, t in rows if k is not None}
    for r in found:
        if r.doc_id is not None and r.doc_id != 1:  # 1 stands for several texts
            base, own = set(by_id[r.doc_id]) - {""}, r.spans.split(",")
            assert base <= set(own)
            counts = collections.Counter(s.split(":")[0] for s in base)
            assert [counts[k] for k in pii.KINDS] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
            spans = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in own if s)]
            assert spans == sorted(spans)


def test_hidden_spans_are_added_and_clean_texts_left_alone(private):
    rows, _, found = private
    text = dict(rows)
    got = {r.doc_id: [text[r.doc_id][int(a) : int(b)] for _, a, b in (s.split(":") for s in r.spans.split(",") if s)] for r in found if r.doc_id}
    assert got[5000] == [CARD, CARD] and got[5001] == [OTHER]
    assert got[5002] == ["jo.doe (at) mail (dot) example (dot) com"]
    assert all(not got[i] for i in (6000, 6001, 6002))
    for r in found:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        base = set(base_spans(text[r.doc_id]).split(",")) if r.doc_id and r.doc_id != 1 else None
        for k, a, b in spans if base is not None else []:
            if f"{k}:{a}:{b}" not in base:
                assert all(int(y[2]) <= int(a) or int(y[1]) >= int(b) for y in spans if y != [k, a, b])


def test_private_of_nothing(spark, private):
    _, df, _ = private
    assert pii.find_private(df.limit(0)).count() == 0
    got = pii.find_private(spark.createDataFrame([(1, "no data"), (2, None)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.spans, r.n_added) for r in got) == [(1, "", 0), (2, "", 0)]


def test_reliabilities_are_found():
    """Labelers of known reliability: the posterior of a pattern of votes is near the true one."""
    right, rng = [0.95, 0.9, 0.8, 0.7, 0.55], random.Random(8)
    votes, truth = collections.Counter(), collections.Counter()
    for _ in range(40_000):
        yes = rng.random() < 0.4
        v = tuple((1 if yes else -1) * (1 if rng.random() < p else -1) for p in right)
        votes[v] += 1
        truth[v] += yes
    got = pii.estimate([(0, v, n) for v, n in votes.items()])
    error = sum(n * abs(got[0, v] - truth[v] / n) for v, n in votes.items()) / 40_000
    assert error < 0.05
    weights = pii.fit([(0, (1, 0, 1, 1, 1), 95.0, 100), (0, (2, 0, 1, 1, 0), 5.0, 100)])[0]
    assert weights["size", 1] > 0 > weights["size", 2]


def test_no_python_in_the_plan(private):
    _, df, _ = private
    text = pii.find_private(df)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
