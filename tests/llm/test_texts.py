"""Exact dedup, near dedup, repeated passages and language models against plain versions, on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import components, elias_fano, exact_dedup, lm_scoring, near_dedup, substring_dedup
from sightline.llm.words import WordHashes, shingles

from .conftest import words


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups_match_brute_force(odd):
    rows = odd.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[plain(r.text)].append(r)
    got = exact_dedup.label_duplicates(odd).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for body, members in groups.items():
        keep = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)).doc_id
        for r in members:
            want[r.doc_id, keep, len(members), hashlib.sha256(body.encode()).hexdigest()] += 1
    assert collections.Counter((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got) == want
    assert collections.Counter(g.text_sha256 for g in got if g.kept) == collections.Counter(g.text_sha256 for g in set(got))\
        or sum(g.kept for g in got) == len(groups)


def test_exact_stage_keeps_columns_and_one_row(odd, empty):
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns
    bodies = [plain(r.text) for r in kept.collect()]
    assert len(bodies) == len(set(bodies)) == len({plain(r.text) for r in odd.collect()})
    assert exact_dedup.drop_duplicates(empty).count() == exact_dedup.label_duplicates(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=12), st.integers(0, 50)), max_size=60), st.sampled_from([1, 3000, 1 << 20]))
def test_trie_with_and_without_spills(entries, budget):
    trie, want, count = exact_dedup.Trie(budget), {}, collections.Counter()
    for key, doc in entries:
        rank = (0, False, doc, doc)
        trie.add(key, rank, 1)
        want[key] = min(want.get(key, rank), rank)
        count[key] += 1
    assert {k: (r, n) for k, r, n in trie.entries()} == {k: (want[k], count[k]) for k in want}


def test_trie_spills_subtrees():
    trie = exact_dedup.Trie(20_000)
    keys = [hashlib.sha256(str(i).encode()).digest() * 20 for i in range(300)]
    for i, key in enumerate(keys * 2):
        trie.add(key, (0, False, i, i), 1)
    assert trie.spills > 3
    assert {k: (r[2], n) for k, r, n in trie.entries()} == {k: (i, 2) for i, k in enumerate(keys)}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 14))
def test_banded_distance(a, b, most):
    want = levenshtein(a, b)
    assert near_dedup.within(a, b, most) == (want if want <= most else None)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 14), st.integers(0, 3))
def test_distance_beyond_the_band(a, b, most, band):
    want = levenshtein(a, b)
    assert near_dedup.within(a, b, most, band) == (want if want <= most else None)


def test_near_groups_on_odd_rows(odd, empty):
    got = near_dedup.label_near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(set)
    for g in got:
        by[g.doc_id].add(g.class_id)
    assert by[4] == by[5] == by[6] == by[7] == by[8] == {4}
    assert by[1] != by[3] and all(by[i] == {i} for i in (9, 10, 11, 12, 13, 14, 15, 16, 17))
    assert sum(g.kept for g in got) == len({(g.class_id, g.group_size) for g in got})
    stage = near_dedup.keep_one_of_each(odd)
    assert stage.columns == odd.columns and stage.count() == sum(g.kept for g in got)
    assert near_dedup.label_near_duplicates(empty).count() == 0


def test_near_groups_lose_no_link(spark):
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {g.doc_id: g.class_id for g in near_dedup.label_near_duplicates(sf).collect()}
    hashes = WordHashes()
    docs = {r.doc_id: hashes.of(r.text).tolist() for r in sf.collect()}
    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if near_dedup.similarity(docs[a], docs[b]) >= near_dedup.SIMILARITY and docs[a]:
                assert got[a] == got[b], (a, b)


def test_near_groups_are_those_of_all_pairs_in_a_bucket(spark):
    rng = random.Random(8)
    shared, docs = words(rng, 30).split(), []
    for i in range(40):
        tail = words(rng, 40, 10**6).split()
        # near copies that share no run of five words but those of the common passage
        docs += [" ".join(shared + tail), " ".join(shared + [f"x{i}" if j % 5 == 2 else w for j, w in enumerate(tail)])]
    hashes, met = WordHashes(), collections.defaultdict(set)
    coded = [hashes.of(d) for d in docs]
    for i, c in enumerate(coded):
        for bucket in near_dedup.sketch(c):
            met[bucket].add(i)
    near = {frozenset((i, i + 1)) for m in met.values() for i in m if i % 2 == 0 and i + 1 in m}
    assert len(near) > 15 and max(map(len, met.values())) > 5
    want = [i - 1 if frozenset((i - 1, i)) in near else i for i in range(80)]
    rows = spark.createDataFrame([*enumerate(docs)], "doc_id int, text string").repartition(3)
    for size in ("2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {g.doc_id: g.class_id for g in near_dedup.label_near_duplicates(rows).collect()}
        assert [got[i] for i in range(80)] == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    coded = [(bytes([i]), len(c), near_dedup.sketch(c).tolist(), near_dedup.tally(c)) for i, c in enumerate(coded)]
    sketched = spark.createDataFrame(coded, near_dedup._SKETCH)
    classes = [(bytes([i]), i, 0 if i < 20 else i) for i in range(80)]
    classes = spark.createDataFrame(classes, "node binary, first long, class long")
    none = spark.createDataFrame([], near_dedup._PAIR)
    found = [sorted(map(tuple, near_dedup.other_links(sketched, classes, none, block).collect())) for block in (1, 3, 1000)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 5


def test_further_links_are_fewer_than_pairs(spark):
    rng = random.Random(3)
    base, docs = words(rng, 120).split(), []
    for i in range(40):
        docs.append(" ".join(f"y{i}" if j in (30, 60, 90) else w for j, w in enumerate(base)))
    coded = [WordHashes().of(d) for d in docs]
    assert all(near_dedup.similarity(a.tolist(), b.tolist()) >= near_dedup.SIMILARITY for a in coded for b in coded)
    sketched = [(bytes([i]), len(c), near_dedup.sketch(c).tolist(), near_dedup.tally(c)) for i, c in enumerate(coded)]
    sketched = spark.createDataFrame(sketched, near_dedup._SKETCH)
    classes = spark.createDataFrame([(bytes([i]), i, i) for i in range(40)], "node binary, first long, class long")
    none = spark.createDataFrame([], near_dedup._PAIR)
    for block in (7, 1000):
        found = [(r.a[0], r.b[0]) for r in near_dedup.other_links(sketched, classes, none, block).collect()]
        assert len(found) < 40 * 39 // 2 // 3
        root = list(range(40))
        for a, b in found:
            root = [root[a] if r == root[b] else r for r in root]
        assert len(set(root)) == 1


def test_rounds_of_few_links_write_few_files(spark, monkeypatch):
    written = []

    def counted(df, label):
        written.append(df.rdd.getNumPartitions())
        return staged(df, label)

    staged = components.staged
    monkeypatch.setattr(components, "staged", counted)
    merges = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merges, "false")
    try:
        chain = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
        found = components.components(chain)
        assert sorted((r.node, r.root) for r in found.collect()) == [(i, 0) for i in range(21)]
        assert set(written[1:]) == {1}
        del written[:]
        monkeypatch.setattr(components, "LINKS_PER_FILE", 5)
        assert {r.root for r in components.components(chain).collect()} == {0}
        assert max(written[1:]) > 1
    finally:
        spark.conf.unset(merges)


def test_windows_of_texts_together_are_those_of_each_alone():
    rng = np.random.default_rng(4)
    sizes = np.array([3, 46, 47, 0, 300, 1, 90, 45, 60])
    texts = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in sizes]
    texts[6][:] = 7  # ties go to the first place
    text, *found = substring_dedup.windows_of(np.concatenate(texts), sizes)
    for i, runs in enumerate(texts):
        least = substring_dedup.LEAST_RUNS
        bits = np.uint64(len(runs).bit_length())
        expected = []
        for kind, odd in enumerate(substring_dedup._ODD):
            hashed = runs * odd
            hashed ^= hashed >> np.uint64(31)
            ranks = [(int(h >> bits), place) for place, h in enumerate(hashed)]
            ends = range(len(runs) - least + 1)
            for place in sorted({min(range(k, k + least), key=ranks.__getitem__) for k in ends}):
                left = next((k + 1 for k in range(place - 1, -1, -1) if ranks[k] < ranks[place]), 0)
                right = next((k - 1 for k in range(place + 1, len(runs)) if ranks[k] < ranks[place]), len(runs) - 1)
                expected.append((kind, int(hashed[place]), place, left, right))
        assert list(zip(*(x[text == i].tolist() for x in found))) == expected


def test_compact_windows_cover_every_passage_once():
    rng = np.random.default_rng(1)
    runs = rng.integers(0, 40, 90).astype(np.uint64)
    least = 7
    for kind, value, place, left, right in substring_dedup.compact_windows(runs, least):
        hashed = {int(p): int(v) for p, v in zip(place, value)}
        for i in range(90):
            for j in range(i + least - 1, 90):
                inside = [int(c) for c, a, b in zip(place, left, right) if a <= i <= c <= j <= b]
                assert len(inside) == 1 and hashed[inside[0]] is not None


def test_repeated_passages(odd, empty):
    got = substring_dedup.repeated_passages(odd).collect()
    texts = {r.doc_id: (r.text or "").lower().split() for r in odd.collect()}
    pairs = {frozenset((g.doc_id, g.other_id)) for g in got}
    assert frozenset((9, 10)) in pairs and not any({0, 1, 2, 3, 11, 12, 16} & p for p in pairs)
    for g in got:
        if {g.doc_id, g.other_id} == {9, 10}:
            spans = {g.doc_id: (g.first_word, g.last_word), g.other_id: (g.other_first_word, g.other_last_word)}
            a, b = (texts[i][spans[i][0] : spans[i][1] + 1] for i in (9, 10))
            assert a == b and len(a) == 70
    assert substring_dedup.repeated_passages(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 34), max_size=80, unique=True))
def test_elias_fano(values):
    values = np.array(sorted(values), np.uint64)
    body = elias_fano.EliasFano.packed(values)
    sequence = elias_fano.EliasFano(body, 0)
    assert sequence.access(np.arange(len(values))).tolist() == values.tolist()
    asked = np.unique(np.concatenate([values, values + np.uint64(1), np.array([0, 1 << 40], np.uint64)]))
    known = {v: i for i, v in enumerate(values.tolist())}
    assert sequence.find(asked).tolist() == [known.get(v, -1) for v in asked.tolist()]


@pytest.mark.parametrize("head_words", [lm_scoring.HEAD_WORDS, 40])
def test_scores_match_a_plain_model(odd, empty, monkeypatch, head_words):
    monkeypatch.setattr(lm_scoring, "HEAD_WORDS", head_words)
    rows = odd.select("doc_id", "text").collect()
    texts = [((r.text or "").encode().lower().split(), r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 != 0) for r in rows]
    count, pairs, contexts = collections.Counter(), collections.Counter(), collections.Counter()
    learned = [w for w, train in texts if train]
    for w in learned:
        count.update(w)
    head = {w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:head_words]}
    total, distinct = sum(count.values()) + len(learned), len(count) + 1
    rest, rest_words = sum(n for w, n in count.items() if w not in head), len(count) - len(head)
    path = lambda w: ["<s>", *(x if x in head else "?" for x in w), "</s>"]
    for w in learned:
        pairs.update(zip(path(w), path(w)[1:]))
        contexts.update(path(w))
    strength = lm_scoring.STRENGTH
    want = []
    for (w, _), r in zip(texts, rows):
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        base += math.log10((len(learned) + 0.1) / (total + 0.1 * (distinct + 1)))
        score = 0.0
        for a, b in zip(path(w), path(w)[1:]):
            chance = ((rest if b == "?" else contexts[b]) + 0.1) / (total + 0.1 * (len(head) + 2))
            score += math.log10((pairs[a, b] + strength * chance) / (contexts[a] + strength))
        score += sum(math.log10((count[x] + 0.1) / (rest + 0.1 * (rest_words + 1))) for x in w if x not in head)
        want.append((r.doc_id, len(w) + 1, sum(count[x] > 0 for x in w) + 1, base, score))
    got = lm_scoring.score(odd).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((g.doc_id, g.n_tokens, g.n_known, g.base_score, g.score, g.train_tokens) for g in got), key=order)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=order)):
        assert g[:3] == w[:3] and g[5] == total
        assert g[3] == pytest.approx(w[3], abs=1e-6)
        assert abs(g[4] - w[4]) <= 0.02 * w[1]
    assert lm_scoring.score(empty).count() == 0
    assert len(shingles(np.empty(0, np.uint64), 5)) == 0
