"""Language ID, tokens, decontamination, toxicity, archives, URL rules and the pipeline on odd rows."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from sightline.llm import bpe, decontamination, lang_id, queries, toxicity, url_filters, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_duckdb(spark, name):
    from checks.compare import compare, connect

    rows, verdict = compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])
    assert verdict == "ok" and rows


def test_languages(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lang_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.96
    got = lang_id.identify(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred in ("en", "de", "und"))
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 17)} == {"und"}
    kept = lang_id.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == sum(not r.rejected for r in got)
    assert lang_id.identify(empty).count() == 0
    assert {r.lang_pred for r in lang_id.identify(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_letters_and_many_languages(spark):
    """Numerals are no letters, and every learned language can be the answer."""
    rng = random.Random(6)
    rows = []
    for lang in range(40):
        letters = "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6))
        stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(40)]
        for i in range(12 if lang else 200):
            text = " ".join(rng.choice(stems) for _ in range(60))
            # What tells the language stands in the middle of a long text.
            rows.append((len(rows), "1 " * 3000 + text + " 1" * 3000 if i % 4 == 0 else text, f"l{lang:02d}"))
    odd = ["½ ²", "Ⅷ", "① ٣", "", None, "ª"]
    rows += [(100_000 + i, t, None) for i, t in enumerate(odd)] + [(0, "abc", "l01")] * 3
    found = lang_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r for r in found.collect()}
    assert [got[100_000 + i].lang_pred == "und" for i in range(6)] == [True] * 5 + [False]
    held = [r for i, (_, _, lang) in enumerate(rows[:600]) if (r := got[i]).held_out and lang]
    right = [rows[r.doc_id][2] == r.lang_pred for r in held]
    assert np.mean(right) > 0.95 and len({r.lang_pred for r in held}) > 30


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.public_tokenizers.path(bpe.VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"abthe  \n\t\x0b\x1c\x85 's1٣é漢😀.,!<|>", "<|endoftext|>", "'re", "ing"]), max_size=60).map("".join))
def test_tokens_as_the_library(library, text):
    own = bpe.tokenizer(bpe.public_tokenizers.path(bpe.VOCABULARY))
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_token_digests_and_columns(odd, empty, library):
    want = collections.Counter()
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[r.doc_id, len(ids), sha, hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.tokenize(odd).collect())) == want
    stage = bpe.with_tokens(odd)
    assert [c for c in stage.columns if c not in odd.columns] == ["token_ids", "n_tokens"]
    back = stage.withColumn("again", bpe.decode("token_ids")).select("text", "again").collect()
    assert all((r.text or "") == r.again for r in back)
    assert bpe.tokenize(empty).count() == 0


def test_leaks_match_brute_force(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = {(d, i.item_id) for i in items.collect() for d, t in texts.items() if i.text in t}
    assert whole and whole <= got and len(got) <= len(whole) + 1
    left = decontamination.drop_leaks(docs, items)
    assert {r.doc_id for r in left.collect()} == texts.keys() - {d for d, _ in got}
    mine = odd.where("doc_id in (11, 16)").selectExpr("doc_id + 100 as item_id", "text").collect()
    some = [(r.item_id, r.text) for r in mine] + [(1, None), (2, ""), (None, "a b c d e f"), (102, mine[1].text)]
    some = spark.createDataFrame(some, "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(odd, some).collect()} == {(11, 111), (16, 116), (16, 102)}
    assert decontamination.find_leaks(empty, some).count() == 0
    assert decontamination.find_leaks(odd, some.limit(0)).count() == 0
    assert decontamination.drop_leaks(odd, some.limit(0)).count() == odd.count()


def test_wand_retrieves_all_above_the_threshold():
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(6, 20))) + ".") for i in range(90)]
    hashes = decontamination.WordHashes()
    pieces = [s for _, t in items for s in decontamination.segments_of(hashes.of(t))]
    df = collections.Counter(int(w) for s in pieces for w in np.unique(s))
    index = decontamination.Index(items, df, len(pieces), float(np.mean([len(s) for s in pieces])))
    for threshold in (0.3, 0.5, 0.7):
        for _ in range(40):
            terms = sorted(rng.sample(range(len(index.words)), 25))
            want = {}
            for t in terms:
                for s, x in zip(index.lists[t], index.weights[t]):
                    want[s] = want.get(s, 0) + x
            got = [f for b in range(index.blocks) for f in index.wand(terms, b, threshold)]
            assert {s for s, _ in got} == {s for s, x in want.items() if x >= threshold}
            assert all(x == pytest.approx(want[s]) for s, x in got)


def test_toxicity(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.grade(docs, labels).join(labels.select("doc_id", "toxic").withColumnRenamed("toxic", "true"), "doc_id")
    held = found.where("held_out").collect()
    assert np.mean([r.toxic == (r.true == 1) for r in held]) > 0.93
    assert sum(r.toxic and not r.true for r in held) < 0.02 * len(held)
    some = spark.createDataFrame([(4, None, 1), (9, 1, 0), (10, 0, 1), (None, 1, 1), (11, 1, None), (999, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = toxicity.grade(odd, some).collect()
    assert len(got) == odd.count() and all(0 <= r.expected_severity <= 2 for r in got)
    none = toxicity.grade(odd, some.limit(0)).collect()
    assert all(r.expected_severity is None and r.toxic is False for r in none)
    assert toxicity.grade(empty, some).count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        grade = int(rng.integers(0, 3))
        rows.append([k for k in range(2) if grade > k] + [2 + int(rng.integers(0, 5))])
        grades.append(grade)
    weights, cuts = toxicity.ordinal_fit(rows, np.array(grades), 7)
    assert cuts[0] < cuts[1] and weights[0] > 1 and weights[1] > 1 and abs(weights[2:]).max() < 1


PAGES = [
    (1, "http://A.Example.net/en/x?q#f", "p" * 1200), (2, "https://b.net/", "p" * 1200), (3, None, "p" * 1200),
    (4, "no scheme", None), (5, "http://x.org", ""), (6, "ftp://sub.fr.org/fr/a", "short"), (7, "http://x.org/fr/", "short"),
    (8, "://", "ü" * 600), (9, "http://example.com/de/1\n2", "ü" * 600), (9, "http://example.com/de/1\n2", "ü" * 600),
    (None, "http://net/?a", "WARC/1.1\r\n\r\n" * 200), (None, None, None), (11, "http://net:80/en/", "\r\n\r\n" * 3),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "v", "x") for p in PAGES], "page_id bigint, url string, html string, verdict string, row string")


def test_archives(pages):
    got = warc.archive(pages).collect()
    best = {}
    for i, _, html in PAGES:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    assert len(got) == len(PAGES)
    want = collections.Counter((i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in PAGES)
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {1: 3, 2: 3, 8: 9, 9: 9}
    assert [r for r in got] == sorted(got, key=lambda r: warc.order_of(tuple(r)))
    assert warc.archive(pages.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=12).map(sorted), max_size=9))
def test_loser_tree(runs):
    assert list(warc.loser_tree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("b.net", "/", "allow"), ("b.net", "/", "block"), (None, "/", "block"), ("org", "/fr/a", "block")]


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in RULES if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("buckets", [1, 7])
def test_url_rules(spark, pages, buckets):
    rng = random.Random(5)
    more = ["http://" + ".".join(rng.choice(["a", "b", "example"]) for _ in range(rng.randrange(3))) + rng.choice([".net", ".org", ".com"])
            + rng.choice(["", "/", "/en/", "/de/q", "/fr/ab", "?/fr/", "/fr"]) for _ in range(80)]
    both = pages.select("page_id", "url", "verdict").unionByName(
        spark.createDataFrame([(100 + i, u, "v") for i, u in enumerate(more)], "page_id bigint, url string, verdict string")
    )
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = collections.Counter(map(tuple, url_filters.judge_urls(both, rules, buckets=buckets).collect()))
    assert got == collections.Counter((r.page_id, *judged(r.url)) for r in both.collect())
    assert url_filters.judge_urls(both.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(both, rules.limit(0)).collect()} == {"allow"}


def test_pipeline(spark, odd):
    names = odd.columns
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF)
        assert docs.columns == names and docs.count() <= before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count() and set(last.columns) > set(names)
    assert len({r.doc_id for r in docs.collect()} & {4, 5, 6, 7, 8, None}) == 1
    assert duckdb.sql(f"select count(*) from '{SF}/documents.parquet'").fetchall()[0][0] >= corpus_pipeline.run(spark, SF).count() > 100
