import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint,"
    " row string, node string, keep_id string, kept string, score string, best string, k string, shard string"
)


def words(rng, n, kinds=400):
    return " ".join(rng.choice("ban da ko lo mir ta ven zu".split()) + str(rng.randrange(kinds)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, and columns named like inner ones."""
    rng = random.Random(4)
    base = words(rng, 120)
    passage = words(rng, 70)
    texts = [None, "", " \t\n", "one", base, base, base.replace(" ", "\n"), base.replace("ban", "bun", 2), base + " tail"]
    texts += [words(rng, 300) + " " + passage, passage + " " + words(rng, 200), words(rng, 9000), "x" * 50_000, "of " * 300]
    texts += ["<|endoftext|> end", "Ünïcödé 漢字 😀 " * 20, words(rng, 60), "1234 ... !!"]
    rows = [(i, t, "en" if i % 3 else None, "s", 1) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base, "de", None, None), (None, None, None, None, None)]
    extra = ("r", "n", "kid", "k", "s", "b", "k", "sh")
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
