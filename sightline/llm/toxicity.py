"""Severity of toxic text by cumulative-link ordinal regression (operator 3).

Labels give three ordered grades: 0 not toxic, 1 toxic, 2 toxic in a text of low quality. One weight per
feature is shared by all thresholds: P(grade >= k) = 1 - sigmoid(threshold_k - sum of the weights of the
text's features: its distinct words, and the beginnings of these). The result is the expected grade and P(grade >= 1).

Fitting takes a bounded sample of labelled documents. Spark counts in how many of them each feature
stands and keeps those whose share among toxic ones is off by at least LEAST_Z standard errors; gradients
are taken on the driver over these feature numbers only (at most SAMPLE_DOCUMENTS short lists).

Defined results: null or empty text has the grade of a text without any known feature. Without labelled
documents the expected grade and the probability are null and `toxic` is false; with labels of one kind
only, the features decide nothing. Null `toxic` labels and labels without document teach nothing, null
`quality` counts as good, a document labelled twice teaches twice. Rows with null or repeated doc_id are
each judged. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of

GRADES = 3
#: Bounds of the fit: labelled documents, and features with a weight.
SAMPLE_DOCUMENTS, MOST_WORDS = 20_000, 5_000
LEAST_Z, LEAST_DOCUMENTS, PENALTY, ROUNDS = 4.5, 5, 2e-4, 400
#: Beside each word, its beginnings of these lengths are features, so that compounds share a weight.
BEGINNINGS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Distinct lower-case words of letters, and their beginnings followed by a hyphen."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in BEGINNINGS))


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    thresholds: tuple[float, ...]

    def at_least(self, text: str | None) -> list[float]:
        """P(grade >= k) for k from 1 on."""
        found = self.words.keys() & features(text)
        total = math.fsum(self.words[w] for w in found)
        return [1 / (1 + math.exp(min(700.0, t - total))) for t in self.thresholds]


def ordinal_fit(rows: list[list[int]], grades: np.ndarray, size: int, kinds: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds, by Adam on the penalised likelihood. `rows` are lists of word numbers."""
    n = len(rows)
    columns = np.concatenate([np.asarray(r, np.int64) for r in rows]) if n else np.empty(0, np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    share = np.array([(grades >= k).mean() for k in range(1, kinds)]).clip(1e-6, 1 - 1e-6)
    start = np.log((1 - share) / share)
    # thresholds = first, then positive steps exp(g)
    values = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    mean, square = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, ROUNDS + 1):
        weights, first, gaps = values[:size], values[size], np.exp(values[size + 1 :])
        cuts = first + np.concatenate([[0.0], np.cumsum(gaps)])
        total = np.bincount(owner, weights[columns], n)
        below = 1 / (1 + np.exp(-np.clip(cuts[None, :] - total[:, None], -40, 40)))
        edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
        slope = edge * (1 - edge)
        at = np.arange(n)
        chance = np.maximum(edge[at, grades + 1] - edge[at, grades], 1e-12)
        by_total = (slope[at, grades + 1] - slope[at, grades]) / chance / n
        by_cut = np.zeros((n, kinds + 1))
        by_cut[at, grades + 1] -= slope[at, grades + 1] / chance / n
        by_cut[at, grades] += slope[at, grades] / chance / n
        cut_sum = by_cut[:, 1:-1].sum(axis=0)
        tail = np.cumsum(cut_sum[::-1])[::-1]
        change = np.concatenate(
            [np.bincount(columns, by_total[owner], size) + PENALTY * weights, tail[:1], tail[1:] * gaps]
        )
        mean, square = 0.9 * mean + 0.1 * change, 0.999 * square + 0.001 * change**2
        rate = 0.1 * (1 - step / (ROUNDS + 1)) + 0.002
        values = values - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    weights, first, gaps = values[:size], values[size], np.exp(values[size + 1 :])
    return weights, first + np.concatenate([[0.0], np.cumsum(gaps)])


def feature_column(text: Column) -> Column:
    """The features of a text."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([sorted(features(t)) for t in batch])

    return run(text)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """docs (doc_id, text), labels (doc_id, quality, toxic) → a model, or None without labelled documents."""
    low = F.coalesce(F.col("quality"), F.lit(1)) == 0
    grade = F.when(F.col("toxic") == 0, 0).when(low, 2).otherwise(1)
    graded = labels.where("toxic is not null and doc_id is not null").select("doc_id", grade.alias("grade"))
    total = graded.count()
    part = min(1.0, SAMPLE_DOCUMENTS / max(total, 1))
    some = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    chosen = some.limit(SAMPLE_DOCUMENTS)
    # at most SAMPLE_DOCUMENTS rows are broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.select("grade", feature_column(F.col("text")).alias("words")).persist()
    kinds = {r.grade: r["count"] for r in sample.groupBy("grade").count().collect()}
    n, bad = sum(kinds.values()), sum(v for k, v in kinds.items() if k)
    if not n:
        sample.unpersist()
        return None
    share = bad / n
    found = sample.select(F.explode("words").alias("word"), (F.col("grade") > 0).cast("int").alias("bad"))
    found = found.groupBy("word").agg(F.count("*").alias("df"), F.sum("bad").alias("bad"))
    z = (F.col("bad") - F.col("df") * share) / F.sqrt(F.col("df") * F.lit(max(share * (1 - share), 1e-9)))
    kept = found.where(F.col("df") >= LEAST_DOCUMENTS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z)
    names = [r.word for r in kept.orderBy(F.desc("z"), "word").limit(MOST_WORDS).collect()]
    number = {w: i for i, w in enumerate(names)}
    known = F.array(*[F.lit(w) for w in names]) if names else F.array().cast("array<string>")
    rows = sample.select("grade", F.array_intersect("words", known).alias("words")).limit(2 * SAMPLE_DOCUMENTS).collect()
    sample.unpersist()
    rows.sort(key=lambda r: (r.grade, r.words))
    grades = np.array([r.grade for r in rows])
    weights, cuts = ordinal_fit([[number[w] for w in r.words] for r in rows], grades, len(names))
    return Model(dict(zip(names, weights.tolist())), tuple(cuts.tolist()))


def severity(text: Column, model: Model | None) -> Column:
    """Struct of expected_severity, p_toxic and toxic."""

    @F.pandas_udf("expected_severity double, p_toxic double, toxic boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if model is None:
                rows = [(None, None, False)] * len(batch)
            else:
                chances = [model.at_least(t) for t in batch]
                rows = [(math.fsum(c), c[0], c[0] >= 0.5) for c in chances]
            frame = pd.DataFrame(rows, columns=["expected_severity", "p_toxic", "toxic"])
            yield frame.astype({"expected_severity": "float64", "p_toxic": "float64", "toxic": "bool"})

    return run(text)


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels → doc_id, held_out, expected_severity, p_toxic, toxic; held-out labels are not learned from."""
    rest = F.coalesce(F.pmod(crc32_of("doc_id"), F.lit(5)) == 0, F.lit(False))
    model = fit(docs, labels.where(~rest))
    judged = docs.select("doc_id", rest.alias("held_out"), severity(F.col("text"), model).alias("found"))
    return judged.select("doc_id", "held_out", "found.*")
