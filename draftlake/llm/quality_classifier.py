"""Quality classifier: ordinal cumulative-link regression on graded ratings."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .store import read

#: Bits of the hashed feature space.
BITS = 22
#: Most labelled documents that are fitted on: those with the least hash of the doc_id.
SAMPLE = 12_000
#: Documents of the sample that a feature must occur in.
LEAST_DOCS = 3
#: A document is selected if the probability of the best grade reaches this.
SELECT = 0.5
GRADES = 3
#: Weight of the lasso penalty.
PENALTY = 3e-4
#: Bytes of the word beginnings that are features.
PREFIXES = (4, 5, 6)
_TABLE: list = []  # the last model, which is held so that none is taken for it, and its weights by feature


class Model(NamedTuple):
    """P(grade >= k + 1) = sigmoid(score - thresholds[k]), with increasing thresholds and one weight a feature for all."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def features(texts: pa.Array, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, feature numbers, bounds by row): the distinct hashed features of each text.

    They are the words in lower case, their beginnings of 4 to 6 bytes, the runs of other signs, and for the shares of upper
    case, of signs, of repeated words and of words equal to the one before a sign for the step of the scale. ``known`` is a
    table of the features to return; without it all are.
    """
    shift, wide = np.uint64(64 - BITS), np.uint64(BITS)
    for first, data, offs, low, low_offs in T.both_cases(texts):
        n = len(offs) - 1
        s, e, wb = T.words(low, low_offs)
        h = T.hash_runs(low, s, e)
        ps, pe, pb = T.words(low, low_offs, T.PUNCT)
        row, prow = T.rows_of(wb), T.rows_of(pb)
        found = [(row, h), (prow, T.hash_runs(low, ps, pe))]
        for size in PREFIXES:
            longer = np.flatnonzero(e - s > size)
            found.append((row[longer], T.mix(T.hash_runs(low, s[longer], s[longer] + size) + np.uint64(size))))
        many = np.maximum(np.diff(wb), 1)
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        letters = np.concatenate([[0], np.cumsum(T.WORD[data])])
        cut = lambda c: c[offs[1:]] - c[offs[:-1]]
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        distinct = np.bincount(
            (np.unique((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))) >> np.uint64(40)).astype(np.int64), minlength=n
        )
        shares = [
            cut(upper) / np.maximum(cut(letters), 1), np.diff(pb) / many, 1 - distinct / many, np.bincount(row[same], minlength=n) / many
        ]
        every = np.arange(n)
        found += [
            (every, T.mix(np.minimum(np.maximum(x, 0) * 20, 20).astype(np.uint64) + np.uint64(1000 * (k + 1))))
            for k, x in enumerate(shares)
        ]
        keys = []
        for r, x in found:
            x = x >> shift
            if known is not None:
                ok = known[x.astype(np.int64)]
                r, x = r[ok], x[ok]
            keys.append((r.astype(np.uint64) << wide) | x)
        key = np.unique(np.concatenate(keys))
        yield first, (key & np.uint64((1 << BITS) - 1)).astype(np.int64), np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << wide)


def fit(rows: list[np.ndarray], grades: np.ndarray, least_docs: int = LEAST_DOCS, steps: int = 250, penalty: float = PENALTY) -> Model:
    """Maximum likelihood with a lasso penalty, by proximal Adam on all rows at once; deterministic."""
    gaps = np.zeros(GRADES - 2)
    if not len(rows):
        return Model(np.zeros(0, np.int64), np.zeros(0), np.arange(GRADES - 1, dtype=float))
    flat, bounds = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    names, flat, count = np.unique(flat, return_inverse=True, return_counts=True)
    used = count >= least_docs
    number = np.cumsum(used) - 1
    keep = used[flat]
    held = np.concatenate([[0], np.cumsum(keep)])
    flat, bounds = number[flat[keep]], held[bounds]
    row, n, m = T.rows_of(bounds), len(rows), int(used.sum())
    # sums over runs: features in the order of rows, and rows in the order of features
    by = np.argsort(flat, kind="stable")
    by_row, by_flat = row[by], np.concatenate(
        [[0], np.cumsum(np.bincount(flat, minlength=m))[:-1]]
    ).astype(np.int64) if m else np.zeros(0, np.int64)
    some = np.flatnonzero(np.diff(bounds))
    theta = np.concatenate([np.zeros(m), [-1.0], gaps])  # weights, the first threshold, logarithms of the gaps
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    lower_at, upper_at = grades - 1, grades
    for t in range(1, steps + 1):
        w, cut = theta[:m], theta[m] + np.concatenate([[0], np.cumsum(np.exp(theta[m + 1 :]))])
        score = np.zeros(n)
        if len(flat):
            score[some] = np.add.reduceat(w[flat], bounds[:-1][some])
        edges = np.concatenate([[-np.inf], cut, [np.inf]])
        sig = lambda x: 1 / (1 + np.exp(np.clip(-x, -60, 60)))
        hi, lo = sig(edges[upper_at + 1] - score), sig(edges[lower_at + 1] - score)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        dscore = (dhi - dlo) / n  # of the negative log likelihood
        dcut = np.array([(np.where(upper_at == k, -dhi, 0) + np.where(lower_at == k, dlo, 0)).sum() / n for k in range(GRADES - 1)])
        dgap = np.array([dcut[k + 1 :].sum() * np.exp(theta[m + 1 + k]) for k in range(GRADES - 2)])
        grad = np.concatenate([np.add.reduceat(dscore[by_row], by_flat) if m else np.zeros(0), [dcut.sum()], dgap])
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        rate = 0.1 * (1 - t / steps * 0.9) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        theta = theta - rate * (first / (1 - 0.9**t))
        theta[:m] = np.sign(theta[:m]) * np.maximum(np.abs(theta[:m]) - np.minimum(rate[:m] * penalty, 1), 0)
    cut = theta[m] + np.concatenate([[0], np.cumsum(np.exp(theta[m + 1 :]))])
    alive = theta[:m] != 0
    return Model(names[used][alive], theta[:m][alive], cut)


def score(model: Model, texts: pa.Array) -> np.ndarray:
    if not _TABLE or _TABLE[0] is not model:
        table = np.zeros(1 << BITS)
        table[model.features] = model.weights
        _TABLE[:] = [model, table]
    table = _TABLE[1]
    parts = []
    for _, f, bounds in features(texts, table != 0):
        held = np.concatenate([[0], np.cumsum(table[f])])
        parts.append(held[bounds[1:]] - held[bounds[:-1]])
    return np.concatenate(parts) if parts else np.zeros(0)


def grade(quality: F.Column, toxic: F.Column) -> F.Column:
    """0 for low quality, 1 for good but toxic text, 2 for good text; null where a rating is missing."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` rated documents: of those with a grade the ones with the least hash of their doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rated = labels.select(
        "doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")
    ).where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # so many rows at most: small enough to broadcast
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, f, bounds in features(b.column(1)):
                n = len(bounds) - 1
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(f.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(first, n), b.column(2).slice(first, n), lists], ["doc_id", "grade", "f"]
                )

    got = texts.select("doc_id", "text", "grade").transform(
        T.batched, run, f"doc_id {kind}, grade int, f array<int>"
    ).toArrow().sort_by([("doc_id", "ascending")])
    f = got.column("f").combine_chunks()
    flat, at = np.asarray(pa.compute.list_flatten(f)).astype(np.int64), np.concatenate(
        [[0], np.cumsum(np.asarray(pa.compute.list_value_length(f)))]
    ) if len(f) else np.zeros(1, np.int64)
    rows = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
    rows = [
        rows[i] for i in sorted(range(len(rows)), key=lambda i: (got.column("doc_id")[i].as_py(), rows[i].tobytes()))
    ] if len({x for x in got.column("doc_id").to_pylist()}) < len(rows) else rows
    return fit(rows, np.asarray(got.column("grade")).astype(np.int64))


def graded(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, select: float = SELECT) -> DataFrame:
    """(doc_id, expected_grade, p_fair, p_best, keep) of each row of ``docs``.

    Grades are 0 (low quality), 1 (good but toxic) and 2 (good). The cumulative-link model has one score for all grades, the
    sum of hashed-text weights, and ordered thresholds: P(grade >= k) = sigmoid(score - threshold_k). ``expected_grade`` is
    the sum of the tail probabilities ``p_fair`` and ``p_best``; a document is selected where ``p_best`` >= ``select``.

    Defined cases: a null or empty text has the score of a text without words and keep = false; a text of any length is read
    whole; a null doc_id is returned as null; repeated rows each get a row; other columns are ignored; of equal hashes in the
    sample the least doc_ids are taken; features of fewer than ``LEAST_DOCS`` documents of the sample have no weight; ratings that are null or other than 0 and 1, and ratings of unknown documents, are
    ignored, of several of one document the lowest counts; without any rating the score is 0; an empty table gives an
    empty result. Scoring is one narrow pass; fitting reads at most ``sample`` documents' features on the driver.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = spark.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            tails = model.tails(score(model, b.column(1)))
            inked = np.asarray(pa.compute.fill_null(pa.compute.match_substring_regex(b.column(1), r"\S"), False))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, -1]),
                    pa.array((tails[:, -1] >= select) & inked)
                ],
                ["doc_id", "expected_grade", "p_fair", "p_best", "keep"]
            )

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).transform(
        T.batched, run, f"doc_id {kind}, expected_grade double, p_fair double, p_best double, keep boolean"
    )


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
