"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector is shared by all ordered thresholds. x marks which of a
small vocabulary a document holds. The vocabulary is counted by Spark over a sample of labelled documents of bounded size;
only that sample's marks come to the driver, where the model is fitted. Every document is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, BASE, LOWER, U64, Words, grams, mix, settle, steps, table

#: Labelled rows that a model is fitted on at most, those of the least hashes of their ids; features that it keeps at most.
FIT_ROWS, VOCABULARY = 8192, 1024
PREFIXES = (4, 5, 6)
#: Documents that hold a word, at least; deviations from its expected share among toxic ones, at least.
LEAST_DOCS, LEAST_Z = 5, 4.0
#: Grades of severity, 0 for clean.
GRADES = 4
PENALTY, ROUNDS, RATE = 1e-4, 400, 0.05


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of each word, and of its beginnings of PREFIXES bytes, so that a stem counts in all its forms."""
    rows, codes = [w.doc], [w.code]
    for n in PREFIXES:
        long = np.flatnonzero(w.end - w.start >= n)
        rows.append(w.doc[long])
        codes.append(mix(grams(w.bytes, BASE, w.start[long], w.start[long] + n) + U64(n)))
    return np.concatenate(rows), np.concatenate(codes)


def distinct_lists(row: np.ndarray, code: np.ndarray, rows: int) -> pa.ListArray:
    """The distinct codes of each row."""
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    new = np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))[: len(row)]
    row, code = row[new], code[new]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), pa.array(code.view(np.int64)))


def word_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features, and the distinct whole words, of each document."""
    for b in it:
        for i, j, data, off in steps(b["text"]):
            w = Words(LOWER[data], off, ALNUM)
            cols = [b["doc_id"].slice(i, j - i), b["label"].slice(i, j - i), distinct_lists(*features(w), j - i), distinct_lists(w.doc, w.code, j - i)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "label", "codes", "whole"])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """Vocabulary codes (sorted), a weight each, and ascending thresholds."""

    def __init__(self, vocabulary: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.vocabulary, self.weights, self.thresholds = vocabulary, weights, thresholds

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade = k) by row."""
        below = np.column_stack([logistic(self.thresholds[None, :] - score[:, None]), np.ones(len(score))])
        return np.diff(below, axis=1, prepend=0)


def objective(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Minus the penalised mean log likelihood of grades y, and its gradient.

    p: a weight for each column of x, the first threshold, and the logarithms of the gaps to the others.
    """
    k, rows = x.shape[1], np.arange(len(y))
    w, gaps = p[:k], np.exp(p[k + 1 :])
    t = np.append(p[k], p[k] + np.cumsum(gaps))
    below = np.column_stack([np.zeros(len(y)), logistic(t[None, :] - (x @ w)[:, None]), np.ones(len(y))])
    slope, chance = below * (1 - below), np.maximum(below[rows, y + 1] - below[rows, y], 1e-12)
    up, down = slope[rows, y + 1] / chance, slope[rows, y] / chance
    g_t = np.array([(down * (y == i + 1)).sum() - (up * (y == i)).sum() for i in range(GRADES - 1)]) / len(y)
    tail = np.cumsum(g_t[::-1])[::-1]
    gradient = np.concatenate([x.T @ ((up - down) / len(y)) + PENALTY * w, [tail[0]], tail[1:] * gaps])
    return float(-np.log(chance).mean() + PENALTY * (w @ w) / 2), gradient


def fit(words: np.ndarray, x: np.ndarray, y: np.ndarray) -> Model:
    """The model of documents given as marks of the vocabulary `words`, and their grades."""
    if not len(y) or (y > 0).all() or not (y > 0).any():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES - 1, -50.0 if len(y) and (y > 0).all() else 50.0))
    start = np.log([(y <= k).mean() + 1e-3 for k in range(GRADES - 1)]) - np.log([(y > k).mean() + 1e-3 for k in range(GRADES - 1)])
    p = np.concatenate([np.zeros(len(words)), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])  # gaps as exponentials: thresholds stay in order
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, ROUNDS + 1):
        g = objective(p, x, y)[1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    t = np.append(p[len(words)], p[len(words)] + np.cumsum(np.exp(p[len(words) + 1 :])))
    return Model(words, p[: len(words)], t)


def grades_of(toxic: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Grades of rows labelled 0 or 1: toxic ones by thirds of how many distinct toxic words they hold."""
    if not toxic.any():
        return np.zeros(len(toxic), int)
    low, high = np.quantile(held[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + (held > low) + (held > high), 0)


def mark_batches(words: np.ndarray, good: np.ndarray):
    """(doc_id, label, marks, held) of features: the places of a document's features in `words`, which are sorted, and how
    many of its whole words are toxic ones.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = b.num_rows
            row = lambda c: np.repeat(np.arange(n), b[c].value_lengths().to_numpy(zero_copy_only=False))
            codes, whole = (b[c].flatten().to_numpy(zero_copy_only=False) for c in ("codes", "whole"))
            at = np.searchsorted(words, codes)
            hit = np.flatnonzero(words[np.minimum(at, len(words) - 1)] == codes) if len(words) else np.zeros(0, np.int64)
            marks = pa.ListArray.from_arrays(pa.array(np.searchsorted(row("codes")[hit], np.arange(n + 1)), pa.int32()), pa.array(at[hit].astype(np.int32)))
            held = np.bincount(row("whole")[np.isin(whole, words[good])], minlength=n)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], marks, pa.array(held.astype(np.int32))], ["doc_id", "label", "marks", "held"])

    return run


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", graded: bool = False, rows: int = FIT_ROWS) -> Model:
    """A model fitted on `rows` labelled documents at most.

    graded: the labels are grades, else 0 and 1. Rows without a label or an id are left out; of several labels of an id
    the greatest counts, and of several texts of an id the first in order.
    """
    some = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(column).cast("long")).alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(some, "doc_id").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").alias("label"), F.min("text").alias("text"))
    held = settle(texts.mapInArrow(word_batches, "doc_id long, label long, codes array<long>, whole array<long>"))
    n, share = held.agg(F.count("*"), F.avg((F.col("label") > 0).cast("double"))).first()
    if not n:
        return fit(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0, int))
    by = held.select("label", F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("held"), F.sum((F.col("label") > 0).cast("long")).alias("hits")).where(F.col("held") >= LEAST_DOCS)
    z = (F.col("hits") - F.col("held") * share) / F.sqrt(F.col("held") * (share * (1 - share)) + 1e-9)
    best = by.select("code", z.alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "code").limit(VOCABULARY).collect()
    words, z_ = np.array([r.code for r in best], np.int64), np.array([r.z for r in best])
    order = np.argsort(words)
    words, z_ = words[order], z_[order]
    got = held.mapInArrow(mark_batches(words, z_ > 0), "doc_id long, label long, marks array<int>, held int").orderBy("doc_id").collect()  # `rows` at most, of VOCABULARY marks each
    x = np.zeros((len(got), len(words)))
    for k, r in enumerate(got):
        x[k, r.marks] = 1
    label, toxic_words = np.array([r.label for r in got], int), np.array([r.held for r in got], int)
    return fit(words, x, np.clip(label, 0, GRADES - 1) if graded else grades_of(label > 0, toxic_words))


def score_batches(held):
    def run(it):
        m = held.value
        vocabulary, weights = m.vocabulary.view(U64), m.weights
        by = np.argsort(vocabulary)
        vocabulary, weights = vocabulary[by], weights[by]
        near = np.zeros(1 << 16, bool)  # by their first bits, most features are told from the vocabulary's
        near[vocabulary >> U64(48)] = True
        for b in it:
            for i, j, data, off in steps(b["text"]):
                w = Words(LOWER[data], off, ALNUM)
                score = np.zeros(j - i)
                if len(vocabulary):
                    row, code = features(w)
                    hit = np.flatnonzero(near[code >> U64(48)])
                    row, code = row[hit], code[hit]
                    at = np.minimum(np.searchsorted(vocabulary, code), len(vocabulary) - 1)
                    hit = np.flatnonzero(vocabulary[at] == code)
                    pair = np.unique(row[hit] * len(vocabulary) + at[hit])
                    np.add.at(score, pair // len(vocabulary), weights[pair % len(vocabulary)])
                chance = m.chances(score)
                p = 1 - chance[:, 0]
                cols = [b["doc_id"].slice(i, j - i), pa.array(chance @ np.arange(GRADES)), pa.array(p), pa.array(chance.argmax(1).astype(np.int32)), pa.array(p >= 0.5)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return run


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (the expected grade), p_toxic (of grade 1 or more), grade (the likeliest) and toxic of every row.

    A null or empty text has no features and gets the model's base rate; repeated rows are scored alike, and a null id
    stays null. A very long text is scored as a whole, in one step of a task. Of equally likely grades the lowest is
    given. A model of no labelled rows, or of clean ones only, calls nothing toxic. Other columns of docs don't come out,
    so their names can't clash.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # VOCABULARY words at most
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score_batches(held), "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents graded by a model of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return grade(docs, train(docs, table(spark, sf_dir, "labels")))
