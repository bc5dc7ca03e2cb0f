"""Quality rules: fixed base rules and a calibrated logistic regression over hashed n-grams.

Features are the shares of hashed word 1-grams and 2-grams and of byte 2-grams and 4-grams in a text. The regression is
fitted on a bounded sample of labelled rows (`sample` per class, in the order of a hash of their id), calibrated on the
part of the sample it has not seen, and scored in Arrow batches against the fixed threshold. Scoring covers whole texts.

Null text has no words; texts without words fail the base rules. Repeated rows are scored alike and all kept as rows;
rows with null ids are scored too (a null id carries no label). A row labelled both ways is no training row. Without
labels of both classes the model keeps all that pass the base rules. Empty tables give empty results; other columns stay
out of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldcast.llm.common import arrow_map
from fieldcast.llm.words import BLANK, Texts, runs, shingle_hash, texts_of

#: log2 of the hashed features of one kind
BITS = 16
KINDS = 4
#: labelled rows of each class that the model is fitted on, at most
SAMPLE = 1_500
THRESHOLD = 0.5
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, samples: tuple[int, int], where: Column | None = None
) -> DataFrame:
    """(doc_id, text, y): up to `samples` labelled rows of class 0 and of class 1, in the order of a hash of the id."""
    one = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("other"))
        .where("y = other")
    )
    if where is not None:
        one = one.where(where)
    picked = [
        one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(samples[y]).select("doc_id", "y")
        for y in (0, 1)
    ]
    # as many rows as `samples` says at most, whatever the table's size
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # an id that is repeated brings its smallest text only
    return texts.join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def features(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: (text, hashed feature) of every n-gram."""
    words = texts.word_hashes()
    out = [(texts.text_of_word, words), texts.shingles(2, words)]
    for k in (2, 4):
        n = np.maximum(texts.end - texts.begin - k + 1, 0)
        at = runs(texts.begin, n)
        out.append((np.repeat(np.arange(len(n)), n), shingle_hash(texts.data.astype(np.uint64), at, k)))
    mask = np.uint64((1 << BITS) - 1)
    return [(of, ((h & mask) + np.uint64(i << BITS)).astype(np.int64)) for i, (of, h) in enumerate(out)]


@dataclass
class Model:
    """Weights by hashed feature; the calibrated probability is sigmoid(slope * margin + intercept)."""

    weights: np.ndarray
    slope: float
    intercept: float

    def margins(self, texts: Texts) -> np.ndarray:
        n = len(texts.begin)
        total = np.zeros(n)
        for of, index in features(texts):
            size = np.bincount(of, minlength=n)
            total += np.bincount(of, weights=self.weights[index], minlength=n) / np.maximum(size, 1)
        return total

    def probability(self, texts: Texts) -> np.ndarray:
        return sigmoid(self.slope * self.margins(texts) + self.intercept)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Slopes and intercept of a logistic regression by Newton steps, lightly regularised; classes weigh as they come."""
    design = np.column_stack([x, np.ones(len(y))])
    beta = np.zeros(design.shape[1])
    penalty = np.eye(len(beta)) * 1e-2
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = sigmoid(design @ beta)
        step = np.linalg.solve(
            design.T @ (design * (p * (1 - p))[:, None]) + penalty, design.T @ (y - p) - penalty @ beta
        )
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def fit(rows: list[tuple[str, int]], rounds: int = 150) -> Model:
    """Regression on four fifths of the rows by Adam steps on all of them, calibrated on the other fifth."""
    weights = np.zeros(KINDS << BITS)
    y = np.array([r[1] for r in rows], float)
    if len(set(y)) < 2:
        return Model(weights, 0.0, 50.0)
    of, index, value, base = [], [], [], 0
    for a, b, texts in texts_of(pa.array([r[0] for r in rows], pa.string())):
        for doc, feature in features(texts):
            size = np.bincount(doc, minlength=b - a)
            key, count = np.unique(doc * (KINDS << BITS) + feature, return_counts=True)
            d = key // (KINDS << BITS)
            of.append((d + base).astype(np.int32))
            index.append((key % (KINDS << BITS)).astype(np.int32))
            value.append((count / size[d]).astype(np.float32))
        base = b
    of, index, value = map(np.concatenate, (of, index, value))
    held = np.arange(len(y)) % 5 == 4
    used = ~held[of]
    o, j, v = of[used], index[used], value[used]
    balance = np.where(y == 1, 0.5 / max(y[~held].sum(), 1), 0.5 / max((1 - y[~held]).sum(), 1))
    first = second = np.zeros_like(weights)
    for t in range(1, rounds + 1):
        p = sigmoid(np.bincount(o, weights=weights[j] * v, minlength=len(y)))
        slope = np.bincount(j, weights=((p - y) * balance)[o] * v, minlength=len(weights)) + 1e-7 * weights
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        weights = weights - 1.0 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    margin = np.bincount(of, weights=weights[index] * value, minlength=len(y))
    shown = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    scale = max(np.abs(margin[shown]).max(), 1e-9)
    slope, intercept = calibrate(margin[shown] / scale, y[shown])
    return Model(weights, slope / scale, intercept)


def base_counts(texts: Texts) -> dict[str, np.ndarray]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words and n_words of each text."""
    n = len(texts.begin)
    data = texts.data
    words = texts.n_words
    # lines with a word, each but the first of equal ones
    cut = np.flatnonzero(data == 10)
    of_cut = np.searchsorted(texts.end, cut, side="right")
    of = np.concatenate([np.arange(n), of_cut])
    start = np.concatenate([texts.begin, cut + 1])
    stop = np.concatenate([texts.end, cut])
    start, stop = start[np.lexsort((start, of))], stop[np.lexsort((stop, of))]
    of = np.sort(of)
    filled = np.searchsorted(texts.start, stop) > np.searchsorted(texts.start, start)
    lines = texts.spans(start[filled], stop[filled])
    of = of[filled]
    sort = np.lexsort((lines, of))
    again = (lines[sort][1:] == lines[sort][:-1]) & (of[sort][1:] == of[sort][:-1])
    dup_lines = np.bincount(of[sort][1:][again], minlength=n)
    # words of repeated windows
    doc, window = texts.shingles(3, texts.word_hashes())
    at = runs(texts.first, np.maximum(words - 2, 0))
    sort = np.lexsort((window, doc))
    same = (window[sort][1:] == window[sort][:-1]) & (doc[sort][1:] == doc[sort][:-1])
    twice = np.zeros(len(window), bool)
    twice[sort[1:][same]] = True
    twice[sort[:-1][same]] = True
    marked = np.zeros(len(texts.start), bool)
    for i in range(3):
        marked[at[twice] + i] = True
    return {
        "n_words": words,
        "word_chars": texts.total(texts.inside & ((data & 0xC0) != 0x80)),
        "n_symbols": texts.total(SYMBOLS[data]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(texts.text_of_word[marked], minlength=n),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = counts["n_words"]
    return (n < 50) | (100 * counts["n_repeat_words"] > 50 * n)


MADE = ", base_failed boolean, quality double, kept boolean"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(
    documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD
) -> DataFrame:
    """Every column of documents with the base counts, base_failed, the calibrated `quality` and kept.

    Columns of documents with the names of the results are replaced.
    """
    documents = documents.drop(*COLUMNS, "base_failed", "quality", "kept")
    spark = documents.sparkSession
    rows = labelled_sample(documents, labels, "quality", (sample, sample)).orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    model = fit([(r.text, r.y) for r in rows.collect()])
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights
    place = documents.columns.index("text")
    names = [*documents.columns, *COLUMNS, "base_failed", "quality", "kept"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in texts_of(batch.column(place), BLANK):
                counts = base_counts(texts)
                failed = base_failed(counts)
                p = shared.value.probability(texts)
                made = [*(pa.array(counts[c], pa.int64()) for c in COLUMNS), pa.array(failed), pa.array(p)]
                kept = pa.array(~failed & (p >= threshold))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *made, kept], names=names)

    made = StructType.fromDDL(", ".join(f"{c} long" for c in COLUMNS) + MADE)
    return arrow_map(documents, score, StructType([*documents.schema.fields, *made.fields]))
