"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models, the label itself
last. Each later model also sees the probabilities of the earlier ones; in
training these are out-of-fold predictions, so that it learns from what it will
get. For a fold, inputs are chosen, scaled and marked on the other folds alone.

Inputs of the models are the words of a text and their first four and five
bytes, as 64-bit fingerprints. A bounded sample of labelled rows (`sample_rows`)
chooses `n_features` of them by how unevenly they fall on the classes, and fits
the weights. Every document is then scored whole in one narrow pass.

The labels name one category, `toxic`. Two easier ones come before it: `dense`
(toxic, with many marked inputs for its length) and `repeated` (toxic, with
several marked inputs); an input is marked if it stands mostly in toxic rows.

A null or word-free text gets the score of no words. Without both classes in
the sample every score is the share of the positive class. Repeated rows and
ids, null ids and further columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradelake.llm.labelled import held_out, sample
from tradelake.llm.staging import discard, staged
from tradelake.llm.tokens import NOT_ALNUM, chunks, mix, words

CATEGORIES = ("dense", "repeated", "toxic")
SAMPLE_ROWS, N_FEATURES, FOLDS = 20_000, 768, 4
CHUNK_BYTES = 2_000_000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, input) pairs, as often as they occur, and the number of words of each text."""
    w = words(texts, NOT_ALNUM)
    text, out, at = w.text_of_word(), [w.hash], [w.text_of_word()]
    for n in (4, 5):
        long = np.flatnonzero(w.end - w.start > n)
        key = np.full(len(long), n, np.uint64)
        for k in range(n):
            key = key << np.uint64(8) | w.data[w.start[long] + k].astype(np.uint64)
        out.append(mix(key))
        at.append(text[long])
    return np.concatenate(at), np.concatenate(out), np.diff(w.first)


def once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs, in order."""
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", CHUNK_BYTES):
        text, feature, n = features(batch.column("text"))
        text, feature = once(text, feature)
        offsets = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("fold"), lists, pa.array(n)], ["y", "fold", "features", "n_words"])


@dataclass
class Matrix:
    """Rows of inputs that are there or not, each with its own scale; also one dense column per earlier category."""

    row: np.ndarray
    column: np.ndarray
    extra: np.ndarray
    scale: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        k = len(self.scale)
        return np.bincount(self.row, (w[:k] * self.scale)[self.column], len(self.extra)) + self.extra @ w[k:-1] + w[-1]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.r_[np.bincount(self.column, r[self.row], len(self.scale)) * self.scale, r @ self.extra, r.sum()]

    def take(self, rows: np.ndarray) -> "Matrix":
        new = np.full(len(self.extra), -1)
        new[rows] = np.arange(len(rows))
        here = new[self.row] >= 0
        return Matrix(new[self.row[here]], self.column[here], self.extra[rows], self.scale)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(x: Matrix, y: np.ndarray, steps: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Logistic weights, the last one the intercept, by accelerated gradient steps."""
    w = np.zeros(len(x.scale) + x.extra.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else 0
        return w
    rate = 4 * len(y) / (len(y) * (x.extra.shape[1] + 1) + (np.bincount(x.row, x.scale[x.column] ** 2, len(y))).sum())
    v, t = w, 1.0
    for _ in range(steps):
        g = x.back(sigmoid(x.dot(v)) - y) / len(y) + l2 * v
        new, u = v - rate * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / u * (new - w), new, u
    return w


@dataclass
class Inputs:
    """Chosen inputs, as sorted fingerprints, with their scale and whether they are marked."""

    features: np.ndarray
    scale: np.ndarray
    marked: np.ndarray

    def columns(self, row: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number of the input) of the pairs whose input is chosen."""
        at = np.searchsorted(self.features, feature)
        here = at < len(self.features)
        here[here] = self.features[at[here]] == feature[here]
        return row[here], at[here]

    def matrix(self, row: np.ndarray, feature: np.ndarray, extra: np.ndarray) -> Matrix:
        return Matrix(*self.columns(row, feature), extra, self.scale)

    def target(self, category: str, row: np.ndarray, feature: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        r, c = self.columns(row, feature)
        n = np.bincount(r, self.marked[c], len(y)) if len(r) else np.zeros(len(y))
        return y * {"dense": n * 50 >= size, "repeated": n >= 8, "toxic": np.ones(len(y), bool)}[category]


@dataclass
class Chain:
    inputs: Inputs
    weights: list[np.ndarray]

    def probabilities(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """One column per category; (row, feature) pairs must differ."""
        out = np.zeros((n, 0))
        for w in self.weights:
            out = np.c_[out, sigmoid(self.inputs.matrix(row, feature, out).dot(w))]
        return out


def fit_chain(row: np.ndarray, feature: np.ndarray, y: np.ndarray, size: np.ndarray, fold: np.ndarray,
              whole: Inputs, without: list[Inputs]) -> Chain:
    """`without[k]` are the inputs as the rows outside fold k choose them."""
    extra, weights = np.zeros((len(y), 0)), []
    for category in CATEGORIES:
        weights.append(fit_linear(whole.matrix(row, feature, extra), whole.target(category, row, feature, y, size)))
        apart = np.zeros(len(y))
        for k, inputs in enumerate(without):
            x, t = inputs.matrix(row, feature, extra), inputs.target(category, row, feature, y, size)
            rest, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            apart[own] = sigmoid(x.take(own).dot(fit_linear(x.take(rest), t[rest])))
        extra = np.c_[extra, apart]
    return Chain(whole, weights)


def _choose(counts: DataFrame, totals: dict, without: int | None, n_features: int) -> Inputs:
    """The most uneven inputs over all rows but those of one fold."""
    folds = [k for k in totals if k != without]
    n, positive = (sum(totals[k][i] for k in folds) for i in (0, 1))
    share = positive / max(n, 1)
    best = []
    if 0 < share < 1:
        one = [F.sum(F.when(F.col("fold").isin(folds), F.col(c))).alias(c) for c in ("n", "p")]
        uneven = (F.col("p") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
        best = counts.groupBy("f").agg(*one).where("n >= 3").withColumn("z", uneven).orderBy(F.abs("z").desc(), "f").limit(n_features).collect()
    best.sort(key=lambda r: np.uint64(r.f & (1 << 64) - 1))
    positive, negative = max(positive, 1), max(n - positive, 1)
    # an input counts by the log ratio of its rates in both classes
    scale = np.array([np.log((r.p + 0.5) / positive) - np.log((r.n - r.p + 0.5) / negative) for r in best])
    return Inputs(np.array([r.f for r in best], np.int64).view(np.uint64), scale, np.array([r.z > 4 for r in best], bool))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
          n_features: int = N_FEATURES) -> Chain:
    """Fits on at most sample_rows labelled documents; only chosen inputs come to the driver."""
    chosen_ids = sample(labels, label, sample_rows)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    known = docs.select("doc_id", "text").join(F.broadcast(chosen_ids), "doc_id").select("text", "y", fold)
    made: list[str] = []
    rows = staged(known.mapInArrow(_listed, "y int, fold int, features array<bigint>, n_words bigint"), "toxicity", made)
    totals = {r.fold: (r.n, r.p) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()}
    counts = rows.select("y", "fold", F.explode("features").alias("f")).groupBy("f", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    counts = staged(counts, "toxicity-counts", made)
    whole = _choose(counts, totals, None, n_features)
    without = [_choose(counts, totals, k, n_features) for k in range(FOLDS)]
    every = np.unique(np.concatenate([i.features for i in (whole, *without)])).view(np.int64)
    some = F.array(*(F.lit(int(f)) for f in every)) if len(every) else F.array().cast("array<bigint>")
    got = rows.select("y", "fold", "n_words", F.array_intersect("features", some).alias("f")).toArrow()
    discard(rows.sparkSession, made)
    if not len(got):
        return Chain(whole, [np.zeros(len(whole.features) + k + 1) for k in range(len(CATEGORIES))])
    f = got["f"].combine_chunks()
    row, feature = np.repeat(np.arange(len(got)), f.value_lengths().to_numpy()), f.flatten().to_numpy().view(np.uint64)
    return fit_chain(row, feature, got["y"].to_numpy().astype(float), got["n_words"].to_numpy(), got["fold"].to_numpy(), whole, without)


def _scoring(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK_BYTES):
            text, feature, _ = features(batch.column("text"))
            p = chain.probabilities(*_once_chosen(chain.inputs, text, feature), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in p.T)],
                                             ["doc_id", *(f"p_{c}" for c in CATEGORIES)])

    return run


def _once_chosen(inputs: Inputs, text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of a text and a chosen input."""
    row, at = inputs.columns(text, feature)
    row, at = once(row, at)
    return row, inputs.features[at]


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, a probability per category) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"p_{c} double" for c in CATEGORIES)
    return docs.select("doc_id", "text").mapInArrow(_scoring(chain), schema)


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: probabilities, the score of the last category and the verdict at one half."""
    s = score(docs, train(docs, labels, **options))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *(f"p_{c}" for c in CATEGORIES),
                    F.col("p_toxic").alias("score"), (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"))
