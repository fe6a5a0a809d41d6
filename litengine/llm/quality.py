"""Quality by positive-unlabelled learning: the non-negative unbiased risk of a linear model.

Positives are documents marked as good; the unlabelled ones are any documents, whatever their marks. The share of good
ones among the unlabelled is estimated first, by how a classifier of positives against unlabelled ones scores both.
A text's features are shares and lengths of its whole text, each cut at quantiles, so that a linear model can bend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, modest_batches
from .training import sample
from .words import batches, fold, split

#: Rows of either kind that training takes at most.
TRAINING_ROWS = 5000
#: Quantiles at which a feature is cut: close at the ends, where what is odd about a text shows.
CUTS = (0.005, 0.015, 0.03, 0.06, 0.1, 0.25, 0.5, 0.75, 0.9, 0.94, 0.97, 0.985, 0.995)
EPOCHS, RATE, RIDGE = 120, 0.05, 1e-4
#: The share of positives that may score below one half.
MISSED = 0.005
#: The threshold of the prediction.
GOOD = 0.3

FEATURES = (
    "log words", "word length", "word length spread", "upper", "digits", "punctuation", "other signs", "non-ASCII", "lines a word", "short lines",
    "equal neighbours", "distinct words", "distinct pairs", "distinct fives", "words with signs", "most common word", "end marks", "bars",
)


def features(texts: pa.Array) -> np.ndarray:
    """A row of numbers for each text; an empty one has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, j in batches(texts):
        words = split(texts[i:j])
        data, rows, first = words.data, words.rows, words.first
        hashes, row = words.hashes(), words.row()
        size = np.maximum(np.diff(rows), 1).astype(float)
        n = np.diff(first)
        some = np.maximum(n, 1).astype(float)
        sums = lambda mask, at=rows: np.diff(np.concatenate(([0], np.cumsum(mask)))[at])
        kind = _KIND[data]
        length = (words.end - words.start).astype(float)
        by_row = lambda x: np.bincount(row, x, len(n)) if len(row) else np.zeros(len(n))
        mean = by_row(length) / some
        lines = sums(data == 10) + 1
        mark = np.concatenate(([0], np.cumsum(kind == 4)))
        signed = (mark[words.end] - mark[words.start]) > 1 if len(row) else np.zeros(0)
        same = np.zeros(len(hashes))
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        distinct = [_distinct(fold(hashes, k), row[: max(0, len(row) - k + 1)], row[k - 1 :], len(n)) for k in (1, 2, 5)]
        last = data[np.maximum(words.end - 1, 0)] if len(row) else data[:0]
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        short = by_row(np.concatenate(([0.0], (breaks[words.start[1:]] > breaks[words.start[:-1]]).astype(float))) if len(row) else np.zeros(0))
        out[i:j] = np.stack(
            [
                np.log1p(n), mean, np.sqrt(np.maximum(by_row(length**2) / some - mean**2, 0)), sums(kind == 1) / size, sums(kind == 2) / size, sums(kind == 3) / size,
                sums(kind == 4) / size, sums(kind == 5) / size, lines / some, short / lines, by_row(same) / some, distinct[0][0], distinct[1][0], distinct[2][0],
                by_row(signed.astype(float)) / some, distinct[0][1], by_row(((last == 46) | (last == 33) | (last == 63)).astype(float)) / some, sums(data == 124) / some,
            ], 1
        )
        out[i:j][n == 0] = 0
    return out


_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 3
_KIND[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_KIND[128:] = 5


def _distinct(h: np.ndarray, row: np.ndarray, end_row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row's runs of words: the share that are distinct, and the share of the most common one."""
    inside = row == end_row
    h, row = h[inside], row[inside]
    n = np.bincount(row, minlength=rows)
    if not len(h):
        return np.ones(rows), np.zeros(rows)
    # Sorting by hash within each row.
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    most = np.zeros(rows)
    np.maximum.at(most, row[at], runs)
    return np.where(n > 0, np.bincount(row[at], minlength=rows) / np.maximum(n, 1), 1.0), most / np.maximum(n, 1)


@dataclass(frozen=True)
class Model:
    edges: np.ndarray  # (features, cuts)
    weights: np.ndarray  # one for each bin of each feature
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[_bins(self.edges, x)].sum(1) + self.bias, -40, 40)))


def _bins(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The index of each feature's bin among all weights."""
    return np.stack([np.searchsorted(e, x[:, k], "left") + k * (edges.shape[1] + 1) for k, e in enumerate(edges)], 1)


def _sgd(bins, sign_risk, n_weights: int, rng, bias: float) -> tuple[np.ndarray, float]:
    """Adam on what sign_risk gives: the derivative of the risk by each row's margin."""
    w, m, v = np.zeros(n_weights + 1), np.zeros(n_weights + 1), np.zeros(n_weights + 1)
    w[-1] = bias
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bins))
        for k in range(0, len(order), 512):
            part = order[k : k + 512]
            z = w[bins[part]].sum(1) + w[-1]
            d = sign_risk(part, z)
            grad = np.append(np.bincount(bins[part].ravel(), np.repeat(d, bins.shape[1]), n_weights), d.sum()) + RIDGE * w
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def prior(positive: np.ndarray, unlabelled: np.ndarray, n_weights: int, rng) -> float:
    """The share of positives among the unlabelled: the least ratio of their shares over sets that a classifier picks.

    A classifier of positives against unlabelled orders the rows; above each of its thresholds lies a share of either
    kind, and unlabelled over positive there is at least the prior, with equality where all are positive.
    """
    bins = np.concatenate((positive, unlabelled))
    half = rng.random(len(bins)) < 0.5
    y = np.arange(len(bins)) < len(positive)
    weight = np.where(y, 0.5 / max(1, len(positive)), 0.5 / max(1, len(unlabelled))) * len(bins)
    used = np.flatnonzero(half)
    w, b = _sgd(bins[used], lambda part, z: weight[used][part] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[used][part]) / len(part), n_weights, rng, 0.0)
    z = w[bins[~half]].sum(1) + b
    p, u = np.sort(z[y[~half]]), np.sort(z[~y[~half]])
    if not len(p) or not len(u):
        return 0.5
    cuts = np.quantile(p, np.linspace(0.0, 0.7, 36))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    ratio = above_u / above_p + np.sqrt(above_u / len(u)) / above_p
    return float(np.clip(ratio.min(), 0.05, 0.99))


def train(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 9) -> Model:
    """From features of positive and of unlabelled texts. Batches whose negative risk falls below 0 step back up."""
    rng = np.random.default_rng(seed)
    every = np.concatenate((positive, unlabelled))
    edges = np.quantile(every, CUTS, axis=0).T if len(every) else np.zeros((len(FEATURES), len(CUTS)))
    n = edges.size + len(edges)
    if not len(positive) or not len(unlabelled):
        return Model(edges, np.zeros(n), 0.0, 0.5)
    p, u = _bins(edges, positive), _bins(edges, unlabelled)
    pi = prior(p, u, n, rng)
    bins, is_p = np.concatenate((p, u)), np.arange(len(p) + len(u)) < len(p)

    def risk(part: np.ndarray, z: np.ndarray) -> np.ndarray:
        # Sigmoid loss: l(z) = 1 / (1 + e^z) for a positive, 1 - l(z) for a negative.
        s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        slope = s * (1 - s)
        a = is_p[part]
        np_, nu = max(1, a.sum()), max(1, (~a).sum())
        negative = (s[~a].sum() / nu) - pi * (s[a].sum() / np_)
        d_negative = np.where(a, -pi * slope / np_, slope / nu)
        if negative < 0:
            return -d_negative
        return np.where(a, -pi * slope / np_, 0.0) + d_negative

    w, b = _sgd(bins, risk, n, rng, 0.0)
    # The sigmoid loss leaves the level of the scores open: nearly all positives are to lie above one half.
    return Model(edges, w, -float(np.quantile(w[p].sum(1), MISSED)), pi)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Learns from bounded samples outside the held-out fold: documents marked good, and any documents."""
    marks = labels.where(~held_out()).where("quality = 1").select("doc_id").distinct()
    texts = docs.where(~held_out()).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("bytes", F.octet_length("text"))
    good, any_ = (sample(x, rows).column("text").combine_chunks() for x in (texts.join(marks, "doc_id", "left_semi"), texts))
    return train(features(_plain(good)), features(_plain(any_)))


def _plain(x) -> pa.Array:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return pc.fill_null(x.cast(pa.string()), "")


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each of docs: doc_id, held_out, score (0 to 1), predicted (score >= `GOOD`).

    Null texts score as empty ones, by the bins of a text without words. Null doc_ids count as held out. Repeated rows
    come as often. Very long texts are read whole; other columns are not looked at. An empty table gives an empty one.
    The model is a table of fixed size.
    """
    modest_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            score = sent.value.score(features(_plain(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= GOOD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORED)
