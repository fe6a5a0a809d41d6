"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by gradient descent in numpy.

A text's subwords are its runs of 3 and 4 bytes, in lower case, with everything but letters read as one space. Their
embeddings are averaged over the whole text. Scores are softened by a temperature fitted on texts kept out of training,
and a text is rejected when its score is below what nearly all of those reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, modest_batches, packed, unpacked
from .training import sample
from .words import batches

BUCKETS = 1 << 16
DIMENSIONS = 16
SIZES = (3, 4)
#: Bytes of text whose subwords are in memory at once; a longer text's are taken piece by piece, none of them lost or added.
BLOCK = 1 << 18
#: Labelled rows that training takes at most.
TRAINING_ROWS = 4000
EPOCHS = 3
RATE = 20.0
#: The share of kept-out texts whose scores lie below the threshold of rejection, and what it is multiplied with.
REJECTED, SLACK = 0.001, 0.8
UNKNOWN = "und"

_UPPER, _LOWER = np.uint32(0x9E3779B1), np.uint32(16)


def _plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in lower case, runs of what are no letters as one space, one of these before each text; and where each begins."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    offsets = np.frombuffer(low.buffers()[1], np.int32 if pa.types.is_string(low.type) else np.int64)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    raw = low.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    letter = ((data >= 97) & (data <= 122)) | (data >= 0x80)
    data = np.where(letter, data, np.uint8(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    # One space between words, and one before the first.
    seen = np.concatenate(([0], np.cumsum(keep)))
    return data[keep], seen[offsets]


def _buckets(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of runs of n bytes, and which of the runs are subwords: a space may only be their first or last byte."""
    m = len(data) - n + 1
    h = np.zeros(m, np.uint32)
    for k in range(n):
        h = h * np.uint32(257) + data[k : k + m]
    return ((h * _UPPER + np.uint32(n)) >> _LOWER).astype(np.int64), (data[1 : m + 1] != 32) & (data[n - 2 : n - 2 + m] != 32)


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, text by text, and where each text's begin (one more entry than texts)."""
    data, offsets = _plain(texts)
    ids, row = [], np.repeat(np.arange(len(texts)), np.diff(offsets))
    counts = np.zeros(len(texts), np.int64)
    parts = []
    for n in SIZES:
        m = len(data) - n + 1
        if m <= 0:
            continue
        found, inside = _buckets(data, n)
        inside &= row[:m] == row[n - 1 :]
        ids.append(found[inside])
        parts.append(row[:m][inside])
        counts += np.bincount(parts[-1], minlength=len(texts))
    starts = np.concatenate(([0], np.cumsum(counts)))
    if not ids:
        return np.zeros(0, np.int64), starts
    order = np.argsort(np.concatenate(parts), kind="stable")
    return np.concatenate(ids)[order], starts


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray  # (buckets, languages): embedding times output weights
    temperature: float
    threshold: float

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return _softmax(_means(self.scores, pc.fill_null(texts, "")) / self.temperature)


def _means(table: np.ndarray, texts: pa.Array) -> np.ndarray:
    """The mean of table's rows over each text's subwords; zeros for a text without any."""
    sums, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    for i, j in batches(texts, BLOCK):
        if j - i == 1 and texts[i].as_buffer() is not None and texts[i].as_buffer().size > BLOCK:
            data, _ = _plain(texts[i:j])
            for size in SIZES:
                # Pieces share what a run over their border needs.
                for k in range(0, len(data) - size + 1, BLOCK):
                    found, inside = _buckets(data[k : k + BLOCK + size - 1], size)
                    sums[i] += table[found[inside]].sum(0, dtype=np.float64)
                    n[i] += inside.sum()
        else:
            sums[i:j], n[i:j] = _sums(table, texts[i:j])
    return sums / np.maximum(n, 1)[:, None]


def _sums(table: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ids, starts = subwords(texts)
    n = np.diff(starts)
    sums = np.zeros((len(texts), table.shape[1]))
    if len(ids):
        some = n > 0
        sums[some] = np.add.reduceat(table[ids], starts[:-1][some], axis=0)
    return sums, n


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: pa.Array, languages: list[str], seed: int = 5) -> Model:
    """Each language weighs the same, however many texts it has. One text in five only calibrates."""
    names = tuple(sorted(set(languages)))
    y = np.array([names.index(x) for x in languages], np.int64)
    # Distinct buckets of each text and their shares, end to end: few large arrays, which leave nothing behind.
    buckets, shares, sizes = [], [], [0]
    for i, j in batches(texts, BLOCK):
        ids, starts = subwords(texts[i:j])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            u, n = np.unique(ids[a:b].astype(np.uint16), return_counts=True)
            buckets.append(u)
            shares.append((n / max(1, b - a)).astype(np.float32))
            sizes.append(len(u))
    ends = np.cumsum(sizes)
    buckets, shares = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((buckets, np.uint16), (shares, np.float32)))
    bag = lambda k: (buckets[ends[k] : ends[k + 1]], shares[ends[k] : ends[k + 1]])
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(names)), np.float32)
    order = rng.permutation(len(texts))
    kept, used = order[: len(order) // 5], order[len(order) // 5 :]
    weight = 1 / np.maximum(np.bincount(y[used], minlength=len(names)), 1)
    weight = weight / weight[y[used]].mean() if len(used) else weight
    steps, done = EPOCHS * max(1, len(used)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(used):
            u, n = bag(k)
            mean = n @ table[u]
            p = _softmax((mean @ out)[None])[0]
            p[y[k]] -= 1
            p *= min(weight[y[k]], 10.0) * (1 - done / steps)
            back = out @ p
            out -= RATE / 20 * np.outer(mean, p)
            table[u] -= RATE * n[:, None] * back
            done += 1
    scores = (table @ out).astype(np.float32)
    kept = kept if len(kept) else used
    logits = np.array([n @ scores[u] for u, n in map(bag, kept)]).reshape(len(kept), len(names))
    grid = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(kept)), y[kept]], 1e-12)).mean() for t in grid] if len(kept) else [0.0]
    t = float(grid[int(np.argmin(loss))])
    best = _softmax(logits / t).max(1) if len(kept) else np.ones(1)
    floor = 1 / max(2, len(names))
    # Never below what ignorance scores, never above an even chance.
    threshold = float(np.clip(SLACK * np.quantile(best, REJECTED), min(1.4 * floor, 0.5), 0.5))
    return Model(names, scores, t, threshold)


def fit(docs: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Learns from text and lang of a bounded sample of the documents outside the held-out fold; each language may take an equal part of it."""
    modest_batches(docs)
    known = docs.where(~held_out()).where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    got = sample(known, rows, by="lang")
    return train(got.column("text").combine_chunks(), got.column("lang").to_pylist())


PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def _predicted(model):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in source:
            texts = pc.fill_null(batch.column(2), "")
            p = m.probabilities(texts)
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            best = p.argmax(1)
            names = np.array([*m.languages, UNKNOWN], dtype=object)
            score = np.where(letters, p[np.arange(len(p)), best], 0.0)
            found = names[np.where(letters, best, len(m.languages))]
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(score), pa.array(~letters | (score < m.threshold))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def predicted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each of docs: doc_id, held_out, lang_pred, score, rejected.

    A null text, or one without letters, is `und` with score 0 and rejected. Where no row has a language to learn from,
    every text is `und`. Null doc_ids count as held out. Rows that repeat come as often. Very long texts are read whole.
    Other columns are not looked at; an empty table gives an empty one. The model has 2^16 rows of one number for each
    language, whatever the input.
    """
    model = model or fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    if not model.languages:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    return rows.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model)), PREDICTION)


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs that language ID does not reject, unchanged, whatever their columns are called."""
    model = model or fit(docs)
    if not model.languages:
        return docs.limit(0)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = packed(docs, text=F.col("text").cast("string")).select("row", "text")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = pc.fill_null(batch.column(1), "")
            ok = (sent.value.probabilities(texts).max(1) >= sent.value.threshold) & pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            yield batch.select([0]).filter(pa.array(ok))

    return unpacked(rows.mapInArrow(run, rows.select("row").schema), docs.columns)
