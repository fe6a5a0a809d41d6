"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores the alignment.

Seeds are n-grams of the items. How many texts of the whole corpus hold each one is counted first, and every stretch of
an item gives its rarest n-gram as a seed, so that an item of common words has seeds as well. Where a text holds a
seed, the words around it are aligned with the item's. The items go to the tasks in blocks of a bounded size; texts are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import modest_batches, packed, stored, unpacked
from .words import batches, fold, split

NGRAM = 3
#: Every so many words of an item give one seed.
STRETCH = 4
#: Characters of items in one block: the bound of what is broadcast.
BLOCK_CHARS = 4_000_000
#: Share of an item's best possible alignment score at which a passage counts as a copy of it.
THRESHOLD = 0.55
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items of fewer words are only found as a whole: a share of their score would be a few common words.
SHORT = 8
#: Pairs of an n-gram of a text and a seed that are looked at together, whatever number of items share a seed.
PAIRS = 1 << 18


class Items:
    """A block of items: word hashes, and n-gram keys with their items and places."""

    def __init__(self, ids: np.ndarray, texts: list[str]):
        words = split(pa.array(texts, pa.string()))
        hashes = words.hashes()
        self.ids, self.first, self.words = ids, words.first, hashes
        sizes = np.diff(words.first)
        grams = fold(hashes, NGRAM) if len(hashes) >= NGRAM else np.zeros(0, np.uint64)
        place = np.arange(len(hashes)) - np.repeat(words.first[:-1], sizes)
        item = np.repeat(np.arange(len(sizes)), sizes)
        inside = place[: len(grams)] + NGRAM <= sizes[item[: len(grams)]]
        self.grams, self.item, self.place = grams[inside], item[: len(grams)][inside], place[: len(grams)][inside]
        self.sizes = sizes
        self.keys = np.unique(self.grams)

    def seeds(self, counts: np.ndarray) -> None:
        """Keep the rarest n-gram of each stretch; counts go with keys."""
        rarity = counts[np.searchsorted(self.keys, self.grams)]
        stretch = self.place // STRETCH
        order = np.lexsort((self.place, rarity, stretch, self.item))
        at = np.stack((self.item[order], stretch[order]))
        first = np.ones(len(order), bool)
        first[1:] = (at[:, 1:] != at[:, :-1]).any(0)
        order = order[first]
        order = order[np.argsort(self.grams[order], kind="stable")]
        self.seed_key, self.seed_item, self.seed_place = self.grams[order], self.item[order], self.place[order]
        self.probe = _probe(self.seed_key)


def _probe(keys: np.ndarray) -> np.ndarray:
    """A table of 2^20 flags that tells most n-grams from the keys at once."""
    out = np.zeros(1 << 20, bool)
    out[(keys >> np.uint64(44)).astype(np.int64)] = True
    return out


def align(text: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of rows of word hashes: (B, W) windows of texts with (B, L) items; 0 stands for no word.

    Returns the best score of each row, and the window's words from its first to after its last: of alignments with that
    score the one that ends first, and of these the one that begins last. Each cell carries where its alignment began, in
    the low half of the number that is maximised.
    """
    b, w = text.shape
    one = np.int64(1) << 32
    steps = -GAP * one * np.arange(1, w + 1)
    places = np.arange(w, dtype=np.int64)
    row = np.zeros((b, w), np.int64)
    best, start, end = np.zeros(b, np.int64), np.zeros(b, np.int64), np.zeros(b, np.int64)
    for i in range(item.shape[1]):
        word = item[:, i : i + 1]
        diagonal = np.zeros_like(row)
        diagonal[:, 1:] = row[:, :-1]
        # Where nothing was aligned, an alignment begins here.
        diagonal = np.where(diagonal < one, places, diagonal)
        same = (text == word) & (word != 0)
        score = np.maximum(diagonal + np.where(same, MATCH * one, MISMATCH * one), row + GAP * one)
        score[score < one] = 0
        # A gap along the window: the best of all starts, each less what the gap costs.
        score = np.maximum.accumulate(score + steps, axis=1) - steps
        live = (word != 0) & (text != 0) & (score >= one)
        row = np.where(live, score, 0)
        high = (row >> 32).max(1)
        some = np.flatnonzero((high >= best) & (high > 0))
        at = (row[some] >> 32).argmax(1)
        begins = row[some, at] & (one - 1)
        better = (high[some] > best[some]) | (at + 1 < end[some]) | (at + 1 == end[some]) & (begins > start[some])
        some, at = some[better], at[better]
        best[some], end[some], start[some] = high[some], at + 1, begins[better]
    return best, start, end


def _counted(items):
    """How many texts hold each n-gram key: sums of a task."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        probe, total = _probe(block.keys), np.zeros(len(block.keys), np.int64)
        for batch in source:
            texts = batch.column(1)
            for i, j in batches(texts):
                words = split(texts[i:j])
                grams, row = fold(words.hashes(), NGRAM), words.row()
                hit = np.flatnonzero(probe[(grams >> np.uint64(44)).astype(np.int64)])
                at = np.searchsorted(block.keys, grams[hit])
                ok = (at < len(block.keys)) & (block.keys[np.minimum(at, len(block.keys) - 1)] == grams[hit])
                ok &= row[hit] == row[np.minimum(hit + NGRAM - 1, len(row) - 1)]
                pair = np.unique(np.stack((row[hit[ok]], at[ok])), axis=1)
                total += np.bincount(pair[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["key", "n"])

    return run


FOUND = "doc_id long, item_id long, score double, start long, end long"


def _aligned(items, threshold: float):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Items = items.value
        for batch in source:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in batches(texts):
                words = split(texts[i:j])
                hashes, row = words.hashes(), words.row()
                got = _search(block, words.first, hashes, row, threshold)
                if got is None:
                    continue
                r, item, score, lo, hi = got
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[i:j].take(pa.array(r)),
                        pa.array(block.ids[item]),
                        pa.array(score),
                        pa.array(words.characters(words.start[lo], r)),
                        pa.array(words.characters(words.end[hi - 1], r)),
                    ],
                    names=["doc_id", "item_id", "score", "start", "end"],
                )

    return run


def _search(block: Items, first, hashes, row, threshold):
    """Rows, items, scores and word ranges of alignments over the threshold; the best one of each text and item."""
    grams = fold(hashes, NGRAM)
    hit = np.flatnonzero(block.probe[(grams >> np.uint64(44)).astype(np.int64)])
    lo, hi = np.searchsorted(block.seed_key, grams[hit], "left"), np.searchsorted(block.seed_key, grams[hit], "right")
    n = np.where(row[hit] == row[np.minimum(hit + NGRAM - 1, len(row) - 1)], hi - lo, 0) if len(hit) else hi - lo
    hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
    reach = np.cumsum(n)
    best: dict[tuple[int, int], tuple] = {}
    begin = 0
    while begin < len(hit):
        stop = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + PAIRS, "right")))
        for text, item, score, s, e in _scored(block, first, hashes, row, hit[begin:stop], lo[begin:stop], n[begin:stop], threshold):
            now = best.get((text, item))
            if now is None or (-score, s, e) < (-now[0], now[1], now[2]):
                best[text, item] = (score, s, e)
        begin = stop
    if not best:
        return None
    found = sorted((*k, *v) for k, v in best.items())
    return tuple(np.array(c) for c in zip(*found, strict=True))


def _scored(block: Items, first, hashes, row, hit, lo, n, threshold) -> list[tuple[int, int, float, int, int]]:
    """Alignments over the threshold around some of a batch's seeds: row, item, score, and its range of words."""
    at = np.repeat(hit, n)
    seed = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, text = block.seed_item[seed], row[at]
    # A window begins where the item would, a quarter of its length earlier; seeds of the same place share one.
    size = block.sizes[item]
    slack = size // 4 + 4
    begin = (at - block.seed_place[seed] - slack) // slack
    key = np.unique(np.stack((text, item, begin)), axis=1)
    text, item, begin = key
    size, slack = block.sizes[item], block.sizes[item] // 4 + 4
    begin = begin * slack
    stop = np.minimum(begin + size + 3 * slack, first[text + 1])
    begin = np.maximum(begin, first[text])
    out: list[tuple] = []
    order = np.argsort(size, kind="stable")
    k = 0
    while k < len(order):
        # Items of about one length at a time, in about two million cells.
        width = int(max((stop - begin)[order[k : k + 4096]].max(), 1))
        some = order[k : k + max(1, 400_000 // width)]
        k += len(some)
        rows = np.arange(len(some))
        w, m = int((stop - begin)[some].max()), int(size[some].max())
        window, other = np.zeros((len(some), w), np.uint64), np.zeros((len(some), m), np.uint64)
        cols = begin[some][:, None] + np.arange(w)
        inside = cols < stop[some][:, None]
        window[inside] = hashes[cols[inside]]
        cols = np.arange(m) + np.zeros((len(some), 1), np.int64)
        inside = cols < size[some][:, None]
        other[inside] = block.words[(block.first[item[some]][:, None] + cols)[inside]]
        best, start, end = align(window, other)
        share = best / (MATCH * np.maximum(size[some], 1))
        ok = share >= np.where(size[some] < SHORT, 1.0, threshold)
        for q in rows[ok]:
            p = some[q]
            out.append((int(text[p]), int(item[p]), float(share[q]), int(begin[p] + start[q]), int(begin[p] + end[q])))
    return out


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Items in blocks of about so many characters, by ranges of item_id; the driver holds one block at a time."""
    items = benchmark.where("item_id is not null and text is not null").groupBy(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).count()
    items = stored(items.select("item_id", "text"), "items")
    sized = items.select("item_id", F.length("text").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    n = total // block_chars + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        if part.num_rows:
            yield part.column("item_id").to_numpy(), part.column("text").to_pylist()


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, score (share of the item's best score), start, end (code points): the best alignment of each pair.

    Documents that hold no item within the threshold have no row. An item of fewer than `SHORT` words has to stand in
    the text word for word; one of fewer than `NGRAM` words is not looked for. Rows without an id, and null or empty
    texts, on either side match nothing; items that share an id count as one with several texts; a repeated document
    row comes once. Words are cut at ASCII white space and A-Z count as a-z. Very long texts are read whole, and other
    columns of docs not looked at. No benchmark items, or no docs, give an empty table.
    """
    modest_batches(docs)
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    parts = []
    for ids, item_texts in _blocks(benchmark, block_chars):
        block = Items(ids, item_texts)
        if not len(block.keys):
            continue
        sent = spark.sparkContext.broadcast(block)
        counts = texts.mapInArrow(_counted(sent), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        total = np.zeros(len(block.keys), np.int64)
        total[counts.column("key").to_numpy()] = counts.column("n").to_numpy()
        block.seeds(total)
        parts.append(stored(texts.mapInArrow(_aligned(spark.sparkContext.broadcast(block), threshold), FOUND), "alignments"))
    if not parts:
        return spark.createDataFrame([], FOUND)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    by = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("score"), "start", "end")
    return out.withColumn("rank", F.row_number().over(by)).where("rank = 1").drop("rank")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs less the rows whose doc_id `contaminated` names. Rows without a doc_id stay."""
    found = stored(contaminated(docs, benchmark, threshold).select("doc_id").distinct(), "contaminated")
    return unpacked(packed(docs).join(found, "doc_id", "left_anti"), docs.columns)
