"""Ranked lexical search in dual-sorted wavelet trees, one a shard of documents.

The postings of a shard are one sequence of documents: term by term, and for each term by falling impact, which is what a
posting adds to a score before the term's weight. A wavelet matrix over that sequence splits any term's range by the bits
of the document's place and keeps its order. So a range is read two ways: from its front by impact, and down the tree by
doc_id. In each subtree the front of a term's range is the most that the term can add there; their weighted sum bounds
all documents of the subtree. The search opens the subtree with the highest bound first, follows only terms that still
have postings there, and ends when no bound reaches the k-th best document: exact, without scoring every document.

Shards are rows of a table in the shared folder. A block of queries goes through all shards of a task together, and the
k best so far prune the shards after them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import modest_batches, stored
from .words import Words, batches, split

#: Documents and words of a shard. A longer document makes a shard of its own.
SHARD_DOCUMENTS = 4096
SHARD_WORDS = 1 << 20
#: Characters of queries that go through the shards together.
QUERY_CHARACTERS = 2_000_000
#: Subtrees that a query opens at a time.
OPENED = 4
#: Shards of an Arrow batch.
SHARD_ROWS = 4
TOP = 10

#: Fixed values of the score: the scale of an impact, and the share of a document's length in it.
IMPACT, SATURATION, LENGTH_SHARE = 1_000_000_000, 8, 75

#: No impact is greater: it is less than IMPACT / 1000.
MOST = (1 << 20) - 1

_PLAIN = np.full(256, 0x20, np.uint8)
for _keep in (range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B), range(0x80, 0x100)):
    _PLAIN[list(_keep)] = list(_keep)

SHARD = "n_documents long, documents binary, nulls binary, terms binary, sizes binary, impacts binary, bits binary"


class Index(NamedTuple):
    """shards: one row each. documents and words: how many documents have a word, and how many words they have."""

    shards: DataFrame
    documents: int
    words: int


def terms(texts: pa.Array) -> Words:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z as a-z; a null text has none."""
    texts = texts.cast(pa.string()).fill_null("")
    offsets, data = texts.buffers()[1], texts.buffers()[2]
    if data is None:
        return split(texts)
    plain = _PLAIN[np.frombuffer(data, np.uint8)]
    return split(pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, pa.py_buffer(plain)], 0, texts.offset))


def _lengths(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    documents = words = 0
    for piece in pieces:
        for i, j in batches(piece.column(0), 1 << 22):
            n = np.diff(terms(piece.column(0)[i:j]).first)
            documents, words = documents + int((n > 0).sum()), words + int(n.sum())
    yield pa.RecordBatch.from_pydict({"documents": [documents], "words": [words]})


class Shard:
    """A wavelet matrix over the documents of postings, with what is needed to open subtrees of many queries at once."""

    def __init__(self, documents: np.ndarray, nulls: np.ndarray, term: np.ndarray, sizes: np.ndarray, impacts: np.ndarray, bits: np.ndarray):
        # Documents with a greater doc_id, and those without one, come after others of the same score.
        self.last = list(zip((-nulls.astype(np.int64)).tolist(), (-documents).tolist(), strict=True))
        self.terms = term
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.depth, n = max(0, len(self.last) - 1).bit_length(), len(impacts)
        self.zeros, self.total, self.impacts = [], [], [impacts]
        for level in range(self.depth):
            one = np.unpackbits(bits[level * ((n + 7) // 8) : (level + 1) * ((n + 7) // 8)], count=n).view(bool)
            before = np.zeros(n + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            self.total.append(int(before[-1]))
            above = self.impacts[-1]
            self.impacts.append(np.concatenate((above[~one], above[one])))

    @staticmethod
    def pack(ids: list[int | None], places: np.ndarray, hashes: np.ndarray, lengths: np.ndarray, documents: int, words: int) -> dict[str, Any]:
        """A row of the index: ids of documents, and for each of their words its hash and its document's place."""
        nulls = np.array([d is None for d in ids], bool)
        values = np.array([d or 0 for d in ids], np.int64)
        order = np.lexsort((values, nulls))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        term, at = np.unique(hashes, return_inverse=True)
        pair, tf = np.unique(at * len(ids) + rank[places], return_counts=True)
        at, place = np.divmod(pair, len(ids))
        # Of Python's own numbers, so that no product overflows.
        m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * documents // max(1, words) for n in lengths[order].tolist()], np.int64)
        impact = (IMPACT * tf) // (1000 * tf + SATURATION * m[place])
        depth, bits = max(0, len(ids) - 1).bit_length(), []
        # One sort by term, falling impact (below 2^20) and place.
        code = np.sort((at << (20 + depth)) | ((MOST - impact) << depth) | place)
        place, impact = code & ((1 << depth) - 1), MOST - ((code >> depth) & MOST)
        for level in range(depth):
            one = (place >> (depth - 1 - level)) & 1 == 1
            bits.append(np.packbits(one))
            place = np.concatenate((place[~one], place[one]))
        raw = lambda x, kind: np.ascontiguousarray(x, kind).tobytes()
        return {
            "n_documents": len(ids), "documents": raw(values[order], np.int64), "nulls": raw(nulls[order], bool), "terms": raw(term, np.uint64),
            "sizes": raw(np.bincount(at, minlength=len(term)), np.int32), "impacts": raw(impact, np.int32), "bits": b"".join(map(bytes, bits)),
        }

    @classmethod
    def unpack(cls, row: dict[str, Any]) -> Shard:
        kinds = {"documents": np.int64, "nulls": bool, "terms": np.uint64, "sizes": np.int32, "impacts": np.int32, "bits": np.uint8}
        return cls(*(np.frombuffer(row[name], kind) for name, kind in kinds.items()))

    def roots(self, query: Queries) -> tuple[np.ndarray, ...]:
        """Of all queries, the terms that the shard has: query, weight, and the range of postings."""
        if not len(self.terms):
            return (np.zeros(0, np.int64),) * 4
        at = np.minimum(np.searchsorted(self.terms, query.hashes), len(self.terms) - 1)
        have = (self.terms[at] == query.hashes) & (query.weights > 0)
        at = at[have]
        return query.owner[have], query.weights[have], self.first[at], self.first[at + 1]

    def open(self, level: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges, each at its level of the tree, to those of the two subtrees below: shape (2, n), zeros first."""
        out_low, out_high = np.empty((2, len(low)), np.int64), np.empty((2, len(low)), np.int64)
        for k in np.unique(level):
            here = level == k
            a, b = self.zeros[k][low[here]], self.zeros[k][high[here]]
            out_low[0, here], out_high[0, here] = a, b
            out_low[1, here], out_high[1, here] = self.total[k] + low[here] - a, self.total[k] + high[here] - b
        return out_low, out_high

    def front(self, level: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The highest impact of each range."""
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            here = level == k
            out[here] = self.impacts[k][low[here]]
        return out

    def search(self, query: Queries, best: list[list[tuple[int, int, int]]], k: int) -> None:
        """Add to each query's k best (a heap of score, and the negated rank of its id, the worst first)."""
        owner, weight, low, high = self.roots(query)
        if not len(owner):
            return
        heaps: dict[int, list[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        starts = np.flatnonzero(np.concatenate(([True], np.diff(owner) != 0)))
        bounds = np.add.reduceat(weight * self.impacts[0][low], starts)
        ends = np.append(starts[1:], len(owner))
        for q, bound, i, j in zip(owner[starts].tolist(), bounds.tolist(), starts.tolist(), ends.tolist(), strict=True):
            heaps[q] = [(-bound, 0, 0, weight[i:j], low[i:j], high[i:j])]
        while heaps:
            opened = []
            for q in list(heaps):
                heap, found, taken = heaps[q], best[q], 0
                while heap and taken < OPENED:
                    bound, doc, level, *ranges = heap[0]  # doc: the place of the subtree's first document
                    if len(found) == k and (-bound, *self.last[doc]) <= found[0][:3]:
                        heap.clear()  # bounds only fall from here, and places of equal bounds only rise
                        break
                    heapq.heappop(heap)
                    if level == self.depth:
                        add = (-bound, *self.last[doc])
                        if len(found) < k:
                            heapq.heappush(found, add)
                        else:
                            heapq.heapreplace(found, add)
                    else:
                        opened.append((q, doc, level, *ranges))
                        taken += 1
                if not heap and not taken:
                    del heaps[q]
            if opened:
                self._open_all(opened, heaps, best, k)

    def _open_all(self, opened: list[tuple], heaps: dict[int, list], best: list[list[tuple[int, int, int]]], k: int) -> None:
        sizes = np.array([len(o[3]) for o in opened])
        weight, low, high = (np.concatenate([o[i] for o in opened]) for i in (3, 4, 5))
        level = np.repeat([o[2] for o in opened], sizes)
        lows, highs = self.open(level, low, high)
        node = np.repeat(np.arange(len(opened)), sizes)
        for side in (0, 1):
            have = np.flatnonzero(lows[side] < highs[side])
            if not len(have):
                continue
            w, a, b, at = weight[have], lows[side][have], highs[side][have], node[have]
            value = w * self.front(level[have] + 1, a)
            starts = np.flatnonzero(np.concatenate(([True], np.diff(at) != 0)))
            bounds = np.add.reduceat(value, starts).tolist()
            ends = [*starts[1:].tolist(), len(at)]
            for n, bound, i, j in zip(at[starts].tolist(), bounds, starts.tolist(), ends, strict=True):
                q, doc, above = opened[n][:3]
                found, doc = best[q], doc + (side << (self.depth - above - 1))
                if len(found) < k or bound >= found[0][0]:
                    heapq.heappush(heaps[q], (-bound, doc, above + 1, w[i:j], a[i:j], b[i:j]))


class Queries(NamedTuple):
    """Distinct terms of a block of queries: the query that has one, its hash, and its weight times its repeats."""

    owner: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray
    count: int


def _split_queries(texts: list[str | None]) -> Queries:
    found = terms(pa.array(texts, pa.string()))
    pair = np.empty(len(found.start), [("q", np.int64), ("h", np.uint64)])
    pair["q"], pair["h"] = found.row(), found.hashes()
    pair, repeats = np.unique(pair, return_counts=True)
    return Queries(pair["q"].copy(), pair["h"].copy(), repeats.astype(np.int64), len(texts))


def build(docs: DataFrame, shard_documents: int = SHARD_DOCUMENTS, shard_words: int = SHARD_WORDS) -> Index:
    """Index all of docs (doc_id, text) by whole texts; every row is a document. Two passes, and nothing is shuffled.

    Documents without a word are in no posting. Rows with a null doc_id are indexed. An empty table gives an empty index.
    Other columns are not looked at. Terms are 64-bit hashes: 10^9 different ones would share one with a query's term with a
    probability of about 10^-10.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    modest_batches(rows)
    found = rows.select("text").mapInArrow(_lengths, "documents long, words long").agg(F.sum("documents"), F.sum("words")).first()
    documents, words = found[0] or 0, found[1] or 0

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        hashes: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        n = 0

        def shard() -> pa.RecordBatch:
            size = np.concatenate(lengths)
            row = Shard.pack(ids, np.repeat(np.arange(len(ids)), size), np.concatenate(hashes), size, documents, words)
            return pa.RecordBatch.from_pylist([row], SHARD_SCHEMA)

        for piece in pieces:
            for i, j in batches(piece.column(0), 1 << 20):
                cut = terms(piece.column(0)[i:j])
                size = np.diff(cut.first)
                if ids and (len(ids) + j - i > shard_documents or n + len(cut.start) > shard_words):
                    yield shard()
                    ids, hashes, lengths, n = [], [], [], 0
                some = np.flatnonzero(size)
                names = piece.column(1)[i:j].to_pylist()
                ids += [names[r] for r in some]
                hashes.append(cut.hashes())
                lengths.append(size[some])
                n += len(cut.start)
        if ids:
            yield shard()

    return Index(stored(rows.mapInArrow(run, SHARD), "shards"), documents, words)


SHARD_SCHEMA = pa.schema([("n_documents", pa.int64()), *((name, pa.binary()) for name in ("documents", "nulls", "terms", "sizes", "impacts", "bits"))])


def _frequencies(index: Index, wanted: np.ndarray) -> np.ndarray:
    """How many documents hold each of these terms (sorted hashes): from the shards' term tables alone."""

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(wanted), np.int64)
        for piece in pieces:
            for raw, sizes in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                have, size = np.frombuffer(raw, np.uint64), np.frombuffer(sizes, np.int32)
                if not len(have):
                    continue
                at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
                sums += np.where(have[at] == wanted, size[at], 0)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"at": pa.array(some, pa.int64()), "n": pa.array(sums[some], pa.int64())})

    out = np.zeros(len(wanted), np.int64)
    for at, n in index.shards.select("terms", "sizes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # at most one row a term of the block
        out[at] = n
    return out


def _weights(index: Index, query: Queries) -> Queries:
    wanted, at = np.unique(query.hashes, return_inverse=True)
    weight = [math.floor(1000 * math.log((2 * index.documents + 2) / (2 * int(n) + 1))) for n in _frequencies(index, wanted)]
    return query._replace(weights=query.weights * np.array(weight, np.int64)[at] if len(wanted) else query.weights)


def _search(index: Index, query: Queries, k: int) -> DataFrame:
    """query (its place in the block), doc_id, score: the k best of each task at least."""

    def run(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int, int]]] = [[] for _ in range(query.count)]
        for piece in pieces:
            for r in range(piece.num_rows):
                Shard.unpack({name: piece.column(name)[r].as_py() for name in piece.schema.names}).search(query, best, k)
        rows = [(q, None if null else -doc, score) for q, found in enumerate(best) for score, null, doc in found if score > 0]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query", "doc_id", "score"])

    return index.shards.mapInArrow(run, "query long, doc_id long, score long")


def _blocks(queries: DataFrame) -> Iterator[list[tuple[Any, str | None]]]:
    """Queries as (item_id, text), so many at a time that their characters are bounded; one longer query goes alone."""
    block: list[tuple[Any, str | None]] = []
    n = 0
    for item, text in queries.select("item_id", F.col("text").cast("string")).toLocalIterator():
        if block and n + len(text or "") > QUERY_CHARACTERS:
            yield block
            block, n = [], 0
        block.append((item, text))
        n += len(text or "") + 10
    if block:
        yield block


def search(index: Index, queries: DataFrame, k: int = TOP) -> DataFrame:
    """For each row of queries (item_id, text) its k best documents: item_id, rank (from 1), doc_id, score.

    Documents without a term of the query have no score and are not there. Equal scores go by ascending doc_id, a null one
    last; repeated rows of documents are documents of their own. Queries that are null or have no term have no rows, and
    repeated queries have their rows as often. Queries go through the shards in blocks of a bounded size.
    """
    spark, parts = queries.sparkSession, []
    item_type = queries.schema["item_id"].dataType
    for block in _blocks(queries):
        query = _weights(index, _split_queries([text for _, text in block]))
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = _search(index, query, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(block)], StructType([StructField("query", LongType()), StructField("item_id", item_type)]))
        parts.append(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], StructType([StructField("item_id", item_type)])).selectExpr("item_id", "0 as rank", "0L as doc_id", "0L as score")
    return reduce(DataFrame.unionByName, parts)
