"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a balanced hierarchical clustering of a bounded sample, and are searched by an in-memory graph of
their neighbours. A vector near a boundary goes to several lists. A query reads the lists whose centroids are within a
ratio of its nearest one's distance; each list is scanned with exact cosines in double precision. Equal vectors are one
class, so that a vector that a third of all rows share is stored and scanned once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import modest_batches, stored

#: Distinct vectors that a list should hold, lists at most, and sampled vectors a list for the clustering.
LIST_SIZE, MAX_LISTS, SAMPLED = 64, 8192, 16
#: Lists that a vector goes to at most, and how much farther than the nearest a list's centroid may be.
COPIES, BOUNDARY = 4, 0.25
#: How much farther than its nearest centroid a query looks.
REACH = 0.25
#: Neighbours of a centroid in the graph, and the width of a search in it.
DEGREE, BEAM = 24, 32
#: Postings of a list that one task scans with all of the list's queries.
SHARD = 4096
#: Rows of answers that a task holds before it merges them.
HELD = 500_000


def _normal(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def centroids(x: np.ndarray, lists: int, seed: int = 10) -> np.ndarray:
    """Unit centroids of so many clusters: parts get lists in proportion to their sizes, so that lists come out alike."""
    rng, out = np.random.default_rng(seed), []
    todo = [(_normal(x.astype(np.float32)), lists)]
    while todo:
        part, n = todo.pop()
        if n <= 1 or len(part) <= n:
            out += [part.mean(0)] if n <= 1 else list(part)
            continue
        k = min(8, n)
        mid = part[rng.choice(len(part), k, replace=False)]
        for _ in range(8):
            own = (part @ mid.T).argmax(1)
            mid = _normal(np.stack([part[own == c].mean(0) if (own == c).any() else part[rng.integers(len(part))] for c in range(k)]))
        own = (part @ mid.T).argmax(1)
        sizes = np.bincount(own, minlength=k)
        share = n * sizes / len(part)
        give = np.maximum(np.floor(share).astype(int), (sizes > 0).astype(int))
        while give.sum() < n:
            give[np.argmax(share - give)] += 1
        while give.sum() > n:
            give[np.argmax(np.where(give > 1, give - share, -np.inf))] -= 1
        todo += [(part[own == c], int(give[c])) for c in range(k) if sizes[c]]
    return _normal(np.stack(out)).astype(np.float32)


@dataclass(frozen=True)
class Graph:
    points: np.ndarray
    near: np.ndarray  # (lists, degree): neighbours of each point, itself where there are fewer
    doors: np.ndarray  # where searches begin
    usual: float  # the usual distance of a vector to its nearest centroid

    def search(self, q: np.ndarray, width: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Nearest points found for each unit row of q, nearest first, with distances; -1 and infinity where there are no more."""
        n, c = len(q), len(self.points)
        width = min(width, c)
        seen = np.zeros((n, c), bool)
        d = self._distance(q, np.tile(self.doors, (n, 1)))
        start = np.argsort(d, axis=1)[:, : min(4, len(self.doors))]
        ids = np.full((n, width), -1)
        dist = np.full((n, width), np.inf)
        k = min(width, start.shape[1])
        ids[:, :k], dist[:, :k] = self.doors[start[:, :k]], np.take_along_axis(d, start[:, :k], 1)
        np.put_along_axis(seen, self.doors[start], True, 1)
        done = ids < 0
        rows = np.arange(n)[:, None]
        while not done.all():
            pick = np.argsort(np.where(done, np.inf, dist), axis=1)[:, :4]
            live = ~np.take_along_axis(done, pick, 1)
            np.put_along_axis(done, pick, True, 1)
            new = self.near[np.take_along_axis(ids, pick, 1)].reshape(n, -1)
            new = np.where(np.repeat(live, self.near.shape[1], 1), new, -1)
            fresh = (new >= 0) & ~seen[rows, new]
            row, col = np.nonzero(fresh)
            seen[row, new[row, col]] = True
            far = np.where(fresh, self._distance(q, np.maximum(new, 0)), np.inf)
            ids, dist = np.concatenate((ids, np.where(fresh, new, -1)), 1), np.concatenate((dist, far), 1)
            done = np.concatenate((done, ~fresh), 1)
            # A point that stands twice among the new ones is kept once.
            order = np.lexsort((ids, dist), axis=1)
            ids, dist, done = (np.take_along_axis(x, order, 1) for x in (ids, dist, done))
            twin = np.zeros_like(done)
            twin[:, 1:] = (ids[:, 1:] == ids[:, :-1]) & (ids[:, 1:] >= 0)
            dist[twin], done[twin] = np.inf, True
            ids[twin] = -1
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            ids, dist, done = (np.take_along_axis(x, order, 1) for x in (ids, dist, done))
        return ids, dist

    def within(self, q: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each row the points within (1 + reach) of its nearest one's distance, by following the graph inside that range."""
        ids, dist = self.search(q)
        out = []
        for v, first, d0 in zip(q, ids, dist[:, 0], strict=True):
            bound = (1 + reach) * max(d0, self.usual)
            seen = np.zeros(len(self.points), bool)
            front = first[first >= 0]
            seen[front] = True
            got = [front]
            while len(front):
                new = np.unique(self.near[front])
                new = new[~seen[new]]
                seen[new] = True
                front = new[self._distance(v[None], new[None])[0] <= bound]
                got.append(front)
            every = np.unique(np.concatenate(got))
            out.append(every[self._distance(v[None], every[None])[0] <= bound])
        return out

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,nkd->nk", q, self.points[ids])))


def graph(points: np.ndarray, sample: np.ndarray) -> Graph:
    c = len(points)
    near = np.empty((c, min(DEGREE, c)), np.int64)
    for i in range(0, c, 1024):
        near[i : i + 1024] = np.argsort(-(points[i : i + 1024] @ points.T), axis=1)[:, : near.shape[1]]
    # A few far neighbours keep the graph in one piece.
    if c > DEGREE:
        rng = np.random.default_rng(1)
        near[:, -3:] = rng.integers(0, c, (c, 3))
    doors = np.unique(np.linspace(0, c - 1, min(c, max(4, int(4 * np.sqrt(c))))).astype(np.int64))
    part = sample[:: max(1, len(sample) // 4096)]
    usual = float(np.median(np.sqrt(np.maximum(0, 2 - 2 * (part @ points.T).max(1))))) if len(part) else 0.0
    return Graph(points, near, doors, usual)


VECTORS = "vec_id long, key binary, vector binary, size int"


def _vectors(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that take part, as bytes of doubles, with a digest that equal ones share. -0 counts as 0."""
    for batch in source:
        ids, rows = batch.column(0), []
        for vec_id, v in zip(ids.to_pylist(), batch.column(1), strict=True):
            if vec_id is None or not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
            if np.isfinite(x).all() and x.any():
                data = x.tobytes()
                rows.append((vec_id, hashlib.md5(data).digest(), data, len(x)))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["vec_id", "key", "vector", "size"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _posted(index):
    """A vector's lists: the nearest, and others that are about as near and not nearer to one already taken."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Graph = index.value
        for batch in source:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _normal(_matrix(part.column("vector"))).astype(np.float32)
                ids, dist = g.search(x)
                ids, dist = ids[:, :COPIES], dist[:, :COPIES]
                ok = (ids >= 0) & (dist <= (1 + BOUNDARY) * np.maximum(dist[:, :1], 1e-6))
                row, col = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, col].astype(np.int32)), part.column("rep").take(pa.array(row)), part.column("vector").take(pa.array(row))], names=["list", "rep", "vector"])

    return run


def _asked(index):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = index.value.within(_normal(_matrix(part.column("vector"))).astype(np.float32), REACH)
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int32)), part.column("rep").take(pa.array(row)), part.column("vector").take(pa.array(row))], names=["list", "rep", "vector"])

    return run


def _merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (query, class, score), the k best of each query; a class that several lists gave counts once."""
    q, c, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
    q, c, score = q[new], c[new], score[new]
    keep = np.arange(len(q)) - np.searchsorted(q, q, "left") < k
    return q[keep], c[keep], score[keep]


def _scanned(k: int):
    """Rows come sorted by list and shard, queries first. Keeps the k best classes of each query over the task's lists.

    What is kept is merged whenever it passes `HELD` rows, and handed on when merging does not make it half of that.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q_ids, q, q_norm, best, who = None, [], [], None, None, None
        asking: list[np.ndarray] = []

        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def take() -> None:
            if best is not None and len(who):
                row, col = np.nonzero(who >= 0)
                found.append((np.concatenate(q_ids)[row], who[row, col], best[row, col]))

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found.pop()], names=["q", "c", "score"])

        for batch in source:
            if not batch.num_rows:
                continue
            keys = np.stack((batch.column("list").to_numpy(), batch.column("shard").to_numpy(), batch.column("side").to_numpy()))
            cut = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [batch.num_rows]))
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                part, where, side = batch.slice(s, e - s), (int(keys[0, s]), int(keys[1, s])), keys[2, s]
                if where != now:
                    take()
                    if sum(len(x[0]) for x in found) > HELD:
                        found[:] = [_merged(found, k)]
                        if len(found[0][0]) > HELD // 2:
                            yield rows()
                    now, q_ids, asking, q, best, who = where, [], [], None, None, None
                if side == 0:
                    q_ids.append(part.column("rep").to_numpy())
                    asking.append(_matrix(part.column("vector")))
                    continue
                if not asking:
                    continue
                if best is None:
                    q = np.concatenate(asking)
                    q_norm = np.linalg.norm(q, axis=1)
                    best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
                for at in range(0, part.num_rows, 1024):
                    some = part.slice(at, 1024)
                    x, ids = _matrix(some.column("vector")), some.column("rep").to_numpy()
                    score = (q @ x.T) / (q_norm[:, None] * np.linalg.norm(x, axis=1))
                    every, names = np.concatenate((best, score), 1), np.concatenate((who, np.broadcast_to(ids, score.shape)), 1)
                    order = np.lexsort((names, -every), axis=1)[:, :k]
                    best, who = np.take_along_axis(every, order, 1), np.take_along_axis(names, order, 1)
        take()
        if found:
            found[:] = [_merged(found, k)]
            yield rows()

    return run


NEIGHBOURS = "query_id long, rank int, vec_id long, score double"


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Columns vec_id and embedding are read. Null, zero and empty vectors and those with null or non-finite components take
    no part, nor do rows without an id or with another number of components than most. Equal scores go by vec_id. Rows
    that repeat an id and a vector count once. Fewer other vectors than k give fewer ranks; no vectors an empty table.
    """
    modest_batches(vectors)
    spark = vectors.sparkSession
    every_row = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).mapInArrow(_vectors, VECTORS)
    rows = stored(every_row, "vectors")
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").head()
    if sizes is None:
        return spark.createDataFrame([], NEIGHBOURS)
    rows = rows.where(F.col("size") == sizes["size"])

    # The k + 1 least ids of each class stand for all of it: no answer needs more.
    ids = rows.select("key", "vec_id").distinct()
    by_key = Window.partitionBy("key").orderBy("vec_id")
    members = ids.withColumn("n", F.row_number().over(by_key)).where(F.col("n") <= k + 1)
    members = stored(members.withColumn("rep", F.min("vec_id").over(Window.partitionBy("key"))).select("key", "rep", "vec_id"), "members")
    reps = members.where("rep = vec_id").select("key", "rep")
    classes = stored(rows.join(reps, (rows.key == reps.key) & (rows.vec_id == reps.rep)).select("rep", rows["key"], "vector").dropDuplicates(["rep"]), "vector-classes")
    asked = stored(ids.where(F.col("vec_id") % every == 0).join(reps, "key").select(F.col("vec_id").alias("query_id"), "rep"), "asked")

    n = classes.count()
    lists = int(np.clip(n // LIST_SIZE, 1, MAX_LISTS))
    share = min(1.0, SAMPLED * lists / n)
    taken = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).orderBy("rep").select("vector").toArrow()
    sample = _normal(_matrix(taken.column("vector").combine_chunks())).astype(np.float32) if taken.num_rows else np.zeros((1, sizes["size"]), np.float32)
    index = spark.sparkContext.broadcast(graph(centroids(sample, lists), sample))

    kind = "list int, rep long, vector binary"
    posted = stored(classes.select("rep", "vector").mapInArrow(_posted(index), kind), "postings")
    wanted = classes.join(asked.select("rep").distinct(), "rep").select("rep", "vector").mapInArrow(_asked(index), kind)
    shards = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    left = wanted.join(shards, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(0).alias("side"), "rep", "vector")
    right = posted.join(shards, "list").select("list", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int").alias("shard"), F.lit(1).alias("side"), "rep", "vector")
    both = left.unionByName(right).repartition("list", "shard").sortWithinPartitions("list", "shard", "side")
    near = both.mapInArrow(_scanned(k + 1), "q long, c long, score double")
    near = near.groupBy("q", "c").agg(F.max("score").alias("score"))
    by_q = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    near = stored(near.withColumn("n", F.row_number().over(by_q)).where(F.col("n") <= k + 1).drop("n"), "nearest")

    wide = near.join(members.select(F.col("rep").alias("c"), "vec_id"), "c")
    by_q = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    wide = wide.withColumn("n", F.row_number().over(by_q)).where(F.col("n") <= k + 1).drop("n")
    out = asked.join(wide, asked.rep == wide.q).where("vec_id <> query_id")
    by_id = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
