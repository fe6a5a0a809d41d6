"""Set-similarity join on word n-grams: rare-first prefixes, length, positional and suffix filters, one check a pair.

Texts with equal sets are one class, and only class representatives go on. A global order of n-grams puts those that
many representatives hold last, so that a prefix holds rare ones. Two sets that are similar enough share an n-gram of
their prefixes; representatives meet there. In such a bucket the representative with the fewest rare n-grams is the
pivot, and the others are compared with it first: what is linked to it needs no comparison with the rest that is. A second pivot
is taken from what stands outside. What then still stands outside its first pivot's component passes the filters
against everyone who shares that pivot, in blocks, so that no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, key_bitmap, modest_batches, stored, with_bit
from .graph import components
from .words import batches, mix, shingle_sets

#: An n-gram held by so many representatives counts as frequent.
FREQUENT = 32
#: The share of all n-grams, by hash, whose frequency is counted; prefixes are taken from there first.
COUNTED = 0.3
#: Hash classes of the suffix filter; counts of 255 are open upwards.
CLASSES = 256
#: Representatives of a block, when those that share a pivot are compared.
BLOCK = 256

_LOW = np.int64(-(2**63) + int(COUNTED * 2**64))
_MASK = (1 << BITMAP_BITS) - 1


@dataclass(frozen=True)
class Rule:
    """Sets of n-word shingles are linked when 100 * intersection >= percent * union."""

    n: int = 5
    percent: int = 80

    def prefix(self, size: int) -> int:
        return size - -(-self.percent * size // 100) + 1

    def overlap(self, x, y):
        """The least intersection of sets of these sizes that are linked."""
        return -(-(self.percent * (x + y)) // (100 + self.percent))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sets(batch: pa.RecordBatch, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    ids, texts = batch.column(0), batch.column(1)
    for i, j in batches(texts):
        yield from zip(ids[i:j].to_pylist(), shingle_sets(texts[i:j], rule.n), strict=True)


PROFILE = "doc_id long, n_shingles long, d1 long, d2 long, classes binary"


def _profiles(rule: Rule):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows: list[tuple] = []
            for doc, s in _sets(batch, rule):
                u = s.view(np.uint64)
                counts = np.minimum(np.bincount((u >> np.uint64(56)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8)
                rows.append((doc, len(s), int(np.bitwise_xor.reduce(mix(u)).view(np.int64)) if len(s) else 0, int(u.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0, counts.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "n_shingles", "d1", "d2", "classes"])

    return run


def _counted(rule: Rule):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            low = [s[: np.searchsorted(s, _LOW)] for _, s in _sets(batch, rule)]
            if low:
                token, n = np.unique(np.concatenate(low), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n.astype(np.int32))], names=["token", "n"])

    return run


def _prefixes(rule: Rule, bits):
    """Rows of prefixes: rare n-grams first, then those not counted, then frequent ones, each by hash.

    rare is the share of a set's counted n-grams that are rare, in millionths.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in source:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, s in _sets(batch, rule):
                k = len(s)
                if not k:
                    continue
                slot, p = s & np.int64(_MASK), rule.prefix(k)
                counted = int(np.searchsorted(s, _LOW))
                hot = ((words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                hot[counted:] = False
                rare = np.flatnonzero(~hot[:counted])
                order = np.concatenate((rare, np.arange(counted, k), np.flatnonzero(hot)))[:p]
                for c, v in zip(out, (s[order], np.full(p, doc), np.full(p, k, np.int32), np.arange(p, dtype=np.int32), np.full(p, 1_000_000 * len(rare) // max(1, counted), np.int32)), strict=True):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["token", "doc_id", "n", "pos", "rare"])

    return run


def _bits(spark, tokens: DataFrame) -> np.ndarray:
    """The bitmap of a column `token`, as numpy words of 64 bits: 4 MB, whatever the input."""
    slot = F.col("token").bitwiseAND(F.lit(_MASK))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    got = tokens.select(F.shiftright(slot, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _fits(rule: Rule, n1: Column, n2: Column, pos1: Column, pos2: Column) -> Column:
    """Length and positional filters, for two sets that share an n-gram at these positions of their prefixes."""
    least = F.ceil(rule.percent * (n1 + n2) / F.lit(100 + rule.percent) - F.lit(1e-9))
    return (100 * F.least(n1, n2) >= rule.percent * F.greatest(n1, n2)) & (F.least(n1 - pos1, n2 - pos2) >= least)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CLASSES)


def _suffix(rule: Rule):
    """Drop pairs whose counts by hash class leave too little to share."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column("ca")), _matrix(batch.column("cb"))
            n1, n2 = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ok = np.minimum(x, y).sum(1, dtype=np.int64) >= rule.overlap(n1, n2)
            ok |= (x == 255).any(1) | (y == 255).any(1)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _checked(rule: Rule):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = (batch.column("ta"), batch.column("tb"))
            keep, last = [], (None, None)
            # Pairs come grouped by a, so a set is made once for a run of pairs.
            for k in range(batch.num_rows):
                a = batch.column("a")[k].as_py()
                if last[0] != a:
                    last = (a, next(shingle_sets(texts[0][k : k + 1], rule.n)))
                x, y = last[1], next(shingle_sets(texts[1][k : k + 1], rule.n))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= rule.percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, profiles: DataFrame, rule: Rule) -> DataFrame:
    """Of candidate pairs (a, b), those that are linked. Texts of other documents stay where they are."""
    side = lambda c: profiles.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("classes").alias(f"c{c}"))
    rich = pairs.join(side("a"), "a").join(side("b"), "b")
    left = stored(rich.mapInArrow(_suffix(rule), "a long, b long"), "candidates")
    ids = left.select(F.col("a").alias("doc_id")).unionByName(left.select(F.col("b").alias("doc_id")))
    needed = with_bit(texts, F.col("doc_id"), key_bitmap(ids, "doc_id"), "needed").where("needed").drop("needed")
    rich = left.join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    rich = rich.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return stored(rich.mapInArrow(_checked(rule), "a long, b long").distinct(), "links")


def similar_sets(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of each row of docs.

    Columns doc_id and text are read, others ignored. A text without words, an empty or a null one has an empty set,
    which is linked with nothing. Rows with equal texts and other doc_ids are linked; a row that is repeated as it is
    comes out as often. A row without a doc_id keeps its size and has no component. Very long texts are read whole. An
    empty table gives an empty one.
    """
    modest_batches(docs)
    rule, spark, texts = Rule(n, percent), docs.sparkSession, _texts(docs)
    profiles = stored(texts.mapInArrow(_profiles(rule), PROFILE), "profiles")
    classes = stored(
        profiles.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")),
        "classes",
    )
    reps = classes.select(F.col("rep").alias("doc_id"))
    one = with_bit(texts.where("doc_id is not null"), F.col("doc_id"), key_bitmap(reps, "doc_id"), "rep").where("rep").drop("rep")
    frequent = one.mapInArrow(_counted(rule), "token long, n int").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    bits = spark.sparkContext.broadcast(_bits(spark, frequent))
    rows = one.mapInArrow(_prefixes(rule, bits), "token long, doc_id long, n int, pos int, rare int")
    # Buckets: all of an n-gram's rows with its pivot; n-grams of one representative end here. The pivot is a minimum that
    # is combined before the shuffle, and only rows that meet another go on, so that a frequent n-gram is no group of one task.
    heads = rows.groupBy("token").agg(F.min(F.struct("rare", "doc_id", "n", "pos")).alias("pivot"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    heads = stored(heads.where("first < last").select("token", F.col("pivot.doc_id").alias("p"), F.col("pivot.n").alias("pn"), F.col("pivot.pos").alias("ppos")), "pivots")
    met = with_bit(rows, F.col("token"), key_bitmap(heads, "token"), "met").where("met").drop("met")
    buckets = stored(met.join(heads, "token").select("token", "doc_id", "n", "pos", "rare", "p", "pn", "ppos"), "buckets")
    order = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = buckets.where("doc_id <> p").where(_fits(rule, F.col("n"), F.col("pn"), F.col("pos"), F.col("ppos")))
    star = stored(star.select(*order(F.col("doc_id"), F.col("p"))).distinct(), "star")
    links = _links(star, texts, profiles, rule)
    groups = stored(buckets.groupBy("p", "doc_id").agg(F.first("n").alias("n"), F.first("rare").alias("rare")), "groups")

    rows = _labelled(groups, stored(components(links), "components"))
    second = rows.where("comp <> pcomp").groupBy("p").agg(F.min(F.struct("rare", "doc_id", "n", "comp")).alias("q"))
    pairs = rows.join(second, "p").where("comp <> q.comp").where(100 * F.least("n", "q.n") >= percent * F.greatest("n", "q.n"))
    pairs = pairs.select(*order(F.col("doc_id"), F.col("q.doc_id"))).distinct().join(star, ["a", "b"], "left_anti")
    links = links.unionByName(_links(pairs, texts, profiles, rule))

    rows = _labelled(groups, stored(components(links), "components"))
    links = links.unionByName(_links(_rest(rows, profiles, rule), texts, profiles, rule))
    found = components(links)
    rep_of = profiles.join(classes, ["d1", "d2", "n_shingles"], "left").select("doc_id", "n_shingles", "rep")
    return rep_of.join(found, rep_of.rep == found.id, "left").select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _labelled(groups: DataFrame, found: DataFrame) -> DataFrame:
    label = lambda c, to: found.select(F.col("id").alias(c), F.col("component").alias(to))
    rows = groups.join(label("doc_id", "comp"), "doc_id", "left").join(label("p", "pcomp"), "p", "left")
    return stored(rows.select("p", "doc_id", "n", "rare", F.coalesce("comp", "doc_id").alias("comp"), F.coalesce("pcomp", "p").alias("pcomp")), "labelled")


def _rest(rows: DataFrame, profiles: DataFrame, rule: Rule) -> DataFrame:
    """Pairs that share a pivot, stand in different components, one of them outside the pivot's, and pass the filters."""
    out = (F.col("comp") != F.col("pcomp")).cast("int")
    blocks = rows.groupBy("p").agg(F.ceil(F.sum(out) / BLOCK).alias("outer"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("inner")).where("outer > 0")
    rows = rows.join(blocks, "p").join(profiles.select("doc_id", "classes"), "doc_id")
    own = lambda of: F.pmod(F.xxhash64("doc_id"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    kept = ["doc_id", "n", "comp", "pcomp", "classes"]
    left = rows.where("comp <> pcomp").select("p", own("outer").alias("o"), every("inner").alias("i"), F.lit(True).alias("left"), *kept)
    right = rows.select("p", every("outer").alias("o"), own("inner").alias("i"), F.lit(False).alias("left"), *kept)
    both = left.unionByName(right).repartition("p", "o", "i").sortWithinPartitions("p", "o", "i")
    return both.mapInArrow(_compared(rule), "a long, b long").distinct()


def _compared(rule: Rule):
    """Length and suffix filters within each (p, o, i); these come sorted, and each is about two blocks long at most."""

    def pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        left = t.column("left").to_numpy(zero_copy_only=False)
        doc, n, comp, pcomp = (t.column(c).to_numpy() for c in ("doc_id", "n", "comp", "pcomp"))
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        # Pairs of two rows outside are met from either side; one is enough.
        ok = (comp[x][:, None] != comp[y]) & ((comp[y] == pcomp[y]) | (doc[x][:, None] < doc[y]))
        ok &= 100 * np.minimum(n[x][:, None], n[y]) >= rule.percent * np.maximum(n[x][:, None], n[y])
        i, j = np.nonzero(ok)
        if not len(i):
            return doc[:0], doc[:0]
        sums = np.empty(len(i), np.int64)
        m = _matrix(t.column("classes").combine_chunks())
        for k in range(0, len(i), 1 << 14):
            u, v = m[x[i[k : k + (1 << 14)]]], m[y[j[k : k + (1 << 14)]]]
            sums[k : k + (1 << 14)] = np.where((u == 255).any(1) | (v == 255).any(1), 1 << 40, np.minimum(u, v).sum(1, dtype=np.int64))
        keep = sums >= rule.overlap(n[x[i]].astype(np.int64), n[y[j]].astype(np.int64))
        a, b = doc[x[i[keep]]], doc[y[j[keep]]]
        return np.minimum(a, b), np.maximum(a, b)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in source:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            keys = np.stack([t.column(c).to_numpy() for c in ("p", "o", "i")])
            starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1))
            found = [pairs(t.slice(s, e - s)) for s, e in zip(starts[:-1], starts[1:], strict=True)]
            held = t.slice(starts[-1])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["a", "b"])
        if held is not None and held.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pairs(held)], names=["a", "b"])

    return run
