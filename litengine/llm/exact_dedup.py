"""Exact dedup through an extendible-hash index on shared files, in DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z. Their 64-bit hash is the key of the index. A directory
names, by the first bits of a key, the bucket that holds it; a bucket holds at most `capacity` distinct keys. Buckets
that are overfull split by one more bit, and where a bucket's depth passes the directory's, the directory doubles; only
keys of overfull buckets are looked at again. Buckets are ranges of keys: the entries are dealt to tasks by range, and
each task writes the buckets that it owns, with the different texts of one key chained.

Copies are counted before they are shuffled, so a text that a third of all rows share is one row a task. Grouping by key
and text compares whole texts byte by byte; only texts whose key occurs twice are sent.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import key_bitmap, packed, stored, unpacked, with_bit

#: Distinct keys of a bucket.
CAPACITY = 50_000
#: Bits of a key's place. Bits beyond the 62nd never split a bucket.
PLACE_BITS = 62
#: The directory is broadcast up to so many slots (16 bytes each); a larger one is joined by a shuffle.
BROADCAST_SLOTS = 1 << 20
#: An entry with at least this share of all rows is hot; there are at most 1 / HOT_SHARE of them, so they are broadcast.
HOT_SHARE = 1 / 2000


class Index(NamedTuple):
    """Tables in the shared folder.

    rows: doc_id, h, digest of each row of docs. entries: bucket, h, chain (place among the different texts of a key, from
    1), digest, keep_id (greatest doc_id), size; files are ranges of buckets. directory: slot, bucket, depth.
    """

    rows: DataFrame
    entries: DataFrame
    directory: DataFrame
    depth: int


def normalised(text: str | Column = "text") -> Column:
    """A text with A-Z as a-z and nothing else changed; null is empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.translate(F.coalesce(column.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)


def _slot(depth: int) -> Column:
    """The first `depth` bits of a key, as a number."""
    return F.shiftright(F.shiftrightunsigned("h", 64 - PLACE_BITS), PLACE_BITS - depth)


def _directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Buckets of distinct keys h: slot, bucket (its first place), depth, for a directory of 2^depth slots; and that depth.

    It begins with as many slots as the keys fill, as a directory that doubled so far would have.
    """
    depth = min(PLACE_BITS, max(0, math.ceil(math.log2(max(1, keys.count()) / capacity))))
    leaves: list[DataFrame] = []
    while True:
        sizes = stored(keys.groupBy(_slot(depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).withColumn("depth", F.lit(depth)), "bucket-sizes")
        full = F.col("n") > (capacity if depth < PLACE_BITS else 2**62)
        leaves.append(sizes.where(~full))
        over = sizes.where(full).select("prefix")
        if over.isEmpty():
            break
        keys = keys.withColumn("prefix", _slot(depth)).join(over, "prefix", "left_semi").drop("prefix")
        depth += 1
    width = F.expr(f"shiftleft(1L, {depth} - depth)")
    slots = reduce(DataFrame.unionByName, leaves).select(
        F.explode(F.sequence(F.col("prefix") * width, (F.col("prefix") + 1) * width - 1)).alias("slot"),
        F.expr(f"shiftleft(prefix, {PLACE_BITS} - depth)").alias("bucket"), "depth",
    )
    return stored(slots, "directory"), depth


def build(docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> Index:
    """Index every row of docs (doc_id, text) by its whole text. `key` gives a text's 64-bit key.

    A null text is an empty one. Rows with a null doc_id are indexed, with null as the least doc_id. Equal rows count as
    often as they stand there. Other columns are not looked at, and an empty table gives an empty index.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"))
    digest = F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest")
    rows = stored(texts.select("doc_id", key(F.col("norm")).alias("h"), digest), "exact-rows")
    keys = stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("keep_id"), F.min("digest").alias("digest")), "exact-keys")
    directory, depth = _directory(keys.select("h"), capacity)

    # Keys of several rows: whole texts are compared, by grouping them.
    several = keys.where("size > 1").select("h")
    sent = with_bit(texts.select("doc_id", "norm", key(F.col("norm")).alias("h")), F.col("h"), key_bitmap(several, "h"), "likely").where("likely")
    equal = sent.groupBy("h", "norm").agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("keep_id")).select("h", digest, "keep_id", "size")
    # A key that only the bitmap took for one of several rows comes with its single row, as it does from `keys`.
    entries = equal.where("size > 1").unionByName(equal.where("size = 1").join(several, "h", "left_semi"))
    entries = entries.unionByName(keys.where("size = 1").select("h", "digest", "keep_id", "size"))
    slots = F.broadcast(directory) if 1 << depth <= BROADCAST_SLOTS else directory
    owned = entries.withColumn("slot", _slot(depth)).join(slots, "slot").drop("slot", "depth").repartitionByRange("bucket")
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("digest"))
    return Index(rows, stored(owned.withColumn("chain", chain), "exact-entries"), directory, depth)


def _kept(rows: DataFrame, index: Index) -> DataFrame:
    """rows (h, digest, ...) with keep_id and size of their entries; null where the text occurs once.

    Entries with a large share of all rows are few, and broadcast; the others meet their rows by a shuffle, in which no
    key is hot. Rows of single texts take part in neither.
    """
    several = index.entries.where("size > 1").select("h", "digest", "keep_id", "size")
    total = index.rows.count()
    hot = F.col("size") >= total * HOT_SHARE
    flagged = with_bit(rows, F.col("h"), key_bitmap(several, "h"), "likely")
    single = flagged.where("not likely").drop("likely").withColumn("keep_id", F.lit(None).cast("long")).withColumn("size", F.lit(None).cast("long"))
    met = flagged.where("likely").drop("likely").join(F.broadcast(several.where(hot)), ["h", "digest"], "left")
    found = met.where("size is not null")
    rest = met.where("size is null").drop("keep_id", "size").join(several.where(~hot), ["h", "digest"], "left")
    return single.unionByName(found).unionByName(rest)


def copies(docs: DataFrame, capacity: int = CAPACITY, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """For each row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text, lowercase hex).

    Of rows with equal texts the one with the greatest doc_id stays; rows that share that doc_id too are one document, and
    all marked as kept. A null doc_id is less than any other; alone with its text it stays. Null and empty texts are equal.
    """
    index = build(docs, capacity, key)
    found = _kept(index.rows, index)
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """docs with one row for each different text: the row with the greatest doc_id, and one of those that share it.

    All columns stay as they are, whatever their names.
    """
    index = build(docs, capacity)
    norm = normalised(F.col("row.text"))
    rows = packed(docs).select("row", "doc_id", F.xxhash64(norm).alias("h"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"))
    found = _kept(rows, index)
    one = found.where("size is not null and doc_id <=> keep_id").dropDuplicates(["h", "digest"])
    return unpacked(found.where("size is null").unionByName(one), docs.columns)
