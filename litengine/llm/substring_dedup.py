"""Substring dedup by hashing units, grouping digests globally and keeping the earliest ranked occurrence.

Units are lines, cut further where a two-word hash is the least within `RADIUS` words of the same line on either side.
Such cuts depend on the words around them alone, so a passage pasted into the middle of a line is cut the same way as
its original. What is digested is a block: from each unit on, as few units of the text as hold `min_words` words, and the
last of these once more on to the text's end. A block whose words stand at an earlier rank, next to one another in one text, is removed; rank is (doc_id, offset). Blocks that
overlap or touch are reported as one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import key_bitmap, modest_batches, packed, stored, unpacked, with_bit
from .words import batches, fold, mix, split

RADIUS = 3
#: Words of a block at least. A shared passage of 50 words holds whole units of more than that, wherever it was pasted.
MIN_WORDS = 24

BLOCKS = "doc_id long, text_id long, start int, end int, word int, n_words int, digest long"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _cuts(words, hashes: np.ndarray) -> np.ndarray:
    """Indexes of the words that begin a unit: the first of a line, and least two-word hashes. Words of other lines and texts count for nothing."""
    n = len(hashes)
    line = np.concatenate(([0], np.cumsum(words.data == 10)))[words.start] + words.row()
    pairs = np.full(n, 2**64 - 1, np.uint64)
    inner = line[1:] == line[:-1]
    pairs[:-1][inner] = fold(hashes, 2)[inner]
    least = pairs < np.uint64(2**64 - 1)
    for k in range(1, RADIUS + 1):
        other = line[k:] != line[:-k]
        least[k:] &= (pairs[k:] < pairs[:-k]) | other
        least[:-k] &= (pairs[:-k] < pairs[k:]) | other
    least[0] = True
    least[1:] |= ~inner
    return np.flatnonzero(least)


def _blocks(min_words: int):
    """A row for each unit that begins a block of at least so many words of its text."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids, marks, texts = batch.column(0), batch.column(1), batch.column(2)
            for i, j in batches(texts):
                words = split(texts[i:j])
                if not len(words.start):
                    continue
                hashes, row = words.hashes(), words.row()
                at = _cuts(words, hashes)
                # Each block ends with the first unit that reaches the words it needs.
                stops = np.append(at[1:], len(hashes))
                last = np.searchsorted(stops, at + min_words, "left")
                whole = last < len(at)
                at, stop = at[whole], stops[last[whole]]
                same = row[at] == row[stop - 1]
                at, stop = at[same], stop[same]
                # The last block of a text goes on to its end, so that a copied end leaves no short rest.
                ends = words.first[row[at] + 1]
                final = np.append(row[at[1:]] != row[at[:-1]], True)[: len(at)] & (stop < ends)
                at, stop = np.concatenate((at, at[final])), np.concatenate((stop, ends[final]))
                if not len(at):
                    continue
                # A polynomial of the block's words, from sums over the batch.
                up = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(hashes) - 1, _BASE))))
                down = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(hashes) - 1, _BASE_INVERSE))))
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)))
                digest = mix((sums[stop] - sums[at]) * down[at] + (stop - at).astype(np.uint64))
                owner = row[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[i:j].take(pa.array(owner)),
                        marks[i:j].take(pa.array(owner)),
                        pa.array(words.characters(words.start[at], owner).astype(np.int32)),
                        pa.array(words.characters(words.end[stop - 1], owner).astype(np.int32)),
                        pa.array((at - words.first[owner]).astype(np.int32)),
                        pa.array((stop - at).astype(np.int32)),
                        pa.array(digest.view(np.int64)),
                    ],
                    names=[x.split()[0] for x in BLOCKS.split(", ")],
                )

    return run


def _runs(docs: DataFrame, min_words: int) -> DataFrame:
    """`repeated_runs`, with text_id: rows that share a doc_id but not their text are told apart."""
    modest_batches(docs)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = texts.select("doc_id", F.xxhash64("text").alias("text_id"), "text").mapInArrow(_blocks(min_words), BLOCKS)
    first = stored(
        blocks.select("digest", "doc_id", "start").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start")).alias("first")).where("n > 1").drop("n"),
        "first-blocks",
    )
    # Only blocks whose digest may repeat go through the join's shuffle.
    likely = with_bit(blocks, F.col("digest"), key_bitmap(first, "digest"), "likely").where("likely").drop("likely")
    again = likely.join(first, "digest").where("doc_id > first.doc_id or (doc_id = first.doc_id and start > first.start)")
    # A run begins where a block starts past the end of all blocks before it; a text's repeated blocks are the largest group.
    by_text = Window.partitionBy("doc_id", "text_id").orderBy("word", "start")
    reached = F.max(F.col("word") + F.col("n_words")).over(by_text.rowsBetween(Window.unboundedPreceding, -1))
    begins = again.withColumn("begins", F.when(F.col("word") <= reached, 0).otherwise(1))
    return (
        begins.withColumn("run", F.sum("begins").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "text_id", "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            (F.max(F.col("word") + F.col("n_words")) - F.min("word")).cast("long").alias("n_words"),
            F.min(F.struct("word", "first")).alias("head"),
        )
        .select("doc_id", "text_id", "start", "end", "n_words", F.col("head.first.doc_id").alias("first_doc_id"), F.col("head.first.start").alias("first_start"))
    )


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of repeated blocks: doc_id, start, end (code points, end exclusive), n_words, first_doc_id, first_start.

    Every word of a run lies in a block of at least `min_words` words that stands word for word at an earlier rank, in one
    piece of one text; first_* name the earliest place of the run's first block. The result depends on the texts alone,
    however they are dealt to tasks. Texts of fewer words than min_words, null and empty ones, and rows with a null doc_id have no
    blocks. Repeats within one text count too. Rows that share a doc_id are told apart by their texts; a block at the
    same offset of two of them is a tie, and both stay, so a row that is repeated as it is stays as often. Very long
    texts are read whole. Other columns of docs are not looked at. An empty table gives an empty one.
    """
    return _runs(docs, min_words).drop("text_id")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with repeated runs cut out of text, and a column removed (in place of any of that name): the cut spans with their original offsets.

    Every row stays; a text that is all repeats is left with its white space. Rows without runs skip the join's shuffle.
    """
    runs = stored(_runs(docs, min_words).select("doc_id", "text_id", "start", "end"), "runs")
    spans = runs.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    kind = "array<struct<start:int,end:int>>"
    text = F.col("text").cast("string")
    flagged = with_bit(packed(docs, text=text, text_id=F.xxhash64(text)), F.col("doc_id"), key_bitmap(runs, "doc_id"), "hit")
    hit = flagged.where("hit").join(spans, ["doc_id", "text_id"], "left")
    gaps = F.expr(
        "concat(transform(sequence(0, size(removed) - 1), k -> substring(text, if(k = 0, 0, removed[k - 1].end) + 1,"
        " removed[k].start - if(k = 0, 0, removed[k - 1].end))), array(substring(text, removed[size(removed) - 1].end + 1)))"
    )
    text = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(gaps, ""))
    hit = hit.select(F.col("row").withField("text", text).alias("row"), "removed")
    rest = flagged.where("not hit").select("row", F.lit(None).cast(kind).alias("removed"))
    return unpacked(rest.unionByName(hit), [c for c in docs.columns if c != "removed"], "removed")
