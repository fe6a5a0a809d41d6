"""Line dedup by a deletion neighbourhood, in DataFrame functions only.

Lines are trimmed and lower-cased and cut at single spaces. A line's deletion variants are the line itself and the line
less one word, each as a hashed key. Two lines are within one word edit (a word put in, taken out or replaced) exactly
if one is a variant of the other, or both give the same variant by losing a word at the same place. So the lines of a
(variant, place) are all within one edit of one another, and of the line that is the variant. Lines are kept in the order of
their rank: each that no kept one before it is within one edit of. That needs no pairs, only the least undecided and the
least kept rank of each (variant, place), in a few rounds. Only lines that share their first or last half with another
line emit variants at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_bitmap, packed, stored, unpacked, with_bit

#: Lines of fewer words are kept, whatever repeats.
MIN_WORDS = 1
#: Lines of at least so many words are also removed when an earlier line is within one word edit: with fewer words, one
#: edit is a similarity of less than 0.8.
MIN_EDIT_WORDS = 5


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line: trimmed and lower-cased; lines without characters are left out."""
    cut = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line")
    )
    return cut.withColumn("line", F.lower(F.trim("line"))).where("line <> ''")


def _n_words(line: str) -> Column:
    """Words of a line that is cut at single spaces."""
    return F.octet_length(line) - F.octet_length(F.replace(F.col(line), F.lit(" "), F.lit(""))) + 1


def _half(name: str, size: str) -> Column:
    """A key of the first or last words of a line."""
    return F.expr(f"xxhash64('{name}', {size}, substring_index(line, ' ', {'' if name == 'first' else '-'}{size}))")


def _without(line: str, place: str, n: str) -> str:
    """SQL for a line less the word at a place from 1 to n."""
    return f"concat_ws(' ', if({place} = 1, null, substring_index({line}, ' ', {place} - 1)), if({place} = {n}, null, substring_index({line}, ' ', {place} - {n})))"


def _kept_in_order(variants: DataFrame) -> DataFrame:
    """Of variants (h, first, v, place): the lines h that a kept one is within one edit of, as h, place, best (its first, h, place).

    In rank order, a line is kept unless a kept line before it meets it: at the same place of a variant, or where one of
    the two is the variant (place 0). Each round keeps the undecided lines that are the first undecided ones wherever
    they are met, and drops what meets a kept one. Rounds are as many as kept and dropped lines alternate in the longest
    chain; every one decides a line at least, so they end.
    """
    head = F.struct("first", "h", "place")
    both = F.struct(F.min(F.when(F.col("kept"), head)).alias("kept"), F.min(F.when(~F.col("kept"), F.col("first"))).alias("open"))
    # The rows of v that can meet another: those of a place of which there are several lines, or of a v that is a line itself.
    sizes = variants.groupBy("v", "place").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    some = sizes.groupBy("v").agg((F.max(F.col("lo") < F.col("hi")) | (F.min("place") == 0) & (F.max("place") > 0)).alias("meet")).where("meet").select("v")
    rows = stored(variants.join(some, "v").withColumn("kept", F.lit(False)), "edit-variants")
    drops: list[DataFrame] = []
    while not rows.isEmpty():
        place = rows.groupBy("v", "place").agg(both.alias("at"))
        # Place 0 is met by all places; any other one by itself and place 0.
        group = place.groupBy("v").agg(
            F.struct(F.min("at.kept").alias("kept"), F.min("at.open").alias("open")).alias("all"),
            F.min(F.when(F.col("place") == 0, F.col("at"))).alias("own"),
        )
        met = rows.join(place.select("v", "place", F.when(F.col("place") > 0, F.col("at")).alias("at")), ["v", "place"]).join(group, "v")
        seen = F.when(F.col("place") == 0, F.struct(F.col("all.kept"), F.col("all.open"))).otherwise(
            F.struct(F.least("at.kept", "own.kept").alias("kept"), F.least("at.open", "own.open").alias("open"))
        )
        by_line = met.where("not kept").select("h", "first", "place", seen.alias("seen")).groupBy("h").agg(
            F.min(F.when(F.col("seen.kept.first") < F.col("first"), F.struct(F.col("seen.kept").alias("best"), "place"))).alias("m"),
            F.max(F.col("seen.open") < F.col("first")).alias("waits"),
        )
        by_line = stored(by_line.where("m is not null or not coalesce(waits, false)"), "edit-decided")
        drops.append(by_line.where("m is not null").select("h", "m.place", "m.best"))
        decided = by_line.select("h", F.col("m").isNotNull().alias("dropped"))
        after = rows.join(decided, "h", "left").where("dropped is null or not dropped").withColumn("kept", F.col("kept") | F.col("dropped").isNotNull()).drop("dropped")
        # A kept line stays to drop others while any that may meet it is undecided.
        undecided = after.groupBy("v").agg(F.min("kept").alias("all_kept")).where("not all_kept").select("v")
        rows = stored(after.join(undecided, "v").select("h", "first", "place", "v", "kept"), "edit-variants")
    return reduce(DataFrame.unionByName, drops) if drops else rows.select("h", "place", F.struct("first", "h", "place").alias("best"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_edit_words: int = MIN_EDIT_WORDS) -> DataFrame:
    """Lines to remove: doc_id, line_no, kind (exact or edit), first_doc_id, first_line_no (an earlier line that stays for it).

    Rank is (doc_id, line_no). exact: an earlier line that stays is equal. edit: else, an earlier line that stays is
    within one word edit. Rows of docs that share a doc_id and a line number rank alike: none is earlier, so equal lines
    of such rows stay together. Null texts, null doc_ids and empty texts have no lines, blank lines always stay. Very long texts and
    lines are read whole. Other columns of docs are not looked at. An empty table gives an empty one.
    """
    lines = _lines(docs)
    keyed = lines.withColumn("n", _n_words("line")).where(F.col("n") >= min_words)
    # Halves of the shorter line of a pair: lines of n words meet n - 1, n or n + 1.
    keyed = keyed.withColumn("k", F.floor(F.col("n") / 2).cast("int")).withColumn("less", F.floor((F.col("n") - 1) / 2).cast("int"))
    long_enough = F.col("n") >= min_edit_words
    both = long_enough & (F.col("k") > F.col("less"))
    keyed = stored(
        keyed.select(
            "doc_id", "line_no", F.xxhash64("line").alias("h"), "n",
            F.when(long_enough, _half("first", "k")).alias("f1"), F.when(long_enough, _half("last", "k")).alias("l1"),
            F.when(both, _half("first", "less")).alias("f2"), F.when(both, _half("last", "less")).alias("l2"),
        ), "lines",
    )
    rank = F.struct("doc_id", "line_no")
    halves = ("f1", "l1", "f2", "l2")
    distinct = stored(keyed.groupBy("h").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in halves)), "distinct-lines")

    # Lines that share a half with another one, and so may have a neighbour: the edit is in the other half.
    keys = distinct.where("f1 is not null").select("h", F.explode(F.array(*(F.struct(F.lit(c[0]).alias("side"), F.col(c).alias("key")) for c in halves))).alias("e")).where("e.key is not null")
    keys = keys.select("h", "e.side", "e.key")
    shared = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("key")
    near = keys.join(shared, "key").groupBy("h").agg(F.max(F.col("side") == "f").alias("early"), F.max(F.col("side") == "l").alias("late"))
    near = stored(distinct.join(near, "h").select("h", "n", "first", "early", "late"), "near-lines")

    likely = with_bit(lines.withColumn("h", F.xxhash64("line")), F.col("h"), key_bitmap(near, "h"), "likely").where("likely")
    texts = likely.join(near, "h").where("doc_id = first.doc_id and line_no = first.line_no").dropDuplicates(["h"])
    texts = stored(texts.select("h", "first", "line", "n", "early", "late"), "near-texts")
    places = F.expr("sequence(if(late, 1, cast((n - 1) / 2 as int) + 1), if(early, n, n - cast((n - 1) / 2 as int)))")
    changed = texts.select("h", "first", "line", "n", F.explode(places).alias("place")).select("h", "first", "place", F.expr(f"xxhash64({_without('line', 'place', 'n')})").alias("v"))
    variants = changed.unionByName(texts.select("h", "first", F.lit(0).alias("place"), F.col("h").alias("v")))
    found = _kept_in_order(variants.distinct())
    found = found.select("h", "place", F.col("best.first").alias("to"), F.col("best.h").alias("h2"), F.col("best.place").alias("place2"))

    # Once for each line: do the two lines differ by one word, as their keys say?
    verified = found.join(texts.select("h", F.col("line").alias("l1")), "h").join(texts.select(F.col("h").alias("h2"), F.col("line").alias("l2")), "h2")
    verified = verified.withColumn("n1", _n_words("l1")).withColumn("n2", _n_words("l2"))
    side = lambda line, place, n: F.expr(f"if({place} = 0, {line}, {_without(line, place, n)})")
    edits = stored(verified.where(side("l1", "place", "n1") == side("l2", "place2", "n2")).select("h", "to"), "line-edits")

    drop = stored(distinct.join(edits, "h", "left").where("copies > 1 or to is not null").select("h", "first", "to"), "line-drops")
    hit = with_bit(keyed.select("doc_id", "line_no", "h"), F.col("h"), key_bitmap(drop, "h"), "likely").where("likely").join(drop, "h")
    at_first = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    hit = hit.withColumn("kind", F.when(F.col("to").isNotNull(), F.lit("edit")).when(~at_first, F.lit("exact"))).where("kind is not null")
    by = F.coalesce("to", "first")
    return hit.select("doc_id", "line_no", "kind", by.getField("doc_id").alias("first_doc_id"), by.getField("line_no").alias("first_line_no"))


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_edit_words: int = MIN_EDIT_WORDS) -> DataFrame:
    """docs with the lines of `repeated_lines` cut out of text; other columns and rows stay as they are.

    A text of which all lines go becomes empty. Rows without such lines skip the join's shuffle.
    """
    drops = stored(repeated_lines(docs, min_words, min_edit_words).select("doc_id", "line_no").distinct(), "dropped-lines")
    by_doc = drops.groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    flagged = with_bit(packed(docs), F.col("doc_id"), key_bitmap(drops, "doc_id"), "hit")
    hit = flagged.where("hit").join(by_doc, "doc_id", "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i)), "\n")
    hit = hit.select(F.col("row").withField("text", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)).alias("row"))
    return unpacked(flagged.where("not hit").select("row").unionByName(hit), docs.columns)
