"""Library pipelines composed of the smaller operators: annotation sources, listings, alignment ladders, research sessions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import relations as R

C = F.col


def annotation_fragments(annotations: DataFrame, parents: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """SRC4, SRC6: annotations whose item and parent are not deleted, each as a highlight and, where it has one, a comment."""
    gone = deleted.select(C("id").alias(key))
    kept = annotations.join(gone, key, "left_anti").join(parents, "parent_id").join(deleted.select(C("id").alias("parent_id")), "parent_id", "left_anti")
    parts = F.array(F.struct(F.lit("zotero_highlight").alias("source_type"), C("text").alias("body")), F.struct(F.lit("zotero_annotation_comment").alias("source_type"), C("comment").alias("body")))
    out = kept.select(key, "parent_id", "document_id", F.explode(parts).alias("f")).select(key, "parent_id", "document_id", "f.source_type", "f.body")
    return out.where(C("body").isNotNull() & (F.trim("body") != ""))


def first_marked(df: DataFrame, path: str, text: str, marker: str) -> DataFrame:
    """ING16: for each value of a marker, the first file in path order that holds it."""
    value = F.regexp_extract(text, marker, 1)
    return df.select(value.alias("value"), C(path)).where("value <> ''").groupBy("value").agg(F.min(path).alias(path))


def unique_numbers(df: DataFrame, group: str, order: str, heading: str) -> DataFrame:
    """ING18: headings with a section id from their number; numbers that come again get a suffix."""
    number = F.regexp_extract(heading, r"^(\d+(\.\d+)*)", 1)
    ranked = df.withColumn("number", number).withColumn("_k", F.row_number().over(Window.partitionBy(group, "number").orderBy(order)))
    return ranked.withColumn("section_id", F.when(C("number") == "", F.concat(F.lit("s"), C(order).cast("string"))).when(C("_k") == 1, C("number")).otherwise(F.concat("number", F.lit("-"), C("_k").cast("string")))).drop("_k")


def page_markdown(df: DataFrame, page: str, order: str, kind: str, text: str) -> DataFrame:
    """ING21: blocks in their order as Markdown, headings marked, a marker for each page."""
    line = F.when(C(kind) == "heading", F.concat(F.lit("## "), C(text))).when(C(kind) == "list", F.concat(F.lit("- "), C(text))).otherwise(C(text))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(C(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n\n")
    return df.groupBy(page).agg(F.concat(F.lit("<!-- PDF_PAGE: "), C(page).cast("string"), F.lit(" -->\n"), body).alias("markdown"))


def whole_section(df: DataFrame, group: str, order: str, chapter: str, heading: str, at: int, most: int = 8) -> DataFrame:
    """WIN6: neighbours of one row in the same chapter, or under the same heading where a chapter is unknown; a null heading is any."""
    here = df.where(C(order) == at).select(group, C(chapter).alias("_c"), C(heading).alias("_h"))
    same = F.when(C(chapter).isNotNull() & C("_c").isNotNull(), C(chapter) == C("_c")).otherwise(C(heading).isNull() | C("_h").isNull() | (C(heading) == C("_h")))
    rows = df.join(here, group).withColumn("_same", same).where(F.abs(C(order) - at) <= most)
    # Walking out from the row stops at the first one that differs.
    before = F.min(C("_same").cast("int")).over(Window.partitionBy(group).orderBy(order).rowsBetween(0, Window.unboundedFollowing))
    after = F.min(C("_same").cast("int")).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    left = rows.where(C(order) <= at).withColumn("_ok", before)
    right = rows.where(C(order) >= at).withColumn("_ok", after)
    return left.unionByName(right.where(C(order) > at)).where("_ok = 1").drop("_same", "_ok", "_c", "_h")


def remapped(refs: DataFrame, chunks: DataFrame, key: str, ref: str) -> DataFrame:
    """ALN5: references to chunks: on the same page, a page beside, or by their quote; the first way that finds any, then the least chunk."""
    near = R.nearest_page(refs.select(key, ref, "page_no"), chunks.select(key, C("page").alias("page"), "chunk_id"), key, "page_no", "page", ref)
    by_page = near.select(ref, "chunk_id", F.when(C("offset_rank") == 0, 0).otherwise(1).alias("way"))
    quoted = refs.where(F.trim("quote") != "").join(chunks, key).where(F.contains(T.normalize_quote(C("chunk_text")), T.normalize_quote(C("quote"))))
    every = by_page.unionByName(quoted.select(ref, "chunk_id", F.lit(2).alias("way")))
    best = every.groupBy(ref).agg(F.min(F.struct("way", "chunk_id")).alias("m"))
    return best.select(ref, C("m.chunk_id").alias("chunk_id"), F.element_at(F.array(F.lit("exact_page"), F.lit("nearby_page"), F.lit("quote")), C("m.way") + 1).alias("method"))


def related(relations: DataFrame, predicates: Sequence[Column], ident: str, limit: int) -> DataFrame:
    """RES2, J6, J7: relations that one of up to eight predicates asks for, each once, the newest first."""
    parts = [relations.where(p) for p in predicates[:8]]
    return reduce(DataFrame.unionByName, parts).dropDuplicates([ident]).orderBy(F.desc(ident), ident).limit(limit)


def readiness_score(*present: Column) -> Column:
    """RES13: the share of parts that are there, to four places."""
    return F.round(sum((p.cast("double") for p in present), F.lit(0.0)) / len(present), 4)


def verdict_rules(database: Column, index: Column, vectors: Column, writes: Column) -> Column:
    """INT2, SET7: reasons of a document's state: what is missing, stale or written to while reading."""
    return F.array_join(F.array_compact(F.array(F.when(~database, "database_missing"), F.when(index > 0, "index_drift"), F.when(vectors > 0, "vectors_stale"), F.when(writes, "writes_performed"))), ",")


# Counts that must be 0, and the reason each of them gives; counts of orphans may be unknown.
FAILURE_COUNTS = {
    "foreign_key_issues": "database_foreign_key_issues", "missing_pdf_chunk_count": "fts_missing_pdf_chunk_count", "orphan_pdf_chunk_count": "fts_orphan_pdf_chunk_count",
    "missing_personal_note_count": "fts_missing_personal_note_count", "orphan_personal_note_count": "fts_orphan_personal_note_count",
}
MISSING_VECTORS, ORPHAN_VECTORS = ("passage_missing_count", "note_missing_count"), ("passage_orphan_count", "note_orphan_count")


def integrity_verdict(r: Column) -> Column:
    """INT2: a document's verdict and its reasons, from a report as a struct: verdict (fail, warn or pass) and reasons.

    r: source_recorded, database_ok, foreign_key_issues, fts_ready, the counts of FAILURE_COUNTS, vectors_available,
    MISSING_VECTORS and ORPHAN_VECTORS (null: not known), vector_reasons, wrote, journal_failures, pdf_warning,
    excluded_notes, history_recorded, journal_warnings. Null flags are false, null counts 0 and null lists empty; a document
    without a recorded history has a warning. Reasons are distinct: warnings first, then failures.
    """
    true = lambda c: F.coalesce(r[c], F.lit(False))
    count = lambda c: F.coalesce(r[c], F.lit(0))
    listed = lambda c: F.coalesce(r[c], F.array().cast("array<string>"))
    some = lambda *reasons: F.array_compact(F.array(*reasons))
    counted = [F.when(count(c) > 0, reason) for c, reason in FAILURE_COUNTS.items()]
    vectors = [F.when(count(c) > 0, f"vector_{c}") for c in (*MISSING_VECTORS, *ORPHAN_VECTORS)]
    failures = F.concat(
        some(
            F.when(~true("source_recorded"), "document_source_binding_missing"), F.when(~true("database_ok"), "database_integrity_check_failed"), counted[0], F.when(~true("fts_ready"), "fts_not_ready"), *counted[1:],
            F.when(~true("vectors_available"), "vector_store_unavailable"), *vectors, F.when(true("wrote"), "read_only_contract_violated"),
        ),
        listed("journal_failures"),
    )
    notes = F.when(count("excluded_notes") > 0, F.concat(F.lit("personal_notes_excluded_from_fts:"), count("excluded_notes").cast("string")))
    warnings = F.concat(
        some(*[F.when(r[c].isNull(), f"vector_{c}_not_available") for c in ORPHAN_VECTORS]), F.transform(listed("vector_reasons"), lambda x: F.concat(F.lit("vector_inspection:"), x)),
        some(r["pdf_warning"], notes, F.when(~true("history_recorded"), "historical_events_not_recorded")), listed("journal_warnings"),
    )
    reasons = F.array_distinct(F.concat(warnings, failures))
    return F.struct(F.when(F.size(failures) > 0, "fail").when(F.size(reasons) > 0, "warn").otherwise("pass").alias("verdict"), reasons.alias("reasons"))


def status(indexed: Column, expected: Column, fingerprint: Column, active: Column) -> Column:
    """INT4, INT7: missing, corrupt, stale, source_drift or ready, in this order."""
    return F.when(indexed.isNull(), "missing").when(indexed == 0, "corrupt").when(~fingerprint.eqNullSafe(active), "stale").when(indexed != expected, "source_drift").otherwise("ready")


def objects_grouped(df: DataFrame, group: str, label: str, rank: Column) -> DataFrame:
    """RET41: objects of a document by group, each group's names in the order of a rank."""
    names = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), C(label)))), lambda x: x[label])
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array_join(names, ",").alias("names"))


# What a section's label holds, and what that adds to a match.
SECTION_PRIORITY = ((("proposed", "method", "approach"), 1.5), (("experiment", "evaluation", "metric", "training"), 0.8), (("front matter", "abstract"), -0.4))


def match_strength(spec: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """RET40: an object's best alias in each chunk: 5 for the text, 2.2 for the heading and 1.6 for the title that hold it, and what the section adds.

    A specification has few objects and aliases and goes to the chunks, which stay where they are: all of one key would be one
    task's work. Chunks of a document meet those of its key.
    """
    both = chunks.join(F.broadcast(spec.select(key, "object", F.explode("aliases").alias("alias"))), key)
    low = lambda c: F.lower(F.coalesce(C(c), F.lit("")))
    parts = [F.when(F.contains(low(c), low("alias")), w).otherwise(0.0) for c, w in (("text", 5.0), ("heading", 2.2), ("title", 1.6))]
    points = reduce(lambda a, b: a + b, parts)
    added = F.lit(0.0)
    for words, weight in reversed(SECTION_PRIORITY):
        added = F.when(low("section").rlike("|".join(words)), weight).otherwise(added)
    found = both.where(C("alias") != "").withColumn("points", points).where("points > 0").withColumn("points", F.round(C("points") + added, 6))
    return found.groupBy("object", "chunk_id").agg(F.max("points").alias("points"), F.min_by("alias", F.struct(-C("points"), "alias")).alias("alias"))
