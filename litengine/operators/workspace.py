"""What a reader's workspace shows: fragments with what supports them, documents, chunks, chapters, sessions, review queues."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import review
from .objects import compact

C = F.col

# Sources of a notebook, what they need besides, kinds of notes that are no product, and lengths of lists and snippets.
NOTEBOOK_TYPES = ("pdf_chunk", "zotero_annotation_comment", "zotero_child_note", "zotero_inspiration_note")
SUPPORT = {"zotero_annotation_comment": ("zotero_highlight",), "zotero_inspiration_note": ("zotero_highlight", "pdf_chunk")}
EXCLUDED_ORIGINS = ("synthetic_seed",)
LISTED, SNIPPET, SUMMARY = 10, 160, 280


def is_product(source_type: Column, origin: Column) -> Column:
    """FIL12: false for notes of an excluded origin; chunks of documents and rows without an origin are products."""
    return ~((source_type != "pdf_chunk") & F.coalesce(origin.isin(*EXCLUDED_ORIGINS), F.lit(False)))


def notebook_fragments(catalog: DataFrame, source_types: Sequence[str] = NOTEBOOK_TYPES, document_ids: Sequence[int] = ()) -> DataFrame:
    """EVD5: fragments of the requested types; a comment with the text of the highlight it belongs to as selected_text.

    catalog has fragment_id, parent_fragment_id, source_type, document_id, origin_kind and text. Types that support the requested
    ones are read with them, and not returned. Unknown types are an error.
    """
    unknown = sorted(set(source_types) - set(NOTEBOOK_TYPES))
    if unknown:
        raise ValueError(f"unsupported notebook source types: {unknown}")
    support = sorted({s for t in source_types for s in (t, *SUPPORT.get(t, ()))})
    rows = catalog.where(C("source_type").isin(support))
    if document_ids:
        rows = rows.where(C("document_id").isin(list(document_ids)))
    marked = rows.where("source_type = 'zotero_highlight'").select(C("fragment_id").alias("parent_fragment_id"), C("text").alias("_marked"))
    asked = rows.where(C("source_type").isin(list(source_types)) & is_product(C("source_type"), C("origin_kind")))
    return asked.join(marked, "parent_fragment_id", "left").withColumn("selected_text", F.when(C("source_type") == "zotero_annotation_comment", C("_marked"))).drop("_marked")


def rows_per(df: DataFrame, key: str, ident: str) -> DataFrame:
    """AGG3: rows with an id by key, for keys that are not null; no row where the table has no such column."""
    if key not in df.columns:
        return df.sparkSession.createDataFrame([], f"{key} long, n long")
    return df.where(C(key).isNotNull()).groupBy(key).agg(F.count(ident).alias("n"))


def snippet(x: Column, size: int = SNIPPET) -> Column:
    """Text on one line, cut to a size with three dots where it is longer."""
    line = compact(x)
    return F.when(F.length(line) <= size, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, size - 3)), F.lit("...")))


def first_of(df: DataFrame, key: str, value: str, order: Column, most: int = LISTED) -> DataFrame:
    """The first distinct values of each key, as a list: values are made distinct before they are ranked."""
    once = df.groupBy(key, value).agg(F.min(order).alias("_o"))
    ranked = once.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_o", value))).where(C("_r") <= most)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: x[value]).alias(value))


def document_detail(documents: DataFrame, chunks: DataFrame, notes: DataFrame, tags: DataFrame, relations: DataFrame) -> DataFrame:
    """LIB2: documents that are read, with counts of chunks and notes, tags in order, the first ten headings, notes and relations.

    All tables have document_id. Notes count once a document however often they are linked. Documents without any have zeros and empty lists.
    """
    read = documents.where(C("read_status").isin("read", "mastered"))
    parts = [
        chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count")),
        notes.groupBy("document_id").agg(F.count_distinct("note_id").alias("note_count")),
        tags.groupBy("document_id").agg(F.array_sort(F.collect_set("tag")).alias("tags")),
        first_of(chunks.select("document_id", C("heading").alias("headings"), "chunk_index"), "document_id", "headings", C("chunk_index")),
        first_of(notes.select("document_id", C("note_id").alias("note_ids")), "document_id", "note_ids", C("note_ids")),
        first_of(relations.select("document_id", C("relation_id").alias("relation_ids")), "document_id", "relation_ids", C("relation_ids")),
    ]
    out = reduce(lambda a, b: a.join(b, "document_id", "left"), parts, read).fillna(0, ["chunk_count", "note_count"])
    lists = [c for c in ("tags", "headings", "note_ids", "relation_ids")]
    return out.withColumns({c: F.coalesce(C(c), F.array().cast(out.schema[c].dataType)) for c in lists})


def chunk_preview(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """LIB4: chunks with their document's title, a snippet and whether and how a page can be opened: metadata, page, text and path are asked in this order.

    A chunk's own path comes before its document's. Chunks of documents that do not exist are left out.
    """
    both = chunks.join(documents.select("document_id", "title", C("pdf_path").alias("_path")), "document_id")
    path, text = F.coalesce(F.nullif(C("pdf_path"), F.lit("")), C("_path")), C("chunk_text")
    no = lambda c, empty: c.isNull() | (c == empty)
    metadata = F.coalesce(T.is_metadata(text), F.lit(False))
    status = F.when(metadata, "metadata_non_locatable").when(no(C("page"), 0), "no_page").when(compact(text) == "", "no_text").when(no(path, ""), "pdf_missing").otherwise("page_level_only")
    out = both.select(*[C(c) for c in chunks.columns if c != "pdf_path"], "title", path.alias("pdf_path"), snippet(text).alias("snippet"), metadata.alias("is_metadata_chunk"), status.alias("locator_status"))
    return out.withColumn("is_locatable", C("locator_status") == "page_level_only")


def workspace_state(documents: DataFrame, chapters: DataFrame) -> DataFrame:
    """LIB13: for each chapter of a document what can be read and searched.

    documents has document_id, title, pdf_path, source_path and zotero_key; chapters has document_id, chapter_id and counts of evidence, notes and user notes.
    """
    given = lambda c: c.isNotNull() & (c != "")
    either = lambda c, yes, no: F.when(c > 0, yes).otherwise(no)
    both = chapters.fillna(0, ["evidence_count", "note_count", "user_note_count"]).join(documents, "document_id")
    return both.select(
        "document_id", "chapter_id", F.coalesce("title", F.lit("")).alias("document_title"), F.lit(1).alias("source_count"),
        (given(C("pdf_path")) | given(C("source_path"))).alias("pdf_available"), (C("evidence_count") > 0).alias("chunked"), C("evidence_count").alias("chunk_count"), given(C("zotero_key")).alias("zotero_source_available"),
        either(C("note_count"), "available", "empty").alias("notes_status"), C("note_count").alias("notes_existing"), C("user_note_count").alias("notes_user"),
        either(C("evidence_count"), "available", "unavailable").alias("passages"), either(C("note_count"), "available", "unavailable").alias("notes"),
    )


def research_session(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RES5: what retrieval found for a question, without test data, judged: counts, what blocks and what warns, and whether a hypothesis may be tried.

    results has text, channels (names), tag_matches, relations, notes, tags, score and chunk_id. Rows of several questions are judged by the columns in `by`.
    Blocking are no_results, no_evidence, no_high_confidence and single_channel (every row has one channel, keyword or vector); a note or relation that no row has warns.
    """
    channels = C("channels")
    distinct = F.size(F.array_distinct(channels))
    single = (distinct == 1) & (F.array_contains(channels, "keyword") | F.array_contains(channels, "vector"))
    good = review.confident(channels, C("tag_matches"), C("relations"), C("notes"), C("tags"), C("score"))
    tagged = (C("tag_matches") > 0) | (C("relations") > 0) | F.array_contains(channels, "tag") | F.array_contains(channels, "relation")
    keep = C("_keep")
    counts = {"total_results": keep, "high_confidence": keep & good, "evidence_backed": keep & C("chunk_id").isNotNull(), "supported": keep & tagged, "_single": keep & single, "_notes": keep & (C("notes") > 0), "_relations": keep & (C("relations") > 0), "excluded": ~keep}
    out = results.withColumn("_keep", ~F.coalesce(T.hygiene(C("text")), F.lit("none")).isin("strong", "weak")).groupBy(*by).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()])
    n = C("total_results")
    blocking = [F.when(n == 0, "no_results"), F.when(C("evidence_backed") == 0, "no_evidence"), F.when((n > 0) & (C("high_confidence") == 0), "no_high_confidence"), F.when((n > 0) & (C("_single") == n), "single_channel")]
    warning = [F.when(C("_notes") == 0, "no_notes"), F.when(C("_relations") == 0, "no_relations")]
    listed = lambda parts: F.array_join(F.array_compact(F.array(*parts)), ",")
    judged = out.withColumn("blocking", listed(blocking)).withColumn("warning", listed(warning))
    return judged.withColumn("ready", C("blocking") == "").drop("_single", "_notes", "_relations")


def _item(rank: int, kind: str, view: str, ident: Column, summary: Column, priority, risks: Sequence[Column], action) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    flags = F.array_compact(F.array(*risks)).cast("array<string>")
    return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("item_type"), F.lit(view).alias("source_view"), ident.alias("source_id"), F.substring(summary, 1, SUMMARY).alias("summary"), lit(priority).alias("priority"), flags.alias("risk_flags"), lit(action).alias("suggested_action"), F.lit("pending_review").alias("status"))


def review_queue(mappings: DataFrame, candidates: DataFrame, hypotheses: DataFrame, critics: DataFrame, plans: DataFrame, gaps: DataFrame, evidence: DataFrame) -> DataFrame:
    """RES12: what people are to look at, from a session's parts; rank orders the kinds.

    mappings: raw, target_bucket, mapping_status, needs_review, reason, each (raw, target_bucket) once; candidates: candidate_id, title, speculation, strength,
    unsupported; hypotheses: hypothesis_id, claim, speculation, unsupported; critics: candidate_id, novelty_risk, strength, downgrade; plans:
    candidate_id, baseline, dataset, metric; gaps: view, gap; evidence: evidence_id and the fields of its trace. A claim without support
    counts once, candidates before hypotheses. Items carry no running number: kind and source_id name them.
    """
    weak = lambda c: C(c) == "weak"
    unmapped = C("target_bucket").isNull() | (C("mapping_status") == "unmapped")
    some = F.size(F.coalesce("unsupported", F.array().cast("array<string>"))) > 0
    text = lambda c: F.coalesce(C(c).cast("string"), F.lit("None"))
    flag = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    open_ = lambda c: C(c).isNull() | (C(c) == "") | F.contains(C(c), F.lit("must be selected"))
    once = mappings.groupBy("raw", "target_bucket").agg(F.min_by(F.struct("mapping_status", "needs_review", "reason"), F.struct("mapping_status", "needs_review", "reason")).alias("m")).select("raw", "target_bucket", "m.*")
    claims = candidates.select(F.lit(0).alias("k"), C("candidate_id").alias("id"), F.explode("unsupported").alias("claim")).unionByName(hypotheses.select(F.lit(1).alias("k"), C("hypothesis_id").alias("id"), F.explode("unsupported").alias("claim")))
    claims = claims.withColumn("claim", F.trim("claim")).where("claim <> ''").groupBy("claim").agg(F.min(F.struct("k", "id")).alias("f"))
    traced = ("document_id", "document_title", "chunk_id", "heading_path", "pdf_path")
    missing = evidence.select("evidence_id", F.explode(F.array_compact(F.array(*[F.when(C(c).isNull() | (C(c).cast("string") == ""), c) for c in traced]))).alias("field"))
    said = gaps.select("view", F.trim("gap").alias("gap")).where("gap <> ''").distinct()
    gap = lambda rank, kind, view, risk: (said.where(C("view") == view), _item(rank, kind, view, C("gap"), C("gap"), "low", [F.lit(risk)], "manual_classification_or_ignore"))
    mechanism, inspiration = gap(9, "missing_mechanism", "mechanism_view", "mechanism_view_empty"), gap(10, "missing_inspiration", "inspiration_path_view", "inspiration_path_empty")
    raw_gaps = mappings.where((C("mapping_status") == "unmapped") | C("target_bucket").isNull()).groupBy("raw").agg(F.min("reason").alias("reason"))
    parts = [
        (once, _item(0, "suggested_tag_mapping", "tag_aggregation_view", C("raw"), F.concat("raw", F.lit(" → "), F.coalesce("target_bucket", F.lit("unmapped")), F.lit(" as "), "mapping_status"), F.when(unmapped, "high").otherwise("medium"), [flag(unmapped | C("needs_review"), "needs_human_review")], F.when(unmapped, "manual_classification_or_ignore").otherwise("accept_or_edit"))),
        (candidates, _item(1, "draft_candidate_method", "candidate_method_view", C("candidate_id"), F.coalesce("title", "candidate_id"), "high", [flag(C("speculation"), "speculation"), flag(weak("strength"), "weak_evidence"), flag(some, "unsupported_claims")], "review_evidence_and_critic")),
        (hypotheses, _item(2, "draft_hypothesis", "draft_hypothesis_view", C("hypothesis_id"), F.coalesce("claim", "hypothesis_id"), "high", [flag(C("speculation"), "speculation"), flag(some, "unsupported_claims")], "review_unsupported_assumptions")),
        (critics, _item(3, "critic_entry", "critic_view", C("candidate_id"), F.concat(F.lit("Novelty risk: "), text("novelty_risk"), F.lit(", evidence: "), text("strength"), F.lit(", "), F.coalesce("downgrade", F.lit(""))), "medium", [flag(weak("strength"), "weak_evidence"), flag(weak("strength"), "downgrade_reason")], "accept_or_edit")),
        (plans, _item(4, "experiment_plan", "experiment_plan_view", C("candidate_id"), F.concat(F.lit("Baseline: "), text("baseline"), F.lit(", Dataset: "), text("dataset")), "medium", [flag(open_("dataset"), "dataset_focus_missing"), flag(open_("metric"), "metric_focus_missing")], "review_and_revise_if_needed")),
        (claims, _item(5, "unsupported_claim", "claims", F.concat(C("f.id"), F.lit(":"), F.substring("claim", 1, 60)), C("claim"), "medium", [F.lit("unsupported"), F.lit("speculation")], "find_supporting_evidence_or_mark_speculation").withField("source_view", F.when(C("f.k") == 0, "candidate_method_view").otherwise("draft_hypothesis_view"))),
        gap(6, "evidence_gap", "evidence_view", "needs_human_review"),
        (missing, _item(7, "source_trace_gap", "evidence_view", F.concat(F.lit("missing_"), "field", F.lit(":"), "evidence_id"), F.concat(F.lit("missing source_trace."), "field", F.lit(" for "), "evidence_id"), "low", [F.lit("source_trace_incomplete")], "manual_classification_or_ignore")),
        (raw_gaps, _item(8, "unmapped_tag", "tag_aggregation_view", F.concat(F.lit("unmapped:"), "raw"), F.concat(F.lit("Unmapped tag: "), "raw", F.lit(" — "), F.coalesce("reason", F.lit("no mapping available"))), "low", [F.lit("needs_human_review")], "manual_classification_or_ignore")),
        (mechanism[0].where("contains(lower(gap), 'mechanism')"), mechanism[1]),
        (inspiration[0].where("contains(lower(gap), 'inspiration')"), inspiration[1]),
    ]
    return reduce(DataFrame.unionByName, [df.select(item.alias("i")).select("i.*") for df, item in parts])


def queue_summary(queue: DataFrame) -> DataFrame:
    """RES12: how many items of a queue there are of each kind that a summary names, in one row."""
    kinds = {"draft_candidate": ["draft_candidate_method"], "draft_hypothesis": ["draft_hypothesis"], "critic": ["critic_entry"], "experiment_plan": ["experiment_plan"], "unsupported_claim": ["unsupported_claim"]}
    kinds["unresolved_gap"] = ["evidence_gap", "source_trace_gap", "unmapped_tag", "missing_mechanism", "missing_inspiration"]
    return queue.agg(F.count(F.lit(1)).alias("total_items"), F.count_if(C("status") == "pending_review").alias("pending_count"), *[F.count_if(C("item_type").isin(v)).alias(f"{k}_count") for k, v in kinds.items()])
