"""Evidence, exports, alignment of notes with texts, research packages, integrity and library listings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import relations as R

C = F.col


# --- evidence and exports


def stitched(df: DataFrame, group: str, order: str, text: str, before: str, after: str, most: int = 2400) -> DataFrame:
    """EVD1: a chunk's text from a sentence's beginning to a sentence's end, completed from the stored overlaps, at most so long."""
    lead = F.regexp_extract(C(before), r"([^.!?。！？]*)$", 1)
    tail = F.regexp_extract(C(after), r"^([^.!?。！？]*[.!?。！？])", 1)
    starts = F.trim(C(text)).rlike(r"^[\p{Lu}\p{N}#]")
    ends = F.trim(C(text)).rlike(r"[.!?。！？]$")
    whole = F.concat(F.when(starts, "").otherwise(F.coalesce(lead, F.lit(""))), C(text), F.when(ends, "").otherwise(F.coalesce(tail, F.lit(""))))
    return df.withColumn("evidence", F.trim(F.substring(F.regexp_replace(whole, r"\s+", " "), 1, most)))


def in_order(df: DataFrame, ids: Sequence[int], key: str) -> DataFrame:
    """EVD3, EVD4: the asked rows, in the order asked, each once."""
    asked = df.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(dict.fromkeys(ids))] or [(0, -1)], f"position int, {key} long")
    return asked.join(df, key).orderBy("position")


def locator_strategy(annotation: Column, note: Column, bbox: Column, selected: Column, page: Column, attachment: Column) -> Column:
    """EVD6: the most exact way to a fragment's place, with how sure it is; a box, a selection or a page needs the attachment for full weight."""
    here = lambda c: c.isNotNull() & attachment.isNotNull()
    ladder = ((annotation.isNotNull(), "annotation:1.0"), (note.isNotNull(), "note:1.0"), (here(bbox), "bbox:0.98"), (here(selected), "text:0.85"), (here(page), "page:0.65"), (page.isNotNull(), "page:0.2"), (selected.isNotNull(), "text:0.1"))
    return F.coalesce(*[F.when(c, F.lit(way)) for c, way in ladder], F.lit("page:0.0"))


def evidence_jsonl(df: DataFrame, by: str, then: Sequence[Column], fields: Sequence[str], parts: int = 64) -> DataFrame:
    """EXP1, EXP3: a JSON line for each record, with ids E001, E002, ... by falling `by` and then; keys sorted.

    Ranks are counted within ranges of `by`, whose bounds are its quantiles, and moved on by the counts of the ranges before.
    """
    bounds = sorted({b for b in df.approxQuantile(by, [k / parts for k in range(1, parts)], 0.5 / parts)}, reverse=True)
    part = F.coalesce(*[F.when(C(by) > b, F.lit(k)) for k, b in enumerate(bounds)], F.lit(len(bounds)))
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(by), *then))
    ranked = rows.withColumn("_local", local).join(before, "_part").withColumn("rank", C("_before") + C("_local"))
    number = F.concat(F.lit("E"), F.when(C("rank") < 1000, F.lpad(C("rank").cast("string"), 3, "0")).otherwise(C("rank").cast("string")))
    names = sorted([*fields, "evidence_id"])
    return ranked.select("rank", F.to_json(F.struct(*[(number if n == "evidence_id" else C(n)).alias(n) for n in names])).alias("line"))


def evidence_markdown(df: DataFrame, group: str, title: str, text: str, order: str) -> DataFrame:
    """EXP2: a section for each group with its quotes in order."""
    quotes = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.concat(F.lit("> "), F.replace(x[text], F.lit("\n"), F.lit("\n> "))))
    return df.groupBy(group).agg(F.concat(F.lit("## "), F.min(title), F.lit("\n\n"), F.array_join(quotes, "\n\n")).alias("markdown"))


def export_fingerprint(df: DataFrame, entry: Column, options: str) -> DataFrame:
    """EXP4: a hash over the options and all entries, in whatever order they come."""
    return R.content_hash(df, [], F.concat(F.lit(options + "|"), entry)).select(C("hash").alias("fingerprint"))


# --- alignment


def exact_matches(notes: DataFrame, chunks: DataFrame, note: str, selected: str, text: str, scope: Sequence[str] = ()) -> DataFrame:
    """ALN1, J11: notes with the chunks that hold their selection: note, the chunk's other columns, match (1.0 for an equal text, 0.96 for a part).

    Candidates share the longest run of three words inside the selection, by its hash (and the columns of scope, such as a document); a
    selection of fewer than five words is looked for as whole words. Normal forms are made once for each side.
    """
    norm = lambda c: T.normalize_match_text(F.coalesce(C(c), F.lit("")))
    runs = lambda words, first, last, n: F.transform(F.sequence(first, last - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    left = notes.select(note, *scope, norm(selected).alias("_a")).where("_a <> ''").withColumn("_w", F.split("_a", " ")).withColumn("_k", F.size("_w"))
    inner = F.when(C("_k") >= 5, runs(C("_w"), F.lit(2), C("_k") - 1, F.lit(3))).otherwise(runs(C("_w"), F.lit(1), C("_k"), F.least(C("_k"), F.lit(3))))
    longest = F.element_at(F.array_sort(inner, lambda x, y: (F.length(x) - F.length(y)).cast("int")), -1)
    left = left.select(note, *scope, "_a", "_k", longest.alias("_run"), F.size(F.split(longest, " ")).alias("_size"))
    sizes = [r[0] for r in left.select("_size").distinct().collect()]  # at most 1, 2 and 3
    right = chunks.withColumn("_b", norm(text)).withColumn("_bw", F.split("_b", " "))
    some = [F.when(F.size("_bw") >= n, runs(C("_bw"), F.lit(1), F.size("_bw"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in sizes]
    keys = F.array_distinct(F.transform(F.concat(F.array().cast("array<string>"), *some), lambda run: F.xxhash64(run)))
    right = right.withColumn("_key", F.explode(keys)).drop("_bw", text)
    both = left.withColumn("_key", F.xxhash64("_run")).join(right, ["_key", *scope])
    whole = lambda c: F.concat(F.lit(" "), C(c), F.lit(" "))
    held = F.when(C("_k") >= 5, F.contains("_b", "_a")).otherwise(F.contains(whole("_b"), whole("_a")))
    both = both.withColumn("match", F.when(C("_a") == C("_b"), 1.0).when(held, 0.96)).where("match is not null")
    return both.drop("_a", "_b", "_k", "_run", "_size", "_key")


def ranked_matches(df: DataFrame, note: str, chunk: str, score: Column, most: int = 5) -> DataFrame:
    """ALN2: the best candidates of each note."""
    return df.withColumn("score", score).withColumn("rank", F.row_number().over(Window.partitionBy(note).orderBy(F.desc("score"), chunk))).where(C("rank") <= most)


def annotation_score(chunk: Column, annotation: Column, chunk_page: Column, page: Column) -> Column:
    """ALN4: how well an annotation fits a chunk: score, method and confidence.

    1.0 (or 0.95 off the page) for a text that is the chunk's or stands in it; 0.85 on the page with an overlap of 0.65 of
    the smaller set of words, 0.75 anywhere with 0.8; 0.35 for the page alone.
    """
    norm = lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9\x{4e00}-\x{9fff}]+", " "))
    a, b = norm(chunk), norm(annotation)
    both = (a != "") & (b != "")
    same = F.coalesce((chunk_page == page) & (page != 0), F.lit(False))
    share = T.overlap(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " ")))
    graded = lambda score, method, sure: F.struct(F.lit(score).alias("score"), F.lit(method).alias("method"), F.lit(sure).alias("confidence"))
    return (
        F.when(both & (a == b) & same, graded(1.0, "text_exact", "high")).when(both & (a == b), graded(0.95, "text_exact", "high"))
        .when(both & F.contains(a, b) & same, graded(1.0, "text_contains", "high")).when(both & F.contains(a, b), graded(0.95, "text_contains", "high"))
        .when(both & same & (share >= 0.65), graded(0.85, "normalized_overlap", "medium")).when(both & (share >= 0.8), graded(0.75, "normalized_overlap", "medium"))
        .when(same, graded(0.35, "page_only", "low")).otherwise(graded(0.0, "unknown", "low"))
    )


def fuzzy_contains(haystack: Column, needle: Column) -> Column:
    """The whole needle, its first 60 or 40 characters, or all its words of three and more characters."""
    h, n = T.normalize_quote(haystack), T.normalize_quote(needle)
    words = F.filter(F.split(n, " "), lambda w: F.length(w) >= 3)
    return (n != "") & (F.contains(h, n) | ((F.length(n) > 60) & F.contains(h, F.substring(n, 1, 60))) | ((F.length(n) > 40) & F.contains(h, F.substring(n, 1, 40))) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(h, w))))


def aligned_blocks(chunks: DataFrame, blocks: DataFrame, key: str, chunk: str, block: str, most: int = 8) -> DataFrame:
    """J24, ALN6: blocks on a chunk's pages, graded exact or overlap by shared tokens, the best of each chunk."""
    both = chunks.join(blocks, key).where(C("page").between(C("page_start"), F.coalesce(C("page_end"), C("page_start"))))
    score = F.round(T.overlap(T.token_set(C("chunk_text")), T.token_set(C("block_text"))), 6)
    graded = both.withColumn("score", score).withColumn("grade", F.when(F.contains(T.normalize_quote(C("chunk_text")), T.normalize_quote(C("block_text"))), "exact").when(C("score") >= 0.3, "overlap")).where(C("grade").isNotNull())
    return graded.withColumn("rank", F.row_number().over(Window.partitionBy(chunk).orderBy((C("grade") == "exact").desc(), F.desc("score"), block))).where(C("rank") <= most)


def object_links(notes: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """J23, RES14: objects that share chunks with a note, or whose first 24 terms (three characters and more) the note's text holds."""
    both = notes.join(objects, key)
    terms = F.slice(F.filter(C("terms"), lambda t: F.length(t) >= 3), 1, 24)
    held = F.exists(terms, lambda t: F.contains(F.lower("note_text"), F.lower(t)))
    return both.withColumn("reason", F.when(F.arrays_overlap("note_chunks", "object_chunks"), "shared_chunk").when(held, "term")).where(C("reason").isNotNull())


def relation_confidence(kind: Column, sources: Column, chunks: Column, pages: Column, compatible: Column) -> Column:
    """J21, RES15: by what two objects share (numbers of sources, chunks and pages) and whether their types go together; a mere relation has at most 0.58."""
    ladder = (((sources > 0) & compatible, 0.72), ((chunks > 0) & compatible, 0.66), (sources > 0, 0.58), (chunks > 0, 0.56), ((pages > 0) & compatible, 0.54))
    value = F.coalesce(*[F.when(c, v) for c, v in ladder], F.lit(0.5))
    return F.when(kind == "related_to", F.least(value, F.lit(0.58))).otherwise(value)


# --- research packages


def gaps(package: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """RES3, RES7, RES11: what a package of evidence lacks, and whether it is ready: at least three pieces from two documents."""
    n, docs, notes, good = (F.coalesce(F.sum(c), F.lit(0)) for c in ("pieces", "is_document", "notes", "strong"))
    out = package.groupBy(*by).agg(n.alias("pieces"), docs.alias("documents"), notes.alias("notes"), good.alias("strong"))
    lacks = F.array_compact(F.array(F.when(C("pieces") == 0, "no_evidence"), F.when(C("documents") < 2, "single_document"), F.when(C("notes") == 0, "no_notes"), F.when(C("strong") == 0, "low_confidence")))
    ready = F.when((C("pieces") >= 3) & (C("documents") >= 2), "ready").when(C("pieces") > 0, "partial").otherwise("not_ready")
    return out.withColumn("gaps", F.array_join(lacks, ",")).withColumn("readiness", ready)


# Words of evidence about limits, and what is said of each gap.
LIMITS = ("limitation", "experiment", "ablation", "failure", "failure case", "局限", "实验", "消融", "失败", "失败案例")
GAPS = {
    "no_chunks": "当前知识库未检索到相关 evidence chunk，不能进入假设生成。",
    "no_notes": "未找到相关 personal_notes，缺少个人理解层判断。",
    "no_tags": "未找到相关标签，任务/方法/问题/局限结构仍不明确。",
    "no_relations": "未找到相关 knowledge_relations，方法-问题-证据链仍不完整。",
    "no_pages": "检索到的证据缺少 PDF 页码，后续需要补齐页码回溯。",
    "test_data": "当前命中的证据包含 mock/test/acceptance 数据，不应作为真实研究问题的充分证据。",
    "only_test_data": "当前没有可用于真实研究判断的有效 evidence chunk。",
    "dimension": "当前 evidence 未覆盖问题维度：%s。",
    "few": "证据数量偏少，且缺少 limitation / experiment / ablation / failure case 相关证据。",
}


def evidence_gaps(questions: DataFrame, evidence: DataFrame, ident: str, dimensions: dict[str, Sequence[str]]) -> DataFrame:
    """RES3: for each question what its evidence lacks: ident and gaps, an array of codes in the order of GAPS.

    questions: ident, question; evidence: ident, kind (chunk, note, tag or relation), page, text. A dimension that the question
    names and no piece of evidence does is `dimension:<name>`. Only flags are gathered, before the shuffle. Null texts hold
    nothing; questions without evidence lack all of it; `gap_text` gives a code's words.
    """
    holds = lambda x, words: reduce(or_, [F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lit(w.lower())) for w in words])
    chunk, test = C("kind") == "chunk", T.hygiene(F.coalesce("text", F.lit(""))).isin("strong", "weak")
    flags = evidence.groupBy(ident).agg(
        *(F.count_if(C("kind") == k).alias(f"_{k}") for k in ("chunk", "note", "tag", "relation")), F.count_if(chunk & C("page").isNotNull()).alias("_paged"),
        F.count_if(test).alias("_test"), F.count_if(chunk & test).alias("_testing"), F.count_if(holds(C("text"), LIMITS)).alias("_limits"),
        *(F.count_if(holds(C("text"), words)).alias(f"_d{k}") for k, words in enumerate(dimensions.values())),
    )
    both = questions.select(ident, "question").join(flags, ident, "left")
    n = lambda c: F.coalesce(C(c), F.lit(0))
    some = n("_chunk") > 0
    open_ = [F.when(holds(C("question"), words) & (n(f"_d{k}") == 0), f"dimension:{name}") for k, (name, words) in enumerate(dimensions.items())]
    found = [
        F.when(~some, "no_chunks"), F.when(n("_note") == 0, "no_notes"), F.when(n("_tag") == 0, "no_tags"), F.when(n("_relation") == 0, "no_relations"), F.when(some & (n("_paged") == 0), "no_pages"),
        F.when(n("_test") > 0, "test_data"), F.when(some & (n("_testing") == n("_chunk")), "only_test_data"), *open_, F.when((n("_chunk") == 1) & (n("_limits") == 0), "few"),
    ]
    return both.select(ident, F.array_compact(F.array(*found)).alias("gaps"))


def gap_text(code: str) -> str:
    """RES3: what is said of a gap."""
    kind, _, name = code.partition(":")
    return GAPS[kind] % name if name else GAPS[kind]


def uncovered(dimensions: dict[str, Sequence[str]], text: Column) -> Column:
    """RES4: dimensions of a question none of whose keywords the evidence holds."""
    holds = lambda words: reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(w.lower())) for w in words])
    return F.array_join(F.array_compact(F.array(*[F.when(~holds(ws), F.lit(d)) for d, ws in dimensions.items()])), ",")


def confident(channels: Column, tag_matches: Column, relations: Column, notes: Column, tags: Column, score: Column) -> Column:
    """RES8: is a fused result of high confidence? A fusion score of 3 at least, and either a note link with a tag or relation,
    related notes with relations or tags, or three channels; never by the keyword or the vector channel alone."""
    has = lambda c: F.array_contains(channels, c)
    distinct = F.size(F.array_distinct(channels))
    alone = (distinct == 1) & (has("keyword") | has("vector"))
    structural = has("note_link") & (has("tag") | has("relation") | (tag_matches > 0) | (relations > 0))
    network = (notes > 0) & ((relations > 0) | (F.size(tags) > 0) | has("tag") | has("relation"))
    return ~alone & (structural | network | (distinct >= 3)) & (score >= 3.0)


def clean(df: DataFrame, text: str) -> DataFrame:
    """RES6: rows without strong or weak signs of test data."""
    return df.where(~T.hygiene(C(text)).isin("strong", "weak"))


def support(evidence: Column, notes: Column, relations: Column, valid_evidence: Column, valid_notes: Column, valid_relations: Column, tags: Column, experiment: Column, risks: Column, failed: Column | None = None) -> Column:
    """RES10: 0.35, 0.2 and 0.15 for ids that are all known, 0.1 for tags and for named risks, 0.1 for an experiment check that is
    `pass` and 0.04 for one that is `weak`; at most 1, and 0 for what failed for good."""
    known = lambda a, v: (F.size(a) > 0) & (F.size(F.array_except(a, v)) == 0)
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    total = one(known(evidence, valid_evidence), 0.35) + one(known(notes, valid_notes), 0.2) + one(known(relations, valid_relations), 0.15) + one(F.size(tags) > 0, 0.1) + one(risks, 0.1)
    total = total + F.when(experiment == "pass", 0.1).when(experiment == "weak", 0.04).otherwise(0.0)
    return F.when(F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False), 0.0).otherwise(F.round(F.least(total, F.lit(1.0)), 4))


def clusters(df: DataFrame, support_key: str, ident: str, most: int = 5) -> DataFrame:
    """RES9: candidates by the set of what supports them, the largest first."""
    sets = df.groupBy(ident).agg(F.array_join(F.array_sort(F.collect_set(C(support_key).cast("string"))), ",").alias("support"))
    out = sets.groupBy("support").agg(F.min(ident).alias("first"), F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "first").limit(most)


# --- integrity and listings


def verdict(checks: DataFrame) -> DataFrame:
    """INT1 to INT3: failed checks by name, and healthy, degraded or broken: a table with name, n and fatal."""
    bad = checks.where("n > 0")
    out = bad.agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("failed"), F.bool_or("fatal").alias("fatal"))
    return out.select("failed", F.when(C("fatal"), "broken").when(C("failed") != "", "degraded").otherwise("healthy").alias("verdict"))


def impact(parts: dict[str, DataFrame]) -> DataFrame:
    """INT5, INT6: how many rows of each table a deletion reaches."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("n")) for name, df in parts.items()])


def tables_with_column(spark, column: str, known: Sequence[str]) -> list[str]:
    """INT8: registered tables and views beyond the known ones that have a column."""
    return sorted(t.name for t in spark.catalog.listTables() if t.name not in known and any(c.name == column for c in spark.catalog.listColumns(t.name)))


# Columns that name a document, and those that name a chunk.
DOCUMENT_COLUMNS = ("document_id", "matched_document_id", "source_doc_id")
CHUNK_COLUMNS = ("chunk_id", "matched_chunk_id", "source_chunk_id", "evidence_chunk_id")


def unknown_references(spark, documents: DataFrame, chunks: DataFrame, known: Sequence[str] = (), pattern: str | None = None) -> DataFrame:
    """INT8: tables and views of the catalog beyond the known ones that refer to a document or chunk: relation, column, n.

    documents, chunks: one column of ids each; repeated and null ones count once and not at all. The plan is made from the
    catalog: each column that names a document or a chunk is one branch of a union, counted where the ids are few or many.
    pattern: which tables to look at, as the catalog matches names. Without any such table the result is empty.
    """
    asked = {**dict.fromkeys(DOCUMENT_COLUMNS, documents), **dict.fromkeys(CHUNK_COLUMNS, chunks)}
    parts = []
    for table in sorted(spark.catalog.listTables(pattern=pattern), key=lambda t: t.name):
        if table.name in known:
            continue
        name = ".".join(f"`{x}`" for x in [*([table.catalog, *(table.namespace or [])] if table.catalog and not table.isTemporary else []), table.name])
        df = spark.table(name)
        for column in (c for c in df.columns if c in asked):
            ids = asked[column].toDF(column).distinct()
            parts.append(df.select(column).join(ids, column, "left_semi").agg(F.lit(table.name).alias("relation"), F.lit(column).alias("column"), F.count(F.lit(1)).alias("n")))
    if not parts:
        return spark.createDataFrame([], "relation string, column string, n long")
    return reduce(DataFrame.unionByName, parts).where("n > 0")


def illegal_transitions(df: DataFrame, key: str, order: str, status: str, edges: Sequence[tuple[str, str]]) -> DataFrame:
    """LIB10, STM5: consecutive statuses of a record that are no legal edge."""
    legal = df.sparkSession.createDataFrame(list(edges), "before string, after string")
    steps = df.withColumn("before", F.lag(status).over(Window.partitionBy(key).orderBy(order))).where("before is not null").withColumnRenamed(status, "after")
    return steps.join(legal, ["before", "after"], "left_anti")


def progress(df: DataFrame, group: str, status: str, done: str) -> DataFrame:
    """LIB11, LIB12: records, finished ones and their share."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(C(status) == done).alias("done"), F.round(F.count_if(C(status) == done) / F.count(F.lit(1)), 4).alias("share"))


def labelled_relations(relations: DataFrame, entities: dict[str, DataFrame], kind: str, ident: str) -> DataFrame:
    """LIB7: relations with the label of what they point to, from the table of its kind; unknown ones by kind and id."""
    names = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias(kind), C("id").alias(ident), "label") for k, df in entities.items()])
    return relations.join(names, [kind, ident], "left").withColumn("label", F.coalesce("label", F.concat_ws(":", kind, ident)))
