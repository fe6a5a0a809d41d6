"""EVD, EXP, ALN, RES, INT and LIB over the bundled tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evidence as E
from ..operators import ingest as I
from ..operators import lexical as L
from ..operators import review as V
from ..operators import windows as X
from ..sources import tables as S
from . import column_query, query, table_of

C = F.col


@query("op_evd1_stitched")
def stitched(spark, sf):
    return V.stitched(I.chunks(S.spread(table_of(spark, sf, "documents"), "doc_id")), "doc_id", "chunk_index", "chunk_text", "overlap_before", "overlap_after").select("doc_id", "chunk_index", "evidence")


@query("op_evd1_coherent")
def coherent(spark, sf):
    """Chunks of documents as those of a book of six chunks a page and forty a chapter."""
    k = C("chunk_index")
    chunks = I.chunks(S.spread(table_of(spark, sf, "documents"), "doc_id")).select(
        C("doc_id").alias("document_id"), "chunk_index", F.floor(k / 40).cast("long").alias("chapter_id"), C("lang").alias("heading_path"), "chunk_text", "overlap_before", "overlap_after",
        F.floor(k / 6).cast("int").alias("pdf_page_start"), F.floor((k + 1) / 6).cast("int").alias("pdf_page_end"),
    )
    return E.coherent(chunks).select("document_id", "chunk_index", "evidence", "page_first", "page_last", "context_before", "context_after")


@query("op_evd3_in_order", "SELECT position, doc_id, lang FROM (VALUES (0, 9), (1, 3), (2, 500), (3, 4)) v(position, id) JOIN documents ON doc_id = id")
def in_order(spark, sf):
    return V.in_order(table_of(spark, sf, "documents"), [9, 3, 500, 9, 4, -5], "doc_id").select("position", "doc_id", "lang")


column_query("op_evd6_locator_strategy", "documents", "doc_id", lambda: V.locator_strategy(F.when(C("doc_id") % 11 == 0, "k"), F.when(C("doc_id") % 7 == 0, "n"), F.when(C("doc_id") % 5 == 0, "b"), F.when(C("doc_id") % 3 == 0, "s"), F.when(C("doc_id") % 2 == 0, 1), F.when(C("lang") != "fr", "a")), "CASE WHEN doc_id % 11 = 0 THEN 'annotation:1.0' WHEN doc_id % 7 = 0 THEN 'note:1.0' WHEN lang <> 'fr' AND doc_id % 5 = 0 THEN 'bbox:0.98' WHEN lang <> 'fr' AND doc_id % 3 = 0 THEN 'text:0.85' WHEN doc_id % 2 = 0 THEN CASE WHEN lang <> 'fr' THEN 'page:0.65' ELSE 'page:0.2' END WHEN doc_id % 3 = 0 THEN 'text:0.1' ELSE 'page:0.0' END")


@query("op_exp1_jsonl", """SELECT rank, '{"doc_id":' || doc_id || ',"evidence_id":"E' || CASE WHEN rank < 1000 THEN lpad(rank::VARCHAR, 3, '0') ELSE rank::VARCHAR END || '","lang":"' || lang || '"}' AS line FROM (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents)""")
def jsonl(spark, sf):
    return V.evidence_jsonl(table_of(spark, sf, "documents"), "n_chars", [C("doc_id")], ["doc_id", "lang"])


@query("op_exp2_markdown", "SELECT conv_id, '## ' || min(role) || chr(10) || chr(10) || string_agg('> ' || replace(text, chr(10), chr(10) || '> '), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def markdown(spark, sf):
    return V.evidence_markdown(table_of(spark, sf, "conversations"), "conv_id", "role", "text", "turn")


@query("op_exp4_fingerprint", "SELECT sha256(concat_ws('|', count(*), sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT), sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT), sum(('0x' || substr(h, 31, 15))::BIGINT::HUGEINT), sum(('0x' || substr(h, 46, 15))::BIGINT::HUGEINT))) AS fingerprint FROM (SELECT *, sha256('md|' || doc_id || '|' || lang) AS h FROM documents)")
def fingerprint(spark, sf):
    return V.export_fingerprint(table_of(spark, sf, "documents"), F.concat_ws("|", "doc_id", "lang"), "md")


NORM = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"


EXACT_SQL = f"SELECT item_id, doc_id, CASE WHEN n = h THEN 1.0 ELSE 0.96 END::DOUBLE AS match FROM (SELECT item_id, {NORM} AS n FROM benchmark) JOIN (SELECT doc_id, {NORM} AS h FROM documents) ON n <> '' AND CASE WHEN len(string_split(n, ' ')) < 5 THEN contains(' ' || h || ' ', ' ' || n || ' ') ELSE contains(h, n) END"


@query("op_aln1_exact_matches", EXACT_SQL)
def exact_matches(spark, sf):
    return V.exact_matches(table_of(spark, sf, "benchmark"), table_of(spark, sf, "documents"), "item_id", "text", "text").select("item_id", "doc_id", "match")


def near_passages(spark, sf):
    """Benchmark items and chunks of documents that share four words in a row, with both texts."""
    items = table_of(spark, sf, "benchmark").select("item_id", "text")
    chunks = I.chunks(S.spread(table_of(spark, sf, "documents"), "doc_id")).select(L.row_id(C("doc_id"), C("chunk_index")).alias("chunk_id"), C("chunk_text").alias("text"))
    pairs = X.sharing_runs(items, chunks, "item_id", "chunk_id")
    return pairs.join(items.withColumnRenamed("text", "selected"), "item_id").join(chunks, "chunk_id")


@query("op_aln3_fuzzy")
def fuzzy(spark, sf):
    return X.fuzzy(near_passages(spark, sf), "selected", "text").select("item_id", "chunk_id", "ratio")


@query("op_win8_windows")
def windows(spark, sf):
    words = lambda c: F.filter(F.split(T.normalize_for_search(C(c)), " "), lambda w: w != "")
    pairs = near_passages(spark, sf).select("item_id", "chunk_id", words("selected").alias("a"), words("text").alias("b"))
    return X.located(pairs, "a", "b")


ANNOTATION = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{2,}}'))"


WORDS = "trim(regexp_replace(lower({}), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g'))"


@query("op_aln4_annotation_score", f"""SELECT conv_id, turn, CASE WHEN x AND na = nb OR x AND contains(na, nb) THEN CASE WHEN same THEN 1.0 ELSE 0.95 END WHEN x AND same AND share >= 0.65 THEN 0.85 WHEN x AND share >= 0.8 THEN 0.75 WHEN same THEN 0.35 ELSE 0.0 END::DOUBLE AS score,
  CASE WHEN x AND na = nb THEN 'text_exact' WHEN x AND contains(na, nb) THEN 'text_contains' WHEN x AND (same AND share >= 0.65 OR share >= 0.8) THEN 'normalized_overlap' WHEN same THEN 'page_only' ELSE 'unknown' END AS method
FROM (SELECT *, na <> '' AND nb <> '' AS x, len(list_intersect(wa, wb)) / greatest(1, least(len(wa), len(wb))) AS share FROM (SELECT *, list_distinct(string_split(na, ' ')) AS wa, list_distinct(string_split(nb, ' ')) AS wb
  FROM (SELECT a.conv_id, a.turn, {WORDS.format('a.text')} AS na, {WORDS.format("CASE WHEN a.turn % 3 = 0 THEN substr(a.text, 5, 30) ELSE b.text END")} AS nb, a.turn % 2 = 0 AS same FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)))""")
def annotation_score(spark, sf):
    t = table_of(spark, sf, "conversations").select("conv_id", "turn", "text")
    pairs = t.join(t.select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("other")), ["conv_id", "turn"])
    noted = F.when(C("turn") % 3 == 0, F.substring("text", 5, 30)).otherwise(C("other"))
    return pairs.select("conv_id", "turn", V.annotation_score(C("text"), noted, F.lit(1), F.when(C("turn") % 2 == 0, 1).otherwise(2)).alias("m")).select("conv_id", "turn", "m.score", "m.method")


QUOTE = r"lower(trim(regexp_replace(regexp_replace(regexp_replace({}, '-\s*\n\s*', '', 'g'), '\[\d+(\s*,\s*\d+)*\]', '', 'g'), '\s+', ' ', 'g')))"


@query("op_j22_fuzzy_contains", f"SELECT conv_id, turn, n <> '' AND (contains(h, n) OR contains(h, substr(n, 1, 60)) AND length(n) > 60 OR contains(h, substr(n, 1, 40)) AND length(n) > 40 OR (len(ws) > 0 AND len(list_filter(ws, lambda w: NOT contains(h, w))) = 0)) AS value FROM (SELECT conv_id, turn, h, n, list_filter(string_split(n, ' '), lambda w: length(w) >= 3) AS ws FROM (SELECT a.conv_id, a.turn, {QUOTE.format('a.text')} AS h, {QUOTE.format("CASE WHEN a.turn % 2 = 0 THEN substr(a.text, 3, 50) ELSE b.text END")} AS n FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1))")
def fuzzy_contains(spark, sf):
    t = table_of(spark, sf, "conversations").select("conv_id", "turn", "text")
    pairs = t.join(t.select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("other")), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", V.fuzzy_contains(C("text"), F.when(C("turn") % 2 == 0, F.substring("text", 3, 50)).otherwise(C("other"))).alias("value"))


@query("op_j24_aligned_blocks", f"SELECT conv_id, turn, other, grade, rank FROM (SELECT conv_id, turn, other, grade, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY grade = 'exact' DESC, score DESC, other))::INTEGER AS rank FROM (SELECT *, CASE WHEN contains(ha, hb) THEN 'exact' WHEN score >= 0.3 THEN 'overlap' END AS grade FROM (SELECT a.conv_id, a.turn, b.turn AS other, {QUOTE.format('a.text')} AS ha, {QUOTE.format('b.text')} AS hb, CASE WHEN least(len({TOKENS.format('a.text')}), len({TOKENS.format('b.text')})) > 0 THEN round(len(list_intersect({TOKENS.format('a.text')}, {TOKENS.format('b.text')})) / least(len({TOKENS.format('a.text')}), len({TOKENS.format('b.text')})), 6) ELSE 0 END AS score FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn AND a.turn + 2)) WHERE grade IS NOT NULL) WHERE rank <= 8")
def aligned_blocks(spark, sf):
    t = table_of(spark, sf, "conversations")
    chunks = t.select("conv_id", "turn", (C("conv_id") * 1000 + C("turn")).alias("chunk"), C("turn").alias("page_start"), (C("turn") + 2).alias("page_end"), C("text").alias("chunk_text"))
    blocks = t.select("conv_id", C("turn").alias("page"), C("turn").alias("other"), C("text").alias("block_text"))
    return V.aligned_blocks(chunks, blocks, "conv_id", "chunk", "other").select("conv_id", "turn", "other", "grade", "rank")


@query("op_j23_object_links", "SELECT s_suppkey AS item_id, n_nationkey AS part, CASE WHEN s_suppkey % 4 = n_nationkey % 4 THEN 'shared_chunk' WHEN contains(lower(s_name || ' of ' || n_name), lower(n_name)) AND length(n_name) >= 3 THEN 'term' END AS reason FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def object_links(spark, sf):
    notes = table_of(spark, sf, "supplier").join(table_of(spark, sf, "nation").select(C("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    notes = notes.select(C("s_nationkey").alias("k"), C("s_suppkey").alias("item_id"), F.concat_ws(" of ", "s_name", "n_name").alias("note_text"), F.array((C("s_suppkey") % 4).cast("long")).alias("note_chunks"))
    objects = table_of(spark, sf, "nation").select(C("n_nationkey").alias("k"), C("n_nationkey").alias("part"), F.array("n_name").alias("terms"), F.array((C("n_nationkey") % 4).cast("long")).alias("object_chunks"))
    return V.object_links(notes, objects, "k").select("item_id", "part", "reason")


PAIR_VALUE = "CASE WHEN doc_id % 3 > 0 AND lang = 'en' THEN 0.72 WHEN doc_id % 2 > 0 AND lang = 'en' THEN 0.66 WHEN doc_id % 3 > 0 THEN 0.58 WHEN doc_id % 2 > 0 THEN 0.56 WHEN doc_id % 5 > 0 AND lang = 'en' THEN 0.54 ELSE 0.5 END"
column_query("op_res15_relation_confidence", "documents", "doc_id", lambda: V.relation_confidence(F.when(C("doc_id") % 4 == 0, "related_to").otherwise("supports"), C("doc_id") % 3, C("doc_id") % 2, C("doc_id") % 5, C("lang") == "en"), f"CASE WHEN doc_id % 4 = 0 THEN least(0.58, {PAIR_VALUE}) ELSE {PAIR_VALUE} END::DOUBLE")
column_query("op_res4_uncovered", "documents", "doc_id", lambda: V.uncovered({"size": ["thth", "ingth"], "time": ["onan"]}, C("text")), "array_to_string(list_filter([CASE WHEN NOT (contains(lower(text), 'thth') OR contains(lower(text), 'ingth')) THEN 'size' END, CASE WHEN NOT contains(lower(text), 'onan') THEN 'time' END], lambda x: x IS NOT NULL), ',')")
column_query("op_res8_confidence", "documents", "doc_id", lambda: V.confident(F.array_compact(F.array(F.when(C("doc_id") % 2 == 0, "keyword"), F.when(C("doc_id") % 3 == 0, "note_link"), F.when(C("doc_id") % 5 == 0, "tag"))), C("doc_id") % 2, C("doc_id") % 4, C("doc_id") % 3, F.array_compact(F.array(F.when(C("lang") == "en", "t"))), C("n_chars") / 100), "n_chars / 100 >= 3 AND NOT (doc_id % 2 = 0 AND doc_id % 3 > 0 AND doc_id % 5 > 0) AND (doc_id % 3 = 0 AND (doc_id % 5 = 0 OR doc_id % 2 > 0 OR doc_id % 4 > 0) OR doc_id % 3 > 0 AND (doc_id % 4 > 0 OR lang = 'en' OR doc_id % 5 = 0) OR doc_id % 30 = 0)")
column_query("op_res10_support", "documents", "doc_id", lambda: V.support(F.array(C("doc_id") % 4), F.array(C("doc_id") % 3), F.array(C("doc_id") % 2), F.array(*[F.lit(x).cast("long") for x in (0, 1)]), F.array(F.lit(0).cast("long")), F.array(F.lit(1).cast("long")), F.array("lang"), F.when(C("doc_id") % 5 == 0, "pass").when(C("doc_id") % 5 == 1, "weak").otherwise("fail"), C("lang") == "de", C("doc_id") % 13 == 0), "(CASE WHEN doc_id % 13 = 0 THEN 0 ELSE round(CASE WHEN doc_id % 4 <= 1 THEN 0.35 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0.2 ELSE 0 END + CASE WHEN doc_id % 2 = 1 THEN 0.15 ELSE 0 END + 0.1 + CASE WHEN doc_id % 5 = 0 THEN 0.1 WHEN doc_id % 5 = 1 THEN 0.04 ELSE 0 END + CASE WHEN lang = 'de' THEN 0.1 ELSE 0 END, 4) END)::DOUBLE")


@query("op_res3_gaps", "SELECT user_id, pieces, documents, notes, strong, array_to_string(list_filter([CASE WHEN documents < 2 THEN 'single_document' END, CASE WHEN notes = 0 THEN 'no_notes' END, CASE WHEN strong = 0 THEN 'low_confidence' END], lambda x: x IS NOT NULL), ',') AS gaps, CASE WHEN pieces >= 3 AND documents >= 2 THEN 'ready' ELSE 'partial' END AS readiness FROM (SELECT user_id, count(*) AS pieces, count(*) FILTER (event_type = 'click') AS documents, count(*) FILTER (event_type = 'view') AS notes, count(*) FILTER (value > 3) AS strong FROM events GROUP BY 1)")
def gaps(spark, sf):
    one = lambda c: c.cast("long")
    e = table_of(spark, sf, "events").select("user_id", F.lit(1).cast("long").alias("pieces"), one(C("event_type") == "click").alias("is_document"), one(C("event_type") == "view").alias("notes"), one(C("value") > 3).alias("strong"))
    return V.gaps(e, ["user_id"])


_TEST = "regexp_matches(' ' || regexp_replace(lower(coalesce(e.text, '')), '[^\\p{L}\\p{N}]', ' ', 'g') || ' ', ' (mock data|dummy|lorem ipsum|placeholder|test|demo|mock) ')"
_LIMIT = "regexp_matches(lower(coalesce(e.text, '')), 'limitation|experiment|ablation|failure|局限|实验|消融|失败')"
_KIND = "CASE turn % 4 WHEN 1 THEN 'note' WHEN 2 THEN 'tag' WHEN 3 THEN 'relation' ELSE 'chunk' END"


@query("op_res3_evidence_gaps", f"""WITH q AS (SELECT conv_id, text AS question FROM conversations WHERE turn = 0), e AS (SELECT conv_id, {_KIND} AS kind, CASE WHEN conv_id % 3 > 0 THEN turn END AS page, text FROM conversations WHERE turn > 0 OR conv_id % 2 = 0),
f AS (SELECT conv_id, count(*) FILTER (kind = 'chunk') AS c, count(*) FILTER (kind = 'note') AS n, count(*) FILTER (kind = 'tag') AS t, count(*) FILTER (kind = 'relation') AS r, count(*) FILTER (kind = 'chunk' AND page IS NOT NULL) AS p, count(*) FILTER ({_TEST}) AS x, count(*) FILTER (kind = 'chunk' AND {_TEST}) AS y, count(*) FILTER ({_LIMIT}) AS l, count(*) FILTER (contains(lower(text), 'th')) AS d0, count(*) FILTER (contains(lower(text), 'qu')) AS d1 FROM e GROUP BY 1)
SELECT conv_id, array_to_string(list_filter([CASE WHEN coalesce(c, 0) = 0 THEN 'no_chunks' END, CASE WHEN coalesce(n, 0) = 0 THEN 'no_notes' END, CASE WHEN coalesce(t, 0) = 0 THEN 'no_tags' END, CASE WHEN coalesce(r, 0) = 0 THEN 'no_relations' END, CASE WHEN c > 0 AND p = 0 THEN 'no_pages' END, CASE WHEN x > 0 THEN 'test_data' END, CASE WHEN c > 0 AND y = c THEN 'only_test_data' END,
  CASE WHEN contains(lower(question), 'th') AND coalesce(d0, 0) = 0 THEN 'dimension:th' END, CASE WHEN contains(lower(question), 'qu') AND coalesce(d1, 0) = 0 THEN 'dimension:qu' END, CASE WHEN c = 1 AND l = 0 THEN 'few' END], lambda v: v IS NOT NULL), ',') AS gaps FROM q LEFT JOIN f USING (conv_id)""")
def evidence_gaps(spark, sf):
    """First turns as questions, the others (of every second talk, the first one too) as chunks, notes, tags and relations."""
    t = table_of(spark, sf, "conversations")
    kind = F.when(C("turn") % 4 == 1, "note").when(C("turn") % 4 == 2, "tag").when(C("turn") % 4 == 3, "relation").otherwise("chunk")
    evidence = t.where("turn > 0 or conv_id % 2 = 0").select("conv_id", kind.alias("kind"), F.when(C("conv_id") % 3 > 0, C("turn")).alias("page"), "text")
    out = V.evidence_gaps(t.where("turn = 0").select("conv_id", C("text").alias("question")), evidence, "conv_id", {"th": ["TH"], "qu": ["qu"]})
    return out.select("conv_id", F.array_join("gaps", ",").alias("gaps"))


@query("op_res6_hygiene", "SELECT doc_id FROM documents WHERE NOT regexp_matches(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]', ' ', 'g') || ' ', ' (mock data|dummy|lorem ipsum|placeholder|test|demo|mock) ')")
def hygiene(spark, sf):
    return V.clean(table_of(spark, sf, "documents"), "text").select("doc_id")


column_query("op_str39_hygiene", "documents", "doc_id", lambda: T.hygiene(C("text")), "CASE WHEN regexp_matches(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '  ', 'g') || ' ', ' (dummy|placeholder) ') THEN 'strong' WHEN regexp_matches(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '  ', 'g') || ' ', ' (test|demo|mock) ') THEN 'weak' WHEN regexp_matches(lower(text), 'test|demo|mock') THEN 'false_positive' ELSE 'none' END")


@query("op_res9_clusters", "SELECT support, min(user_id) AS first, count(*) AS n FROM (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS support FROM events GROUP BY 1) GROUP BY 1 ORDER BY n DESC, first LIMIT 5")
def clusters(spark, sf):
    return V.clusters(table_of(spark, sf, "events"), "event_type", "user_id")


CHECKS = "SELECT 'orphan_vectors' AS name, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)) AS n, false AS fatal UNION ALL SELECT 'repeated_ids', (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)), true"


@query("op_int1_verdict", f"SELECT coalesce(string_agg(name, ',' ORDER BY name), '') AS failed, CASE WHEN bool_or(fatal) THEN 'broken' WHEN count(*) > 0 THEN 'degraded' ELSE 'healthy' END AS verdict FROM ({CHECKS}) WHERE n > 0")
def verdict(spark, sf):
    from ..operators import relations as R

    d, e, l = (table_of(spark, sf, t) for t in ("documents", "embeddings", "labels"))
    a = R.orphans(e, l, "vec_id", "doc_id").select(F.lit("orphan_vectors").alias("name"), C("orphans").alias("n"), F.lit(False).alias("fatal"))
    b = R.repeated(d, "doc_id").agg(F.lit("repeated_ids").alias("name"), F.count(F.lit(1)).alias("n"), F.lit(True).alias("fatal"))
    return V.verdict(a.union(b))


@query("op_int5_impact", "WITH gone AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT 'labels' AS relation, count(*) AS n FROM labels WHERE doc_id IN (FROM gone) UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id IN (FROM gone) UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id IN (FROM gone)")
def impact(spark, sf):
    gone = table_of(spark, sf, "labels").where("toxic = 1").select("doc_id")
    reached = lambda name, key: table_of(spark, sf, name).withColumn("doc_id", C(key)).join(gone, "doc_id", "left_semi")
    return V.impact({"labels": reached("labels", "doc_id"), "embeddings": reached("embeddings", "vec_id"), "documents": reached("documents", "doc_id")})


@query("op_int8_unknown_references", "WITH d AS (SELECT doc_id FROM labels WHERE toxic = 1), c AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'user') SELECT * FROM (SELECT 'int8_embeddings' AS relation, 'document_id' AS \"column\", count(*) AS n FROM embeddings WHERE vec_id IN (FROM d) UNION ALL SELECT 'int8_events', 'matched_document_id', count(*) FROM events WHERE event_id IN (FROM d) UNION ALL SELECT 'int8_events', 'chunk_id', count(*) FROM events WHERE user_id IN (FROM c)) WHERE n > 0")
def unknown_references(spark, sf):
    """Tables that name documents or chunks, one known, one without such a column, against toxic documents and the talks of users."""
    t = lambda name: table_of(spark, sf, name)
    views = {
        "labels": t("labels").withColumnRenamed("doc_id", "document_id"), "embeddings": t("embeddings").withColumnRenamed("vec_id", "document_id"), "nation": t("nation"),
        "events": t("events").withColumnRenamed("event_id", "matched_document_id").withColumnRenamed("user_id", "chunk_id"),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(f"int8_{name}")
    return V.unknown_references(spark, t("labels").where("toxic = 1").select("doc_id"), t("conversations").where("role = 'user'").select("conv_id"), ["int8_labels"], "int8_*")


@query("op_lib10_transitions", "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) WHERE prev IS NOT NULL AND NOT (prev = 'view' AND event_type = 'click' OR prev = 'click' AND event_type = 'purchase' OR prev = event_type AND prev = 'view')")
def transitions(spark, sf):
    return V.illegal_transitions(table_of(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", [("view", "click"), ("click", "purchase"), ("view", "view")]).select("event_id")


@query("op_lib12_progress", "SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS share FROM orders GROUP BY 1")
def progress(spark, sf):
    return V.progress(table_of(spark, sf, "orders"), "o_custkey", "o_orderstatus", "F")


@query("op_lib7_relation_labels", "SELECT id, kind, coalesce(n_name, r_name, kind || ':' || id) AS label FROM (SELECT s_nationkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'nation' WHEN 1 THEN 'region' ELSE 'other' END AS kind FROM supplier) LEFT JOIN nation ON kind = 'nation' AND n_nationkey = id LEFT JOIN region ON kind = 'region' AND r_regionkey = id")
def relation_labels(spark, sf):
    kind = F.when(C("s_suppkey") % 3 == 0, "nation").when(C("s_suppkey") % 3 == 1, "region").otherwise("other")
    relations = table_of(spark, sf, "supplier").select(C("s_nationkey").alias("id"), kind.alias("kind"))
    entities = {"nation": table_of(spark, sf, "nation").select(C("n_nationkey").alias("id"), C("n_name").alias("label")), "region": table_of(spark, sf, "region").select(C("r_regionkey").alias("id"), C("r_name").alias("label"))}
    return V.labelled_relations(relations, entities, "kind", "id").select("id", "kind", "label")


@query("op_lib3_evidence", "SELECT doc_id FROM (SELECT * FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 60) WHERE n_chars > 300 ORDER BY doc_id LIMIT 20")
def evidence(spark, sf):
    return table_of(spark, sf, "documents").where("lang = 'fr'").orderBy("doc_id").limit(60).where("n_chars > 300").orderBy("doc_id").limit(20).select("doc_id")


@query("op_lib6_relations", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey DESC LIMIT 50")
def relations(spark, sf):
    return table_of(spark, sf, "orders").where("o_orderstatus = 'P'").orderBy(F.desc("o_orderkey")).limit(50).select("o_orderkey")


@query("op_src12_invalid_vectors", "SELECT vec_id, 'vector' AS reason FROM embeddings WHERE vec_id % 9 IN (2, 4, 6) UNION ALL SELECT vec_id, 'repeated' FROM embeddings WHERE vec_id % 11 = 1")
def invalid_vectors(spark, sf):
    from ..sources.tables import invalid_vectors as check

    e, nine = table_of(spark, sf, "embeddings").select("vec_id", "embedding"), C("vec_id") % 9
    # Some vectors lose a component, hold one that is no number, or are null; some rows come twice.
    spoiled = F.when(nine == 2, F.slice("embedding", 1, 63)).when(nine == 4, F.transform("embedding", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x).cast("float"))).when(nine != 6, C("embedding"))
    again = e.where("vec_id % 11 = 1").select("vec_id", F.array_repeat(F.lit(1.0).cast("float"), 64).alias("embedding"))
    return check(e.withColumn("embedding", spoiled).unionByName(again), "vec_id", "embedding", 64)
