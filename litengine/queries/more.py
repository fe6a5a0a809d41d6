"""Further operators over the bundled tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion as X
from ..operators import ingest as I
from ..operators import library as Y
from ..operators import relations as R
from ..operators import review as V
from . import column_query, query, table_of
from .review import EXACT_SQL

C = F.col


@query("op_src4_annotations", "SELECT a.event_id AS id, s.t AS source_type, CASE s.t WHEN 'zotero_highlight' THEN event_type ELSE comment END AS body FROM (SELECT *, CASE WHEN value > 1 THEN 'c' || event_id END AS comment FROM events) a JOIN (VALUES ('zotero_highlight'), ('zotero_annotation_comment')) s(t) ON true JOIN nation ON n_nationkey = user_id WHERE a.event_id % 10 <> 0 AND user_id % 10 <> 0 AND (s.t = 'zotero_highlight' OR comment IS NOT NULL)")
def annotations(spark, sf):
    e = table_of(spark, sf, "events").select(C("event_id").alias("id"), C("user_id").alias("parent_id"), C("event_type").alias("text"), F.when(C("value") > 1, F.concat(F.lit("c"), C("event_id").cast("string"))).alias("comment"))
    parents = table_of(spark, sf, "nation").select(C("n_nationkey").cast("long").alias("parent_id"), C("n_regionkey").alias("document_id"))
    gone = table_of(spark, sf, "events").where("event_id % 10 = 0").select(C("event_id").alias("id"))
    return Y.annotation_fragments(e, parents, gone, "id").select("id", "source_type", "body")


@query("op_ing16_first_marked", "SELECT regexp_extract(text, 'sha256:([0-9a-f]{3})', 1) AS value, min(source || '/' || doc_id) AS path FROM (SELECT doc_id, source, substr(text, 1, 60) || ' sha256:' || substr(sha256(text), 1, 4) AS text FROM documents WHERE doc_id % 3 > 0 AND source IS NOT NULL) GROUP BY 1")
def first_marked(spark, sf):
    d = table_of(spark, sf, "documents").where("source is not null").withColumn("path", F.concat_ws("/", "source", "doc_id"))
    marked = F.concat(F.substring("text", 1, 60), F.when(C("doc_id") % 3 > 0, F.concat(F.lit(" sha256:"), F.substring(F.sha2("text", 256), 1, 4))).otherwise(""))
    return Y.first_marked(d.withColumn("text", marked), "path", "text", "sha256:([0-9a-f]{3})")


@query("op_ing18_unique_numbers", "SELECT doc_id, CASE WHEN k = 1 THEN number ELSE number || '-' || k END AS section_id FROM (SELECT doc_id, number, row_number() OVER (PARTITION BY lang, number ORDER BY doc_id) AS k FROM (SELECT doc_id, lang, doc_id % 7 || '.' || doc_id % 3 AS number FROM documents))")
def unique_numbers(spark, sf):
    d = table_of(spark, sf, "documents").select("doc_id", "lang", F.concat((C("doc_id") % 7).cast("string"), F.lit("."), (C("doc_id") % 3).cast("string"), F.lit(" Title")).alias("heading"))
    return Y.unique_numbers(d, "lang", "doc_id", "heading").select("doc_id", "section_id")


@query("op_ing21_page_markdown", "SELECT conv_id, '<!-- PDF_PAGE: ' || conv_id || ' -->' || chr(10) || string_agg(CASE role WHEN 'user' THEN '## ' || text ELSE text END, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1")
def page_markdown(spark, sf):
    t = table_of(spark, sf, "conversations").withColumn("kind", F.when(C("role") == "user", "heading").otherwise("text"))
    return Y.page_markdown(t, "conv_id", "turn", "kind", "text")


@query("op_win4_representatives", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'click' DESC, value DESC, event_id) AS r FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1)) WHERE r <= 2")
def representatives(spark, sf):
    one = R.top_per_group(table_of(spark, sf, "events").withColumn("g", F.concat_ws("|", "user_id", "event_type")), "g", [F.desc("value"), C("event_id")], 1).drop("rank")
    return R.top_per_group(one, "user_id", [F.desc(C("event_type") == "click"), F.desc("value"), C("event_id")], 2).select("user_id", "event_id")


@query("op_win6_same_section")
def same_section(spark, sf):
    t = table_of(spark, sf, "conversations").select("conv_id", "turn", F.when(C("conv_id") % 2 == 0, F.floor(C("turn") / 3)).alias("chapter"), F.when(C("turn") % 4 != 3, "h").alias("heading"))
    return Y.whole_section(t, "conv_id", "turn", "chapter", "heading", 2).select("conv_id", "turn")


@query("op_aln5_remapped", "WITH c AS (SELECT conv_id, turn, conv_id * 100 + turn AS chunk_id FROM conversations WHERE turn % 3 = 0), r AS (SELECT conv_id, conv_id * 100 + turn AS ref, turn FROM conversations), e AS (SELECT ref, chunk_id, CASE WHEN c.turn = r.turn THEN 0 ELSE 1 END AS way, CASE WHEN c.turn = r.turn THEN 0 WHEN c.turn = r.turn + 1 THEN 1 ELSE 2 END AS o FROM r JOIN c ON c.conv_id = r.conv_id AND c.turn BETWEEN r.turn - 1 AND r.turn + 1) SELECT ref, chunk_id, CASE way WHEN 0 THEN 'exact_page' ELSE 'nearby_page' END AS method FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY o, chunk_id) AS k FROM e) WHERE k = 1")
def remapped(spark, sf):
    t = table_of(spark, sf, "conversations").withColumn("chunk_id", C("conv_id") * 100 + C("turn"))
    refs = t.select("conv_id", C("chunk_id").alias("ref"), C("turn").alias("page_no"), F.lit(" ").alias("quote"))
    return Y.remapped(refs, t.where("turn % 3 = 0").select("conv_id", C("turn").alias("page"), "chunk_id", C("text").alias("chunk_text")), "conv_id", "ref")


@query("op_res2_related", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'P' OR o_orderkey % 500 = 0 ORDER BY o_orderkey DESC LIMIT 100")
def related(spark, sf):
    return Y.related(table_of(spark, sf, "orders"), [C("o_custkey") == 7, C("o_orderstatus") == "P", C("o_orderkey") % 500 == 0], "o_orderkey", 100).select("o_orderkey")


column_query("op_res13_readiness", "documents", "doc_id", lambda: Y.readiness_score(C("lang") == "en", C("doc_id") % 2 == 0, C("doc_id") % 3 == 0), "round(((lang = 'en')::INT + (doc_id % 2 = 0)::INT + (doc_id % 3 = 0)::INT) / 3, 4)")
column_query("op_int2_verdict_rules", "documents", "doc_id", lambda: Y.verdict_rules(C("doc_id") % 2 == 0, C("doc_id") % 3, C("doc_id") % 5, C("doc_id") % 7 == 0), "array_to_string(list_filter([CASE WHEN doc_id % 2 <> 0 THEN 'database_missing' END, CASE WHEN doc_id % 3 > 0 THEN 'index_drift' END, CASE WHEN doc_id % 5 > 0 THEN 'vectors_stale' END, CASE WHEN doc_id % 7 = 0 THEN 'writes_performed' END], lambda x: x IS NOT NULL), ',')")
def _report():
    """A made state for each document, from its number, language and size."""
    k, none = C("doc_id"), F.lit(None)
    zero = {c: F.when(k % (11 + i) == 0, k % 3).alias(c) for i, c in enumerate(Y.FAILURE_COUNTS)}
    return F.struct(
        *zero.values(), (k % 17 > 0).alias("source_recorded"), (k % 19 > 0).alias("database_ok"), (k % 23 > 0).alias("fts_ready"), (k % 29 > 0).alias("vectors_available"), (k % 31 == 0).alias("wrote"),
        F.lit(0).alias("passage_missing_count"), F.when(C("lang") == "de", C("n_chars") % 2).alias("note_missing_count"), F.when(k % 4 > 0, 0).alias("passage_orphan_count"), F.when(k % 9 > 0, 0).otherwise(2).alias("note_orphan_count"),
        F.when(C("lang") == "fr", F.array(C("lang"), C("lang"))).alias("vector_reasons"), none.cast("array<string>").alias("journal_failures"), F.when(k % 10 == 0, "pdf_missing").alias("pdf_warning"), (k % 2).alias("excluded_notes"),
        (k % 7 > 0).alias("history_recorded"), F.when(k % 21 == 0, F.array(F.lit("stage_late"))).alias("journal_warnings"),
    )


_W = "[CASE WHEN doc_id % 4 = 0 THEN 'vector_passage_orphan_count_not_available' END, CASE WHEN lang = 'fr' THEN 'vector_inspection:fr' END, CASE WHEN doc_id % 10 = 0 THEN 'pdf_missing' END, CASE WHEN doc_id % 2 > 0 THEN 'personal_notes_excluded_from_fts:1' END, CASE WHEN doc_id % 7 = 0 THEN 'historical_events_not_recorded' END, CASE WHEN doc_id % 21 = 0 THEN 'stage_late' END]"
_C = [f"CASE WHEN doc_id % {11 + i} = 0 AND doc_id % 3 > 0 THEN '{r}' END" for i, r in enumerate(("database_foreign_key_issues", "fts_missing_pdf_chunk_count", "fts_orphan_pdf_chunk_count", "fts_missing_personal_note_count", "fts_orphan_personal_note_count"))]
_F = f"[CASE WHEN doc_id % 17 = 0 THEN 'document_source_binding_missing' END, CASE WHEN doc_id % 19 = 0 THEN 'database_integrity_check_failed' END, {_C[0]}, CASE WHEN doc_id % 23 = 0 THEN 'fts_not_ready' END, {', '.join(_C[1:])}, CASE WHEN doc_id % 29 = 0 THEN 'vector_store_unavailable' END, CASE WHEN lang = 'de' AND n_chars % 2 > 0 THEN 'vector_note_missing_count' END, CASE WHEN doc_id % 9 = 0 THEN 'vector_note_orphan_count' END, CASE WHEN doc_id % 31 = 0 THEN 'read_only_contract_violated' END]"


@query("op_int2_integrity_verdict", f"SELECT doc_id, CASE WHEN len(f) > 0 THEN 'fail' WHEN len(w) > 0 THEN 'warn' ELSE 'pass' END AS verdict, array_to_string(w || f, ',') AS reasons FROM (SELECT doc_id, list_filter({_W}, lambda x: x IS NOT NULL) AS w, list_filter({_F}, lambda x: x IS NOT NULL) AS f FROM documents)")
def integrity_verdict(spark, sf):
    v = table_of(spark, sf, "documents").select("doc_id", Y.integrity_verdict(_report()).alias("v"))
    return v.select("doc_id", "v.verdict", F.array_join("v.reasons", ",").alias("reasons"))


column_query("op_int4_status", "documents", "doc_id", lambda: Y.status(F.when(C("doc_id") % 11 != 0, C("doc_id") % 5), F.lit(3), (C("doc_id") % 2).cast("string"), F.lit("1")), "CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'corrupt' WHEN doc_id % 2 <> 1 THEN 'stale' WHEN doc_id % 5 <> 3 THEN 'source_drift' ELSE 'ready' END")


@query("op_ret41_object_groups", "SELECT p_brand, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY CASE WHEN p_size > 25 THEN 0 ELSE 1 END, lpad(p_partkey::VARCHAR, 9, '0')) AS names FROM part GROUP BY 1")
def object_groups(spark, sf):
    p = table_of(spark, sf, "part").withColumn("label", F.lpad(C("p_partkey").cast("string"), 9, "0"))
    out = Y.objects_grouped(p, "p_brand", "label", F.when(C("p_size") > 25, 0).otherwise(1))
    return out.withColumn("names", F.array_join(F.transform(F.split("names", ","), lambda x: x.cast("long").cast("string")), ","))


@query("op_ret40_match_strength", "SELECT object, chunk_id, max(points)::DOUBLE AS points FROM (SELECT o AS object, doc_id AS chunk_id, round(p + CASE lang WHEN 'en' THEN 1.5 WHEN 'de' THEN 0.8 WHEN 'fr' THEN -0.4 ELSE 0 END, 6) AS points FROM (SELECT o, doc_id, lang, 5.0 * contains(lower(text), a)::INT + 2.2 * contains(lower(source), a)::INT + 1.6 * contains(lower(source || ' ' || lang), a)::INT AS p FROM documents, (VALUES ('x', 'the an'), ('x', 'src1'), ('y', 'pathetic'), ('y', 'de')) s(o, a)) WHERE p > 0) GROUP BY 1, 2")
def match_strength(spark, sf):
    section = F.when(C("lang") == "en", "Our Approach").when(C("lang") == "de", "Evaluation").when(C("lang") == "fr", "Abstract").otherwise("Other")
    d = table_of(spark, sf, "documents").select(F.lit(1).alias("k"), C("doc_id").alias("chunk_id"), C("source").alias("heading"), F.concat_ws(" ", "source", "lang").alias("title"), section.alias("section"), "text")
    spec = spark.createDataFrame([(1, "x", ["the an", "src1"]), (1, "y", ["Pathetic", "de"])], "k int, object string, aliases array<string>")
    return Y.match_strength(spec, d, "k").select("object", "chunk_id", "points")


@query("op_str19_grouped_snippet", "SELECT doc_id, (SELECT CASE WHEN s > 1 THEN '…' ELSE '' END || substr(f, s, 220) || CASE WHEN s + 219 < length(f) THEN '…' ELSE '' END FROM (SELECT f, CASE WHEN strpos(lower(f), 'the') > 0 THEN greatest(1, strpos(lower(f), 'the') - 80) ELSE 1 END AS s FROM (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f))) AS snippet FROM documents")
def grouped_snippet(spark, sf):
    return table_of(spark, sf, "documents").select("doc_id", T.make_snippet(C("text"), F.lit("the"), 220, 80).alias("snippet"))


@query("op_j3_bridge_titles", "SELECT o_custkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS titles FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def bridge_titles(spark, sf):
    o, l = table_of(spark, sf, "orders"), table_of(spark, sf, "lineitem")
    return o.join(l, C("o_orderkey") == C("l_orderkey")).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("titles"))


@query("op_j30_first_document", "SELECT user_id, coalesce(max(CASE WHEN value > 4 THEN event_id END), min_by(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 9, '0'))) AS doc FROM events GROUP BY 1")
def first_document(spark, sf):
    return table_of(spark, sf, "events").groupBy("user_id").agg(F.coalesce(F.max(F.when(C("value") > 4, C("event_id"))), F.min_by("event_id", F.struct("ts", "event_id"))).alias("doc"))


@query("op_j29_core_tags", "SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) ORDER BY 1 LIMIT 1000")
def core_tags(spark, sf):
    return table_of(spark, sf, "supplier").join(table_of(spark, sf, "lineitem").where("l_quantity > 49"), C("s_suppkey") == C("l_suppkey"), "left_semi").select("s_suppkey").orderBy("s_suppkey").limit(1000)


@query("op_j31_parent_context", "SELECT c.conv_id, c.turn, coalesce(p.text, d.text, 'none') AS context FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role = 'user' LEFT JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = 0 AND c.turn > 0")
def parent_context(spark, sf):
    c = table_of(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    parent = c.where("role = 'user'").select("conv_id", (C("turn") + 1).alias("turn"), C("text").alias("p"))
    first = c.where("turn = 0").select("conv_id", C("text").alias("d"))
    return c.select("conv_id", "turn").join(parent, ["conv_id", "turn"], "left").join(first, "conv_id", "left").select("conv_id", "turn", F.coalesce("p", F.when(C("turn") > 0, C("d")), F.lit("none")).alias("context"))


@query("op_agg12_top_documents", "SELECT l_suppkey, l_partkey, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey % 2, l_partkey) AS r FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE r <= 3")
def top_documents(spark, sf):
    n = table_of(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return R.top_per_group(n, "l_suppkey", [F.desc("n"), C("l_partkey") % 2, C("l_partkey")], 3).select("l_suppkey", "l_partkey", "n")


@query("op_agg14_role_counts", "SELECT k AS role, coalesce(n, 0) AS n FROM (SELECT unnest(['user', 'assistant', 'footer']) AS k) LEFT JOIN (SELECT role, count(*) AS n FROM conversations GROUP BY 1) ON role = k")
def role_counts(spark, sf):
    return R.by_kind(table_of(spark, sf, "conversations"), "role", ["user", "assistant", "footer"])


@query("op_top5_vector_top_k", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: (embedding[i] - q[i])::DOUBLE * (embedding[i] - q[i])::DOUBLE)), 5) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 3) ORDER BY list_sum(list_transform(range(1, 65), lambda i: (embedding[i] - q[i])::DOUBLE * (embedding[i] - q[i])::DOUBLE)), vec_id LIMIT 50")
def vector_top_k(spark, sf):
    e = table_of(spark, sf, "embeddings")
    return X.nearest(e, e.where("vec_id = 3"), "vec_id", "embedding", 500, metric="l2").select("vec_id", F.round(F.abs("score"), 5).alias("score"))


@query("op_set11_duplicate_sources", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_sources(spark, sf):
    return R.repeated(table_of(spark, sf, "documents"), "source", "lang")


@query("op_set9_fragment_sets", "SELECT coalesce(a.doc_id, b.vec_id) AS k, CASE WHEN b.vec_id IS NULL THEN 'removed' WHEN a.doc_id IS NULL THEN 'added' ELSE 'retained' END AS state FROM (SELECT doc_id FROM labels) a FULL JOIN (SELECT vec_id FROM embeddings) b ON a.doc_id = b.vec_id")
def fragment_sets(spark, sf):
    a = table_of(spark, sf, "labels").select(C("doc_id").alias("k"), F.lit(1).alias("v"))
    return R.difference(a, table_of(spark, sf, "embeddings").select(C("vec_id").alias("k"), F.lit(1).alias("v")), "k", "v")


@query("op_dup6_cascade", "SELECT DISTINCT k, d, p AS priority FROM (SELECT *, min(p) OVER (PARTITION BY k) AS best FROM (SELECT a.doc_id AS k, b.doc_id AS d, 0 AS p FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id > b.doc_id UNION ALL SELECT a.doc_id, b.doc_id, 1 FROM documents a JOIN documents b ON a.n_chars = b.n_chars AND a.lang = b.lang AND a.doc_id > b.doc_id)) WHERE p = best")
def cascade(spark, sf):
    d = table_of(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("h"))
    l, r = d.select(C("doc_id").alias("k"), "lang", "n_chars", "h"), d.select(C("doc_id").alias("d"), "lang", "n_chars", "h")
    return R.first_source([l.join(r, "h").where("k > d"), l.join(r, ["n_chars", "lang"]).where("k > d")], "k", "d")


@query("op_res1_package", "SELECT doc_id, priority FROM (SELECT doc_id, min(p) AS priority FROM (SELECT doc_id, 0 AS p FROM documents WHERE contains(text, 'of the an') UNION ALL SELECT doc_id, 1 FROM documents WHERE contains(text, ' anst ')) GROUP BY 1 ORDER BY 2, 1 LIMIT 30)")
def package(spark, sf):
    d = table_of(spark, sf, "documents")
    hits = d.where(C("text").contains("of the an")).select("doc_id", F.lit(0).alias("priority")).union(d.where(C("text").contains(" anst ")).select("doc_id", F.lit(1)))
    return R.topped_up(hits, "doc_id", "priority", 30)


@query("op_int6_cross_references", "SELECT count(*) AS n FROM (SELECT l_orderkey, list(l_partkey) AS ps FROM lineitem WHERE l_orderkey > 100 GROUP BY 1) WHERE len(list_intersect(ps, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10])) > 0")
def cross_references(spark, sf):
    g = table_of(spark, sf, "lineitem").where("l_orderkey > 100").groupBy("l_orderkey").agg(F.collect_set(C("l_partkey").cast("long")).alias("ps"))
    return g.where(F.arrays_overlap("ps", F.array(*[F.lit(x).cast("long") for x in range(1, 11)]))).agg(F.count(F.lit(1)).alias("n"))


@query("op_lib5_tagged", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def tagged(spark, sf):
    return table_of(spark, sf, "documents").join(table_of(spark, sf, "labels").where("quality = 1 AND toxic = 0"), "doc_id", "left_semi").select("doc_id", "lang")


@query("op_lib8_note_evidence", "SELECT c.conv_id, c.turn, b.item_id FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id")
def note_evidence(spark, sf):
    return table_of(spark, sf, "conversations").join(table_of(spark, sf, "benchmark"), C("item_id") == C("conv_id")).select("conv_id", "turn", "item_id")


@query("op_lib9_cards_by_status", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def cards_by_status(spark, sf):
    return table_of(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey")


@query("op_lib1_home", "SELECT d.doc_id, d.lang, CASE l.quality WHEN 1 THEN 'read' WHEN 0 THEN 'unread' ELSE 'mastered' END AS read_status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY d.doc_id DESC LIMIT 50")
def home(spark, sf):
    state = F.when(C("quality") == 1, "read").when(C("quality") == 0, "unread").otherwise("mastered")
    return table_of(spark, sf, "documents").join(table_of(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", state.alias("read_status")).orderBy(F.desc("doc_id")).limit(50)


@query("op_evd2_public_fields", "SELECT doc_id, lang, (row_number() OVER (ORDER BY n_chars DESC, doc_id))::INTEGER AS selection_rank FROM documents ORDER BY selection_rank LIMIT 25")
def public_fields(spark, sf):
    return R.ranked(table_of(spark, sf, "documents").select("doc_id", "lang", "n_chars"), [F.desc("n_chars"), C("doc_id")], (), "selection_rank").orderBy("selection_rank").limit(25).select("doc_id", "lang", "selection_rank")


@query("op_ctx1_fragment_context", "SELECT page_id, CASE WHEN (lag(page_id) OVER w IS NOT NULL)::INT + (lead(page_id) OVER w IS NOT NULL)::INT = 2 THEN 'available' WHEN (lag(page_id) OVER w IS NOT NULL)::INT + (lead(page_id) OVER w IS NOT NULL)::INT = 1 THEN 'partial' ELSE 'no_source_context' END AS status FROM pages WINDOW w AS (PARTITION BY page_id % 40 ORDER BY page_id)")
def fragment_context(spark, sf):
    p = table_of(spark, sf, "pages").withColumn("g", C("page_id") % 40)
    return R.neighbour_context(p, "g", ["page_id"], "html").select("page_id", C("context_status").alias("status"))


@query("op_ing20_fragments", "SELECT doc_id AS document_id, 'document:' || doc_id AS locator, sha256(c) AS content_hash FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM documents WHERE trim(text) <> '')")
def document_fragments(spark, sf):
    d = table_of(spark, sf, "documents")
    return I.fragments(d, "document", ["doc_id"], "text", [C("doc_id")], "doc_id", "source").select("document_id", "locator", "content_hash")


@query("op_aln2_ranked_matches", f"SELECT item_id, doc_id, (row_number() OVER (PARTITION BY item_id ORDER BY match DESC, doc_id))::INTEGER AS rank FROM ({EXACT_SQL}) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY match DESC, doc_id) <= 5")
def ranked_matches(spark, sf):
    found = V.exact_matches(table_of(spark, sf, "benchmark"), table_of(spark, sf, "documents"), "item_id", "text", "text")
    return V.ranked_matches(found, "item_id", "doc_id", C("match")).select("item_id", "doc_id", "rank")


@query("op_ret27_flat_library", "SELECT type, id FROM (SELECT 'document' AS type, 0 AS t, doc_id AS id FROM documents WHERE contains(lower(text), 'scum') UNION ALL SELECT 'note', 1, conv_id * 1000 + turn FROM conversations WHERE contains(lower(text), 'the') UNION ALL SELECT 'page', 2, page_id FROM pages WHERE contains(lower(html), 'the')) ORDER BY t, id LIMIT 100")
def flat_library(spark, sf):
    d, n, p = (table_of(spark, sf, t) for t in ("documents", "conversations", "pages"))
    parts = [("document", d.where(F.contains(F.lower("text"), F.lit("scum"))).select(C("doc_id").alias("id"))), ("note", n.where(F.contains(F.lower("text"), F.lit("the"))).select((C("conv_id") * 1000 + C("turn")).alias("id"))), ("page", p.where(F.contains(F.lower("html"), F.lit("the"))).select(C("page_id").alias("id")))]
    return R.typed_concat(parts, "id", 100).select("type", "id")


@query("op_ret34_high_quality", "SELECT user_id, max_score, n_primary FROM (SELECT user_id, max(value) AS max_score, count(*) FILTER (value > 1) AS n_primary, max(value) FILTER (value > 1) AS best FROM events GROUP BY 1) ORDER BY best DESC NULLS LAST, user_id LIMIT 25")
def high_quality(spark, sf):
    e = table_of(spark, sf, "events").select("user_id", "event_id", F.when(C("value") > 1, "primary").otherwise("secondary").alias("tier"), C("value").alias("score"))
    out = R.grouped_passages(e, "user_id", "tier", "score", "event_id").where("n_primary > 0")
    return out.orderBy(F.desc("best_score"), "user_id").limit(25).select("user_id", "max_score", "n_primary")


@query("op_ret42_note_vectors", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 11)), 9) AS score FROM embeddings WHERE label IN (1, 2) ORDER BY score DESC, vec_id LIMIT 15")
def note_vectors(spark, sf):
    e = table_of(spark, sf, "embeddings")
    return X.nearest(e.where("label IN (1, 2)"), e.where("vec_id = 11"), "vec_id", "embedding", 15).select("vec_id", "score")


@query("op_stm1_sync_plan", "SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'removed') AS removed FROM (SELECT CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' WHEN a.v = b.v THEN 'retained' ELSE 'changed' END AS state FROM (SELECT doc_id AS k, quality AS v FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id AS k, toxic AS v FROM labels WHERE doc_id % 3 <> 0) b ON a.k = b.k)")
def sync_plan(spark, sf):
    l = table_of(spark, sf, "labels").withColumnRenamed("doc_id", "k")
    d = R.difference(l.where("k % 5 <> 0").select("k", C("quality").alias("v")), l.where("k % 3 <> 0").select("k", C("toxic").alias("v")), "k", "v")
    return d.agg(*[F.count_if(C("state") == s).alias(s) for s in ("added", "changed", "removed")])


@query("op_stm5_journal_transitions", "SELECT event_id FROM (SELECT event_id, s, max(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT *, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS s FROM events)) WHERE s < top")
def journal_transitions(spark, sf):
    s = F.when(C("event_type") == "view", 0).when(C("event_type") == "click", 1).otherwise(2)
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table_of(spark, sf, "events").withColumn("s", s).withColumn("top", F.max("s").over(w)).where("s < top").select("event_id")
