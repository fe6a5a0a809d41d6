"""Objects, passages by meaning, and what a reader's workspace shows, over the bundled tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import fusion as X
from ..operators import ingest as I
from ..operators import lexical as L
from ..operators import objects as O
from ..operators import relations as R
from ..operators import workspace as W
from ..sources import tables as S
from . import column_query, query, table_of
from .retrieval import FRAGMENTS, hashed_sql

C = F.col


@query("op_agg2_chapter_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def chapter_counts(spark, sf):
    parent, child = table_of(spark, sf, "customer").select("c_custkey"), table_of(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.counts(parent, child, "c_custkey", n=F.count(F.lit(1)))


@query("op_agg3_rows_per_chapter", "SELECT nullif(turn % 4, 3) AS chapter_id, count(*) AS n FROM conversations WHERE turn % 4 <> 3 GROUP BY 1")
def rows_per_chapter(spark, sf):
    t = table_of(spark, sf, "conversations").withColumn("chapter_id", F.nullif(C("turn") % 4, F.lit(3)))
    return W.rows_per(t, "chapter_id", "turn")


@query("op_set5_sync_status", "SELECT count(a.k) AS source, count(b.k) AS indexed, count(*) FILTER (b.k IS NULL) AS missing, count(*) FILTER (a.k IS NULL) AS orphan, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND a.v IS DISTINCT FROM b.v) AS stale, 'source_drift' AS state FROM (SELECT doc_id AS k, quality AS v FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT vec_id // 2 AS k, max_by(label % 2, vec_id) AS v FROM embeddings GROUP BY 1) b ON a.k = b.k")
def sync_status(spark, sf):
    source = table_of(spark, sf, "labels").where("doc_id % 5 <> 0").select(C("doc_id").alias("source_id"), C("quality").alias("v"), C("doc_id").alias("at"))
    half = F.floor(C("vec_id") / 2)
    index = table_of(spark, sf, "embeddings").select(F.when(half % 2 == 0, half).alias("source_id"), half.alias("vector_id"), (C("label") % 2).alias("v"), C("vec_id").alias("at"))
    return R.sync_status(source, index, ["v"], "at")


WORDS = "list_filter(list_transform(string_split(text, ' '), lambda x: trim(x)), lambda x: x <> '')"


@query("op_dup7_ordered_unique", f"SELECT conv_id, turn, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), ' ') AS ids, len(ws) - len(list_distinct(ws)) AS repeated FROM (SELECT conv_id, turn, {WORDS} AS ws FROM conversations)")
def ordered_unique(spark, sf):
    u = R.ordered_unique(F.split("text", " "))
    return table_of(spark, sf, "conversations").select("conv_id", "turn", u.alias("u")).select("conv_id", "turn", F.array_join("u.ids", " ").alias("ids"), C("u.repeated").cast("long").alias("repeated"))


column_query("op_fil12_product", "events", "event_id", lambda: W.is_product(F.when(C("event_type") == "view", "pdf_chunk").otherwise("zotero_child_note"), F.when(C("user_id") % 3 == 0, "synthetic_seed").when(C("user_id") % 3 == 1, "user")), "event_type = 'view' OR user_id % 3 <> 0")


@query("op_ret21_reranked", f"SELECT event_id, 'heuristic' AS mode, false AS external_called, NULL::VARCHAR AS degraded_reason FROM (SELECT * FROM events ORDER BY user_id DESC, event_id LIMIT 40) UNION ALL SELECT event_id, 'external', false, 'external rerank is disabled' FROM (SELECT * FROM events ORDER BY event_id LIMIT 40)")
def reranked(spark, sf):
    e = table_of(spark, sf, "events").select("event_id", "user_id")
    by = [X.reranked(e, mode, "event_id", "event_id", C("user_id")).limit(40) for mode in ("heuristic", "external")]
    return by[0].unionByName(by[1]).drop("user_id")


@query("op_udf3_reranker", "SELECT event_id FROM events ORDER BY event_id % 97 DESC, event_id LIMIT 30")
def reranker(spark, sf):
    @F.pandas_udf("double")
    def model(x: pd.Series) -> pd.Series:
        return (x % 97).astype("float64")

    e = table_of(spark, sf, "events").select("event_id")
    return X.reranked(e, "heuristic", "event_id", "event_id", model("event_id")).limit(30).select("event_id")


def nearness_sql(key, rows, query_text):
    """Rows with the cosine of their hash embedding and a query's; the query is row -1 of what is embedded."""
    both = f"(SELECT {key}, text FROM {rows} UNION ALL SELECT -1, '{query_text}')"
    return f"SELECT a.{key}, round(sum(a.x * b.x) / any_value(za.z * zb.z), 6) AS score FROM s a JOIN z za USING ({key}) JOIN s b ON b.slot = a.slot AND b.{key} = -1 JOIN z zb ON zb.{key} = -1 WHERE a.{key} <> -1 GROUP BY 1", hashed_sql(key, both).removeprefix("WITH ")


PASSAGE_SQL, PASSAGE_CTE = nearness_sql("row_id", "p", "the of and de la")
READ = "CASE lang WHEN 'en' THEN 'read' WHEN 'de' THEN 'mastered' ELSE 'unread' END"
PASSAGE_ROWS = f"{FRAGMENTS.split(',' + chr(10) + 'post AS')[0]}, p AS (SELECT row_id, title || ' ' || section || ' ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM f WHERE section IN ('en', 'de') AND NOT starts_with(lower(text), 'backend:'))"


@query("op_ret28_semantic_passages", f"WITH {PASSAGE_ROWS}, {PASSAGE_CTE}, n AS ({PASSAGE_SQL}) SELECT row_id AS chunk_id, score FROM n ORDER BY score DESC, chunk_id LIMIT 20")
def semantic_passages(spark, sf):
    d = table_of(spark, sf, "documents")
    status = F.when(C("lang") == "en", "read").when(C("lang") == "de", "mastered").otherwise("unread")
    chunks = I.chunks(S.spread(d, "doc_id")).select(L.row_id(C("doc_id"), C("chunk_index")).alias("chunk_id"), C("doc_id").alias("document_id"), C("lang").alias("heading"), "chunk_text")
    return O.semantic_passages(d.select(C("doc_id").alias("document_id"), C("source").alias("title"), status.alias("read_status")), chunks, " the of and  de la ", 20).select("chunk_id", "score")


@query("op_udf4_query_encoder", "SELECT page_id, round(list_cosine_similarity([length(url) + 1.0, 2.0], [4.0, 2.0]), 6) AS score FROM pages")
def query_encoder(spark, sf):
    encode = lambda df, key, text: df.select(key, F.array(F.length(text) + F.lit(1.0), F.lit(2.0)).alias("vector"))
    return O.by_meaning(table_of(spark, sf, "pages"), "page_id", "url", "abc", encode).select("page_id", "score")


OBJECT_SQL, OBJECT_CTE = nearness_sql("p_partkey", "pr", "small ring")
PARTS = "(SELECT p_partkey, p_name, p_type, p_name || ' ' || p_type || ' ' || p_brand AS text FROM part)"


def part_objects(spark, sf):
    """Parts as objects: their type is an alias."""
    p = table_of(spark, sf, "part")
    return p.select(C("p_partkey").alias("id"), F.concat(F.lit("k"), (C("p_partkey") % 500).cast("string")).alias("object_key"), C("p_name").alias("object_name"), C("p_brand").alias("object_type"), F.array("p_type").alias("aliases"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("profile"), F.lit(None).cast("string").alias("description"), (C("p_size") % 9).alias("evidence"), (C("p_size") % 4).alias("notes"), (C("p_size") > 45).alias("deprecated"), F.when(C("p_size") % 10 > 0, "candidate").otherwise("hidden").alias("status"))


@query("op_ret35_semantic_objects", f"WITH pr AS {PARTS}, {OBJECT_CTE}, n AS ({OBJECT_SQL} ORDER BY score DESC, 1 LIMIT 30) SELECT p_partkey AS id, score, lower(p_name) = 'small ring' OR lower(p_type) = 'small ring' AS exact FROM n JOIN part USING (p_partkey) ORDER BY exact DESC, score DESC, id LIMIT 25")
def semantic_objects(spark, sf):
    return O.semantic_objects(part_objects(spark, sf), "Small  ring", limit=25).select("id", "score", "exact")


FLAT = "regexp_replace(lower({}), '[\\s_-]+', '', 'g')"
SCORE = "round(least(1.0, greatest(0.0, CASE WHEN {q} IN ({n}, {a}) THEN 0.42 WHEN contains({n}, {q}) OR contains({a}, {q}) THEN 0.34 ELSE 0.14 END + 0.05 * least(p_size % 9, 5) + 0.03 * least(p_size % 4, 5) - CASE WHEN p_size > 45 THEN 0.3 ELSE 0 END)), 6)::DOUBLE".replace("{n}", FLAT.format("p_name")).replace("{a}", FLAT.format("p_type"))


@query("op_ret38_lexical_objects", f"SELECT object_key, id, score FROM (SELECT 'k' || p_partkey % 500 AS object_key, p_partkey AS id, {SCORE.format(q=chr(39) + 'smallring' + chr(39))} AS score, row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_partkey) AS r FROM part WHERE p_size % 10 > 0 AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'small') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring')) WHERE r = 1 ORDER BY score DESC, id LIMIT 20")
def lexical_objects(spark, sf):
    o = part_objects(spark, sf)
    return O.lexical_objects(o, "Small ring", o, 50).select("object_key", "id", "score")


@query("op_ret38_object_fallback", f"SELECT 'k' || p_partkey AS object_key, p_partkey AS id, {SCORE.format(q=chr(39) + 'economy/nothing' + chr(39))} AS score FROM part WHERE p_size % 9 > 0 AND contains(lower('k' || p_partkey || ' ' || p_name || ' ' || p_type), 'economy') ORDER BY score DESC, id LIMIT 10")
def object_fallback(spark, sf):
    o = part_objects(spark, sf)
    return O.lexical_objects(o, "economy/nothing", o.withColumn("object_key", F.concat(F.lit("k"), C("id").cast("string")))).select("object_key", "id", "score")


@query("op_ret41c_object_by_key", "SELECT 'k7' AS object_key, p_partkey AS id FROM part WHERE p_partkey % 500 = 7 AND p_size % 10 > 0 ORDER BY 2 LIMIT 1")
def object_by_key(spark, sf):
    o = part_objects(spark, sf)
    return O.object_by_key(o, o.where("id < 0"), " K7 ").select("object_key", "id")


@query("op_ret41b_objects_for_chunks", "SELECT object, chunk_id, max(points)::DOUBLE AS points FROM (SELECT o AS object, conv_id * 100 + turn AS chunk_id, 5.0 * contains(lower(text), a)::INT + 2.2 * contains(lower(role), a)::INT AS points FROM conversations, (VALUES ('x', 'the'), ('x', 'user'), ('y', 'de'), ('y', 'assist')) s(o, a)) WHERE points > 0 GROUP BY 1, 2")
def objects_for_chunks(spark, sf):
    t = S.spread(table_of(spark, sf, "conversations"), "conv_id", "turn").select(F.lit(1).alias("k"), (C("conv_id") * 100 + C("turn")).alias("chunk_id"), C("role").alias("heading"), F.lit("").alias("title"), F.lit("Other").alias("section"), "text")
    spec = spark.createDataFrame([(1, "x", ["the", "user"]), (1, "y", ["De", "assist"])], "k int, object string, aliases array<string>")
    return O.objects_for_chunks(spec, t, "k").select("object", "chunk_id", "points")


TYPES = "['pdf_chunk', 'zotero_highlight', 'zotero_annotation_comment', 'zotero_child_note', 'zotero_inspiration_note'][1 + turn % 5]"


@query("op_evd5_notebook_fragments", f"WITH c AS (SELECT conv_id * 100 + turn AS id, {TYPES} AS t, turn, text FROM conversations) SELECT a.id AS fragment_id, a.t AS source_type, CASE WHEN a.t = 'zotero_annotation_comment' THEN b.text END AS selected_text FROM c a LEFT JOIN c b ON b.id = a.id - 1 AND b.t = 'zotero_highlight' WHERE a.t IN ('zotero_annotation_comment', 'zotero_inspiration_note') AND a.turn % 3 <> 0")
def notebook_fragments(spark, sf):
    ident = C("conv_id") * 100 + C("turn")
    kinds = F.array(*map(F.lit, ("pdf_chunk", "zotero_highlight", "zotero_annotation_comment", "zotero_child_note", "zotero_inspiration_note")))
    t = table_of(spark, sf, "conversations").select(ident.alias("fragment_id"), (ident - 1).alias("parent_fragment_id"), F.element_at(kinds, (1 + C("turn") % 5).cast("int")).alias("source_type"), C("conv_id").alias("document_id"), F.when(C("turn") % 3 == 0, "synthetic_seed").alias("origin_kind"), "text")
    return W.notebook_fragments(t, ["zotero_annotation_comment", "zotero_inspiration_note"]).select("fragment_id", "source_type", "selected_text")


@query("op_lib2_document_detail", f"""WITH d AS (SELECT doc_id AS id, source FROM documents WHERE {READ} <> 'unread'),
h AS (SELECT conv_id AS id, string_agg(h, ',' ORDER BY o, h) AS headings FROM (SELECT conv_id, role || turn % 12 AS h, min(turn) AS o, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), role || turn % 12) AS r FROM conversations GROUP BY 1, 2) WHERE r <= 10 GROUP BY 1),
n AS (SELECT user_id AS id, count(*) AS c, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (r <= 10) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY 1),
t AS (SELECT user_id AS id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tags FROM events GROUP BY 1)
SELECT d.id AS document_id, coalesce((SELECT count(*) FROM conversations WHERE conv_id = d.id), 0) AS chunk_count, coalesce(n.c, 0) AS note_count, coalesce(tags, '') AS tags, coalesce(headings, '') AS headings, coalesce(n.ids, '') AS note_ids FROM d LEFT JOIN h USING (id) LEFT JOIN n USING (id) LEFT JOIN t USING (id)""")
def document_detail(spark, sf):
    status = F.when(C("lang") == "en", "read").when(C("lang") == "de", "mastered").otherwise("unread")
    d = table_of(spark, sf, "documents").select(C("doc_id").alias("document_id"), status.alias("read_status"))
    chunks = table_of(spark, sf, "conversations").select(C("conv_id").alias("document_id"), C("turn").alias("chunk_index"), F.concat("role", (C("turn") % 12).cast("string")).alias("heading"))
    e = table_of(spark, sf, "events").select(C("user_id").alias("document_id"), C("event_id").alias("note_id"), C("event_type").alias("tag"), C("event_id").alias("relation_id"))
    out = W.document_detail(d, chunks, e.select("document_id", "note_id"), e.select("document_id", "tag"), e.select("document_id", "relation_id"))
    text = lambda c: F.array_join(C(c).cast("array<string>"), ",").alias(c)
    return out.select("document_id", "chunk_count", "note_count", text("tags"), text("headings"), text("note_ids"))


LINE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query("op_lib4_chunk_preview", f"SELECT doc_id, n_name AS title, CASE WHEN length(l) <= 160 THEN l ELSE rtrim(l[:157]) || '...' END AS snippet, CASE WHEN doc_id % 4 = 0 THEN 'no_page' WHEN l = '' THEN 'no_text' WHEN doc_id % 3 <> 0 AND n_regionkey = 1 THEN 'pdf_missing' ELSE 'page_level_only' END AS locator_status FROM (SELECT *, {LINE} AS l FROM documents JOIN nation ON n_nationkey = doc_id % 30)")
def chunk_preview(spark, sf):
    chunks = table_of(spark, sf, "documents").select("doc_id", (C("doc_id") % 30).alias("document_id"), C("text").alias("chunk_text"), (C("doc_id") % 4).alias("page"), F.when(C("doc_id") % 3 == 0, "own.pdf").when(C("doc_id") % 3 == 1, "").alias("pdf_path"))
    d = table_of(spark, sf, "nation").select(C("n_nationkey").cast("long").alias("document_id"), C("n_name").alias("title"), F.when(C("n_regionkey") != 1, "its.pdf").alias("pdf_path"))
    return W.chunk_preview(chunks, d).select("doc_id", "title", "snippet", "locator_status")


@query("op_lib13_workspace_state", "SELECT p_partkey AS chapter_id, n_name AS document_title, n_regionkey > 0 OR n_nationkey % 2 = 0 AS pdf_available, p_size % 3 > 0 AS chunked, CASE WHEN p_size % 2 > 0 THEN 'available' ELSE 'empty' END AS notes_status, CASE WHEN p_size % 3 > 0 THEN 'available' ELSE 'unavailable' END AS passages FROM part JOIN nation ON n_nationkey = p_partkey % 30")
def workspace_state(spark, sf):
    d = table_of(spark, sf, "nation").select(C("n_nationkey").cast("long").alias("document_id"), C("n_name").alias("title"), F.when(C("n_regionkey") > 0, "a.pdf").alias("pdf_path"), F.when(C("n_nationkey") % 2 == 0, "b.md").otherwise("").alias("source_path"), F.lit(None).cast("string").alias("zotero_key"))
    chapters = table_of(spark, sf, "part").select((C("p_partkey") % 30).alias("document_id"), C("p_partkey").alias("chapter_id"), (C("p_size") % 3).alias("evidence_count"), (C("p_size") % 2).alias("note_count"), F.lit(None).cast("int").alias("user_note_count"))
    return W.workspace_state(d, chapters).select("chapter_id", "document_title", "pdf_available", "chunked", "notes_status", "passages")


CHANNELS = "[['keyword'], ['vector', 'vector'], ['note_link', 'tag'], ['keyword', 'vector', 'tag']][1 + event_id % 4]"


@query("op_res5_research_session", f"""WITH r AS (SELECT user_id, event_id % 7 <> 0 AS keep, {CHANNELS} AS ch, event_id % 2 AS tm, event_id % 3 AS rel, event_id % 5 AS notes, value AS score, event_id % 6 <> 0 AS backed FROM events),
g AS (SELECT *, len(list_distinct(ch)) = 1 AS single, score >= 3 AND len(list_distinct(ch)) > 1 AND ((list_contains(ch, 'note_link')) OR (notes > 0 AND (rel > 0 OR list_contains(ch, 'tag'))) OR len(list_distinct(ch)) >= 3) AS good FROM r),
s AS (SELECT user_id, count(*) FILTER (keep) AS n, count(*) FILTER (keep AND good) AS high, count(*) FILTER (keep AND backed) AS ev, count(*) FILTER (keep AND (tm > 0 OR rel > 0 OR list_contains(ch, 'tag'))) AS sup, count(*) FILTER (keep AND single) AS one, count(*) FILTER (keep AND notes > 0) AS nn, count(*) FILTER (keep AND rel > 0) AS nr, count(*) FILTER (NOT keep) AS ex FROM g GROUP BY 1),
b AS (SELECT *, array_to_string(list_filter([CASE WHEN n = 0 THEN 'no_results' END, CASE WHEN ev = 0 THEN 'no_evidence' END, CASE WHEN n > 0 AND high = 0 THEN 'no_high_confidence' END, CASE WHEN n > 0 AND one = n THEN 'single_channel' END], lambda x: x IS NOT NULL), ',') AS blocking, array_to_string(list_filter([CASE WHEN nn = 0 THEN 'no_notes' END, CASE WHEN nr = 0 THEN 'no_relations' END], lambda x: x IS NOT NULL), ',') AS warning FROM s)
SELECT user_id, n AS total_results, high AS high_confidence, ev AS evidence_backed, sup AS supported, ex AS excluded, blocking, warning, blocking = '' AS ready FROM b""")
def research_session(spark, sf):
    kinds = F.array(*[F.array(*map(F.lit, k)) for k in (["keyword"], ["vector", "vector"], ["note_link", "tag"], ["keyword", "vector", "tag"])])
    n = C("event_id")
    e = table_of(spark, sf, "events").select("user_id", F.when(n % 7 == 0, "only a demo").otherwise("measured").alias("text"), F.element_at(kinds, (1 + n % 4).cast("int")).alias("channels"), (n % 2).alias("tag_matches"), (n % 3).alias("relations"), (n % 5).alias("notes"), F.array().cast("array<string>").alias("tags"), C("value").alias("score"), F.when(n % 6 != 0, n).alias("chunk_id"))
    return W.research_session(e, ["user_id"])


def session_queue(spark, sf):
    p, d = table_of(spark, sf, "part"), table_of(spark, sf, "documents")
    key = C("p_partkey").cast("string")
    mappings = d.select(C("source").alias("raw"), F.when(C("lang") != "de", F.concat("lang", F.lit("_tags"))).alias("target_bucket"), F.lit("suggested").alias("mapping_status"), (C("lang") == "fr").alias("needs_review"), F.lit("by language").alias("reason"))
    candidates = p.where("p_size > 40").select(key.alias("candidate_id"), C("p_name").alias("title"), (C("p_size") % 2 == 0).alias("speculation"), F.when(C("p_size") % 3 == 0, "weak").otherwise("strong").alias("strength"), F.when(C("p_size") % 5 == 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("unsupported"))
    hypotheses = p.where("p_size BETWEEN 30 AND 33").select(F.concat(F.lit("h"), key).alias("hypothesis_id"), C("p_name").alias("claim"), F.lit(False).alias("speculation"), F.array(F.concat(F.lit(" "), "p_brand"), C("p_type")).alias("unsupported"))
    critics = p.where("p_size < 3").select(key.alias("candidate_id"), F.lit("high").alias("novelty_risk"), F.when(C("p_size") == 1, "weak").alias("strength"), F.lit(None).cast("string").alias("downgrade"))
    plans = p.where("p_size = 10").select(key.alias("candidate_id"), C("p_type").alias("baseline"), F.when(C("p_partkey") % 2 == 0, C("p_brand")).alias("dataset"), F.lit("must be selected later").alias("metric"))
    types = table_of(spark, sf, "events").select("event_type").distinct()
    gaps = types.select(F.explode(F.array(F.lit("evidence_view"), F.lit("mechanism_view"), F.lit("inspiration_path_view"))).alias("view"), F.concat(F.lit("no mechanism of "), "event_type").alias("gap"))
    evidence = d.select(C("doc_id").cast("string").alias("evidence_id"), "doc_id", F.when(C("doc_id") % 3 > 0, C("source")).alias("document_title")).select("evidence_id", C("doc_id").alias("document_id"), "document_title", C("doc_id").alias("chunk_id"), F.lit("h").alias("heading_path"), F.lit("p").alias("pdf_path"))
    return W.review_queue(mappings, candidates, hypotheses, critics, plans, gaps, evidence)


QUEUE_SQL = """WITH m AS (SELECT DISTINCT source AS raw, CASE WHEN lang <> 'de' THEN lang || '_tags' END AS b, lang = 'fr' AS need FROM documents),
cl AS (SELECT trim(claim) AS claim, min((k, id)) AS f FROM (SELECT 0 AS k, p_partkey::VARCHAR AS id, p_type AS claim FROM part WHERE p_size > 40 AND p_size % 5 = 0 UNION ALL SELECT 1, 'h' || p_partkey, unnest([p_brand, p_type]) FROM part WHERE p_size BETWEEN 30 AND 33) GROUP BY 1),
ty AS (SELECT DISTINCT 'no mechanism of ' || event_type AS g FROM events),
q AS (SELECT 'suggested_tag_mapping' AS item_type, raw AS source_id, raw || ' → ' || coalesce(b, 'unmapped') || ' as suggested' AS summary, CASE WHEN b IS NULL THEN 'high' ELSE 'medium' END AS priority, CASE WHEN b IS NULL OR need THEN 'needs_human_review' ELSE '' END AS flags FROM m
UNION ALL SELECT 'draft_candidate_method', p_partkey::VARCHAR, p_name, 'high', array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'speculation' END, CASE WHEN p_size % 3 = 0 THEN 'weak_evidence' END, CASE WHEN p_size % 5 = 0 THEN 'unsupported_claims' END], lambda x: x IS NOT NULL), ',') FROM part WHERE p_size > 40
UNION ALL SELECT 'draft_hypothesis', 'h' || p_partkey, p_name, 'high', 'unsupported_claims' FROM part WHERE p_size BETWEEN 30 AND 33
UNION ALL SELECT 'critic_entry', p_partkey::VARCHAR, 'Novelty risk: high, evidence: ' || CASE WHEN p_size = 1 THEN 'weak' ELSE 'None' END || ', ', 'medium', CASE WHEN p_size = 1 THEN 'weak_evidence,downgrade_reason' ELSE '' END FROM part WHERE p_size < 3
UNION ALL SELECT 'experiment_plan', p_partkey::VARCHAR, 'Baseline: ' || p_type || ', Dataset: ' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'None' END, 'medium', CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'dataset_focus_missing,' END || 'metric_focus_missing' FROM part WHERE p_size = 10
UNION ALL SELECT 'unsupported_claim', f[2] || ':' || claim, claim, 'medium', 'unsupported,speculation' FROM cl
UNION ALL SELECT 'evidence_gap', g, g, 'low', 'needs_human_review' FROM ty UNION ALL SELECT 'missing_mechanism', g, g, 'low', 'mechanism_view_empty' FROM ty
UNION ALL SELECT 'source_trace_gap', 'missing_document_title:' || doc_id, 'missing source_trace.document_title for ' || doc_id, 'low', 'source_trace_incomplete' FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT 'unmapped_tag', 'unmapped:' || raw, 'Unmapped tag: ' || raw || ' — by language', 'low', 'needs_human_review' FROM m WHERE b IS NULL)"""


@query("op_res12_review_queue", f"{QUEUE_SQL} SELECT * FROM q")
def review_queue(spark, sf):
    return session_queue(spark, sf).select("item_type", "source_id", "summary", "priority", F.array_join("risk_flags", ",").alias("flags"))


@query("op_res12_queue_summary", QUEUE_SQL + " SELECT count(*) AS total_items, count(*) AS pending_count" + "".join(f", count(*) FILTER (item_type = '{t}') AS {n}_count" for t, n in (("draft_candidate_method", "draft_candidate"), ("draft_hypothesis", "draft_hypothesis"), ("critic_entry", "critic"), ("experiment_plan", "experiment_plan"), ("unsupported_claim", "unsupported_claim"))) + ", count(*) FILTER (item_type IN ('evidence_gap', 'source_trace_gap', 'unmapped_tag', 'missing_mechanism', 'missing_inspiration')) AS unresolved_gap_count FROM q")
def queue_summary(spark, sf):
    return W.queue_summary(session_queue(spark, sf))


ITEM = "[NULL, 'book', ' thesis ', 'preprint', 'webpage', ''][1 + p_partkey % 6]"


@query("op_ing19_document_class", f"""WITH r AS (SELECT p_partkey, p_size * 4 AS pages, p_size % 3 = 0 AS outline, p_size % 7 AS chapters, p_size % 5 = 0 AS paper_like, trim({ITEM}) AS t, CASE WHEN p_partkey % 12 = 0 THEN '978' ELSE '' END AS isbn, CASE WHEN p_partkey % 4 = 1 THEN 'A Dissertation' ELSE p_name END AS title FROM part),
k AS (SELECT *, coalesce(t, '') <> '' AS typed, CASE WHEN coalesce(t, '') <> '' THEN CASE t WHEN 'preprint' THEN 'paper' WHEN 'webpage' THEN 'other' ELSE t END WHEN isbn <> '' THEN 'book' WHEN title LIKE '%Dissertation%' THEN 'thesis' WHEN pages <= 60 OR paper_like THEN 'paper' ELSE 'other' END AS kind FROM r),
s AS (SELECT *, CASE WHEN typed THEN CASE WHEN t = 'webpage' THEN 'medium' ELSE 'high' END WHEN kind = 'other' THEN 'low' ELSE 'medium' END AS sure FROM k)
SELECT p_partkey, kind AS document_type, CASE WHEN chapters >= 5 THEN 'chaptered' WHEN paper_like AND pages <= 60 THEN 'full_document' WHEN (typed AND kind IN ('book', 'thesis', 'report')) OR (pages BETWEEN 61 AND 119 AND outline) OR pages >= 120 THEN 'chaptered' ELSE 'full_document' END AS object_import_mode,
CASE WHEN chapters >= 5 THEN 'high' WHEN pages BETWEEN 61 AND 119 THEN CASE WHEN outline THEN 'medium' ELSE 'low' END WHEN pages >= 120 THEN CASE WHEN sure = 'high' OR outline THEN 'high' ELSE 'medium' END ELSE sure END AS confidence, pages > 60 OR sure = 'low' AS requires_user_confirmation FROM s""")
def document_class(spark, sf):
    n, size = C("p_partkey"), C("p_size")
    kinds = F.array(*map(F.lit, (None, "book", " thesis ", "preprint", "webpage", "")))
    made = I.document_class(F.element_at(kinds, (1 + n % 6).cast("int")), F.when(n % 12 == 0, "978").otherwise(""), F.lit(None).cast("string"), F.when(n % 4 == 1, "A Dissertation").otherwise(C("p_name")), size * 4, size % 5 == 0, size % 3 == 0, size % 7)
    return table_of(spark, sf, "part").select("p_partkey", made.alias("c")).select("p_partkey", "c.*")
