"""Index states, requests, note gates and shelf keys over the bundled tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import lexical as L
from ..operators import states as S
from ..sources import tables as T
from . import column_query, query, table_of

C = F.col
PAIR = "(SELECT doc_id, quality AS v, toxic AS w FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT vec_id AS doc_id, label % 2 AS v, 0 AS w FROM embeddings WHERE vec_id % 7 <> 0) b USING (doc_id)"
ACTION = "CASE WHEN b.v IS NULL THEN 'insert' WHEN a.v IS NULL THEN 'orphan' WHEN a.v = b.v AND a.w = b.w THEN 'skip' ELSE 'update' END"


def source_and_index(spark, sf):
    source = table_of(spark, sf, "labels").where("doc_id % 5 <> 0").select("doc_id", C("quality").alias("v"), C("toxic").alias("w"))
    return source, table_of(spark, sf, "embeddings").where("vec_id % 7 <> 0").select(C("vec_id").alias("doc_id"), (C("label") % 2).alias("v"), F.lit(0).alias("w"))


@query("op_set4_sync_actions", f"SELECT doc_id, {ACTION} AS action FROM {PAIR}")
def sync_actions(spark, sf):
    return S.sync_actions(*source_and_index(spark, sf), "doc_id", ["v", "w"])


@query("op_set3_sync_stats", f"WITH x AS (SELECT {ACTION} AS action FROM {PAIR}), y AS (SELECT count(*) FILTER (action <> 'orphan') AS scanned, count(*) FILTER (action = 'skip') AS skipped, count(*) FILTER (action = 'orphan') AS orphans, count(*) FILTER (action = 'insert') AS would_insert, count(*) FILTER (action = 'update') AS would_update FROM x) SELECT *, orphans AS would_delete, would_insert AS inserted, would_update AS updated, orphans AS deleted_orphans FROM y")
def sync_stats(spark, sf):
    return S.sync_stats(S.sync_actions(*source_and_index(spark, sf), "doc_id", ["v", "w"]), delete_orphans=True)


column_query(
    "op_stm2_gate", "events", "event_id", lambda: S.sync_gate(F.nullif(C("user_id") % 4, F.lit(3)), C("event_id") % 3, 3), "coalesce(nullif(user_id % 4, 3), 0) + event_id % 3 BETWEEN 1 AND 3"
)


@query("op_set7_fallback_reason", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_type = 'view' THEN event_type ELSE 'vector_store_unavailable' END WHEN event_id % 7 = 0 THEN 'old_manifest' WHEN event_id % 5 = 0 THEN 'vector_table_missing' WHEN user_id % 4 <> event_id % 4 OR value < 1 THEN 'vector_store_source_drift' END AS reason FROM events")
def fallback_reason(spark, sf):
    own = F.when(C("event_type") == "view", C("event_type")).when(C("event_type") == "click", "vector_manifest_missing")
    reason = S.fallback_reason(C("event_id") % 11 != 0, own, F.when(C("event_id") % 7 == 0, "old_manifest"), C("event_id") % 5 != 0, C("user_id") % 4, C("event_id") % 4, F.when(C("value") < 1, 1))
    return table_of(spark, sf, "events").select("event_id", reason.alias("reason"))


@query("op_set8_note_plan", """
    WITH c AS (SELECT conv_id * 100 + turn AS id, role, text AS h, length(text) AS s FROM conversations WHERE turn % 5 <> 4),
    p AS (SELECT conv_id * 100 + turn AS id, role, CASE WHEN conv_id % 3 = 0 THEN upper(text) ELSE text END AS h, length(text) + (conv_id % 2) AS s, turn % 4 <> 2 AS ok FROM conversations WHERE conv_id % 7 <> 0),
    j AS (SELECT coalesce(c.role, p.role) AS role, CASE WHEN p.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'removed' WHEN c.h IS NOT DISTINCT FROM p.h AND ok THEN 'reused' ELSE 'changed' END AS state, c.s IS DISTINCT FROM p.s AS differs FROM c FULL JOIN p USING (id))
    SELECT role, state, count(*) AS n, count(*) FILTER (state = 'reused' AND differs) AS metadata_only FROM j GROUP BY ALL""")
def note_plan(spark, sf):
    t = table_of(spark, sf, "conversations").select((C("conv_id") * 100 + C("turn")).alias("id"), "conv_id", "turn", "role", C("text").alias("h"), F.length("text").alias("s"))
    before = t.where("conv_id % 7 <> 0").withColumn("h", F.when(C("conv_id") % 3 == 0, F.upper("h")).otherwise(C("h"))).withColumn("s", C("s") + C("conv_id") % 2).withColumn("ok", C("turn") % 4 != 2)
    plan = S.note_plan(t.where("turn % 5 <> 4"), before, "id", "role", ["h"], ["s"], "ok")
    return plan.groupBy("role", "state").agg(F.count(F.lit(1)).alias("n"), F.count_if("metadata_only").alias("metadata_only"))


@query("op_set10_vector_states", """
    WITH e AS (SELECT DISTINCT user_id, event_id % 40 AS k FROM events WHERE event_type <> 'view'), i AS (SELECT user_id, event_id % 40 AS k, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY ALL)
    SELECT user_id, count(e.k) AS expected, count(i.k) AS indexed, count(*) FILTER (i.k IS NULL) AS missing, count(*) FILTER (e.k IS NULL) AS orphans, count(*) FILTER (n > 1) AS duplicates FROM e FULL JOIN i USING (user_id, k) GROUP BY user_id""")
def vector_states(spark, sf):
    e = table_of(spark, sf, "events").withColumn("k", C("event_id") % 40)
    return S.vector_states(e.where("event_type <> 'view'"), e.where("event_id % 3 <> 0"), "user_id", "k")


@query("op_int3_index_validation", "SELECT (SELECT count(*) FROM conversations) AS ordinary_count, (SELECT count(*) FROM documents) AS unicode_count, (SELECT count(*) FROM pages) AS trigram_count, (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids, false AS count_match, false AS valid")
def index_validation(spark, sf):
    others = {"unicode": table_of(spark, sf, "documents"), "trigram": table_of(spark, sf, "pages")}
    return S.index_validation(table_of(spark, sf, "conversations"), others, "conv_id", 7)


@query("op_fil9_request_warnings", "SELECT user_id, CASE WHEN c_custkey IS NULL THEN 'requested_document_not_found' ELSE 'requested_document_archived' END AS code FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN customer ON c_custkey = user_id WHERE c_custkey IS NULL OR c_mktsegment = 'BUILDING'")
def request_warnings(spark, sf):
    customers = table_of(spark, sf, "customer").select(C("c_custkey").alias("user_id"), F.when(C("c_mktsegment") == "BUILDING", "archived").alias("status"))
    return S.request_warnings(table_of(spark, sf, "events"), customers, "user_id", "status")


@query("op_top12_document_scope", "SELECT user_id, event_id, rank, total FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(nullif(event_id % 50, 7), 2147483647), event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE rank <= 6")
def document_scope(spark, sf):
    return S.scope_ids(table_of(spark, sf, "events").withColumn("at", F.nullif(C("event_id") % 50, F.lit(7))), "user_id", "at", "event_id", 6)


@query("op_agg19_distinct_children", "SELECT count(DISTINCT l_suppkey) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def distinct_children(spark, sf):
    parents = table_of(spark, sf, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    return S.distinct_children(table_of(spark, sf, "lineitem"), parents, "l_orderkey", "l_suppkey")


PLAIN = r"regexp_replace(lower(coalesce({}, '')), '[^\pL\pN_]+', '', 'g')"
column_query("op_fil15_matches_fields", "customer", "c_custkey", lambda: S.matches_fields(" Customer#00000001", [C("c_mktsegment"), C("c_name")]), f"contains({PLAIN.format('c_name')}, 'customer00000001') OR contains({PLAIN.format('c_mktsegment')}, 'customer00000001')")

TERMS = "list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z0-9]{3,}'), flatten(list_transform(regexp_extract_all(lower(text), '[\\x{3400}-\\x{9fff}]{2,}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))))"
column_query(
    "op_fil11_note_relevance", "conversations", "conv_id, turn",
    lambda: S.note_relevant("How do I sort the list of words?", C("text"), (C("turn") % 5 - 1) / 2.0, C("conv_id") % 10 / 10.0),
    f"turn % 5 >= 1 AND (len(list_intersect({TERMS}, ['how', 'sort', 'the', 'list', 'words'])) >= 2 OR ((turn % 5 - 1) / 2.0 >= 0.5 AND (conv_id % 10) / 10.0 >= 0.65))",
)


@query("op_dup3_note_identity", "SELECT conv_id, turn, role, low FROM (SELECT *, lower(trim(text)) AS low, row_number() OVER (PARTITION BY role, lower(trim(text)) ORDER BY conv_id, turn) AS k FROM conversations) WHERE k = 1")
def note_identity(spark, sf):
    t = table_of(spark, sf, "conversations").select("conv_id", "turn", "role", F.lower(F.trim("text")).alias("low"))
    return S.best_of_identity(t.withColumn("rank", F.struct("conv_id", "turn")), ["role", "low"], "rank").drop("rank")


column_query(
    "op_dup8_shelf_key", "events", "event_id",
    lambda: S.shelf_key(F.when(C("event_id") % 5 != 0, F.concat(F.lit("  The  "), C("event_type"), F.lit(" "))), F.when(C("user_id") % 2 == 0, F.concat(F.lit("C:\\A\\"), C("user_id").cast("string"))), F.when(C("event_id") % 3 != 0, F.lit(" KEY1 "))),
    "CASE WHEN event_id % 5 <> 0 AND user_id % 2 = 0 THEN 'title_pdf:the ' || lower(event_type) || '|c:/a/' || user_id WHEN event_id % 5 <> 0 AND event_id % 3 <> 0 THEN 'title_zotero:the ' || lower(event_type) || '|key1' END",
)

column_query("op_ret37_exact_name", "customer", "c_custkey", lambda: S.exact_name(" customer 00000_0007", F.array(F.lower("c_mktsegment"), F.replace("c_name", F.lit("#"), F.lit("-")))), "c_name = 'Customer#000000007'")

KINDS = ["pdf_chunk", "zotero_highlight", "zotero_annotation_comment", "zotero_child_note", "zotero_inspiration_note", "personal_note", "markdown_note", "other"]
column_query(
    "op_ret11_source_points", "events", "event_id", lambda: L.source_points(F.element_at(F.array(*[F.lit(k) for k in KINDS]), (C("event_id") % 8 + 1).cast("int"))),
    "[0.0, 0.45 + 0.35, 0.55 + 0.35, 0.35 + 0.35, 0.45 + 0.35, 0.35 + 0.35, 0.25 + 0.35, 0.0][event_id % 8 + 1]::DOUBLE",
)


@query("op_snk1_vector_lines", "SELECT vec_id, label, len(embedding) AS n, embedding[1]::DOUBLE AS first FROM embeddings")
def vector_lines(spark, sf):
    path = f"{T.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    T.write_jsonl(table_of(spark, sf, "embeddings"), path)
    read = T.jsonl(spark, path, "vec_id long, embedding array<float>, label int")
    return read.select("vec_id", "label", F.size("embedding").alias("n"), F.element_at("embedding", 1).cast("double").alias("first"))


@query("op_gen2_generation", "SELECT doc_id, quality FROM labels")
def generation(spark, sf):
    root = f"{T.shared_folder(spark)}/labels-{uuid.uuid4().hex}"
    labels = table_of(spark, sf, "labels").select("doc_id", "quality")
    T.publish(spark, root, {"labels": labels.limit(0)}, "first")
    T.publish(spark, root, {"labels": labels}, "second")
    return T.generation(spark, root, "labels")
