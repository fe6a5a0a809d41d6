"""AGG, WIN and DUP counts over the bundled tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranges as G
from ..operators import relations as R
from . import query, table_of

C = F.col


def _lines(spark, sf):
    return table_of(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")


@query("op_agg1_counts", "SELECT o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 25 GROUP BY 1")
def counts(spark, sf):
    return R.counts(table_of(spark, sf, "orders").select("o_orderkey"), _lines(spark, sf).where("l_quantity > 25"), "o_orderkey", n=F.count(F.lit(1)))


@query("op_agg4_distinct_counts", "SELECT o_orderkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def distinct_counts(spark, sf):
    return R.counts(table_of(spark, sf, "orders").select("o_orderkey"), _lines(spark, sf), "o_orderkey", parts=F.count_distinct("l_partkey"), suppliers=F.count_distinct("l_suppkey"))


@query("op_agg5_counts_limited", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
def counts_limited(spark, sf):
    o = table_of(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.counts(table_of(spark, sf, "customer").select("c_custkey"), o, "c_custkey", n=F.count(F.lit(1))).orderBy(F.desc("n"), "c_custkey").limit(20)


@query("op_agg6_by_kind", "SELECT k AS lang, coalesce(n, 0) AS n FROM (SELECT unnest(['de', 'en', 'xx']) AS k) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ON lang = k")
def by_kind(spark, sf):
    return R.by_kind(table_of(spark, sf, "documents"), "lang", ["de", "en", "xx"])


@query("op_agg7_repeated", "SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated(spark, sf):
    return R.repeated(table_of(spark, sf, "documents").select(F.sha2("text", 256).alias("h")), "h")


@query("op_agg8_coverage", "SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS sources, count(*) FILTER (lang = 'en') AS en FROM documents")
def coverage(spark, sf):
    return table_of(spark, sf, "documents").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("sources"), F.count_if(C("lang") == "en").alias("en"))


def _passages(spark, sf):
    tier = F.when(C("event_type") == "view", "reference").when(C("value") > 1, "primary").otherwise("secondary")
    return table_of(spark, sf, "events").select("user_id", "event_id", tier.alias("tier"), F.round("value", 4).alias("score"))


PASSAGES = "(SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN 'reference' WHEN value > 1 THEN 'primary' ELSE 'secondary' END AS tier, round(value, 4) AS score FROM events)"


@query("op_agg9_grouped_passages", f"SELECT user_id, max(score) AS max_score, count(*) FILTER (tier = 'primary') AS n_primary, count(*) FILTER (tier = 'secondary') AS n_secondary, coalesce(max(score) FILTER (tier = 'primary'), max(score) FILTER (tier = 'secondary')) AS best_score, string_agg(event_id::VARCHAR, ' ' ORDER BY r) FILTER (r <= 3) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS r FROM {PASSAGES}) GROUP BY user_id")
def grouped_passages(spark, sf):
    return R.grouped_passages(_passages(spark, sf), "user_id", "tier", "score", "event_id").withColumn("top", F.array_join(C("top").cast("array<string>"), " "))


@query("op_agg10_tier_counts", f"SELECT tier, count(*) AS n FROM {PASSAGES} GROUP BY tier")
def tier_counts(spark, sf):
    return _passages(spark, sf).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("op_agg11_group_relevance", f"SELECT user_id, round(least(1.0, 0.72 * max(score) + 0.18 * avg(score)), 6) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS r FROM {PASSAGES}) WHERE r <= 3 GROUP BY user_id")
def group_relevance(spark, sf):
    return R.group_relevance(_passages(spark, sf), "user_id", "score", "event_id").withColumn("relevance", F.round("relevance", 6))


@query("op_agg13_summary", "SELECT event_type, count(value) AS n, min(value) AS least, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def summary(spark, sf):
    return R.summary(table_of(spark, sf, "events"), "value", ["event_type"])


@query("op_agg15_duplicate_groups", "SELECT doc_id, n, CASE WHEN n > 1 THEN min(doc_id) OVER (PARTITION BY text) ELSE doc_id END AS primary_id FROM (SELECT doc_id, text, count(*) OVER (PARTITION BY text) AS n FROM documents)")
def duplicate_groups(spark, sf):
    return R.duplicate_groups(table_of(spark, sf, "documents"), F.sha2("text", 256), "doc_id").select("doc_id", "n", "primary_id")


@query("op_agg16_quality_summary", "SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 0 AND toxic = 0) AS weak FROM labels")
def quality_summary(spark, sf):
    return table_of(spark, sf, "labels").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("quality") == 1).alias("good"), F.count_if(C("toxic") == 1).alias("toxic"), F.count_if((C("quality") == 0) & (C("toxic") == 0)).alias("weak"))


@query("op_agg17_source_counts", "SELECT 'documents' AS source, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages WHERE html <> '' UNION ALL SELECT 'conversations', count(*) FROM conversations")
def source_counts(spark, sf):
    one = lambda t, w="true": table_of(spark, sf, t).where(w).agg(F.lit(t).alias("source"), F.count(F.lit(1)).alias("n"))
    return one("documents").union(one("pages", "html <> ''")).union(one("conversations"))


@query("op_agg18_role_summary", "SELECT r.conv_id, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role <> 'user') AS others FROM conversations c JOIN (SELECT conv_id, min(turn) AS lo, max(turn) - 1 AS hi FROM conversations GROUP BY 1) r ON r.conv_id = c.conv_id AND turn BETWEEN lo AND hi GROUP BY 1")
def role_summary(spark, sf):
    t = table_of(spark, sf, "conversations").select("conv_id", "turn", "role")
    ranges = t.groupBy("conv_id").agg(F.min("turn").alias("lo"), (F.max("turn") - 1).alias("hi"))
    return G.held(t, ranges, "conv_id", "turn", "lo", "hi").groupBy("conv_id").agg(F.count_if(C("role") == "user").alias("users"), F.count_if(C("role") != "user").alias("others"))


@query("op_agg20_merged_candidates", "SELECT l_partkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ' ') AS suppliers, min_by(l_quantity, l_orderkey * 10 + l_linenumber)::DOUBLE AS quantity FROM lineitem GROUP BY 1")
def merged_candidates(spark, sf):
    # Numbers of lines come again: of equal ones the first in the table counts. As in SQL, a row without a number or quantity is passed over.
    number = C("l_orderkey") * 10 + C("l_linenumber")
    at = F.when(number.isNotNull() & C("l_quantity").isNotNull(), F.struct(number, "_metadata.file_path", "_metadata.row_index"))
    l = table_of(spark, sf, "lineitem").select("l_partkey", F.array("l_suppkey").alias("suppliers"), C("l_quantity").cast("double").alias("quantity"), at.alias("at"))
    return R.merged_candidates(l, "l_partkey", "at", ["suppliers"], ["quantity"]).withColumn("suppliers", F.array_join(C("suppliers").cast("array<string>"), " "))


@query("op_agg21_content_hash", "SELECT lang, sha256(concat_ws('|', count(*), sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT), sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT), sum(('0x' || substr(h, 31, 15))::BIGINT::HUGEINT), sum(('0x' || substr(h, 46, 15))::BIGINT::HUGEINT))) AS hash FROM (SELECT *, sha256(doc_id || '|' || n_chars) AS h FROM documents) GROUP BY lang")
def content_hash(spark, sf):
    return R.content_hash(table_of(spark, sf, "documents"), ["lang"], F.concat_ws("|", "doc_id", "n_chars"))


@query("op_agg22_document_tags", "SELECT doc_id, string_agg(tag, ' ' ORDER BY tag) AS tags FROM (SELECT doc_id, 'quality:' || quality AS tag FROM labels UNION SELECT doc_id, 'lang:' || lang FROM documents) GROUP BY doc_id")
def document_tags(spark, sf):
    a = table_of(spark, sf, "labels").select("doc_id", F.concat(F.lit("quality:"), "quality").alias("tag"))
    tags = a.union(table_of(spark, sf, "documents").select("doc_id", F.concat(F.lit("lang:"), "lang")))
    return tags.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("tags"))


@query("op_agg23_top_headings", "SELECT source, min(doc_id) AS first FROM documents GROUP BY source ORDER BY first, source LIMIT 10")
def top_headings(spark, sf):
    return R.top_values(table_of(spark, sf, "documents"), "source", "doc_id", 10)


@query("op_agg24_read_list", "SELECT s_suppkey, count(*) AS lines, count(DISTINCT l_partkey) AS parts FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1 ORDER BY 1 LIMIT 100")
def read_list(spark, sf):
    l = table_of(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    return R.counts(table_of(spark, sf, "supplier").select("s_suppkey"), l, "s_suppkey", lines=F.count(F.lit(1)), parts=F.count_distinct("l_partkey")).where("lines > 0").orderBy("s_suppkey").limit(100)


@query("op_win1_base_rank", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events")
def base_rank(spark, sf):
    return R.ranked(table_of(spark, sf, "events"), [F.desc("value"), C("event_id")], ["event_type"]).select("event_id", C("rank").cast("long").alias("rank"))


@query("op_win2_neighbour_context", "SELECT conv_id, turn, trim(right(lag(text) OVER w, 600)) AS context_before, trim(left(lead(text) OVER w, 600)) AS context_after, CASE (lag(text) OVER w IS NOT NULL)::INT + (lead(text) OVER w IS NOT NULL)::INT WHEN 2 THEN 'available' WHEN 1 THEN 'partial' ELSE 'no_source_context' END AS context_status FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_context(spark, sf):
    return R.neighbour_context(table_of(spark, sf, "conversations"), "conv_id", ["turn"], "text").select("conv_id", "turn", "context_before", "context_after", "context_status")


@query("op_win3_first_per_key", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def first_per_key(spark, sf):
    order = [F.desc(C("event_type") == "purchase"), F.desc("ts"), F.desc("event_id")]
    return R.top_per_group(table_of(spark, sf, "events"), "user_id", order, 1).select("user_id", "event_id")


@query("op_win5_section_neighbours", "WITH i AS (SELECT conv_id, turn, role, sum(CASE WHEN role IS NOT DISTINCT FROM prev AND turn > first THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations)) SELECT conv_id, turn, coalesce(len(list(turn) OVER (PARTITION BY conv_id, island ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)), 0) AS n FROM i")
def section_neighbours(spark, sf):
    out = R.section_neighbours(table_of(spark, sf, "conversations"), "conv_id", "turn", "role")
    return out.select("conv_id", "turn", F.size("before").cast("long").alias("n"))


@query("op_win7_best_runs", "WITH s AS (SELECT a.conv_id, a.turn AS start, count(*) AS n, round(sum(length(b.text) % 7 - 3), 6) AS total FROM conversations a JOIN conversations c ON c.conv_id = a.conv_id AND c.turn BETWEEN a.turn AND a.turn + 9 JOIN conversations b ON b.conv_id = a.conv_id AND b.turn BETWEEN a.turn AND c.turn GROUP BY a.conv_id, a.turn, c.turn) SELECT conv_id, start, n, total::DOUBLE AS total FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY total DESC, n, start) AS r FROM s) WHERE r = 1")
def best_runs(spark, sf):
    t = table_of(spark, sf, "conversations").select("conv_id", "turn", (F.length("text") % 7 - 3).cast("double").alias("s"))
    return R.best_runs(t, "conv_id", "turn", "s").select("conv_id", "start", C("n").cast("long").alias("n"), "total")


@query("op_win9_near_ties", "SELECT event_id, count(*) OVER (PARTITION BY user_id) > 1 AS ambiguous FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS best FROM events) WHERE value >= best - 0.05")
def near_ties(spark, sf):
    return R.near_ties(table_of(spark, sf, "events"), "user_id", "value").select("event_id", "ambiguous")


@query("op_win10_next_chapter", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey LIMIT 1")
def next_chapter(spark, sf):
    rank = F.when(C("o_orderstatus") == "P", 0).when(C("o_orderstatus") == "O", 1).otherwise(2)
    return table_of(spark, sf, "orders").orderBy(rank, "o_orderkey").limit(1).select("o_orderkey", "o_orderstatus")


@query("op_win11_running_ordinal", "SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 AS ordinal FROM documents")
def running_ordinal(spark, sf):
    return R.ranked(table_of(spark, sf, "documents"), [C("doc_id")], ["source", "lang"], "r").select("doc_id", (C("r") - 1).cast("long").alias("ordinal"))


@query("op_top3_page", "SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 20 OFFSET 40")
def page(spark, sf):
    return R.page_of(table_of(spark, sf, "events"), [F.desc("value"), C("event_id")], 40, 20).select("event_id")


@query("op_top7_top_per_group", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 5 AND user_id IN (SELECT user_id FROM events GROUP BY 1 ORDER BY max(value) DESC, 1 LIMIT 5)")
def top_groups(spark, sf):
    return R.top_per_group(table_of(spark, sf, "events"), "user_id", [F.desc("value"), C("event_id")], 5, [F.max("value")], 5).select("user_id", "event_id")


@query("op_top8_typed_concat", "SELECT type, id FROM (SELECT 'document' AS type, 0 AS t, doc_id AS id FROM documents WHERE n_chars > 15000 UNION ALL SELECT 'page', 1, page_id FROM pages) ORDER BY t, id LIMIT 60")
def typed_concat(spark, sf):
    return R.typed_concat([("document", table_of(spark, sf, "documents").where("n_chars > 15000").select(C("doc_id").alias("id"))), ("page", table_of(spark, sf, "pages").select(C("page_id").alias("id")))], "id", 60).select("type", "id")


@query("op_top9_merged_home", "SELECT kind, id FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate::DATE AS d FROM orders UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, l_shipdate::DATE FROM lineitem) ORDER BY d DESC, kind, id LIMIT 50")
def merged_home(spark, sf):
    o = table_of(spark, sf, "orders").select(F.lit("order").alias("kind"), C("o_orderkey").alias("id"), C("o_orderdate").cast("date").alias("d"))
    l = table_of(spark, sf, "lineitem").select(F.lit("line").alias("kind"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("id"), C("l_shipdate").cast("date").alias("d"))
    return o.union(l).orderBy(F.desc("d"), "kind", "id").limit(50).select("kind", "id")


@query("op_top10_topped_up", "SELECT doc_id, min(p) AS priority FROM (SELECT doc_id, 0 AS p FROM documents WHERE contains(text, 'the ed') UNION ALL SELECT doc_id, 1 FROM documents WHERE contains(text, ' ed ')) GROUP BY 1 ORDER BY 2, 1 LIMIT 40")
def topped_up(spark, sf):
    d = table_of(spark, sf, "documents")
    hits = d.where(C("text").contains("the ed")).select("doc_id", F.lit(0).alias("priority")).union(d.where(C("text").contains(" ed ")).select("doc_id", F.lit(1)))
    return R.topped_up(hits, "doc_id", "priority", 40)


@query("op_top11_interleaved", "SELECT user_id, s.r AS rank, s.v AS event_type FROM (SELECT user_id, min({'r': r, 'v': event_type}) AS s FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) AS r FROM (SELECT event_type, user_id, max(value) AS value FROM events GROUP BY 1, 2)) GROUP BY user_id) ORDER BY 2, 3 LIMIT 50")
def interleaved(spark, sf):
    e = table_of(spark, sf, "events").groupBy("event_type", "user_id").agg(F.max("value").alias("value"))
    return R.interleaved(e, "event_type", "value", "user_id", 50).select("user_id", C("rank").cast("long").alias("rank"), "event_type")


@query("op_top13_title_sort", "SELECT p_partkey FROM part ORDER BY lower(coalesce(p_name, '')), p_partkey LIMIT 50")
def title_sort(spark, sf):
    return table_of(spark, sf, "part").orderBy(F.lower(F.coalesce("p_name", F.lit(""))), "p_partkey").limit(50).select("p_partkey")


@query("op_top14_nulls_last", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN n_chars END AS page FROM documents) ORDER BY page NULLS LAST, doc_id LIMIT 900")
def nulls_last(spark, sf):
    page = F.when(C("doc_id") % 4 != 0, C("n_chars"))
    return table_of(spark, sf, "documents").orderBy(page.asc_nulls_last(), "doc_id").limit(900).select("doc_id")
