"""STR and MTH over documents, pages, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from . import column_query, query, table_of

C = F.col
D = ("documents", "doc_id")
NORM = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"

column_query("op_str1_normalize_for_search", *D, lambda: T.normalize_for_search(C("text")), NORM)
column_query("op_str2_compact_identifier", *D, lambda: T.compact_identifier(C("text")), f"replace({NORM}, ' ', '')")
column_query("op_str4_normalize_text", "pages", "page_id", lambda: T.normalize_text(C("html")), r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')")
column_query("op_str5_build_index_text", *D, lambda: T.build_index_text(C("source"), C("lang"), F.upper("lang"), F.lit(" ")), "source || chr(10) || lang")
column_query("op_str6_infer_language", *D, lambda: T.infer_language(C("text")), "CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\\s\\x00]') THEN NULL WHEN regexp_matches(text, '[\\x{3400}-\\x{9fff}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[\\x{3400}-\\x{9fff}]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'und' END")
column_query(
    "op_str7_html_to_text", "pages", "page_id", lambda: T.html_to_text(C("html")),
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<li[^>]*>', chr(10) || '- ', 'g'), '(?i)</?(p|div|br|h[1-6]|ul|ol|table|tr|blockquote|section|article)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&nbsp;', ' '), '&amp;', '&'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')",
)
column_query("op_str8_parse_heading_path", *D, lambda: F.array_join(T.parse_heading_path(F.concat_ws(" > ", "source", "lang")), "|"), "source || '|' || lang")
column_query("op_str9_normalize_string_list", *D, lambda: F.array_join(T.normalize_string_list(F.concat_ws(";", "source", "lang", F.upper("source"))), "|"), "source || '|' || lang")
column_query("op_str10_sha256_text", *D, lambda: T.sha256_text(C("text")), "sha256(text)")
column_query("op_str11_canonical_locator", "pages", "page_id", lambda: T.canonical_locator(F.lit("page"), C("page_id"), F.lit("a b/c:d")), "'page:' || page_id || ':a%20b/c:d'")
column_query("op_str12_fragment_uuid", *D, lambda: F.length(T.uuid5(F.concat(F.lit("doc:"), C("doc_id").cast("string")))), "36")
column_query("op_str14_display_id", *D, lambda: T.display_id("PDF", C("doc_id"), C("n_chars"), C("source")), "'PDF-D' || doc_id || '-P' || n_chars")
column_query("op_str15_year_or_none", "orders", "o_orderkey", lambda: T.year_or_none(C("o_orderdate").cast("string")), "regexp_extract(o_orderdate::VARCHAR, '(19|20)\\d{2}', 0)::INTEGER")
column_query("op_str16_page_of_position", "events", "event_id", lambda: T.page_of_position(F.concat(F.lit('{"pageIndex": '), C("user_id").cast("string"), F.lit("}"))), "(user_id + 1)::INTEGER")
column_query("op_str17_make_snippet", *D, lambda: T.make_snippet(C("text"), F.lit("the "), 120), f"(SELECT CASE WHEN s > 1 THEN '…' ELSE '' END || substr(f, s, 120) || CASE WHEN s + 119 < length(f) THEN '…' ELSE '' END FROM (SELECT f, CASE WHEN strpos(lower(f), 'the ') > 0 THEN greatest(1, strpos(lower(f), 'the ') - 58) ELSE 1 END AS s FROM (SELECT {FLAT} AS f)))")
column_query("op_str18_best_snippet", *D, lambda: T.make_snippet(C("text"), F.lit("de "), 160, 60), f"(SELECT CASE WHEN s > 1 THEN '…' ELSE '' END || substr(f, s, 160) || CASE WHEN s + 159 < length(f) THEN '…' ELSE '' END FROM (SELECT f, CASE WHEN strpos(lower(f), 'de ') > 0 THEN greatest(1, strpos(lower(f), 'de ') - 60) ELSE 1 END AS s FROM (SELECT {FLAT} AS f)))")
column_query("op_str20_contains_folded", *D, lambda: T.contains_folded(C("text"), F.lit("THE %_A")), "contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the %_a')")
column_query("op_str21_open_url", "pages", "page_id", lambda: T.open_url(C("url"), C("page_id")), "'file:' || url || '#page=' || page_id")
column_query("op_str22_query_tokens", *D, lambda: F.size(T.query_tokens(C("text"))).cast("long"), "len(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9_\\-]+|[\\x{4e00}-\\x{9fff}]{2,}'), lambda t: length(t) >= 2)))")
column_query("op_str24_hash_tokens", *D, lambda: F.size(T.hash_tokens(C("text"))).cast("long"), "len(regexp_extract_all(lower(text), '[a-z0-9_]+'))")
column_query("op_str25_token_set", *D, lambda: F.array_join(F.array_sort(T.token_set(C("text"))), " "), "array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(lower(text), '[a-z0-9]{2,}|[\\x{4e00}-\\x{9fff}]{2,}'), flatten(list_transform(regexp_extract_all(lower(text), '[\\x{4e00}-\\x{9fff}]{4,}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))))), ' ')")
column_query("op_str28_normalize_match_text", *D, lambda: T.normalize_match_text(C("text")), f"lower({FLAT})")
column_query("op_str29_normalize_quote", *D, lambda: T.normalize_quote(C("text")), r"lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '-\s*\n\s*', '', 'g'), '\[\d+(\s*,\s*\d+)*\]', '', 'g'), '\s+', ' ', 'g')))")
column_query("op_str30_normalize_fingerprint", *D, lambda: T.normalize_fingerprint(C("text")), "trim(regexp_replace(lower(text), '[^a-z0-9\\x{4e00}-\\x{9fff}]+', ' ', 'g'))")
column_query("op_str31_selected_text_hash", *D, lambda: T.selected_text_hash(C("text")), f"'sha256:' || sha256({FLAT})")
column_query("op_str33_numbered_path", "nation", "n_nationkey", lambda: F.array_join(T.numbered_path(F.array(F.lit("1 Intro"), F.lit("2 Method"), F.concat(F.lit("2."), C("n_nationkey").cast("string"), F.lit(" Part")))), "|"), "'2 Method|2.' || n_nationkey || ' Part'")
column_query("op_str34_is_front_matter", "nation", "n_nationkey", lambda: T.is_front_matter(F.when(C("n_nationkey") % 2 == 0, " Abstract of it").otherwise("Results")), "n_nationkey % 2 = 0")
column_query("op_str35_is_metadata", *D, lambda: T.is_metadata(F.concat(F.when(C("doc_id") % 5 == 0, " - Backend: x ").when(C("doc_id") % 5 == 1, "Page_Count: 3 pages_with_text: 2\nheadings_detected: 4 ").when(C("doc_id") % 5 == 2, "see backend: x page_count: 3 ").otherwise(""), "text")), "doc_id % 5 IN (0, 1)")
column_query("op_str36_locator_contract", *D, lambda: T.locator_contract(C("text"), F.when(C("doc_id") % 3 > 0, C("doc_id") % 4), F.when(C("doc_id") % 5 > 0, C("source")), C("doc_id") % 7 == 0), "CASE WHEN doc_id % 7 = 0 THEN 'metadata_non_locatable' WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN 'no_page' WHEN trim(text) = '' OR text IS NULL THEN 'no_text' WHEN doc_id % 5 = 0 OR source IS NULL THEN 'pdf_missing' ELSE 'page_level_only' END")
column_query("op_str37_chunk_tokens", *D, lambda: F.array_join(T.chunk_tokens(C("text")), " "), r"array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(text), '\[\d+(,\s*\d+)*\]', ' ', 'g'), '[\p{L}\p{N}]+'), lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '\d{1,3}')), ' ')")
column_query("op_str40_is_test_record", "part", "p_partkey", lambda: T.is_test_record(F.concat(F.when(C("p_size") % 9 == 0, "Test ").otherwise(""), C("p_name")), [F.when(C("p_size") % 11 == 0, " Fixture").otherwise(C("p_brand"))], [F.when(C("p_size") % 13 == 0, "c:\\data\\Mock\\a.pdf").otherwise(C("p_type"))]), "p_size % 9 = 0 OR p_size % 11 = 0 OR p_size % 13 = 0")
column_query("op_str41_normalize_annotation", "benchmark", "item_id", lambda: T.normalize_annotation(C("text")), NORM)
column_query("op_str42_object_key", "part", "p_partkey", lambda: T.object_key(C("p_name")), "lower(trim(p_name))")
column_query("op_str43_citation", *D, lambda: T.citation("doc", C("doc_id"), C("source"), F.when(C("doc_id") % 2 == 0, C("n_chars"))), "'[doc:' || doc_id || '] ' || source || CASE WHEN doc_id % 2 = 0 THEN ', p. ' || n_chars ELSE '' END")
column_query("op_mth3_l2_normalize", "embeddings", "vec_id", lambda: F.round(F.aggregate(F.transform(V.l2_normalize(C("embedding")), F.abs), F.lit(0.0), lambda s, x: s + x), 6), "round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6)")
column_query("op_mth4_score_of_distance", "events", "event_id", lambda: V.score_of_distance(C("value")), "round(1 / (1 + greatest(0.0, value)), 6)")
column_query("op_mth5_relevance", "lineitem", "l_orderkey, l_linenumber", lambda: V.relevance_label(V.relevance(C("l_quantity").cast("double"))), "CASE WHEN l_quantity / 8 >= 0.65 THEN 'high' WHEN l_quantity / 8 >= 0.35 THEN 'medium' ELSE 'low' END")
column_query("op_mth6_clamp", "events", "event_id", lambda: V.clamp(C("value") - 1), "least(1.0, greatest(0.0, value - 1))")
column_query("op_mth7_distance_label", "events", "event_id", lambda: V.distance_label(C("value") % 2), "CASE WHEN value % 2 <= 0.70 THEN 'high' WHEN value % 2 <= 0.95 THEN 'medium' ELSE 'low' END")


@query("op_mth2_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    e = table_of(spark, sf_dir, "embeddings")
    after = e.select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.cosine(C("embedding"), C("other")), 9).alias("value"))


@query("op_mth1_cosine_of_units", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS value FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_of_units(spark, sf_dir):
    e = table_of(spark, sf_dir, "embeddings")
    after = e.select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(V.cosine_of_units(C("embedding"), C("other")), 9).alias("value"))


TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]{{2,}}'))"


@query("op_str27_overlap", f"SELECT a.item_id, round(len(list_intersect({TOKENS.format('a.text')}, {TOKENS.format('b.text')})) / least(len({TOKENS.format('a.text')}), len({TOKENS.format('b.text')})), 9) AS value FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1")
def overlap(spark, sf_dir):
    b = table_of(spark, sf_dir, "benchmark")
    after = b.select((C("item_id") - 1).alias("item_id"), C("text").alias("other"))
    return b.join(after, "item_id").select("item_id", F.round(T.overlap(T.token_set(C("text")), T.token_set(C("other"))), 9).alias("value"))


GRAMS = "list_distinct(list_transform(range(1, greatest(1, length({0}) - 1)), lambda i: substr({0}, i, 3)))"


@query("op_str26_char_ngram_overlap", f"WITH t AS (SELECT item_id, {GRAMS.format('s')} AS g FROM (SELECT item_id, regexp_replace(lower(text), '\\s+', '', 'g') AS s FROM benchmark)) SELECT a.item_id, round(len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)), 9) AS value FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def char_overlap(spark, sf_dir):
    b = table_of(spark, sf_dir, "benchmark")
    after = b.select((C("item_id") - 1).alias("item_id"), C("text").alias("other"))
    return b.join(after, "item_id").select("item_id", F.round(T.char_ngram_overlap(C("text"), C("other")), 9).alias("value"))


@query("op_str32_intersection_fraction", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 0 THEN greatest(0.0, least(l_quantity, 25.0)::DOUBLE) * 10 / (l_quantity::DOUBLE * 10) ELSE 0 END, 9) AS value FROM lineitem")
def rectangles(spark, sf_dir):
    q = C("l_quantity").cast("double")
    a, b = (F.lit(0.0), F.lit(0.0), q, F.lit(10.0)), (F.lit(0.0), F.lit(0.0), F.lit(25.0), F.lit(12.0))
    return table_of(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(T.intersection_fraction(a, b), 9).alias("value"))


@query("op_str38_aggregate_hash", "SELECT lang, sha256(string_agg(line, chr(10) ORDER BY line)) AS value FROM (SELECT lang, source || '/' || doc_id || '|' || sha256(text) AS line FROM documents) GROUP BY lang")
def aggregate_hash(spark, sf_dir):
    line = F.concat(C("source"), F.lit("/"), C("doc_id").cast("string"), F.lit("|"), F.sha2("text", 256))
    return table_of(spark, sf_dir, "documents").groupBy("lang").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("value"))
