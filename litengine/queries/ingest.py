"""ING, SRC and SNK over the bundled tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import relations as R
from . import column_query, query, table_of

C = F.col
MARKED = "'# T' || doc_id % 3 || chr(10) || replace(text, chr(10), chr(10) || '<!-- PDF_PAGE: 7 -->' || chr(10)) || chr(10) || '## S' || chr(10) || 'end'"


def marked(spark, sf):
    text = F.concat(F.lit("# T"), (C("doc_id") % 3).cast("string"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n<!-- PDF_PAGE: 7 -->\n")), F.lit("\n## S\nend"))
    return table_of(spark, sf, "documents").select("doc_id", text.alias("text"))


STARTS = "CASE WHEN length(text) > 700 THEN range(0, greatest(0, ceil((length(text) - 500) / 450.0))::BIGINT * 450 + 1, 450) ELSE [0] END"


@query("op_ing2_chunks", f"WITH s AS (SELECT doc_id, text, unnest({STARTS}) AS start FROM documents WHERE length(text) > 0) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INTEGER AS chunk_index, start::INTEGER AS start, sha256(c) AS hash, substr(text, greatest(0, start - 50) + 1, start - greatest(0, start - 50)) AS overlap_before FROM (SELECT *, trim(substr(text, start + 1, CASE WHEN length(text) > 700 THEN 500 ELSE 700 END)) AS c FROM s) WHERE c <> ''")
def chunks(spark, sf):
    return I.chunks(table_of(spark, sf, "documents")).select("doc_id", "chunk_index", "start", F.sha2("chunk_text", 256).alias("hash"), "overlap_before")


@query("op_ing1_markdown_nodes")
def markdown_nodes(spark, sf):
    return I.markdown_nodes(marked(spark, sf), "doc_id")


@query("op_ing4_blocks", "WITH l AS (SELECT page_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM (SELECT page_id, string_split(html, chr(10)) AS ls FROM pages)), k AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6}\\s+\\S') THEN 'heading' WHEN regexp_matches(line, '^\\s*([-*+]|\\d+[.)])\\s+\\S') THEN 'list_item' WHEN trim(line) = '' THEN NULL ELSE 'paragraph' END AS kind FROM l), b AS (SELECT *, sum(CASE WHEN kind = 'paragraph' AND prev = 'paragraph' THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY page_id ORDER BY pos) AS prev FROM k)) SELECT page_id, kind, (min(pos) + 1)::INTEGER AS line_start, (max(pos) + 1)::INTEGER AS line_end, string_agg(line, chr(10) ORDER BY pos) AS text FROM b WHERE kind IS NOT NULL GROUP BY page_id, block, kind")
def blocks(spark, sf):
    return I.blocks(table_of(spark, sf, "pages"), "page_id", "html").select("page_id", "kind", "line_start", "line_end", "text")


column_query("op_ing5_paragraphs", "pages", "page_id", lambda: F.array_join(I.paragraphs(C("html")), "¶"), "array_to_string(list_filter(list_transform(regexp_split_to_array(html, '\\n\\s*\\n+'), lambda p: trim(p)), lambda p: p <> ''), '¶')")
OCR_TEXT = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '</?(sub|sup|b|i|u|math)[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), ' ([,.;:!?，。；：！？])', '\\1', 'g'))"
column_query(
    "op_ing7_line_role", "conversations", "conv_id, turn", lambda: I.layout_role(F.concat_ws(" ", F.when(C("turn") == 0, F.lit("Chapter")), F.when(C("turn") % 2 == 0, C("conv_id").cast("string")).otherwise(C("text"))), F.lit(100), C("turn") * 100, F.lit(500), C("turn") * 100 + 60, F.lit(600), F.lit(800)),
    r"""CASE WHEN turn % 2 = 1 AND regexp_replace(text, '\s+', '', 'g') = '' THEN 'unknown' WHEN turn % 2 = 0 AND turn > 0 AND length(conv_id::VARCHAR) <= 4 AND (turn * 100 <= 96 OR turn * 100 + 60 >= 720) THEN 'page_number' WHEN turn = 0 THEN 'header' WHEN turn * 100 + 60 >= 752 AND turn * 100 >= 600 AND (turn % 2 = 0 OR length(regexp_replace({0}, '\s+', '', 'g')) <= 40) THEN 'footer'
    WHEN turn % 2 = 1 AND regexp_matches({0}, '^fig(ure)?\.?\s*\d+', 'i') THEN 'figure_caption' WHEN turn % 2 = 1 AND len(regexp_extract_all(text, '[\\δ∞∈≤≥=+*/_^()-]|<math')) >= 6 AND len(regexp_extract_all({0}, '[一-鿿]')) <= 4 THEN 'formula' ELSE 'body' END""".format(OCR_TEXT),
)
column_query("op_ing10_joiner", "conversations", "conv_id, turn", lambda: I.joined_lines(F.concat(F.replace("text", F.lit("."), F.lit(" .")), F.lit(" 图 神"))), "regexp_replace(replace(text, '.', ' .'), ' ([,.;:!?，。；：！？])', '\\1', 'g') || ' 图神'")
column_query("op_ing11_ocr_text", "pages", "page_id", lambda: I.ocr_text(C("html")), "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '</?(sub|sup|b|i|u|math)[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), ' ([,.;:!?，。；：！？])', '\\1', 'g'))")
column_query("op_ing15_sample_indexes", "documents", "doc_id", lambda: F.array_join(I.sample_indexes(C("doc_id") % 40).cast("array<string>"), ","), "CASE WHEN doc_id % 40 = 0 THEN '' WHEN doc_id % 40 <= 12 THEN array_to_string(range(0, doc_id % 40), ',') ELSE array_to_string(list_transform(range(0, 12), lambda i: round_even(i * (doc_id % 40 - 1) / 11, 0)::INTEGER), ',') END")
column_query("op_ing17_fingerprint", "documents", "doc_id", lambda: I.plan_fingerprint(C("doc_id"), C("lang"), F.lit(None)), "sha256(doc_id || '|' || lang || '|')")


LINES = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
N = f"greatest(len({LINES}), 1)"


QUALITY_SQL = r"""WITH d AS (SELECT source AS g, doc_id, coalesce(text, '') AS t, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n?|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
s AS (SELECT g, count(*) AS pages, count(*) FILTER (regexp_replace(t, '^\s+|\s+$', '', 'g') <> '') AS filled, sum(length(regexp_replace(t, '^\s+|\s+$', '', 'g'))) AS bare, sum(length(t)) + count(*) - 1 AS chars, sum(len(ls)) AS n,
  sum(len(list_filter(ls, lambda x: length(x) = 1))) AS one, sum(len(list_filter(ls, lambda x: length(x) <= 3))) AS three, sum(length(t) - length(replace(t, chr(65533), ''))) AS odd,
  sum(len(regexp_extract_all(t, '[\p{C}\p{Z}]')) - len(regexp_extract_all(t, '[ \n\r\t]'))) AS hidden, sum(len(regexp_extract_all(t, ' {3,}'))) AS spaces, sum(len(regexp_extract_all(t, '\b[A-Za-z]\s+(?:[A-Za-z]\s+){3,}[A-Za-z]\b'))) AS split FROM d GROUP BY 1),
l AS (SELECT DISTINCT g, doc_id, regexp_replace(lower(trim(unnest(string_split(t, chr(10))))), '\d+', '#', 'g') AS line FROM d WHERE true), c AS (SELECT g, line, count(*) AS k FROM l WHERE length(line) >= 4 GROUP BY ALL),
r AS (SELECT g, round(sum(CASE WHEN k >= greatest(2, floor(pages / 2)) THEN k ELSE 0 END) / sum(k), 6) AS ratio FROM c JOIN s USING (g) GROUP BY g),
x AS (SELECT g, filled, bare / pages AS mean, 1 - filled / pages AS e, odd / greatest(1, chars) AS o, hidden / greatest(1, chars) AS h, one / greatest(1, n) AS s1, three / greatest(1, n) AS s3, spaces / greatest(1, n) AS sp, CASE WHEN pages > 1 THEN coalesce(ratio, 0) ELSE 0 END AS rp, split / greatest(1, n) AS b FROM s LEFT JOIN r USING (g))
SELECT g AS source, round(greatest(0.0, 100 - (greatest(0.0, 120 - mean) / 120 * 35 + least(55.0, e * 65) + least(25.0, o * 2500) + least(20.0, h * 2000) + least(18.0, s1 * 80) + least(12.0, s3 * 25) + least(12.0, sp * 3) + least(18.0, rp * 45) + least(20.0, b * 50))), 1)::DOUBLE AS score, filled = 0 OR e >= 0.8 AS hard_failure,
  coalesce(nullif(concat_ws(',', CASE WHEN e >= 0.4 THEN printf('high_empty_page_ratio:%.3f', e) END, CASE WHEN mean < 120 THEN printf('low_characters_per_page:%.1f', mean) END, CASE WHEN o >= 0.002 THEN printf('unicode_replacement_ratio:%.4f', o) END, CASE WHEN h >= 0.002 THEN printf('nonprintable_character_ratio:%.4f', h) END,
  CASE WHEN s1 >= 0.08 THEN printf('single_character_line_ratio:%.3f', s1) END, CASE WHEN s3 >= 0.25 THEN printf('very_short_line_ratio:%.3f', s3) END, CASE WHEN sp >= 0.5 THEN printf('abnormal_spacing:%.3f', sp) END, CASE WHEN rp >= 0.2 THEN printf('repeated_header_footer_ratio:%.3f', rp) END, CASE WHEN b >= 0.08 THEN printf('split_word_ratio:%.3f', b) END), ''), 'native_text_layer_quality_acceptable') AS reasons FROM x"""


@query("op_ing12_text_quality", QUALITY_SQL)
def text_quality(spark, sf):
    return I.text_quality(table_of(spark, sf, "documents"), "source", "doc_id")


@query("op_ing13_repeated_line_ratio", "WITH l AS (SELECT DISTINCT lang, doc_id, regexp_replace(lower(trim(unnest(string_split(text, chr(10))))), '\\d+', '#', 'g') AS line FROM documents), n AS (SELECT lang, line, count(*) AS n FROM l WHERE length(line) >= 4 GROUP BY ALL), p AS (SELECT lang, count(DISTINCT doc_id) AS pages FROM documents GROUP BY 1) SELECT lang, round(sum(CASE WHEN n >= greatest(2, floor(pages / 2)) THEN n ELSE 0 END) / sum(n), 6) AS ratio FROM n JOIN p USING (lang) GROUP BY lang")
def repeated_line_ratio(spark, sf):
    return I.repeated_line_ratio(table_of(spark, sf, "documents"), "lang", "doc_id", "text")


@query("op_ing14_marked_pages", f"SELECT doc_id, 7 AS page, trim(unnest(regexp_split_to_array(t, '<!--\\s*PDF_PAGE:\\s*\\d+\\s*-->')[2:])) AS body FROM (SELECT doc_id, {MARKED} AS t FROM documents)")
def marked_pages(spark, sf):
    return I.marked_pages(marked(spark, sf), "doc_id", "text")


def _role(text):
    return I.line_role(text, F.lit(50), F.lit(100))


@query("op_ing9_grouped_lines")
def grouped_lines(spark, sf):
    t = table_of(spark, sf, "conversations").select("conv_id", C("turn").cast("long").alias("turn"), (C("turn") / 4).cast("long").alias("page"), _role(C("text")).alias("role"), "text")
    return I.grouped_lines(t, "conv_id", "turn", "page", "role", "text", 300)


def sources(spark, sf):
    docs, pages, notes = (table_of(spark, sf, t) for t in ("documents", "pages", "conversations"))
    parts = [
        I.fragments(I.chunks(docs), "pdf_chunk", ["doc_id", "chunk_index"], "chunk_text", [C("chunk_index")], "doc_id", "source"),
        I.fragments(pages, "markdown_note", ["page_id"], "html", [C("page_id")], "page_id", "url"),
        I.fragments(notes, "personal_note", ["conv_id", "turn"], "text", [C("turn")], "conv_id", "role"),
    ]
    return parts


@query("op_src3_pdf_chunks", f"SELECT doc_id AS document_id, count(*) AS n FROM (SELECT doc_id, text, unnest({STARTS}) AS start FROM documents WHERE length(text) > 0) WHERE trim(substr(text, start + 1, 500)) <> '' GROUP BY 1")
def pdf_chunks(spark, sf):
    return sources(spark, sf)[0].groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("op_src5_child_notes", "SELECT page_id AS document_id, url AS title, 0::BIGINT AS source_order FROM pages WHERE trim(html) <> ''")
def child_notes(spark, sf):
    return sources(spark, sf)[1].select("document_id", "title", "source_order")


@query("op_src7_personal_notes", "SELECT conv_id AS document_id, role AS title, source_order FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS source_order FROM conversations) WHERE trim(text) <> ''")
def personal_notes(spark, sf):
    return sources(spark, sf)[2].select("document_id", "title", "source_order")


@query("op_src9_registry", "SELECT 'markdown_note' AS source_type, count(*) AS n FROM pages WHERE trim(html) <> '' UNION ALL SELECT 'personal_note', count(*) FROM conversations WHERE trim(text) <> ''")
def registry(spark, sf):
    return I.registry(sources(spark, sf), ["markdown_note", "personal_note"]).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


@query("op_snk7_upsert_counts", "SELECT count(*) FILTER (a.doc_id IS NULL) AS created, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.n_chars <> b.v) AS updated, count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL AND a.n_chars = b.v) AS unchanged, count(*) FILTER (b.doc_id IS NULL) AS removed FROM (SELECT * FROM documents WHERE doc_id % 5 > 0) a FULL JOIN (SELECT doc_id, n_chars + doc_id % 2 AS v FROM documents WHERE doc_id % 7 > 0) b ON a.doc_id = b.doc_id")
def upsert_counts(spark, sf):
    d = table_of(spark, sf, "documents").select("doc_id", "n_chars")
    return I.upsert_counts(d.where("doc_id % 5 > 0"), d.where("doc_id % 7 > 0").withColumn("n_chars", C("n_chars") + C("doc_id") % 2), ["doc_id"], "n_chars")


@query("op_snk3_replaced", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END AS n_chars FROM documents")
def replaced(spark, sf):
    d = table_of(spark, sf, "documents").select("doc_id", "n_chars")
    return I.replaced(d, d.where("doc_id % 4 = 0").withColumn("n_chars", F.lit(0).cast("long")), "doc_id")


@query("op_snk8_ordered_export", "SELECT lang, sha256(concat_ws('|', count(*), sum(('0x' || substr(h, 1, 15))::BIGINT::HUGEINT), sum(('0x' || substr(h, 16, 15))::BIGINT::HUGEINT), sum(('0x' || substr(h, 31, 15))::BIGINT::HUGEINT), sum(('0x' || substr(h, 46, 15))::BIGINT::HUGEINT))) AS hash FROM (SELECT *, sha256((doc_id % 3 = 0) || '|' || n_chars || '|' || doc_id) AS h FROM documents) GROUP BY lang")
def ordered_export(spark, sf):
    # The order of an export is that of its keys, so a digest of keys and rows stands for it.
    return R.content_hash(table_of(spark, sf, "documents"), ["lang"], F.concat_ws("|", C("doc_id") % 3 == 0, "n_chars", "doc_id"))

