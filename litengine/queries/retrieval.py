"""RET over chunks of documents, embeddings and conversations."""

from __future__ import annotations

import hashlib
import inspect
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import deltas as D
from ..operators import expansion as N
from ..operators import fusion as X
from ..operators import ingest as I
from ..operators import lexical as L
from ..plans import query_plan as P
from ..sources import tables as S
from . import column_query, query, table_of

C = F.col


def fragments(documents):
    """Chunks of documents as fragments with all columns that the index knows."""
    chunks = I.chunks(S.spread(documents, "doc_id"))
    return chunks.select(
        L.row_id(C("doc_id"), C("chunk_index")).alias("row_id"), C("doc_id").alias("document_id"), F.lit("pdf_chunk").alias("source_type"), C("source").alias("title"), C("lang").alias("section"),
        F.concat(F.lit("t"), (C("doc_id") % 3).cast("string")).alias("tags"), C("chunk_text").alias("text"), F.lit("").alias("note"), F.lit("").alias("context"),
    )


def stored_index(spark, sf, kind="", change=lambda d: d):
    """The active index generation of a library, built where there is none of these files and this version yet.

    `change` is made to documents before they are indexed; each kind of change has an index of its own."""
    root = f"{S.shared_folder(spark)}/lexical{kind}-{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    now = f"{S.files_fingerprint(spark, f'{sf}/documents.parquet')} version {L.VERSION} chunks {inspect.signature(I.chunks)} columns {' '.join(L.WEIGHTS)}"
    if S.active(spark, root, now)["state"] != "ready":
        S.publish(spark, root, L.stored_tables(fragments(change(table_of(spark, sf, "documents"))), "row_id"), now)
    return L.opened({t: S.generation(spark, root, t) for t in L.Index._fields}, "row_id")


STARTS = "CASE WHEN length(text) > 700 THEN range(0, greatest(0, ceil((length(text) - 500) / 450.0))::BIGINT * 450 + 1, 450) ELSE [0] END"
TOK = "list_filter(string_split(lower(strip_accents(regexp_replace({}, '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+', ' ', 'g'))), ' '), lambda w: w <> '')"
FRAGMENTS = f"""f AS (SELECT doc_id * 8388608 + row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS row_id, doc_id AS document_id, source AS title, lang AS section, 't' || doc_id % 3 AS tags, c AS text
  FROM (SELECT *, trim(substr(text, start + 1, CASE WHEN length(text) > 700 THEN 500 ELSE 700 END)) AS c FROM (SELECT doc_id, source, lang, text, unnest({STARTS}) AS start FROM documents WHERE length(text) > 0)) WHERE c <> ''),
post AS (SELECT row_id, w, field, unnest(range(len(ws))) AS pos, unnest(ws) AS token FROM (
  SELECT row_id, 6.0 AS w, 'title' AS field, {TOK.format('title')} AS ws FROM f UNION ALL SELECT row_id, 3.0, 'section', {TOK.format('section')} FROM f
  UNION ALL SELECT row_id, 2.0, 'tags', {TOK.format('tags')} FROM f UNION ALL SELECT row_id, 1.0, 'text', {TOK.format('text')} FROM f)),
len AS (SELECT row_id, count(*) AS words FROM post GROUP BY 1), st AS (SELECT count(*) AS n FROM f), av AS (SELECT sum(words) / (SELECT n FROM st) AS a FROM len)"""


def bm25_sql(phrases, every):
    """BM25 of phrases of one or two words."""
    parts = []
    for p in phrases:
        a, *b = p.split()
        parts.append(f"SELECT '{p}' AS phrase, x.row_id, sum(x.w) AS f FROM post x " + (f"JOIN post y ON y.row_id = x.row_id AND y.field = x.field AND y.pos = x.pos + 1 AND y.token = '{b[0]}' " if b else "") + f"WHERE x.token = '{a}' GROUP BY x.row_id")
    return f"""occ AS ({' UNION ALL '.join(parts)}), d AS (SELECT phrase, count(*) AS df FROM occ GROUP BY 1),
bm AS (SELECT row_id, sum(CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * words / a))) AS bm25 FROM (
  SELECT occ.row_id, f, words, a, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM occ JOIN d USING (phrase) JOIN len USING (row_id), st, av) GROUP BY row_id HAVING count(*) >= {len(phrases) if every else 1})"""


@query("op_ret7_bm25", f"WITH {FRAGMENTS}, {bm25_sql(['the and', 'ing'], False)} SELECT row_id, round(bm25, 6) AS bm25 FROM bm")
def bm25(spark, sf):
    index = stored_index(spark, sf)
    return L.bm25(index.rows, index.postings, "row_id", ["the and", "ing"], False).select("row_id", F.round("bm25", 6).alias("bm25"))


@query("op_snk2_index", f"WITH {FRAGMENTS} SELECT token, count(*) AS n, count(DISTINCT row_id) AS df FROM post GROUP BY token")
def index(spark, sf):
    """A generation built anew, and what it holds of each token."""
    root = f"{S.shared_folder(spark)}/lexical-built-{uuid.uuid4().hex}"
    S.publish(spark, root, L.stored_tables(fragments(table_of(spark, sf, "documents")), "row_id"), "built")
    return L.terms(S.generation(spark, root, "postings"))


NORM = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
HIT = lambda t: "(" + " OR ".join(f"contains({NORM.format(c)}, '{t}')" for c in ("title", "section", "tags", "text")) + ")"


def lexical_sql(phrases, every, normal, terms, identifiers=()):
    """RET13's page for a query of these parts: candidates by BM25, their signals and scores."""
    some = lambda parts: "(" + " OR ".join(parts) + ")" if parts else "false"
    column = lambda c: some([f"contains({NORM.format(c)}, '{t}')" for t in terms])
    return f"""WITH {FRAGMENTS}, {bm25_sql(phrases, every)}, p AS (SELECT * FROM (SELECT row_id, greatest(0, bm25) AS bm25 FROM bm) ORDER BY round(bm25, 9) DESC, row_id LIMIT 400)
SELECT row_id, round(score, 6) AS score FROM (SELECT row_id, bm25, bm25 + 4.0 * {some([HIT(n) for n in normal])}::INT + 5.0 * {some([HIT(i) for i in identifiers])}::INT + 2.5 * ({' + '.join(HIT(t) + '::INT' for t in terms)}) / {len(terms)}
+ 2.0 * {column('title')}::INT + 1.25 * {column('section')}::INT + 1.25 * {column('tags')}::INT AS score FROM p JOIN f USING (row_id)) ORDER BY round(score, 9) DESC, round(bm25, 9) DESC, row_id LIMIT 20"""


def lexical(name, text, sql):
    @query(name, sql)
    def run(spark, sf):
        return L.retrieved(stored_index(spark, sf), "row_id", P.plan(text)).select("row_id", F.round("score", 6).alias("score"))


lexical("op_ret13_lexical", "the and", lexical_sql(["the", "and"], True, ["the and"], ["the", "and"]))
lexical("op_ret5_quoted", '"the and" ing', lexical_sql(["the and", "ing"], True, ["the and"], ["the and", "ing"]))
lexical("op_ret2_identifier", "src3-the", lexical_sql(["src3", "the"], True, ["src3 the"], ["src3", "the"], ["src3 the", "src3the"]))
lexical("op_ret5_identifier_parts", "ing src3-and", lexical_sql(["ing", "src3", "and"], True, ["ing src3 and"], ["ing", "src3", "and"], ["ing src3 and", "ingsrc3and", "src3 and", "src3and"]))
lexical("op_ret5_spelled", "SRC3", lexical_sql(["src3"], False, [], ["src3"], ["src3"]))
lexical("op_ret10_single_term", "pathetic", lexical_sql(["pathetic"], True, [], ["pathetic"]))


@query("op_ret1_query_plans", r"""WITH q AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark), t AS (SELECT item_id, w, '"' || w[2] || ' ' || w[3] || '" ' || w[4] || ' ' || w[5] || ' ' || w[4] || '-9' AS text FROM q)
SELECT item_id AS query_id, text, w[2] || ' ' || w[3] || ' ' || array_to_string(list_distinct_kept, ' ') AS normal, [w[2] || ' ' || w[3]] AS phrases, list_distinct_kept AS terms, true AS every FROM (SELECT *, CASE WHEN w[4] = w[5] THEN [w[4], '9'] ELSE [w[4], w[5], '9'] END AS list_distinct_kept FROM t)""")
def query_plans(spark, sf):
    """RET1 to RET6 of a table of query lines."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))
    line = F.concat(F.lit('"'), w[1], F.lit(" "), w[2], F.lit('" '), w[3], F.lit(" "), w[4], F.lit(" "), w[3], F.lit("-9"))
    return P.planned(table_of(spark, sf, "benchmark").select(C("item_id").alias("query_id"), line.alias("text"))).select("query_id", "text", "normal", "phrases", "terms", "every")


@query("op_ret12_diversified")
def coverage(spark, sf):
    return L.retrieved(stored_index(spark, sf), "row_id", P.plan("the tion"), coverage=True)


# Letters of a text as CJK characters: the bundled documents have none.
LETTERS, CHARACTERS = "etaoinshr", "\u7684\u4e00\u662f\u4e0d\u4e86\u5728\u4eba\u6709\u6211"


def in_cjk(documents):
    return documents.withColumn("text", F.when(C("lang") == "en", F.translate("text", LETTERS, CHARACTERS)).otherwise(C("text")))


def cjk_query(parts):
    return [p.translate(str.maketrans(LETTERS, CHARACTERS)) for p in parts]


CJK_FRAGMENTS = FRAGMENTS.replace("FROM documents", f"FROM (SELECT * REPLACE (CASE WHEN lang = 'en' THEN translate(text, '{LETTERS}', '{CHARACTERS}') ELSE text END AS text) FROM documents)")


def trigram_sql(terms, every):
    """RET6's scores of some substrings: BM25 over runs of three characters."""
    times = lambda c, w, t: f"{w} * len(list_filter(range(1, length({c}) + 1), lambda i: substr(lower({c}), i, {len(t)}) = '{t}'))"
    parts = " UNION ALL ".join(f"SELECT '{t}' AS term, row_id, {times('title', 6.0, t)} + {times('section', 3.0, t)} + {times('tags', 2.0, t)} + {times('text', 1.0, t)} AS f FROM f WHERE contains(lower(concat_ws(chr(10), title, section, tags, text)), '{t}')" for t in terms)
    return f"""WITH {CJK_FRAGMENTS}, g AS (SELECT row_id, greatest(length(title) - 2, 0) + greatest(length(coalesce(section, '')) - 2, 0) + greatest(length(tags) - 2, 0) + greatest(length(text) - 2, 0) AS grams FROM f),
ga AS (SELECT count(*) AS n, sum(grams) / count(*) AS a FROM g), o AS (SELECT * FROM ({parts}) WHERE f > 0), d AS (SELECT term, count(*) AS df FROM o GROUP BY 1)
SELECT row_id, round(sum(CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * grams / a))), 6) AS bm25 FROM (
  SELECT o.row_id, f, grams, a, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM o JOIN d USING (term) JOIN g USING (row_id), ga) GROUP BY row_id HAVING count(*) >= {len(terms) if every else 1}"""


def trigram_query(name, parts, every):
    @query(name, trigram_sql(cjk_query(parts), every))
    def run(spark, sf):
        terms = cjk_query(parts)
        asked = L.local(spark, [(0, t, len(terms) if every else 1) for t in terms], "query_id int, term string, needed int")
        return L.substring_scores(stored_index(spark, sf, "-cjk", in_cjk), "row_id", asked, True).select("row_id", F.round("bm25", 6).alias("bm25"))


trigram_query("op_ret6_trigram", ["the", "ion"], True)
trigram_query("op_ret6_trigram_coverage", ["thand", "ung d", "blew"], False)


HOLDS = lambda c: f"len(list_filter(ws, lambda t: contains({NORM.format(c)}, t)))"


@query("op_ret30_reranked_variants", f"""WITH {FRAGMENTS}, w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark),
q AS (SELECT 2 * item_id AS query_id, 0 AS variant, w[2:4] AS ws, w[2:4] AS ts FROM w UNION ALL SELECT 2 * item_id + 1, 0, [substr(w[5], 1, 2), w[6]], [substr(w[5], 1, 2), w[6]] FROM w
  UNION ALL SELECT 2 * item_id + 1, 2, [substr(w[5], 1, 2), w[6]], [substr(w[5], 1, 2) || w[6]] FROM w WHERE length(w[6]) >= 2 AND w[5] NOT IN ('a', 'i')),
t AS (SELECT query_id, variant, list_distinct(ws) AS ws, unnest(list_distinct(ts)) AS token, len(list_distinct(ts)) AS needed FROM q),
oc AS (SELECT token, row_id, sum(w) AS f FROM post WHERE token IN (SELECT token FROM t) GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM oc GROUP BY 1),
pt AS (SELECT token, row_id, CASE WHEN idf <= 0 THEN 1e-6 ELSE idf END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * words / a)) AS part FROM (SELECT oc.*, words, a, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM oc JOIN d USING (token) JOIN len USING (row_id), st, av)),
b AS (SELECT query_id, variant, ws, row_id, greatest(0, sum(part)) AS bm25 FROM t JOIN pt USING (token) GROUP BY ALL HAVING count(*) >= any_value(needed)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY round(bm25, 9) DESC, row_id) AS base FROM b QUALIFY base <= 20),
m AS (SELECT query_id, ws, row_id, min((base, variant)) AS dealt FROM r GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dealt) AS place FROM m QUALIFY place <= 20),
s AS (SELECT query_id, row_id, place, round(10.0 * {HOLDS('text')} / len(ws) + 3.0 * ({HOLDS('title')} > 0)::INT + 2.5 * ({HOLDS('section')} > 0)::INT - 5.0, 6) AS rerank_score FROM p JOIN f USING (row_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, place) AS rank, row_id, rerank_score, CASE WHEN rerank_score > 0 THEN 'primary' ELSE 'secondary' END AS tier FROM s QUALIFY rank <= 10""")
def reranked_variants(spark, sf):
    """Two lines of every benchmark item: three of its words, and a short name with a dash, which has three spellings."""
    w = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))
    lines = F.array(F.array_join(F.slice(w, 2, 3), " "), F.concat(F.substring(w[4], 1, 2), F.lit("-"), w[5]))
    queries = table_of(spark, sf, "benchmark").select("item_id", F.posexplode(lines).alias("k", "text")).select((2 * C("item_id") + C("k")).alias("query_id"), "text")
    return L.reranked_variants(stored_index(spark, sf), "row_id", queries).select("query_id", "rank", "row_id", "rerank_score", "tier")


def changed(documents):
    """A library in which every hundredth document is rewritten and another hundredth is gone: (rewritten, gone)."""
    at = F.pmod(C("doc_id"), F.lit(100))
    return documents.where(at == 7).withColumn("text", F.concat(F.lit("rewritten the and "), F.substring("text", 1, 3000))), documents.where(at == 8)


CHANGED = "FROM (SELECT * REPLACE (CASE WHEN doc_id % 100 = 7 THEN 'rewritten the and ' || substr(text, 1, 3000) ELSE text END AS text) FROM documents WHERE doc_id % 100 <> 8)"


def delta(name, phrases, every):
    @query(name, f"WITH {FRAGMENTS.replace('FROM documents', CHANGED)}, {bm25_sql(phrases, every)} SELECT row_id, round(bm25, 6) AS bm25 FROM bm")
    def run(spark, sf):
        folder = f"{S.shared_folder(spark)}/lexical-changes-{uuid.uuid4().hex}"
        new, gone = changed(table_of(spark, sf, "documents"))
        ids = lambda d: d.select(C("doc_id").alias("document_id"))
        D.upsert(spark, folder, "row_id", ids(new), fragments(new))
        D.upsert(spark, folder, "row_id", ids(gone), None)
        index = D.merged(stored_index(spark, sf), folder, "row_id")
        return L.bm25(index.rows, index.postings, "row_id", phrases, every).select("row_id", F.round("bm25", 6).alias("bm25"))


delta("op_snk3_upserted", ["rewritten", "the and"], False)
delta("op_snk4_cleaned", ["the", "ing"], True)


@query("op_ret8_fused", "SELECT user_id, round(max(v) + 0.1 * (sum(v) - max(v)), 6) AS bm25 FROM (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def fused(spark, sf):
    channels = table_of(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("bm25"))
    return L.fused([channels], "user_id").select("user_id", F.round("bm25", 6).alias("bm25"))


@query("op_ret14_keyword", "SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the an') AND lang = 'en' ORDER BY doc_id LIMIT 20")
def keyword(spark, sf):
    return table_of(spark, sf, "documents").where(T.contains_folded(C("text"), F.lit("the AN")) & (C("lang") == "en")).orderBy("doc_id").limit(20).select("doc_id")


HASHED = "(SELECT {0}, w, count(*) AS n, sha256(w) AS h FROM (SELECT {0}, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM {1}) GROUP BY {0}, w)"


def hashed_sql(key, table):
    at = " UNION ALL ".join(f"SELECT {key}, ('0x' || substr(h, {8 * k + 1}, 4))::BIGINT % 256 AS slot, CASE WHEN ('0x' || substr(h, {8 * k + 5}, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END * n * (1 + length(w) / 16) AS x FROM t" for k in range(4))
    return f"WITH t AS {HASHED.format(key, table)}, s AS (SELECT {key}, slot, sum(x) AS x FROM ({at}) GROUP BY 1, 2), z AS (SELECT {key}, sqrt(sum(x * x)) AS z FROM s GROUP BY 1)"


@query("op_ret15_hash_embedding", hashed_sql("item_id", "benchmark") + " SELECT item_id, round(sum(abs(x)) / any_value(z), 6) AS mass, count(*) FILTER (x <> 0) AS used FROM s JOIN z USING (item_id) GROUP BY 1")
def hash_embedding(spark, sf):
    v = X.embedder()(table_of(spark, sf, "benchmark"), "item_id", "text")
    return v.select("item_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("mass"), F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("used"))


@query("op_ret16_vector", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 9) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def vector(spark, sf):
    e = table_of(spark, sf, "embeddings")
    return X.nearest(e, e.where("vec_id = 7"), "vec_id", "embedding", 10).select("vec_id", "score")


@query("op_ret17_hybrid", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), v AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, q ORDER BY round(s, 9) DESC, vec_id LIMIT 50), k AS (SELECT vec_id, row_number() OVER (ORDER BY label DESC, vec_id) AS r FROM embeddings ORDER BY r LIMIT 20) SELECT coalesce(v.vec_id, k.vec_id) AS vec_id, round(0.5 * coalesce(1 / r, 0.0) + 0.5 * coalesce(least(1.0, greatest(0.0, round(s, 9))), 0.0), 9) AS score FROM v FULL JOIN k ON v.vec_id = k.vec_id ORDER BY score DESC, vec_id LIMIT 5")
def hybrid(spark, sf):
    e = table_of(spark, sf, "embeddings")
    return X.hybrid(e.select("vec_id", C("label").cast("double").alias("score")), X.nearest(e, e.where("vec_id = 7"), "vec_id", "embedding", 50), "vec_id", 5)


@query("op_ret18_fusion", "WITH k AS (SELECT user_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events), p AS (SELECT user_id, sum(greatest(0.2, 3 / r)) AS pts, 'keyword' AS c FROM k WHERE r <= 50 GROUP BY 1 UNION ALL SELECT user_id, max(value / 10), 'vector' FROM events GROUP BY 1 UNION ALL SELECT user_id, 1.5 * count(*), 'tag' FROM events WHERE value > 2 GROUP BY 1) SELECT user_id, round(sum(pts) + 0.5 * count(*), 6) AS score, string_agg(c, ',' ORDER BY c) AS channels FROM p GROUP BY 1 HAVING string_agg(c, ',' ORDER BY c) <> 'vector' OR round(sum(pts) + 0.5 * count(*), 6) >= 0.65 ORDER BY 2 DESC, 1 LIMIT 100")
def channel_fusion(spark, sf):
    e = table_of(spark, sf, "events")
    ranks = e.withColumn("rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))).where("rank <= 50")
    return X.channel_fusion({"keyword": ranks, "vector": e.withColumn("points", C("value") / 10), "tag": e.where("value > 2").withColumn("points", F.lit(1.5))}, "user_id", 100)


column_query("op_ret20_heuristic", "documents", "doc_id", lambda: X.heuristic_score(["the", "an"], C("text"), C("source"), C("lang"), F.lit("a tag"), C("doc_id") % 8, C("doc_id") % 3, F.lit(2), F.lit(0.5)), "round(10 * (contains(lower(text), 'the')::INT + contains(lower(text), 'an')::INT) / 2 + 6 * (contains(source, 'the') OR contains(source, 'an'))::INT + 5 * (contains(lang, 'the') OR contains(lang, 'an'))::INT + 1.5 * least(len(regexp_extract_all(lower(text), 'the')) + len(regexp_extract_all(lower(text), 'an')), 5) + 2 * least(doc_id % 8, 5) + 2 * least(doc_id % 3, 5) + 2 + 0.5, 6)")
column_query("op_ret23_grouped_score", "documents", "doc_id", lambda: X.grouped_text_score(C("text"), "the and", ["the", "of"]), "(round(4.0 * contains(lower(text), 'the and')::INT + 1.2 * (regexp_matches(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]', ' ', 'g') || ' ', ' the ')::INT + regexp_matches(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]', ' ', 'g') || ' ', ' of ')::INT), 6))::DOUBLE")
column_query("op_ret25_section_adjustment", "part", "p_partkey", lambda: X.section_adjustment(F.element_at(F.array(*map(F.lit, ("3 Proposed Methods", "1 Introduction", "Results", "Front matter", "Conclusion and approach", "References"))), (1 + C("p_size") % 6).cast("int")), C("p_partkey") % 3 > 0), "(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE [1.0, 0.25, -0.55, -0.15, 1.0, 0.0][1 + p_size % 6] END)::DOUBLE")
column_query("op_ret32_tier", "events", "event_id", lambda: X.tier(C("value") - 1, F.when(C("user_id") % 5 == 0, "References").otherwise("Body")), "CASE WHEN user_id % 5 = 0 THEN 'reference' WHEN value > 1 THEN 'primary' ELSE 'secondary' END")
column_query("op_ret39_object_score", "part", "p_partkey", lambda: X.object_score("brand 1", C("p_brand"), F.array(F.lit("x"), C("p_type")), C("p_size") % 9, C("p_size") % 4, C("p_size") > 45), "(round(least(1.0, greatest(0.0, CASE WHEN regexp_replace(lower(p_brand), '[\\s_-]+', '', 'g') = 'brand1' OR regexp_replace(lower(p_type), '[\\s_-]+', '', 'g') = 'brand1' THEN 0.42 WHEN contains(regexp_replace(lower(p_brand), '[\\s_-]+', '', 'g'), 'brand1') OR contains(regexp_replace(lower(p_type), '[\\s_-]+', '', 'g'), 'brand1') THEN 0.34 ELSE 0.14 END + 0.05 * least(p_size % 9, 5) + 0.03 * least(p_size % 4, 5) - CASE WHEN p_size > 45 THEN 0.3 ELSE 0 END)), 6))::DOUBLE")
HAS = lambda c, *words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query("op_ret39_object_scores", f"""WITH o AS (SELECT p_partkey AS id, lower(p_name) AS name, lower(p_brand) AS alias, CASE WHEN p_size % 4 = 0 THEN 'method' ELSE 'dataset' END AS kind, p_size % 6 AS n, p_partkey % 5 AS m, p_size % 3 = 0 AS made, p_size % 2 = 0 AS sect, p_partkey % 3 AS src, p_partkey % 2 = 0 AS low FROM part),
e AS (SELECT *, CASE WHEN name = 'brand model' OR alias = 'brand model' THEN 0.42 WHEN contains(name, 'brand model') OR contains(alias, 'brand model') OR contains('brand model', name) OR contains('brand model', alias) THEN 0.34 WHEN {HAS('name', 'brand', 'model')} OR {HAS('alias', 'brand', 'model')} THEN 0.14 ELSE 0 END AS a, CASE WHEN kind = 'method' THEN 0.1 ELSE 0 END AS i,
  CASE WHEN n > 0 THEN greatest(0, least(0.16, n * 0.035) + least(0.1, n * 0.03) + CASE WHEN kind = 'method' THEN least(0.04, n * 0.015) ELSE 0 END - CASE WHEN made THEN least(0.12, n * 0.04) ELSE 0 END) ELSE 0 END AS s,
  CASE WHEN sect THEN least(0.1, n * 0.03) ELSE 0 END AS c, CASE WHEN m = 0 THEN 0 ELSE least(0.08, m * 0.035) END AS t, CASE src WHEN 0 THEN 0.2 WHEN 1 THEN 0.07 ELSE 0 END AS b,
  greatest(-0.25, CASE WHEN low THEN -0.05 ELSE 0 END - CASE WHEN n = 0 THEN 0.14 WHEN made THEN 0.05 ELSE 0 END) AS w FROM o)
SELECT id, round(s, 3)::DOUBLE AS evidence_support, round(w, 3)::DOUBLE AS warning_penalty, round(x, 3)::DOUBLE AS object_score, CASE WHEN x >= 0.7 THEN 'high' WHEN x >= 0.38 THEN 'medium' ELSE 'low' END AS score_label FROM (SELECT *, round(least(1, greatest(0, a + i + s + c + t + b + w)), 9) AS x FROM e)""")
def object_scores(spark, sf):
    size, key = C("p_size"), C("p_partkey")
    item = lambda _: F.struct(F.concat(F.lit("on "), "p_brand").alias("snippet"), F.when(size % 3 == 0, "A Mock  paper").otherwise("Paper").alias("document_title"), F.lit("method").alias("evidence_role"), F.when(size % 2 == 0, "3 Proposed").otherwise("Body").alias("section_label"))
    note = lambda _: F.struct(C("p_brand").alias("title"), F.lit(None).cast("string").alias("short_preview"))
    several = lambda n, make: F.transform(F.sequence(F.lit(1), n + 1), make)
    objects = table_of(spark, sf, "part").select(
        key.alias("id"), C("p_name").alias("object_name"), F.lit(None).cast("string").alias("object_key"), F.when(size % 4 == 0, "method").otherwise("dataset").alias("object_type"), F.array("p_brand").alias("aliases"),
        F.when(key % 3 < 2, "object_candidates").otherwise("rules").alias("source"), F.when(key % 3 == 0, "mapped").otherwise("failed").alias("mapping_status"), F.when(key % 3 == 0, "accepted").alias("review_status"),
        F.when(key % 2 == 0, "Low").alias("confidence"), F.lit(None).cast("array<string>").alias("warnings"), F.slice(several(size % 6, item), F.lit(1), size % 6).alias("evidence"), F.slice(several((key % 5).cast("int"), note), F.lit(1), (key % 5).cast("int")).alias("notes"),
    )
    return X.object_scores(objects, "Brand  model").select("id", "evidence_support", "warning_penalty", "object_score", "score_label")


column_query("op_ret43_note_passage", "conversations", "conv_id, turn", lambda: X.note_passage(C("role"), F.lit(" "), C("text")), "role || CASE WHEN trim(text) <> '' THEN chr(10) || text ELSE '' END")
column_query("op_ret45_term_points", "conversations", "conv_id, turn", lambda: X.term_points(["the", "de", "the", "an"], C("text")), "(3.0 * (contains(lower(text), 'the')::INT + contains(lower(text), 'de')::INT + contains(lower(text), 'an')::INT))::DOUBLE")
column_query("op_ret46_library_rank", "part", "p_partkey", lambda: F.coalesce(X.library_rank("1", C("p_partkey").cast("string"), C("p_name"), C("p_brand")), F.lit(-1)), "CASE WHEN p_partkey = 1 THEN 0 WHEN lower(p_name) = '1' THEN 1 WHEN lower(p_name) LIKE '1%' THEN 2 WHEN contains(lower(p_brand), '1') THEN 3 ELSE -1 END")


@query("op_ret44_unified", "WITH p AS (SELECT user_id AS identity, max(value) AS score FROM events WHERE event_type = 'click' GROUP BY 1), pk AS (SELECT identity, score, 'pdf' AS kind FROM p WHERE (SELECT max(score) FROM p) < 4 OR score >= (SELECT max(score) FROM p) - 1.25), n AS (SELECT user_id AS identity, value AS score, 'note' AS kind FROM events WHERE event_type = 'view' AND value >= 0 AND (user_id % 4 >= 2 OR (value >= 0.5 AND value / 2 >= 0.65))), e AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY score DESC, kind) AS r FROM (SELECT * FROM pk UNION ALL SELECT * FROM n)) SELECT identity, score, kind FROM e WHERE r = 1 ORDER BY score DESC, identity LIMIT 60")
def unified(spark, sf):
    e = table_of(spark, sf, "events")
    papers = e.where("event_type = 'click'").groupBy(C("user_id").alias("identity")).agg(F.max("value").alias("score"))
    notes = e.where("event_type = 'view'").select(C("user_id").alias("identity"), C("value").alias("score"), (C("user_id") % 4).alias("shared"), (C("value") / 2).alias("semantic"))
    return X.unified(papers, notes, 60)


@query("op_ret33_prefilter_state", "SELECT CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'view') THEN 'unavailable' ELSE 'none' END AS state FROM events")
def prefilter(spark, sf):
    e = table_of(spark, sf, "events")
    return X.prefilter_state(e.select(F.when(C("event_type") == "error", "failed").when(C("event_type") == "view", "unavailable").otherwise("applied").alias("state")))


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


_RULE_ROWS = ", ".join(f"({k}, '{name}', {_list(markers)}, {_list(x.lower() for x in terms)}, {_list(x.lower() for x in anchors)}, '{policy}')" for k, (name, markers, terms, anchors, policy) in enumerate(N.RULES))


@query("op_ret22_expanded", f"""WITH r(place, rule, markers, terms, anchors, policy) AS (VALUES {_RULE_ROWS}),
q AS (SELECT item_id, trim(regexp_replace(text || CASE item_id % 5 WHEN 0 THEN ' Motion' WHEN 1 THEN ' 牛顿 MFA' WHEN 2 THEN ' TICe note' ELSE '' END, '\\s+', ' ', 'g')) AS c FROM benchmark),
m AS (SELECT item_id, string_agg(rule, ',' ORDER BY place) AS rules, list(terms ORDER BY place) AS ts, string_agg(rule || ':' || policy || ':' || array_to_string(anchors, '/'), ';' ORDER BY place) FILTER (len(anchors) > 0) AS groups FROM q JOIN r ON len(list_filter(markers, lambda x: contains(lower(c), x))) > 0 GROUP BY 1),
b AS (SELECT item_id, [lower(c)] || list_filter(regexp_extract_all(lower(c), '[a-z0-9_+.^-]+'), lambda w: length(w) >= 2 AND NOT list_contains({_list(N.STOPWORDS)}, w)) || list_filter({_list(N.MARKED)}, lambda w: contains(c, w)) || coalesce(flatten(ts), []) AS t, coalesce(rules, '') AS rules, coalesce(groups, '') AS groups FROM q LEFT JOIN m USING (item_id))
SELECT item_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS terms, rules, groups FROM b""")
def expanded(spark, sf):
    """Items of the benchmark as queries, some with a marker added."""
    k = C("item_id") % 5
    text = F.concat("text", F.when(k == 0, " Motion").when(k == 1, " 牛顿 MFA").when(k == 2, " TICe note").otherwise(""))
    out = N.expanded(table_of(spark, sf, "benchmark").select("item_id", text.alias("text")), N.rules_table(spark), "item_id", "text")
    group = lambda g: F.concat_ws(":", g["rule"], g["policy"], F.array_join(g["terms"], "/"))
    return out.select("item_id", F.array_join("terms", "|").alias("terms"), F.array_join("rules", ",").alias("rules"), F.array_join(F.transform("groups", group), ";").alias("groups"))
