"""The queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, decontamination, exact_dedup, language_id, lexical_search, line_dedup, mixing, ngram_join, pii, quality, substring_dedup, toxicity
from .common import documents


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir)).select("doc_id", "mix_topic", "mix_tokens", "mix_p", "mix_weight")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(documents(spark, sf_dir))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(g, ' ') AS g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: ws[i:i + 4]) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS g FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)
), r AS (SELECT doc_id AS x, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x)
SELECT r.x AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c)::BIGINT AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(documents(spark, sf_dir)).select("doc_id", "text")


OP3_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, i AS line_no, raw, lower(trim(raw)) AS line FROM (
    SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), d AS (
  SELECT *, row_number() OVER (ORDER BY first) AS id FROM (
    SELECT line, string_split(line, ' ') AS ws, min((doc_id, line_no)) AS first FROM l WHERE line <> '' GROUP BY line)
), v AS (
  SELECT id, unnest(range(0, len(ws) + 1)) AS place,
    unnest(list_concat([line], list_transform(range(1, len(ws) + 1), lambda i: array_to_string(list_concat(ws[:i - 1], ws[i + 1:]), ' ')))) AS v
  FROM d WHERE len(ws) >= 5
), e AS (
  SELECT a.id, list(DISTINCT b.id) AS earlier FROM v a JOIN v b ON a.v = b.v AND (a.place = b.place OR a.place = 0 OR b.place = 0) AND b.id < a.id GROUP BY ALL
), o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY id) AS i FROM e
), r(i, gone) AS (  -- in rank order, a line goes if one of those before it and near it has not gone
  SELECT 0::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT o.i, CASE WHEN len(list_filter(o.earlier, lambda x: NOT list_contains(r.gone, x))) > 0 THEN list_append(r.gone, o.id) ELSE r.gone END FROM r JOIN o ON o.i = r.i + 1
), g AS (SELECT unnest(gone) AS id FROM (SELECT gone FROM r ORDER BY i DESC LIMIT 1)
), k AS (
  SELECT l.doc_id, l.line_no, l.raw FROM l LEFT JOIN d ON d.line = l.line LEFT JOIN g ON g.id = d.id
  WHERE l.line = '' OR ((l.doc_id, l.line_no) = d.first AND g.id IS NULL)
)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce((SELECT string_agg(raw, chr(10) ORDER BY line_no) FROM k WHERE k.doc_id = documents.doc_id), '') END AS text
FROM documents
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.scored(docs, toxicity.fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(documents(spark, sf_dir))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.found(docs, pii.fit(docs))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_runs(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(docs, quality.fit(docs, labels))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the row of its text that stays; edge cases are those of exact_dedup.copies."""
    return exact_dedup.copies(documents(spark, sf_dir))


OP11_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size, sha256(t) AS text_sha256 FROM t GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM t JOIN g USING (t)
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item; edge cases are those of lexical_search.search."""
    return lexical_search.search(lexical_search.build(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), d AS (SELECT r, doc_id, len(ws)::BIGINT AS n FROM w WHERE len(ws) > 0
), s AS (SELECT count(*)::BIGINT AS cn, sum(n)::BIGINT AS cl FROM d
), q AS (
  SELECT i, item_id, term, count(*)::BIGINT AS times FROM (
    SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS term FROM w) GROUP BY ALL
), f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term
), m AS (SELECT d.r, d.doc_id, 100 - 75 + ((75 * n * cn) // cl) AS m FROM d, s
), c AS (
  SELECT i, item_id, r, doc_id, sum(times * floor(1000 * ln((2 * cn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN f USING (term) JOIN m USING (r), s GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM c WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) <= 10
"""


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizations of every document; edge cases are those of alignment.alignment_counts."""
    return alignment.alignment_counts(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mixing": mixing.oracle_sql(), "op2_ngram_join": OP2_SQL, "op3_line_dedup": OP3_SQL, "op11_exact_dedup": OP11_SQL, "op12_lexical_search": OP12_SQL,
    }
