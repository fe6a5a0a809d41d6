"""FIL, J and SET over the bundled tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import ranges as G
from ..operators import relations as R
from ..sources import tables as S
from . import query, table_of
from .ingest import STARTS

C = F.col
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op_fil1_fragment_filter", "SELECT doc_id, source FROM documents WHERE lang IN ('en', 'de') AND contains(source, 'c1') AND n_chars >= 500 AND n_chars <= 4000")
def fragment_filter(spark, sf):
    return R.fragments_where(table_of(spark, sf, "documents"), {"lang": ["en", "de"], "source": []}, {"source": "C1"}, {"n_chars": 500}, {"n_chars": 4000}).select("doc_id", "source")


@query("op_fil2_substring_predicate", f"SELECT doc_id FROM documents WHERE (contains({FOLD.format('text')}, 'trash') OR contains({FOLD.format('source')}, 'src1')) AND lang = 'en'")
def substring_predicate(spark, sf):
    return R.any_contains(table_of(spark, sf, "documents"), ["text", "source"], "sRc1", {"lang": "en"}).unionByName(R.any_contains(table_of(spark, sf, "documents"), ["text"], "TRASH", {"lang": "en"})).select("doc_id").distinct()


for name, columns, terms in (("op_fil3_tag_conditions", ["n_name"], ["A", "1"]), ("op_fil4_relation_conditions", ["n_name", "n_nationkey::VARCHAR"], ["in", "7"]), ("op_fil5_note_conditions", ["n_name"], ["a", "q"])):
    sql = " OR ".join(f"contains({FOLD.format(c)}, '{t.lower()}')" for c in columns for t in terms)
    query(name, f"SELECT n_nationkey FROM nation WHERE {sql}")(lambda spark, sf, columns=columns, terms=terms: R.any_term(table_of(spark, sf, "nation").withColumn("n_nationkey::VARCHAR", C("n_nationkey").cast("string")), [f"`{c}`" for c in columns], terms).select("n_nationkey"))


@query("op_fil6_whole_token", "SELECT doc_id FROM documents WHERE contains(' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ', ' is ') ORDER BY doc_id LIMIT 50")
def whole_token(spark, sf):
    return R.whole_token(table_of(spark, sf, "documents"), "text", "doc_id", "is", 50).select("doc_id")


@query("op_fil7_id_prefilter", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE vec_id % 7 = 3 ORDER BY score DESC, vec_id LIMIT 20")
def id_prefilter(spark, sf):
    from ..functions.vectors import dot

    e = table_of(spark, sf, "embeddings")
    asked = e.where("vec_id = 0").select(C("embedding").alias("q"))
    scored = e.where("vec_id % 7 = 3").join(F.broadcast(asked)).select("vec_id", F.round(dot("embedding", "q"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20)


@query("op_fil8_requested_documents", "SELECT id, CASE WHEN doc_id IS NULL THEN 'missing' WHEN n_chars > 2000 THEN 'archived' ELSE 'found' END AS state FROM (SELECT DISTINCT unnest([3, 1, 2, 3, 17, 99999999])::BIGINT AS id) LEFT JOIN documents ON doc_id = id")
def requested(spark, sf):
    return R.requested(table_of(spark, sf, "documents").withColumn("gone", C("n_chars") > 2000), [3, 1, 2, 3, 17, 99999999], "doc_id", "gone")


@query("op_fil10_low_relevance_cutoff", "SELECT event_id, value FROM (SELECT *, max(CASE WHEN event_type = 'click' THEN value END) OVER (PARTITION BY user_id) AS best FROM events) WHERE event_type <> 'click' OR coalesce(best, -1e308) < 4 OR value >= best - 1.25")
def cutoff(spark, sf):
    return R.near_best(table_of(spark, sf, "events"), "user_id", "value", "event_type", "click", 4.0, 1.25).select("event_id", "value")


@query("op_fil13_minimum_score", "SELECT event_id FROM events WHERE NOT (event_type = 'view' AND value < 0.15)")
def minimum_score(spark, sf):
    return table_of(spark, sf, "events").where(~((C("event_type") == "view") & (C("value") < 0.15))).select("event_id")


@query("op_fil14_library_filters", f"SELECT p_partkey, p_name FROM part WHERE contains({FOLD.format('p_name')}, 'an') AND coalesce(p_size, 0) <= 25 ORDER BY p_partkey LIMIT 20")
def library_filters(spark, sf):
    return R.any_contains(table_of(spark, sf, "part"), ["p_name"], "AN").where(F.coalesce("p_size", F.lit(0)) <= 25).orderBy("p_partkey").limit(20).select("p_partkey", "p_name")


@query("op_j1_inner_join", "SELECT o_orderkey, l_linenumber, l_quantity::DOUBLE AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def inner_join(spark, sf):
    o, l = table_of(spark, sf, "orders"), table_of(spark, sf, "lineitem")
    return o.where("o_orderstatus = 'F'").join(l, C("o_orderkey") == C("l_orderkey")).select("o_orderkey", "l_linenumber", C("l_quantity").cast("double").alias("quantity"))


@query("op_j2_left_joins", "SELECT c_custkey, n_name, o_orderkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1 LEFT JOIN orders ON o_custkey = c_custkey")
def left_joins(spark, sf):
    c, n, o = (table_of(spark, sf, t) for t in ("customer", "nation", "orders"))
    return c.join(n.where("n_regionkey = 1"), C("n_nationkey") == C("c_nationkey"), "left").join(o, C("o_custkey") == C("c_custkey"), "left").select("c_custkey", "n_name", "o_orderkey")


@query("op_j4_bridge_labels", "SELECT cust, string_agg(k || ':' || l, ' ' ORDER BY k, l) AS labels FROM (SELECT DISTINCT o_custkey AS cust, l_returnflag AS k, l_linestatus AS l FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY cust")
def bridge_labels(spark, sf):
    o = table_of(spark, sf, "orders").select(C("o_custkey").alias("cust"), C("o_orderkey").alias("ok"))
    l = table_of(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "ok")
    return R.bridged(o.select("cust").distinct(), o, l, "cust", "ok", C("l_returnflag"), C("l_linestatus")).select("cust", F.array_join("labels", " ").alias("labels"))


@query("op_j5_join_chain", "SELECT r_name, count(*) AS n, round(sum(l_extendedprice::DOUBLE), 2) AS price FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY r_name")
def join_chain(spark, sf):
    r, n, c, o, l, s = (table_of(spark, sf, t) for t in ("region", "nation", "customer", "orders", "lineitem", "supplier"))
    df = l.join(o, C("l_orderkey") == C("o_orderkey")).join(c, C("o_custkey") == C("c_custkey")).join(n, C("c_nationkey") == C("n_nationkey")).join(r, C("n_regionkey") == C("r_regionkey")).join(s, C("l_suppkey") == C("s_suppkey"))
    return df.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(C("l_extendedprice").cast("double")), 2).alias("price"))


@query("op_j8_hydration", "SELECT e.vec_id, e.label, s.score FROM (SELECT doc_id, max(quality)::DOUBLE AS score FROM labels GROUP BY doc_id) s JOIN embeddings e ON e.vec_id = s.doc_id WHERE e.label > 3")
def hydration(spark, sf):
    s = table_of(spark, sf, "labels").groupBy(C("doc_id").alias("vec_id")).agg(F.max("quality").cast("double").alias("score"))
    return table_of(spark, sf, "embeddings").where("label > 3").join(s, "vec_id").select("vec_id", "label", "score")


@query("op_j9_score_merge", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.s, 0.0)::DOUBLE AS keyword, coalesce(b.s, 0.0)::DOUBLE AS vector FROM (SELECT user_id AS k, round(sum(value), 4) AS s FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id AS k, round(max(value), 4) AS s FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.k = b.k")
def score_merge(spark, sf):
    e = table_of(spark, sf, "events")
    side = lambda t, f, name: e.where(C("event_type") == t).groupBy(C("user_id").alias("k")).agg(F.round(f("value"), 4).alias(name))
    return R.merged_scores(side("click", F.sum, "keyword"), side("purchase", F.max, "vector"), "k", "keyword", "vector")


def _turns(spark, sf):
    return table_of(spark, sf, "conversations").select("conv_id", "turn", "role")


RANGES = "(SELECT conv_id, min(turn) AS lo, CASE WHEN max(turn) > 3 THEN 3 END AS hi FROM conversations GROUP BY conv_id)"


def _ranges(spark, sf):
    return _turns(spark, sf).groupBy("conv_id").agg(F.min("turn").alias("lo"), F.when(F.max("turn") > 3, 3).alias("hi"))


@query("op_j10_interval_join", f"SELECT c.conv_id, c.turn, r.lo, coalesce(r.hi, -1)::BIGINT AS hi FROM conversations c JOIN {RANGES} r ON r.conv_id = c.conv_id AND c.turn BETWEEN r.lo AND coalesce(r.hi, r.lo)")
def interval_join(spark, sf):
    return G.held(_turns(spark, sf), _ranges(spark, sf), "conv_id", "turn", "lo", "hi").select("conv_id", "turn", "lo", F.coalesce(C("hi"), F.lit(-1)).cast("long").alias("hi"))


@query("op_j12_interval_left_join", f"SELECT c.conv_id, c.turn, coalesce(r.lo, -1)::BIGINT AS lo FROM conversations c LEFT JOIN {RANGES} r ON r.conv_id = c.conv_id AND c.turn BETWEEN r.lo AND coalesce(r.hi, r.lo)")
def interval_left_join(spark, sf):
    return G.held(_turns(spark, sf), _ranges(spark, sf), "conv_id", "turn", "lo", "hi", ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce(C("lo"), F.lit(-1)).cast("long").alias("lo"))


def _pages(start, end):
    """Pages of 3000 characters from one position to another, from 1."""
    return (F.floor(start / 3000) + 1).cast("long").alias("page_start"), (F.floor((end - 1) / 3000) + 1).cast("long").alias("page_end")


def _paged_chunks(spark, sf):
    return I.chunks(S.spread(table_of(spark, sf, "documents"), "doc_id")).select("doc_id", C("chunk_index").cast("long").alias("chunk"), *_pages(C("start"), C("end")), "chunk_text")


@query("op_j11_page_candidates", f"WITH s AS (SELECT doc_id, text, unnest({STARTS}) AS start FROM documents WHERE length(text) > 0), c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk, start, least(length(text), start + CASE WHEN length(text) > 700 THEN 500 ELSE length(text) END) AS stop FROM s WHERE trim(substr(text, start + 1, CASE WHEN length(text) > 700 THEN 500 ELSE length(text) END)) <> '') SELECT l.doc_id, 1 + quality + toxic AS page, chunk FROM labels l JOIN c ON c.doc_id = l.doc_id AND 1 + quality + toxic BETWEEN start // 3000 + 1 AND (stop - 1) // 3000 + 1")
def page_candidates(spark, sf):
    """Labels as notes on one of the first three pages of their documents, with the chunks that may hold them."""
    notes = table_of(spark, sf, "labels").select("doc_id", (C("quality") + C("toxic") + 1).cast("long").alias("page"))
    return G.held(notes, _paged_chunks(spark, sf).drop("chunk_text"), "doc_id", "page", "page_start", "page_end").select("doc_id", "page", "chunk")


def _page_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole texts: doc_id, line, page of the character they begin with, text."""
    for batch in batches:
        cut = pc.split_pattern(batch.column("text"), "\n")
        text, at = pc.list_flatten(cut), pc.list_parent_indices(cut)
        n = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        start = np.cumsum(n) - n
        first = np.flatnonzero(np.diff(at.to_numpy(zero_copy_only=False), prepend=-1))
        first = np.repeat(first, np.diff(first, append=len(n)))  # of each line's document
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array(np.arange(len(n)) - first), pa.array((start - start[first]) // 3000 + 1), text], ["doc_id", "line", "page", "text"])


@query("op_aln6_chunk_lines")
def chunk_lines(spark, sf):
    """Lines of documents as those of pages of 3000 characters, with the chunks they were cut into."""
    documents = S.spread(table_of(spark, sf, "documents"), "doc_id").select("doc_id", "text")
    lines = documents.mapInArrow(_page_lines, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, line long, page long, text string")
    # Exploded as arrays of one, since Spark would work out a role once for each of its uses.
    role = F.explode(F.array(I.layout_role(C("text"), *(F.lit(x) for x in (0, 300, 500, 320, 600, 800)))))
    return G.aligned_lines(_paged_chunks(spark, sf), lines.select("doc_id", "page", C("line").alias("line_index"), "line", "text", role.alias("role")), "doc_id", span=2)


@query("op_j13_nearest_page", "SELECT ident, page, offset_rank FROM (SELECT a.conv_id * 100 + a.turn AS ident, b.turn AS page, s.r AS offset_rank, min(s.r) OVER (PARTITION BY a.conv_id * 100 + a.turn) AS best FROM conversations a CROSS JOIN (VALUES (0, 0), (1, 1), (2, -1)) s(r, d) JOIN (SELECT * FROM conversations WHERE turn % 3 = 0) b ON b.conv_id = a.conv_id AND b.turn = a.turn + s.d) WHERE offset_rank = best")
def nearest_page(spark, sf):
    t = _turns(spark, sf)
    points = t.select("conv_id", "turn", (C("conv_id") * 100 + C("turn")).alias("ident"))
    return R.nearest_page(points, t.where("turn % 3 = 0").select("conv_id", C("turn").alias("page")), "conv_id", "turn", "page", "ident").select("ident", "page", "offset_rank")


@query("op_j14_anti_joins", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0) AND c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 5 = 0 AND s_nationkey < 20)")
def anti_joins(spark, sf):
    o = table_of(spark, sf, "orders").where("o_orderkey % 7 = 0").withColumnRenamed("o_custkey", "c_custkey")
    s = table_of(spark, sf, "supplier").where("s_suppkey % 5 = 0 and s_nationkey < 20").withColumnRenamed("s_nationkey", "c_nationkey")
    return R.without(table_of(spark, sf, "customer"), (o, ["c_custkey"]), (s, ["c_nationkey"])).select("c_custkey")


@query("op_j15_tombstones", "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1 WHERE l.doc_id IS NULL")
def tombstones(spark, sf):
    return R.without(table_of(spark, sf, "documents"), (table_of(spark, sf, "labels").where("toxic = 1"), ["doc_id"])).select("doc_id")


@query("op_j16_orphans", "SELECT count(*) AS orphans FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id WHERE l.doc_id IS NULL")
def orphans(spark, sf):
    return R.orphans(table_of(spark, sf, "embeddings"), table_of(spark, sf, "labels"), "vec_id", "doc_id")


@query("op_j17_wide", "SELECT user_id, min(value) FILTER (event_type = 'click') AS click, min(value) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def wide(spark, sf):
    return R.wide(table_of(spark, sf, "events"), "user_id", "event_type", "value", ["click", "view"])


@query("op_j18_resolved", "SELECT p_brand AS brand, CASE count(DISTINCT p_size) WHEN 0 THEN 'missing' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT p_size) = 1 THEN min(p_size) ELSE -1 END::BIGINT AS candidate FROM part GROUP BY p_brand")
def resolved(spark, sf):
    return R.resolved(table_of(spark, sf, "part").withColumnRenamed("p_brand", "brand"), "brand", "p_size").withColumn("candidate", F.coalesce(C("candidate"), F.lit(-1)).cast("long"))


@query("op_j19_first_source", "SELECT DISTINCT k, d, p AS priority FROM (SELECT *, min(p) OVER (PARTITION BY k) AS best FROM (SELECT lang AS k, doc_id AS d, 0 AS p FROM documents WHERE n_chars > 20000 UNION ALL SELECT lang, doc_id, 1 FROM documents WHERE n_chars > 5000)) WHERE p = best")
def first_source(spark, sf):
    d = table_of(spark, sf, "documents").select(C("lang").alias("k"), C("doc_id").alias("d"), "n_chars")
    return R.first_source([d.where("n_chars > 20000"), d.where("n_chars > 5000")], "k", "d")


@query("op_j20_group_pairs", "SELECT a.n_nationkey AS l, b.n_nationkey AS r, CASE WHEN a.n_name < b.n_name THEN 'before' ELSE 'after' END AS kind FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def group_pairs(spark, sf):
    out = R.pairs_of_groups(table_of(spark, sf, "nation"), "n_regionkey", "n_nationkey", ["n_name"])
    return out.select(C("n_nationkey_l").alias("l"), C("n_nationkey_r").alias("r"), F.when(C("n_name_l") < C("n_name_r"), "before").otherwise("after").alias("kind"))


KINDS = ["research_problem", "method", "algorithm", "concept", "metric", "dataset", "mechanism_candidate", "other", "theorem_or_principle", "model", "experiment_candidate"]
OBJECTS_SQL = f"""SELECT p_partkey AS id, p_name AS name, {KINDS!r}[1 + p_size % {len(KINDS)}] AS t, p_partkey % 41 AS g, [p_partkey // 12, 1000000 + (p_partkey + 6) // 12] AS ns, [p_partkey // 5] AS cs, [p_partkey // 9 + p_size % 2] AS ps
FROM part WHERE p_size % 17 <> 3"""


def relation_sql():
    """J20 and J21 over all pairs."""
    m, c = "('method', 'algorithm', 'model', 'experiment_candidate')", "('concept', 'theorem_or_principle')"
    both = m[:-1] + ", " + c[1:]
    rules = [("('research_problem')", both, "addresses_problem", True), ("('metric')", m, "evaluates_with_metric", True), ("('dataset')", m, "evaluated_on_dataset", True), ("('mechanism_candidate')", both, "suggests_mechanism", False), ("('algorithm', 'model')", "('method')", "uses_method", False), (m, c, "supports", False)]
    cases = " ".join(f"WHEN l.t IN {a} AND r.t IN {b} THEN '{k} {second}' WHEN r.t IN {a} AND l.t IN {b} THEN '{k} {not second}'" for a, b, k, second in rules)
    order = "list_position(['research_problem', 'method', 'algorithm', 'model', 'concept', 'theorem_or_principle', 'metric', 'dataset', 'experiment_candidate', 'mechanism_candidate'], t)"
    return f"""WITH o AS (SELECT *, (coalesce({order}, 999), lower(name), id::VARCHAR) AS o FROM ({OBJECTS_SQL})),
p AS (SELECT l.id AS l, r.id AS r, CASE {cases} WHEN l.t IN {c} AND r.t IN {c} OR l.t = 'metric' OR r.t = 'metric' THEN 'related_to False' END AS k,
  len(list_intersect(l.ns, r.ns)) > 0 AS n, len(list_intersect(l.cs, r.cs)) > 0 AS c, len(list_intersect(l.ps, r.ps)) > 0 AS p
  FROM o l JOIN o r ON abs(l.id - r.id) < 30 AND l.o < r.o AND l.g <> r.g AND lower(trim(l.name)) <> lower(trim(r.name))),
q AS (SELECT *, coalesce(split_part(k, ' ', 1), 'related_to') AS relation_type, coalesce(k LIKE '% True', false) AS swapped FROM p WHERE n OR (c AND k IS NOT NULL) OR (p AND k NOT LIKE 'related_to%')),
v AS (SELECT *, CASE WHEN n AND relation_type <> 'related_to' THEN 0.72 WHEN c AND relation_type <> 'related_to' THEN 0.66 WHEN n THEN 0.58 WHEN c THEN 0.56 WHEN p THEN 0.54 ELSE 0.5 END AS x FROM q)
SELECT relation_type, CASE WHEN swapped THEN r ELSE l END AS subject_id, CASE WHEN swapped THEN l ELSE r END AS object_id, CASE WHEN n THEN 'shared_source_server_note_id' WHEN c THEN 'shared_evidence_chunk_id' ELSE 'same_page_type_compatibility' END AS basis,
  CASE WHEN relation_type = 'related_to' THEN least(x, 0.58) ELSE x END::DOUBLE AS confidence FROM v"""


@query("op_j20_relation_candidates", relation_sql())
def relation_candidates(spark, sf):
    """Parts as approved objects, neighbours of which share notes, chunks and pages."""
    k, size = C("p_partkey"), C("p_size")
    part = lambda x, n: F.floor(x / n).cast("long")
    objects = table_of(spark, sf, "part").select(
        k.alias("id"), C("p_name").alias("name"), F.array(*map(F.lit, KINDS))[size % len(KINDS)].alias("object_type"), (k % 41).cast("string").alias("dedup_group"),
        F.array(part(k, 12), part(k + 6, 12) + 1000000).alias("notes"), F.array(part(k, 5)).alias("chunks"), F.array(part(k, 9) + size % 2).alias("pages"), (size % 17 == 3).alias("synthetic"),
    )
    return R.relation_candidates(objects)


@query("op_j25_touching", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)) OR (l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3))")
def touching(spark, sf):
    e = table_of(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.lit("p").alias("pt"), F.lit("s").alias("st"))
    ids = table_of(spark, sf, "supplier").where("s_nationkey = 3")
    return R.touching(e, [(("l_partkey", "pt"), "p"), (("l_suppkey", "st"), "s")], ids, "s_suppkey").select("l_orderkey", "l_linenumber").distinct()


@query("op_j26_same_identity", "SELECT a.event_id, coalesce(min(b.event_id), -1) AS existing FROM events a LEFT JOIN (SELECT event_id, user_id, event_type, CASE WHEN value > 1 THEN NULL ELSE 1 END AS v FROM events) b ON a.user_id IS NOT DISTINCT FROM b.user_id AND a.event_type IS NOT DISTINCT FROM b.event_type AND (CASE WHEN a.value > 1 THEN NULL ELSE 1 END) IS NOT DISTINCT FROM b.v GROUP BY 1")
def same_identity(spark, sf):
    e = table_of(spark, sf, "events").select("event_id", "user_id", "event_type", F.when(C("value") > 1, None).otherwise(1).alias("v"))
    return R.same_identity(e, e, ["user_id", "event_type", "v"], "event_id").select("event_id", F.coalesce("existing", F.lit(-1)).cast("long").alias("existing"))


@query("op_j27_union_ids", "SELECT DISTINCT doc_id AS id FROM labels UNION SELECT vec_id FROM embeddings")
def union_ids(spark, sf):
    return table_of(spark, sf, "labels").select(C("doc_id").alias("id")).union(table_of(spark, sf, "embeddings").select("vec_id")).distinct()


@query("op_j28_core_semi_joins", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5) UNION SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def core_semi_joins(spark, sf):
    o, c, l = (table_of(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    a = o.join(c.where("c_nationkey = 5"), C("o_custkey") == C("c_custkey"), "left_semi")
    return a.select("o_orderkey").union(o.join(l.where("l_quantity = 50"), C("o_orderkey") == C("l_orderkey"), "left_semi").select("o_orderkey")).distinct()


@query("op_set1_difference", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'retained' ELSE 'changed' END AS state FROM (SELECT doc_id AS k, quality AS v FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id AS k, toxic AS v FROM labels WHERE doc_id % 3 <> 0) b ON a.k = b.k")
def difference(spark, sf):
    l = table_of(spark, sf, "labels").withColumnRenamed("doc_id", "k")
    return R.difference(l.where("k % 5 <> 0").select("k", C("quality").alias("v")), l.where("k % 3 <> 0").select("k", C("toxic").alias("v")), "k", "v")


@query("op_set2_field_changes", "SELECT field, count(*) AS n FROM (SELECT unnest([CASE WHEN a.lang IS DISTINCT FROM b.lang THEN 'lang' END, CASE WHEN a.source IS DISTINCT FROM b.source THEN 'source' END]) AS field FROM documents a JOIN documents b ON b.doc_id + 1 = a.doc_id) WHERE field IS NOT NULL GROUP BY field")
def field_changes(spark, sf):
    d = table_of(spark, sf, "documents").select("doc_id", "lang", "source")
    return R.field_changes(d.withColumn("doc_id", C("doc_id") + 1), d, "doc_id", ["lang", "source"])


@query("op_set6_sync_counts", "SELECT count(a.k) AS source, count(b.k) AS indexed, count(*) FILTER (b.k IS NULL) AS missing, count(*) FILTER (a.k IS NULL) AS orphan, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND a.v IS DISTINCT FROM b.v) AS stale, 'source_drift' AS state FROM (SELECT doc_id AS k, quality AS v FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id AS k, toxic AS v FROM labels WHERE doc_id % 3 <> 0) b ON a.k = b.k")
def sync_counts(spark, sf):
    l = table_of(spark, sf, "labels").withColumnRenamed("doc_id", "k")
    return R.sync_counts(l.where("k % 5 <> 0").select("k", C("quality").alias("v")), l.where("k % 3 <> 0").select("k", C("toxic").alias("v")), "k", ["v"])


@query("op_set6_freshness", "WITH t AS (SELECT count(a.k) AS source, count(b.k) AS indexed, count(*) FILTER (b.k IS NULL) AS missing, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL AND a.v IS DISTINCT FROM b.v) AS stale, count(*) FILTER (a.k IS NULL) AS orphan FROM (SELECT doc_id AS k, quality AS v FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id AS k, toxic AS v FROM labels WHERE doc_id % 3 <> 0) b ON a.k = b.k UNION ALL SELECT count(*), count(*), 0, 0, 0 FROM documents) SELECT sum(source)::BIGINT AS source, sum(indexed)::BIGINT AS indexed, sum(missing)::BIGINT AS missing, sum(stale)::BIGINT AS stale, sum(orphan)::BIGINT AS orphan, bool_or(source <> indexed) AS count_mismatch, sum(missing + stale + orphan)::BIGINT AS drift_count, 'source_drift' AS state, 'vector_store_source_drift' AS reason, false AS complete FROM t")
def freshness(spark, sf):
    l, d = table_of(spark, sf, "labels").withColumnRenamed("doc_id", "k"), table_of(spark, sf, "documents").select(C("doc_id").alias("k"), C("lang").alias("v"))
    passages = R.sync_counts(l.where("k % 5 <> 0").select("k", C("quality").alias("v")), l.where("k % 3 <> 0").select("k", C("toxic").alias("v")), "k", ["v"])
    return R.freshness(passages.unionByName(R.sync_counts(d, d, "k", ["v"])), True)


@query("op_dup1_duplicate_candidates", "SELECT doc_id, duplicate, CASE WHEN duplicate THEN array_to_string(list_sort(list_filter(ids, lambda x: x <> doc_id)), ' ') END AS peers FROM (SELECT doc_id, list_sort(list_distinct(list(lang) OVER w)) = ['de', 'en'] AS duplicate, list(doc_id) OVER w AS ids FROM (SELECT *, length(text) AS len FROM documents) WINDOW w AS (PARTITION BY len))")
def duplicate_candidates(spark, sf):
    d = table_of(spark, sf, "documents").withColumn("len", F.length("text"))
    return R.duplicate_candidates(d, "len", "lang", "doc_id", ["en", "de"]).select("doc_id", "duplicate", F.array_join("peers", " ").alias("peers"))


@query("op_dup2_collapsed", "SELECT doc_id, sources FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS r, array_to_string(list_sort(list_distinct(list(source) OVER (PARTITION BY text))), ' ') AS sources FROM documents) WHERE r = 1")
def collapsed(spark, sf):
    d = table_of(spark, sf, "documents").withColumn("sources", F.array("source")).withColumn("g", F.sha2("text", 256))
    return R.collapsed(d, "g", [F.desc("n_chars"), C("doc_id")], ["sources"]).select("doc_id", F.array_join("sources", " ").alias("sources"))


@query("op_dup5_import_duplicates", "SELECT new_id, known_id, min(r) AS priority, string_agg(DISTINCT reason, ' ' ORDER BY reason) AS reasons FROM (SELECT a.doc_id AS new_id, b.doc_id AS known_id, 0 AS r, 'text' AS reason FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 10 = 0 AND b.doc_id % 10 <> 0 UNION ALL SELECT a.doc_id, b.doc_id, 1, 'n_chars' FROM documents a JOIN documents b ON a.n_chars = b.n_chars WHERE a.doc_id % 10 = 0 AND b.doc_id % 10 <> 0) GROUP BY 1, 2")
def import_duplicates(spark, sf):
    d = table_of(spark, sf, "documents")
    new, known = d.where("doc_id % 10 = 0").withColumnRenamed("doc_id", "new_id"), d.where("doc_id % 10 <> 0").withColumnRenamed("doc_id", "known_id")
    return R.import_duplicates(new, known, ["text", "n_chars"], "new_id", "known_id").withColumn("reasons", F.array_join("reasons", " "))
