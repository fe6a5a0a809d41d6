"""Literal cases of index states, requests, gates and keys: nulls, empty tables, repeated rows."""

from pyspark.sql import functions as F

from litengine.operators import lexical as L
from litengine.operators import states as S

C = F.col


def one(spark, **columns):
    """The values of expressions over one row."""
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first().asDict()


def test_sync(spark):
    source = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (None, "n")], "id long, h string")
    index = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "id long, h string")
    actions = S.sync_actions(source, index, "id", ["h"])
    assert {(r.id, r.action) for r in actions.collect()} == {(1, "skip"), (2, "update"), (3, "insert"), (4, "orphan"), (None, "insert")}
    dry, wet = S.sync_stats(actions, dry_run=True).first(), S.sync_stats(actions, delete_orphans=True).first()
    assert (dry.scanned, dry.inserted, dry.updated, dry.deleted_orphans, dry.would_insert, dry.would_update, dry.would_delete) == (4, 0, 0, 0, 2, 1, 0)
    assert (wet.inserted, wet.updated, wet.skipped, wet.orphans, wet.deleted_orphans) == (2, 1, 1, 1, 1)
    assert S.sync_stats(S.sync_actions(source.limit(0), index.limit(0), "id", ["h"])).first().scanned == 0


def test_gate_and_fallback(spark):
    lit, no = F.lit, F.lit(None)
    gate = one(spark, a=S.sync_gate(lit(1), lit(2), 3), b=S.sync_gate(lit(0), no, 3), c=S.sync_gate(lit(4), lit(0), 3), d=S.sync_gate(lit(1), lit(0), 3, enabled=False))
    assert gate == {"a": True, "b": False, "c": False, "d": False}
    why = lambda *x: S.fallback_reason(*(lit(v) for v in x))
    got = one(spark, a=why(False, "vector_manifest_missing", None, True, 1, 1, 0), b=why(None, "", None, True, 1, 1, 0), c=why(True, None, "old", False, 1, 2, 0), d=why(True, None, "", None, 1, 1, 0), e=why(True, None, None, True, 2, 2, 1), f=why(True, None, None, True, None, 0, None))
    assert got == {"a": "vector_store_unavailable", "b": "vector_store_unavailable", "c": "old", "d": "vector_table_missing", "e": "vector_store_source_drift", "f": None}


def test_note_plan(spark):
    fields = "id long, kind string, h string, s string"
    now = spark.createDataFrame([(1, "x", "a", "m"), (2, "x", "a", "m"), (3, "y", "a", "m"), (4, "y", "a", "m")], fields)
    before = spark.createDataFrame([(1, "x", "a", "m", True), (2, "x", "a", "n", True), (3, "y", "a", "m", None), (5, None, "a", "m", True)], fields + ", ok boolean")
    got = {(r.id, r.kind, r.state, r.metadata_only) for r in S.note_plan(now, before, "id", "kind", ["h"], ["s"], "ok").collect()}
    assert got == {(1, "x", "reused", False), (2, "x", "reused", True), (3, "y", "changed", False), (4, "y", "added", False), (5, "unknown", "removed", False)}
    assert {r.state for r in S.note_plan(now, before, "id", "kind", ["h"], ["s"], "ok", compatible=False).collect()} == {"changed", "added", "removed"}


def test_validation(spark):
    t = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    r = S.index_validation(t, {"words": t, "trigram": t.limit(0)}, "id", 3).first()
    assert (r.ordinary_count, r.words_count, r.trigram_count, r.duplicate_ids, r.count_match, r.valid) == (3, 3, 0, 1, False, False)
    assert S.index_validation(t.distinct(), {"words": t}, "id").first().valid


def test_requests(spark):
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "id long")
    known = spark.createDataFrame([(1, None), (2, "archived")], "id long, s string")
    assert {tuple(r) for r in S.request_warnings(asked, known, "id", "s").collect()} == {(2, "requested_document_archived"), (3, "requested_document_not_found")}
    assert S.request_warnings(asked.limit(0), known, "id", "s").count() == 0


def test_notes_and_keys(spark):
    terms = one(spark, a=S.concept_terms(F.lit("The of THE r2d2 图神经网 网 x")), b=S.concept_terms(F.lit(None).cast("string")))
    assert sorted(terms["a"]) == sorted(["the", "r2d2", "图神", "神经", "经网"]) and terms["b"] == []
    rel = lambda text, a, b: S.note_relevant("graph network pose", F.lit(text), F.lit(a), F.lit(b))
    got = one(spark, a=rel("Pose of a GRAPH", 0.0, None), b=rel("Pose of a GRAPH", -0.1, 0.9), c=rel("pose", 0.5, 0.65), d=rel(None, 0.5, 0.64))
    assert got == {"a": True, "b": False, "c": True, "d": False}
    key = lambda *x: S.shelf_key(*(F.lit(v).cast("string") for v in x))
    got = one(spark, a=key(" A  b\n", "C:\\X", "K"), b=key("A", " ", "K "), c=key(None, "p", "k"), d=key("a", None, None))
    assert got == {"a": "title_pdf:a b|c:/x", "b": "title_zotero:a|k", "c": None, "d": None}
    names = lambda q, *n: S.exact_name(q, F.array(*[F.lit(x).cast("string") for x in n]))
    assert one(spark, a=names("R-Precision", None, "r_precision"), b=names(" -", ""), c=names("a", "ab")) == {"a": True, "b": False, "c": False}
    assert one(spark, a=S.matches_fields("Re-ID", [F.lit(None).cast("string"), F.lit("person re id")]), b=S.matches_fields("x", [F.lit("y")])) == {"a": True, "b": False}


def test_source_points(spark):
    got = one(spark, a=L.source_points(F.lit("zotero_annotation_comment")), b=L.source_points(F.lit("pdf_chunk")), c=L.source_points(F.lit("odd")), d=L.source_points(F.lit("markdown_note")))
    assert {k: round(v, 6) for k, v in got.items()} == {"a": 0.9, "b": 0.0, "c": 0.0, "d": 0.6}
