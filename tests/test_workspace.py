"""Literal cases of objects, reranking and the workspace that the bundled tables lack."""

import pytest
from pyspark.sql import functions as F

from litengine.operators import fusion as X
from litengine.operators import ingest as I
from litengine.operators import objects as O
from litengine.operators import relations as R
from litengine.operators import workspace as W

OBJECT = "object_key string, id long, object_name string, object_type string, aliases array<string>, description string, evidence int, notes int, deprecated boolean, status string, profile string"


def objects(spark, *rows):
    return spark.createDataFrame(rows, OBJECT)


def test_lexical_objects_need_every_word_and_fall_back(spark):
    db = objects(
        spark,
        ("mdm", 2, "Motion Diffusion", "method", ["MDM"], None, 1, 0, False, "candidate", "p"),
        ("mdm", 1, "Motion Diffusion", "method", ["MDM"], None, 0, 0, False, "candidate", "p"),
        ("old", 3, "Motion Graph", "method", [], None, 0, 0, True, "hidden", "p"),
    )
    specs = objects(spark, ("foot", 9, "Foot Sliding", "problem", ["skate"], None, 2, 0, False, None, "p"), ("none", 8, "Foot Rest", "problem", ["skate"], None, 0, 0, False, None, "p"))
    ids = lambda q: [r.id for r in O.lexical_objects(db, q, specs).collect()]
    assert ids("diffusion  MOTION") == [1]
    assert ids("motion sliding") == [9]
    assert ids("graph") == []
    assert ids(" ") == []
    assert O.object_by_key(db, specs, " MDM ").first().id == 1
    assert O.object_by_key(db, specs, "foot").first().id == 9
    assert O.object_by_key(db, specs, "none").first() is None


def test_semantic_objects_put_exact_aliases_first(spark):
    db = objects(spark, ("a", 1, "foot sliding foot sliding", "m", [], None, 0, 0, False, "candidate", "foot sliding"), ("b", 2, "other", "m", ["Foot Sliding"], None, 0, 0, False, "candidate", "unlike words"), ("c", 3, "empty", "m", [], None, 0, 0, False, "candidate", " "))
    assert [(r.id, r.exact) for r in O.semantic_objects(db, "foot  sliding").collect()] == [(2, True), (1, False)]
    with pytest.raises(ValueError):
        O.semantic_objects(db, " ")


def test_semantic_passages_read_only(spark):
    d = spark.createDataFrame([(1, "T", "read"), (2, "T", "unread"), (3, "T", "mastered")], "document_id long, title string, read_status string")
    c = spark.createDataFrame([(10, 1, "h", "graph networks"), (11, 1, None, " "), (12, 1, "h", "Backend: x"), (20, 2, "h", "graph networks"), (30, 3, "", "unlike")], "chunk_id long, document_id long, heading string, chunk_text string")
    assert [r.chunk_id for r in O.semantic_passages(d, c, "graph networks").collect()] == [10, 30]
    assert [r.chunk_id for r in O.semantic_passages(d, c, "graph networks", document_ids=[3]).collect()] == [30]


def test_rerank_modes(spark):
    e = spark.createDataFrame([(1, 1, 0.5), (2, 2, 0.9), (3, 3, 0.5)], "id int, rank int, s double")
    assert [r.id for r in X.reranked(e, "none", "rank", "id", F.col("s")).collect()] == [1, 2, 3]
    assert [r.id for r in X.reranked(e, "heuristic", "rank", "id", F.col("s")).collect()] == [2, 1, 3]
    assert X.reranked(e, "external", "rank", "id").first().degraded_reason
    with pytest.raises(ValueError):
        X.reranked(e, "neural", "rank", "id")


def test_ordered_unique(spark):
    df = spark.createDataFrame([(["b", " a ", "", "b", None, "a"],), ([],)], "v array<string>")
    assert [(r.u.ids, r.u.repeated) for r in df.select(R.ordered_unique(F.col("v")).alias("u")).collect()] == [(["b", "a"], 2), ([], 0)]


def test_notebook_fragments(spark):
    rows = [("c1", "h1", "zotero_annotation_comment", 1, None, "n"), ("h1", None, "zotero_highlight", 1, None, "marked"), ("i1", "h1", "zotero_inspiration_note", 1, "synthetic_seed", "x"), ("p1", None, "pdf_chunk", 2, "synthetic_seed", "t")]
    df = spark.createDataFrame(rows, "fragment_id string, parent_fragment_id string, source_type string, document_id long, origin_kind string, text string")
    got = {r.fragment_id: r.selected_text for r in W.notebook_fragments(df).collect()}
    assert got == {"c1": "marked", "p1": None}
    assert [r.fragment_id for r in W.notebook_fragments(df, document_ids=[2]).collect()] == ["p1"]
    with pytest.raises(ValueError):
        W.notebook_fragments(df, ["personal"])


def test_preview_ladder(spark):
    c = spark.createDataFrame([(1, 1, "Backend: x", None, None), (2, 1, "t", 0, "a"), (3, 1, " ", 3, "a"), (4, 2, "t", 3, ""), (5, 1, "t " * 100, 3, None), (6, 9, "t", 3, "a")], "chunk_id int, document_id int, chunk_text string, page int, pdf_path string")
    d = spark.createDataFrame([(1, "A", "b.pdf"), (2, "B", None)], "document_id int, title string, pdf_path string")
    got = {r.chunk_id: r for r in W.chunk_preview(c, d).collect()}
    assert [got[k].locator_status for k in (1, 2, 3, 4, 5)] == ["metadata_non_locatable", "no_page", "no_text", "pdf_missing", "page_level_only"]
    assert 6 not in got and got[5].pdf_path == "b.pdf" and len(got[5].snippet) <= 160 and got[5].snippet.endswith("t...")


def test_session_of_nothing_is_not_ready(spark):
    schema = "text string, channels array<string>, tag_matches int, relations int, notes int, tags array<string>, score double, chunk_id long"
    none = W.research_session(spark.createDataFrame([], schema)).first()
    assert none.blocking == "no_results,no_evidence" and not none.ready and none.excluded == 0
    good = spark.createDataFrame([("t", ["note_link", "tag"], 1, 1, 1, [], 3.5, 7), ("mock data", ["keyword"], 0, 0, 0, [], 9.0, 8)], schema)
    row = W.research_session(good).first()
    assert row.ready and row.total_results == 1 and row.excluded == 1 and row.warning == ""


def test_rows_per_missing_column(spark):
    assert W.rows_per(spark.range(3), "chapter_id", "id").collect() == []


@pytest.mark.parametrize(
    "item, isbn, title, pages, paper, outline, chapters, want",
    [
        ("book", "", "", 40, False, False, 0, ("book", "chaptered", "high", False)),
        ("book", "", "", 40, True, False, 0, ("book", "full_document", "high", False)),
        (None, "978", "", 40, False, False, 0, ("book", "full_document", "medium", False)),
        (None, "", "博士论文", 100, False, False, 0, ("thesis", "full_document", "low", True)),
        (None, None, "x", 130, False, False, 0, ("other", "chaptered", "medium", True)),
        ("preprint", "", "", 20, False, False, 6, ("paper", "chaptered", "high", False)),
        ("film", "", "", 61, False, True, 0, ("other", "chaptered", "medium", True)),
    ],
)
def test_document_class(spark, item, isbn, title, pages, paper, outline, chapters, want):
    lit = lambda v: F.lit(v) if v is not None else F.lit(None).cast("string")
    made = I.document_class(lit(item), lit(isbn), lit(None), lit(title), F.lit(pages), F.lit(paper), F.lit(outline), F.lit(chapters))
    assert tuple(spark.range(1).select(made.alias("c")).first().c) == want
