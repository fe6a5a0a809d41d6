"""Verdicts, gaps and references by literal cases: nulls, empty tables and repeated rows among them."""

from pyspark.sql import functions as F

from litengine.operators import library, review

REPORT = (
    "source_recorded boolean, database_ok boolean, foreign_key_issues int, fts_ready boolean, missing_pdf_chunk_count int, orphan_pdf_chunk_count int, missing_personal_note_count int, orphan_personal_note_count int, "
    "vectors_available boolean, passage_missing_count int, note_missing_count int, passage_orphan_count int, note_orphan_count int, vector_reasons array<string>, wrote boolean, journal_failures array<string>, "
    "pdf_warning string, excluded_notes int, history_recorded boolean, journal_warnings array<string>"
)
GOOD = (True, True, 0, True, 0, 0, 0, 0, True, 0, 0, 0, 0, [], False, [], None, 0, True, [])


def test_verdicts(spark):
    names = [x.split()[0] for x in REPORT.split(", ")]
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(names, GOOD, strict=True))
    cases = [
        (GOOD, "pass", []),
        (change(note_orphan_count=None, excluded_notes=3, pdf_warning="pdf_gone"), "warn", ["vector_note_orphan_count_not_available", "pdf_gone", "personal_notes_excluded_from_fts:3"]),
        (change(journal_failures=["late"], journal_warnings=["slow", "slow"], history_recorded=None), "fail", ["historical_events_not_recorded", "slow", "late"]),
        (change(fts_ready=None, foreign_key_issues=2, missing_pdf_chunk_count=1, wrote=True), "fail", ["database_foreign_key_issues", "fts_not_ready", "fts_missing_pdf_chunk_count", "read_only_contract_violated"]),
        (change(vectors_available=False, note_orphan_count=1, vector_reasons=["table"]), "fail", ["vector_inspection:table", "vector_store_unavailable", "vector_note_orphan_count"]),
    ]
    df = spark.createDataFrame([(k, x[0]) for k, x in enumerate(cases)], f"k int, r struct<{REPORT.replace(' ', ':').replace(',:', ',')}>")
    got = df.select("k", library.integrity_verdict(F.col("r")).alias("v")).orderBy("k").collect()
    assert [(r.v.verdict, r.v.reasons) for r in got] == [(v, reasons) for _, v, reasons in cases]


def test_gaps(spark):
    questions = spark.createDataFrame([(1, "How large is it?"), (2, "size and time"), (3, None), (4, "x")], "q long, question string")
    evidence = spark.createDataFrame(
        [
            (2, "chunk", 4, "the size of it, an ablation"), (2, "note", None, "n"), (2, "tag", None, "t"), (2, "relation", None, None), (2, None, None, "odd"),
            (3, "chunk", None, "mock data"), (3, "chunk", None, "a dummy"), (4, "chunk", 1, "plain"), (4, "note", None, "lorem ipsum"), (None, "chunk", 1, "nobody's"),
        ], "q long, kind string, page int, text string",
    )
    dimensions = {"size": ["large", "SIZE"], "time": ["time"]}
    got = {r.q: r.gaps for r in review.evidence_gaps(questions, evidence, "q", dimensions).collect()}
    assert got == {
        1: ["no_chunks", "no_notes", "no_tags", "no_relations", "dimension:size"], 2: ["dimension:time"],
        3: ["no_notes", "no_tags", "no_relations", "no_pages", "test_data", "only_test_data"], 4: ["no_tags", "no_relations", "test_data", "few"],
    }
    assert review.gap_text("dimension:size") == "当前 evidence 未覆盖问题维度：size。" and review.gap_text("few") == review.GAPS["few"]
    assert [r.gaps[0] for r in review.evidence_gaps(questions, evidence.limit(0), "q", dimensions).collect()] == ["no_chunks"] * 4


def test_unknown_references(spark):
    spark.createDataFrame([(1, 7), (1, 8), (2, 7), (None, None)], "document_id long, chunk_id long").createOrReplaceTempView("refs_a")
    spark.createDataFrame([(9,)], "source_doc_id long").createOrReplaceTempView("refs_b")
    spark.createDataFrame([(1,)], "document_id long").createOrReplaceTempView("refs_known")
    spark.createDataFrame([(1,)], "other long").createOrReplaceTempView("refs_plain")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    got = review.unknown_references(spark, ids(1, 1, None), ids(7), ["refs_known"], "refs_*").collect()
    assert sorted((r.relation, r.column, r.n) for r in got) == [("refs_a", "chunk_id", 2), ("refs_a", "document_id", 2)]
    assert review.unknown_references(spark, ids(1), ids(7), [], "nothing_*").count() == 0
