"""Literal cases: CJK text, nulls, ties, orders, streams, generations and the index against SQLite's."""

import json
import os
import random
import sqlite3
import uuid

import pytest
from pyspark.sql import functions as F

from litengine.functions import text as T
from litengine.operators import fusion, ingest, lexical, relations, review, windows
from litengine.plans import query_plan as P
from litengine.sources import tables
from litengine.streaming import sync

C = F.col


def one(spark, expression, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]).select(expression).first()[0]


@pytest.mark.parametrize("length, spans", [(0, []), (700, [(0, 700)]), (701, [(0, 500), (450, 701)]), (950, [(0, 500), (450, 950)]), (951, [(0, 500), (450, 950), (900, 951)]), (1200, [(0, 500), (450, 950), (900, 1200)])])
def test_chunks(spark, length, spans):
    got = ingest.chunks(spark.createDataFrame([("x" * length,)], "text string")).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == spans and [r.chunk_index for r in got] == list(range(len(spans)))


def test_blank_windows_take_no_index(spark):
    got = ingest.chunks(spark.createDataFrame([("a" + " " * 1000 + "b",), (None,), ("   ",)], "text string")).orderBy("start").collect()
    assert [(r.chunk_index, r.chunk_text) for r in got] == [(0, "a"), (1, "b")]


def test_text_functions(spark):
    assert one(spark, T.normalize_for_search(C("x")), x=" State–of-the_Art!  ") == "state of the art"
    assert one(spark, T.infer_language(C("x")), x="图 model") == "mixed" and one(spark, T.infer_language(C("x")), x="42") == "und"
    assert one(spark, T.infer_language(C("x")), x=" \t") is None and one(spark, T.infer_language(C("x")), x="\u3456") == "zh"
    assert set(one(spark, T.token_set(C("x")), x="A1 b 图神经网络 图 神经")) == {"a1", "图神经网络", "图神", "神经", "经网", "网络"}
    assert one(spark, T.normalize_fingerprint(C("x")), x="Ünder A-b  图 3!") == "nder a b 图 3"
    assert one(spark, T.is_metadata(C("x")), x=" - Backend: z") and not one(spark, T.is_metadata(C("x")), x="the backend: page_count: 3")
    parts = ["图神经网", "神经网络", "图神经", "神经网", "经网络", "图神", "神经", "经网", "网络"]
    assert one(spark, T.query_tokens(C("x")), x="图神经网络 R-precision 图 a") == ["图神经网络", *parts, "R-precision"] and one(spark, T.query_tokens(C("x"), True), x=" A ") == ["a"]
    assert one(spark, T.query_tokens(C("x"), True), x="图神经网络 R-precision R-Precision") == ["图神经网络", *parts, "r-precision"]
    record = lambda title, *kinds: one(spark, T.is_test_record(C("t"), [C("k")], [C("k")]), t=title, k=kinds[0] if kinds else None)
    assert record("A Mock paper") and record("Test of time") and not record("Testing") and record("x", "Test_Seed") and record("x", "c:\\fixtures\\a.pdf") and not record("x", "seed")
    assert one(spark, T.uuid5(C("x")), x="http://a/b") == str(uuid.uuid5(uuid.NAMESPACE_URL, "http://a/b"))
    assert one(spark, T.parse_heading_path(C("x")), x='["A", " B "]') == ["A", "B"] and one(spark, T.parse_heading_path(C("x")), x="A::B") == ["A", "B"]
    assert one(spark, T.numbered_path(C("x")), x=["1 A", "2 B", "2.3 C", "2.3.1 D"]) == ["2 B", "2.3 C", "2.3.1 D"]
    assert one(spark, T.html_to_text(C("x")), x="<p>a &amp; b</p><ul><li>c</ul>") == "a & b\n\n- c"
    assert one(spark, T.hash_tokens(C("x")), x="A 图神") == ["a", "图", "神", "图神"]
    where = lambda x, page, path: one(spark, T.locator_contract(C("x"), F.lit(page).cast("int"), F.lit(path).cast("string")), x=x)
    assert (where(" ", None, None), where("a", 0, "p"), where(" ", 1, "p"), where("a", 1, ""), where("a", 1, "p")) == ("no_page", "no_page", "no_text", "pdf_missing", "page_level_only")


def test_plans():
    p = P.plan("R-precision")
    assert p.terms == ("r", "precision") and p.identifiers == ("r precision", "rprecision")
    assert P.plan('"foot sliding" mdm').phrases == ("foot sliding",) and P.plan("图").short and P.plan("图").cjk
    assert P.plan("gnn", {"g": ["GNN", "graph network"], "m": ["mdm"]}).aliases == ("graph network",) and P.plan("gnn x", {"g": ["gnn", "y"]}).aliases == ()
    with pytest.raises(ValueError):
        P.expanded_aliases("a", {"x": ["a"], "y": ["A"]})
    assert P.plan("a\u2015b").normal == "a b" and P.plan("x\u2212y").identifiers == () and P.plan("图神经").terms == ("图神经",)
    assert P.plan("T2M GPT").identifiers == ("t2m gpt", "t2mgpt") and P.plan("T2MGPT").identifiers == ("t2mgpt", "t2m gpt")
    assert P.plan("the ResNet 50 v2 model").identifiers == ("the resnet 50 v2 model", "theresnet50v2model", "50 v2 model", "50v2model")
    assert P.plan('"Foot Sliding" mdm x').normal == "foot sliding mdm x" and P.plan("mdm (two).").terms == ("mdm", "two")
    with pytest.raises(ValueError):
        P.plan("  ")
    assert P.recall_variants("R-precision") == ("R-precision", "r precision", "rprecision") and P.recall_variants("R  precision") == ("R precision", "rprecision")
    assert P.recall_variants("a cat") == ("a cat",) and P.recall_variants("I-beam") == ("I-beam",) and P.recall_variants("abcd-x1") == ("abcd-x1",) and P.recall_variants("kl\u2013loss") == ("kl\u2013loss", "kl loss", "klloss")
    # RET5: parts are all needed, whatever the query looks like; only a single part may be spelled otherwise.
    assert P.plan("GPT-2 residual blocks").required() == (("gpt", "2", "residual", "blocks"), True) and P.plan("T2M").required() == (("t2m",), False)
    assert P.plan("GPT-2").required() == (("gpt", "2"), True) and P.plan("x").required() == ((), False) and P.plan("gnn", {"g": ["gnn", "graph net"]}).required(True) == (("gnn", "graph net"), False)
    # RET6: the whole query counts among the terms.
    assert P.plan("图神经 model").substrings() == ("图神经 model", "图神经", "model") and P.plan("图神").substrings() == () and P.plan("model").substrings() == ()
    assert P.pool(0, 1) == 200 and P.pool(500, 100) == 2000


INDEXED = [
    (1, "graph neural network", "intro", "", "graph neural network models for graphs", "", ""),
    (2, "motion", "method", "gnn", "a graph of joints and a neural network", "graph neural network note", ""),
    (3, "other", "", "", "nothing relevant here", "", "graph neural context"),
    (4, "café résumé", "", "", "state-of-the-art baseline", "", ""),
]


@pytest.mark.parametrize("phrases, every, want", [(["graph", "neural"], True, [(1, 4e-6), (2, 3e-6), (3, 2e-6)]), (["graph neural network"], True, [(1, 2e-6), (2, 1e-6)]), (["cafe"], True, [(4, 1.610147)]), (["state of the art"], True, [(4, 0.957815)])])
def test_bm25_literals(spark, phrases, every, want):
    df = spark.createDataFrame(INDEXED, "id long, title string, section string, tags string, text string, note string, context string")
    got = lexical.bm25(df, lexical.postings(df, "id"), "id", phrases, every).orderBy(F.desc("bm25")).collect()
    assert [(r.id, round(r.bm25, 6)) for r in got] == want


def test_bm25_against_fts5(spark):
    rng, words = random.Random(1), ["graph", "net", "café", "joint", "the", "of", "model", "zürich"]
    rows = [(k, *(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(6))) for k in range(150)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(title, section, tags, text, note, context, tokenize='unicode61')")
    con.executemany("insert into t(rowid, title, section, tags, text, note, context) values (?, ?, ?, ?, ?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id long, title string, section string, tags string, text string, note string, context string")
    posted = lexical.postings(df, "id").cache()
    for phrases, every in ((["graph net"], True), (["zurich", "of the"], False), (["cafe", "model"], True)):
        match = (" AND " if every else " OR ").join(f'"{p}"' for p in phrases)
        want = {i: -s for i, s in con.execute("select rowid, bm25(t, 6.0, 3.0, 2.0, 1.0, 2.0, 0.75) from t where t match ?", (match,))}
        got = {r.id: r.bm25 for r in lexical.bm25(df, posted, "id", phrases, every).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_graded_matches(spark):
    from litengine.operators import review as V

    def graded(a, b, pa, pb):
        r = one(spark, V.annotation_score(C("a"), C("b"), C("pa"), C("pb")), a=a, b=b, pa=pa, pb=pb)
        return r.score, r.method, r.confidence

    assert graded("A graph!", "a  graph", 3, 3) == (1.0, "text_exact", "high") and graded("A graph!", "a graph", 3, 4) == (0.95, "text_exact", "high")
    assert graded("on a graph net", "graph net", None, 4) == (0.95, "text_contains", "high") and graded("graph", "on a graph", 1, 2) == (0.75, "normalized_overlap", "medium")
    assert graded("a b c", "c b z", 2, 2) == (0.85, "normalized_overlap", "medium") and graded("a b c", "x", 2, 2) == (0.35, "page_only", "low") and graded(None, "x", 2, 1) == (0.0, "unknown", "low")


def test_exact_matches_of_short_and_long_selections(spark):
    from litengine.operators import review as V

    notes = spark.createDataFrame([(1, "Graph"), (2, "raph neural networks learn m"), (3, "one two three"), (4, ""), (5, None), (6, "is a graph neural networks")], "note long, selected string")
    chunks = spark.createDataFrame([(10, "is a graph  neural networks learn much"), (11, "graph"), (12, "graphs one two threes"), (13, None), (14, "zero one two three")], "chunk long, text string")
    got = {(r.note, r.chunk, r.match) for r in V.exact_matches(notes, chunks, "note", "selected", "text").collect()}
    assert got == {(1, 10, 0.96), (1, 11, 1.0), (2, 10, 0.96), (3, 14, 0.96), (6, 10, 0.96)}


def test_scores_and_fusion(spark):
    row = spark.createDataFrame([(1.0, True, False, 1.0, True, False, False, False, None, "zotero_highlight")], "bm25 double, phrase_hit boolean, identifier_hit boolean, coverage double, title_hit boolean, section_hit boolean, tag_hit boolean, alias_hit boolean, note string, source_type string")
    assert round(lexical.scored(row).first().score, 6) == 10.30
    assert round(lexical.scored(row.withColumn("source_type", F.lit("pdf_chunk"))).first().score, 6) == 9.50
    keyword = spark.createDataFrame([(1, 1), (1, 4)], "id long, rank int")
    other = lambda x: spark.createDataFrame([(1, x)], "id long, points double")
    assert fusion.channel_fusion({"keyword": keyword, "vector": other(0.4), "tag": other(1.5)}, "id", 5).first().score == 7.15


def test_greedy_coverage(spark):
    rows = [("A", 1, "pdf", 10.0), ("B", 1, "pdf", 9.5), ("C", 2, "pdf", 9.0), ("D", 3, "note", 8.8)]
    df = spark.createDataFrame([(i, d, s, x, 1.0, k) for k, (i, d, s, x) in enumerate(rows)], "id string, document_id long, source_type string, score double, bm25 double, base_rank int")
    assert [r.id for r in lexical.diversified(df, "document_id", "source_type", "score", "id").orderBy("rank").collect()] == ["A", "D", "C", "B"]


def test_orders(spark):
    df = spark.createDataFrame([("v1", "a", 3.0), ("v1", "b", 2.0), ("v1", "c", 1.0), ("v2", "a", 2.0), ("v2", "d", 1.0)], "v string, id string, s double")
    assert [r.id for r in relations.interleaved(df, "v", "s", "id", 4).collect()] == ["a", "b", "d", "c"]
    papers = spark.createDataFrame([(1, "pdf", 7.98), (1, "pdf", 6.66), (1, "note", 0.1), (2, "pdf", 7.0), (2, "pdf", 6.0), (3, "note", 0.8)], "q long, kind string, score double")
    assert sorted(r.score for r in relations.near_best(papers, "q", "score", "kind", "pdf", 4.0, 1.25).collect()) == [0.1, 0.8, 6.0, 7.0, 7.98]
    notes = spark.createDataFrame([(1, 1, "t1"), (1, 2, "t2"), (1, 3, "t3"), (2, 1, "x")], "d long, at long, t string")
    got = {(r.d, r.at): (r.context_before, r.context_after, r.context_status) for r in relations.neighbour_context(notes, "d", ["at"], "t").collect()}
    assert got == {(1, 1): (None, "t2", "partial"), (1, 2): ("t1", "t3", "available"), (1, 3): ("t2", None, "partial"), (2, 1): (None, None, "no_source_context")}


def test_markdown_and_lines(spark):
    text = "lost\n# A\nx\n<!-- PDF_PAGE: 3 -->\ny\n## B\nz\n# C\n#### not a node"
    got = ingest.markdown_nodes(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "id").orderBy("node").collect()
    assert [(r.title, r.path, r.page, r.body, r.continuation) for r in got] == [("A", "A", None, "x", False), ("A", "A", 3, "y", True), ("B", "A / B", 3, "z", False), ("C", "C", 3, "#### not a node", False)]
    lines = spark.createDataFrame([(1, k, p, r, "w" * n) for k, (p, r, n) in enumerate([(1, "body", 60), (1, "body", 60), (1, "heading", 5), (1, "body", 30), (2, "body", 30)])], "id long, at long, page long, role string, text string")
    units = ingest.grouped_lines(lines, "id", "at", "page", "role", "text", 100).orderBy("unit").collect()
    assert [(r.line_start, r.line_end, r.page_start, r.page_end) for r in units] == [(0, 0, 1, 1), (1, 1, 1, 1), (2, 3, 1, 1), (4, 4, 2, 2)]


def test_evidence_and_review(spark):
    df = spark.createDataFrame([(1, 1, "values rise. It", "The observed ", " becomes complete. Next")], "d long, at long, text string, before string, after string")
    assert review.stitched(df, "d", "at", "text", "before", "after").first().evidence == "The observed values rise. It becomes complete."
    pairs = spark.createDataFrame([("abcdef", "xx abcdef yy"), ("abc", None), ("", "x")], "a string, b string")
    assert [r.ratio for r in windows.fuzzy(pairs, "a", "b").collect()][1:] == [0.0, 0.0]
    spark.createDataFrame([(1,)], "document_id long").createOrReplaceTempView("strange_table")
    assert "strange_table" in review.tables_with_column(spark, "document_id", [])
    same = relations.same_identity(spark.createDataFrame([(1, None)], "a long, b string"), spark.createDataFrame([(1, None, 9)], "a long, b string, id long"), ["a", "b"], "id")
    assert same.first().existing == 9


def test_generations(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert tables.active(spark, root)["state"] == "missing"
    first = tables.publish(spark, root, {"rows": spark.range(3).toDF("id")}, "f1")
    old = tables.generation(spark, root, "rows")
    second = tables.publish(spark, root, {"rows": spark.range(5).toDF("id")}, "f2")
    assert first != second and old.count() == 3 and tables.generation(spark, root, "rows").count() == 5
    assert tables.active(spark, root, "f1")["state"] == "stale" and tables.active(spark, root, "f2")["rows"] == {"rows": 5}
    (tmp_path / "b.md").write_text("# B")
    (tmp_path / "A.md").write_text("# A\nx")
    assert [r.text for r in tables.markdown_files(spark, root).collect()] == ["# A\nx", "# B"]
    (tmp_path / "v.jsonl").write_text('{"id": 1}\nnot json\n')
    assert [r.id for r in tables.jsonl(spark, f"{root}/v.jsonl", "id long").collect()] == [1, None]


def test_streams(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [  # file, operation, stage, status, whether it is accepted
        (0, "a", "body_import_started", "running", False), (0, "a", "confirmation_accepted", "accepted", True), (0, "b", "confirmation_accepted", "accepted", True),
        (1, "a", "publish_completed", "running", True), (1, "a", "publish_started", "running", False), (1, "a", "receipt_persisted", "committed", False),
        (2, "a", "final_verification_completed", "running", True), (2, "a", "receipt_persisted", "committed", True), (2, "a", "rollback_started", "running", False),
        (3, "c", "confirmation_accepted", "accepted", True), (3, "c", "odd", "running", False), (3, "c", "rollback_started", "running", True), (3, "c", "receipt_persisted", "failed", True), (4, "d", "confirmation_accepted", "accepted", True),
    ]
    for k in range(5):
        path = tmp_path / f"{k:03}.json"
        lines = [json.dumps({"operation_id": o, "seq": n, "stage": a, "status": s, "at": f"2024-01-01T0{k}:00:00Z"}) for n, (f, o, a, s, _) in enumerate(rows) if f == k]
        path.write_text("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # files come in the order of their times
    stream = spark.readStream.schema("operation_id string, seq long, stage string, status string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    out = sync.journal(stream.withWatermark("at", "0 seconds"), silence=90 * 60 * 1000)
    query = out.writeStream.format("memory").queryName("journal").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("journal").collect()
    assert sorted((r.seq, r.verdict == "accepted") for r in got if r.verdict != "timer") == [(n, x[4]) for n, x in enumerate(rows)]
    # b is silent for more than an hour and a half; a and c have ended; d is too young
    assert [(r.operation_id, r.stage, r.status, r.seq) for r in got if r.verdict == "timer"] == [("b", "confirmation_accepted", "orphaned", None)]
    seen = []
    sync.worker(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "c2")).awaitTermination(120)
    assert sum(seen) == len(rows)


def test_legal_moves():
    moves = sync.legal_moves()
    run = lambda a, b, t="running": (a, "running", b, t) in moves
    assert run("body_import_started", "rollback_started") and run("rollback_started", "rollback_completed") and not run("rollback_completed", "rollback_started")
    assert not run("rollback_started", "publish_started") and run("rollback_completed", "receipt_persisted", "failed") and not run("rollback_completed", "receipt_persisted", "committed")
    assert run("final_verification_completed", "receipt_persisted", "committed") and not run("publish_completed", "receipt_persisted", "committed") and not run("publish_completed", "publish_started")
    assert ("confirmation_accepted", "accepted", "confirmation_accepted", "orphaned") in moves and not any(s in ("committed", "failed", "orphaned") for _, s, _, _ in moves)
