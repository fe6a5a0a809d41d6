"""Lexical search over stored indexes: substrings against FTS5's trigrams, tables of queries, changes of single documents."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from litengine.operators import deltas as D
from litengine.operators import lexical as L
from litengine.plans import query_plan as P
from litengine.sources import tables as S

C = F.col
SCHEMA = "row_id long, document_id long, source_type string, title string, section string, tags string, text string, note string, context string"
LETTERS = ["图", "神", "经", "网", "络", "model", "Net", "ré", "a", "2", " ", " ", "-"]


def library(rng, documents, salt=""):
    """Rows of (row_id, document_id, source type and six columns); one document has very many chunks."""
    piece = lambda n: "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, n)))
    out = []
    for d in documents:
        for k in range(1500 if d == 3 else rng.randint(1, 3)):
            out.append(((d << L.ROW_BITS) + k, d, "pdf_chunk", piece(4), piece(3), piece(2), salt + piece(30), piece(3), piece(3)))
    return out


@pytest.fixture(scope="module")
def rows():
    return library(random.Random(6), [*range(1, 60), -4])


@pytest.fixture(scope="module")
def index(spark, rows):
    tables = L.index_tables(spark.createDataFrame(rows, SCHEMA).repartition(5), "row_id")
    return L.Index(*(S.written(df, f"test-{name}") for name, df in tables.items()))


@pytest.mark.parametrize("terms, every", [(["神经网"], True), (["神经网", "model"], True), (["图神 经网", "odeln", "etmo"], False), (["没有它"], True)])
def test_substrings_against_fts5(spark, rows, index, terms, every):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(title, section, tags, text, note, context, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no trigrams")
    con.executemany("insert into t(rowid, title, section, tags, text, note, context) values (?, ?, ?, ?, ?, ?, ?)", [(r[0], *r[3:]) for r in rows])
    match = (" AND " if every else " OR ").join(f'"{t}"' for t in terms)
    want = {i: max(0.0, -s) for i, s in con.execute("select rowid, bm25(t, 6.0, 3.0, 2.0, 1.0, 2.0, 0.75) from t where t match ?", (match,))}
    asked = L.local(spark, [(0, t, len(terms) if every else 1) for t in terms], "query_id int, term string, needed int")
    got = {r.row_id: r.bm25 for r in L.substring_scores(index, "row_id", asked).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_filters_reach_the_postings(spark, index, capfd):
    asked = L.local(spark, [(0, "神经网", 1)], "query_id int, term string, needed int")
    L.substring_candidates(index, "row_id", asked).explain("formatted")
    L.word_scores(index, "row_id", L.local(spark, [(0, "model", 1)], "query_id int, phrase string, needed int")).explain("formatted")
    plan = capfd.readouterr().out
    assert any("PushedFilters" in line and "gram" in line and "神经网" in line for line in plan.splitlines())
    assert any("PushedFilters" in line and "token" in line and "model" in line for line in plan.splitlines())


def test_row_numbers(spark):
    text = "x" * 600_000 + " end"
    from litengine.operators import ingest as I

    df = spark.createDataFrame([(7, text), (8, "short"), (-3, "other")], "doc_id long, text string")
    chunks = I.chunks(df).select("doc_id", L.row_id(C("doc_id"), C("chunk_index")).alias("id"))
    assert chunks.count() > 1300 and chunks.select("id").distinct().count() == chunks.count()
    assert chunks.where(L.document_of(C("id")) != C("doc_id")).count() == 0
    with pytest.raises(Exception, match="no row number"):
        spark.createDataFrame([(1 << 50, 0)], "d long, k int").select(L.row_id(C("d"), C("k"))).collect()


QUERIES = [(1, "神经网 model"), (2, '"net a" 2'), (3, "图"), (4, "a"), (5, "T2M"), (6, "model net"), (7, None), (8, "  "), (9, "神经"), (10, "ré-2 a")]


@pytest.mark.parametrize("coverage", [False, True])
def test_a_table_of_queries_is_like_each_query(spark, index, coverage):
    plans = P.planned(spark.createDataFrame(QUERIES, "query_id long, text string"), coverage=coverage)
    got = {}
    for r in L.search(index, "row_id", plans, 7, 1, coverage).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.row_id, round(r.score, 9)))
    for query_id, text in QUERIES:
        if query_id in (3, 6):
            want = [(r["rank"], r.row_id, round(r.score, 9)) for r in L.retrieved(index, "row_id", P.plan(text), 7, 1, coverage).collect()]
            assert sorted(got.get(query_id, [])) == sorted(want)
    assert set(got) >= {3, 4, 6, 9} and 7 not in got and 8 not in got


def test_changes_are_like_an_index_built_anew(spark, rows, index, tmp_path):
    rng, folder = random.Random(9), f"file://{tmp_path}/changes"
    assert D.merged(index, folder, "row_id") is index
    ids = lambda ds: spark.createDataFrame([(d,) for d in ds], "document_id long")
    first, second = library(rng, [5, 3, 90], "神经网 "), library(rng, [5], "model ")
    D.upsert(spark, folder, "row_id", ids([5, 3, 90]), spark.createDataFrame(first, SCHEMA))
    D.upsert(spark, folder, "row_id", ids([7, 8, 12345]), None)
    D.upsert(spark, folder, "row_id", ids([5]), spark.createDataFrame(second, SCHEMA))
    D.upsert(spark, folder, "row_id", ids([]), None)
    now = [r for r in rows if r[1] not in (5, 3, 7, 8)] + [r for r in first if r[1] != 5] + second
    anew = L.Index(*L.index_tables(spark.createDataFrame(now, SCHEMA), "row_id").values())
    changed = D.merged(index, folder, "row_id")
    for table in L.Index._fields:
        a, b = (sorted(map(repr, getattr(x, table).collect())) for x in (changed, anew))
        assert a == b
    for text in ("model a",):
        got, want = ([(r.row_id, round(r.score, 9)) for r in L.retrieved(x, "row_id", P.plan(text)).collect()] for x in (changed, anew))
        assert got == want and got


def test_an_unfinished_change_is_not_seen(spark, index, tmp_path):
    folder = f"file://{tmp_path}/changes"
    for table, df in L.index_tables(spark.createDataFrame(library(random.Random(1), [5]), SCHEMA), "row_id").items():
        df.write.parquet(f"{folder}/change-000001-left/{table}")
    assert D.merged(index, folder, "row_id") is index


def test_reranked_variants(spark):
    rows = [(k, k, "pdf_chunk", t, s, "", x, "", "") for k, (t, s, x) in enumerate([("T", "Method", "R precision is high"), ("T", "7 References", "rprecision of models"), ("T", "Body", "precision and R"), ("R", "Body", "r precision precision"), ("T", "Body", "nothing of it")])]
    index = L.Index(*L.index_tables(spark.createDataFrame(rows, SCHEMA), "row_id").values())
    got = L.reranked_variants(index, "row_id", spark.createDataFrame([("q", "R-precision"), ("n", None), ("z", "zzz")], "query_id string, text string")).orderBy("rank").collect()
    assert {r.row_id for r in got} == {0, 1, 2, 3} and {r.query_id for r in got} == {"q"}
    assert {r.row_id: r.tier for r in got} == {0: "primary", 1: "reference", 2: "primary", 3: "primary"} and got[0].row_id == 3
    assert {r.row_id: r.variant for r in got}[1] == 2
