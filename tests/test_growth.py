"""What may not grow faster than the input: shuffles of builds, pairs of rows and queries, work for each chunk; and ties as SQL has them."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__ as entry
from litengine.functions import text
from litengine.operators import fusion, ingest, lexical, library, ranges
from litengine.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_of_equal_places_the_first_row_counts(spark, tmp_path):
    n = 400
    made = pa.table({"l_orderkey": [k // 4 for k in range(n)], "l_linenumber": pa.array([1] * n, pa.int32()), "l_partkey": [k // 8 for k in range(n)], "l_suppkey": [k % 3 for k in range(n)], "l_quantity": [float(n - k if k % 2 else k) for k in range(n)]})
    pq.write_table(made, tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = con.sql(entry.oracle_sql()["op_agg20_merged_candidates"]).fetchall()
    assert {tuple(r) for r in entry.queries()["op_agg20_merged_candidates"](spark, str(tmp_path)).collect()} == set(want)


def test_rows_without_a_place_or_value_do_not_come_first(spark, tmp_path):
    """Nulls in every column: DuckDB's min_by passes over rows whose number or quantity is null, also where no other row is left."""
    rng = random.Random(20)
    some = lambda share, x: None if rng.random() < share else x
    rows = [{"l_orderkey": some(0.2, k), "l_linenumber": some(0.1, k % 7), "l_partkey": some(0.05, rng.randrange(150)), "l_suppkey": some(0.3, k % 5), "l_quantity": some(0.3, float(k))} for k in range(400)]
    rows += [{"l_orderkey": 1, "l_linenumber": 1, "l_partkey": 900, "l_suppkey": None, "l_quantity": None}, {"l_orderkey": None, "l_linenumber": 1, "l_partkey": 901, "l_suppkey": 3, "l_quantity": 2.0}]
    kinds = pa.schema([("l_orderkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_partkey", pa.int64()), ("l_suppkey", pa.int64()), ("l_quantity", pa.float64())])
    pq.write_table(pa.Table.from_pylist(rows, kinds), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = con.sql(entry.oracle_sql()["op_agg20_merged_candidates"]).fetchall()
    got = [tuple(r) for r in entry.queries()["op_agg20_merged_candidates"](spark, str(tmp_path)).collect()]
    assert set(got) == set(want) and len(got) == len(want)
    assert {(900, "", None), (901, "3", None)} <= set(got)


def test_runs_that_cannot_win_are_not_compared(monkeypatch):
    calls, overlap = [], ranges._overlap
    monkeypatch.setattr(ranges, "_overlap", lambda a, b: calls.append(1) or overlap(a, b))
    chunk = frozenset(f"w{k}" for k in range(40))
    rows = [(k, k, True, frozenset({f"w{k % 40}"}), 1.0 if k < 10 else 0.4, False) for k in range(64)]
    value, n, start, run = ranges._best_window(chunk, rows, 10)
    assert (n, start, [r[0] for r in run]) == (10, 0, list(range(10)))
    assert len(calls) < 64


def test_embedding_shuffles_texts_once(spark):
    df = spark.createDataFrame([(1, "the ring The"), (1, "牛顿 ring"), (2, "..."), (3, None), (4, "a_1 é")], "k long, t string")
    got = fusion.hash_embedding(df, "k", "t")
    assert plan(got).count("Exchange hashpartitioning") == 1
    rows = {r.k: r.vector for r in got.collect()}
    assert set(rows) == {1, 4} and all(abs(sum(x * x for x in v) - 1) < 1e-12 and len(v) == 256 for v in rows.values())
    both = fusion.hash_embedding(spark.createDataFrame([(1, "the ring The 牛 ring 顿 牛顿")], "k long, t string"), "k", "t").first().vector
    assert sum(a * b for a, b in zip(both, rows[1], strict=True)) > 0.8  # rows of one key are one text


def test_index_is_built_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "Café the the", None), (2, "the İs", "x-1")], "id long, text string, title string")
    full = rows.select("id", "text", "title", *[F.lit("").alias(c) for c in ("section", "tags", "note", "context")])
    for df in lexical.index_tables(full, "id").values():
        assert "Exchange" not in plan(df)
    got = sorted(tuple(r) for r in lexical.postings(full, "id").collect())
    assert got == sorted([(1, "text", 0, "cafe", True, 3), (1, "text", 1, "the", True, 3), (1, "text", 2, "the", False, 3), (2, "title", 0, "x", True, 4), (2, "title", 1, "1", True, 4), (2, "text", 0, "the", True, 4), (2, "text", 1, "is", True, 4)])


def test_chunks_walk_through_a_text_once(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é𝄞\n ") for _ in range(n)) for n in (1, 700, 701, 950, 951, 1400, 1401, 5000)] + ["a" + " " * 1500 + "b"]
    df = ingest.chunks(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    assert "regexp_extract_all" in plan(df)
    got = {}
    for r in df.collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.chunk_text, r.overlap_before, r.overlap_after))
    for k, t in enumerate(texts):
        n, size = len(t), 500 if len(t) > 700 else len(t)
        starts = range(0, max(0, -(-(n - 500) // 450)) * 450 + 1, 450) if n > 700 else [0]
        want = [(s, min(n, s + size), t[s : s + size].strip(" "), t[max(0, s - 50) : s], t[min(n, s + size) : s + size + 50]) for s in starts if t[s : s + size].strip(" ")]
        assert sorted(got.get(k, [])) == want


def test_rows_come_to_a_query_by_its_rarest_parts(spark, monkeypatch):
    seen, written = {}, tables.written
    monkeypatch.setattr(tables, "written", lambda df, name: seen.setdefault(name, written(df, name)))
    held = {k: {"the"} | ({"rare"} if k % 50 == 0 else set()) | ({"ing"} if k % 3 == 0 else set()) for k in range(200)}
    parts = spark.createDataFrame([(p, k, float(len(p) + k)) for k, ps in held.items() for p in ps], "phrase string, id long, part double")
    asked = [(1, ["the", "rare"], 2), (2, ["the", "ing", "rare"], 2), (3, ["ing", "none"], 1), (4, ["the", "none"], 2), (5, ["the", "rare", "the"], 3)]
    table = spark.createDataFrame([(q, p, n) for q, ps, n in asked for p in ps], "query_id int, phrase string, needed int")
    got = {(r.query_id, r.id): r.bm25 for r in lexical._held(parts, table, "phrase", "id").collect()}
    assert got == {(q, k): sum(len(p) + k for p in ps if p in held[k]) for q, ps, n in asked for k in held if sum(p in held[k] for p in ps) >= n}
    assert {r.phrase for r in seen["first"].where("query_id = 1").collect()} == {"rare"}


def test_a_token_is_stored_once_a_segment(spark, tmp_path):
    n, text = 400, "the ring the café ÀÉ x_1 ﾊ 𝄞 İs 图神经网 the"
    rows = spark.createDataFrame([(k, "pdf_chunk", text if k % 4 else None, "图" * (k % 5)) for k in range(n)], "id long, source_type string, text string, title string").repartition(2)
    full = rows.select("*", *[F.lit("").alias(c) for c in ("section", "tags", "note", "context")])
    stored = tables.store(spark, f"file://{tmp_path}/index", lexical.stored_tables(full, "id"))
    assert stored["postings"].where("token = 'the'").count() <= 2 and stored["grams"].where("gram = '图神经'").count() <= 2
    assert {r.token: (r.n, r.df) for r in lexical.terms(stored["postings"]).collect()}["the"] == (900, 300)
    opened, plain = lexical.opened(stored, "id"), lexical.Index(*lexical.index_tables(full, "id").values())
    for a, b in zip(opened, plain, strict=True):
        assert sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))


def test_batches_become_one_sorted_segment():
    texts = ["the ring", "", None, "a ring the the é", "x" * 40, "Ring"]
    batches = [pa.record_batch({"id": [7 - k << 40], "a": [t or ""], "b": ["the" if k % 2 else ""]}) for k, t in enumerate(texts)]
    (segment,) = lexical._posted(iter(batches))
    tokens = segment["token"].to_pylist()
    assert tokens == sorted(tokens) and segment["packed"].type == pa.binary()
    got = [(t, o["row"], o["field"], o["at"], o["words"], o["first"]) for t, of in zip(tokens, lexical._occurrences(segment["packed"]).to_pylist(), strict=True) for o in of]
    want = []
    for k, t in enumerate(texts):
        fields = [(t or "").lower().replace("é", "e").split(), ["the"] * (k % 2)]
        for field, words in enumerate(fields):
            want += [(w, 7 - k << 40, field, at, sum(map(len, fields)), w not in words[:at] and (field == 0 or w not in fields[0])) for at, w in enumerate(words)]
    assert sorted(got) == sorted(want)
    sliced = lexical._occurrences(segment["packed"].slice(1, 3)).to_pylist()
    assert sliced == lexical._occurrences(segment["packed"]).to_pylist()[1:4]


def test_grams_are_sorted_once(monkeypatch):
    monkeypatch.delattr(lexical.np, "unique")
    rng = random.Random(9)
    texts = [["".join(rng.choice("图神经a Bé𠀀") for _ in range(rng.randint(0, 12))) for _ in range(60)] for _ in range(2)]
    batch = pa.record_batch({"id": [k - 30 << 40 for k in range(60)], "a": texts[0], "b": texts[1]})
    got = [(g, r) for s in lexical._gram_lists(iter([batch.slice(0, 7), batch.slice(7)])) for g, rows in zip(s["gram"].to_pylist(), lexical._rows_packed(s["packed"]).to_pylist(), strict=True) for r in rows]
    assert got == sorted(set(got))
    assert set(got) == {(t[i : i + 3], k - 30 << 40) for column in texts for k, t in enumerate(x.lower() for x in column) for i in range(len(t) - 2) if any("\u3400" <= c <= "\u9fff" for c in t[i : i + 3])}
    # So many different characters that a gram and a row don't fit one number: the piece is halved.
    wide = "".join(map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x110000)])).lower()
    piece = pa.record_batch({"id": list(range(16)), "a": [wide] + ["图神经"] * 15})
    parts = list(lexical._grams(piece))
    assert len(parts) > 1 and sorted(r for s in parts for g, rows in zip(s["gram"].to_pylist(), lexical._rows_packed(s["packed"]).to_pylist(), strict=True) if g == "图神经" for r in rows) == list(range(1, 16))


def test_pieces_lose_no_row(monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT", 100)
    monkeypatch.setattr(lexical, "ROW", 1)
    rng = random.Random(5)
    texts = ["x" * rng.choice([0, 3, 40, 99, 100, 250]) for _ in range(300)]
    whole = pa.record_batch({"id": list(range(300)), "t": texts})
    for step in (1, 7, 300):
        pieces = list(lexical._pieces(whole.slice(k, step) for k in range(0, 300, step)))
        assert [i for p in pieces for i in p["id"].to_pylist()] == list(range(300))
        assert all(p.num_rows == 1 or sum(len(t) + 1 for t in p["t"].to_pylist()) <= 100 for p in pieces)
        assert len(pieces) < 300


def test_postings_of_one_query_are_read_once(spark, monkeypatch):
    seen, written = [], tables.written
    monkeypatch.setattr(tables, "written", lambda df, name: seen.append(name) or written(df, name))
    df = spark.createDataFrame([(k, "the ring" if k % 2 else "the") for k in range(9)], "id int, text string")
    full = df.select("id", "text", *[F.lit("").alias(c) for c in ("title", "section", "tags", "note", "context")])
    got = lexical.bm25(full, lexical.postings(full, "id"), "id", ["the ring"], True)
    assert "found" in seen and sorted(r.id for r in got.collect()) == [1, 3, 5, 7]


def test_words_of_segments_are_those_of_expressions(spark):
    texts = [f"a{chr(c)}B {chr(c)}" for c in range(1, 0x3100)] + ["", " ", "x", "İstanbul ŠĐ", "\U0001d11e\U00020000 q"]
    # Characters that the JVM's Unicode doesn't know yet are left out.
    known = spark.createDataFrame(list(enumerate(texts)), "k int, t string").where(~F.col("t").rlike(r"\p{Cn}")).orderBy("k").select("t", lexical.tokens(F.col("t")).alias("w")).collect()
    texts, want = [r.t for r in known], [r.w for r in known]
    assert len(texts) > 11000
    letters, begins, of = lexical._cut(texts)
    got = [[] for _ in texts]
    for k, w in zip(of, lexical._strings(letters, begins).to_pylist(), strict=True):
        got[k].append(w)
    assert [(t, a, b) for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_a_text_is_normalised_once_for_metadata(spark):
    df = spark.createDataFrame([(1, "  Backend:  x"), (2, "plain text"), (3, None), (4, "a page_count: PAGES_with_text:\n headings_detected:")], "k int, t string")
    told = df.where(~text.is_metadata(F.col("t")))
    assert plan(told).count("regexp_replace") == 1 and [r.k for r in told.collect()] == [2]


def test_chunks_of_one_key_stay_where_they_are(spark):
    chunks = spark.createDataFrame([(1, k, "the ring" if k % 2 else "x", "", "", "") for k in range(50)], "k int, chunk_id int, text string, heading string, title string, section string")
    spec = spark.createDataFrame([(1, "o", ["Ring", "the"])], "k int, object string, aliases array<string>")
    got = library.match_strength(spec, chunks, "k")
    assert "BroadcastHashJoin" in plan(got) and "SortMergeJoin" not in plan(got) and "hashpartitioning(k" not in plan(got)
    assert sorted(r.chunk_id for r in got.collect()) == list(range(1, 50, 2))
