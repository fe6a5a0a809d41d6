"""The stages of the corpus pipeline, each against plain Python on its own input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from litengine.llm import decontamination, language_id, mixing

from .conftest import SCHEMA, clashing, prose
from .test_similarity import brute_components, brute_lines

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """The corpus with benchmark passages and a text in no language, as tables of a folder."""
    rng = random.Random(17)
    path = tmp_path_factory.mktemp("tables")
    items = [(k, prose(rng, 24, "de")) for k in range(6)]
    more = [(700 + k, f"{prose(rng, 40, 'de')} {items[k][1]} {prose(rng, 30, 'de')}", "de", "src1", 0) for k in range(6)] + [(800, "Ωβγδ ζηθ ξρσ τυφχ " * 9, None, "src1", 0)]
    docs.unionByName(spark.createDataFrame(more, SCHEMA)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def ids(frame):
    return Counter(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_on_their_own_input(spark, folder):
    rows = lambda frame: [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    model = language_id.fit(docs)
    known = STAGES["language_id"](spark, docs, folder)
    assert ids(known) == Counter(r.doc_id for r in language_id.predicted(docs, model).where("not rejected").collect())
    assert 800 not in ids(known) and not {300, 301, 304} & set(ids(known))

    before = rows(known)
    cut = STAGES["line_dedup"](spark, known, folder)
    gone = brute_lines(before)
    keep = lambda i, t: t if i is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
    want = Counter((i, keep(i, t)) for i, t in before)
    assert Counter(rows(cut)) == Counter({k: n for k, n in want.items() if k[1].strip(" ")})
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    before = rows(cut)
    apart = STAGES["ngram_join"](spark, cut, folder)
    component = brute_components(before)
    assert ids(apart) == Counter(i for i, _ in before if i is None or component[i] == i)

    clean = STAGES["decontamination"](spark, apart, folder)
    found = {r.doc_id for r in decontamination.contaminated(apart, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert set(range(700, 706)) <= found and ids(clean) == Counter({i: n for i, n in ids(apart).items() if i not in found})

    mixed = STAGES["mixing"](spark, clean, folder)
    cells = {(r._source, r._lang, r._topic): r.p for r in mixing.fitted(clean).collect()}
    spot = {r.doc_id: r.u for r in clean.select("doc_id", mixing.uniform().alias("u")).collect()}
    told = [(r.doc_id, cells[r._source, r._lang, r._topic]) for r in mixing.with_cells(clean).collect()]
    assert ids(mixed) == Counter(i for i, p in told if spot[i] < round(p, 9))


def test_run_on_odd_columns(spark, folder, tmp_path):
    """Names that the stages use, a dotted one, and columns in another order pass; the last stage adds its own."""
    docs = clashing(spark.read.parquet(f"{folder}/documents.parquet")).withColumns({"_id": F.lit(1), "a.b": F.lit("x"), "mix_p": F.lit(0.0), "row": F.lit(2)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [c for c in docs.columns if c != "mix_p"] + ["mix_topic", "mix_tokens", "mix_p", "mix_weight"]
    rows = got.collect()
    assert rows and all(r["a.b"] == "x" and r["_id"] == 1 for r in rows)


def test_run_on_nothing(spark, nothing, folder, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
