"""Pairs from inverted lists, long ones cut, against all pairs."""

import random

from pyspark.sql import functions as F

from litengine.operators import relations as R

C = F.col


def test_listed_pairs_of_cut_lists(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, [7] * (rng.random() < 0.6) + [rng.randrange(20) for _ in range(rng.randint(0, 3))] + [None] * (k % 9 == 0), [rng.randrange(30)] if k % 4 else None) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, notes array<int>, pages array<int>").repartition(3)
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                notes, pages = ({x for x in s[0] or [] if x is not None} & {x for x in s[1] or [] if x is not None} for s in ((a[1], b[1]), (a[2], b[2])))
                if notes or pages:
                    want[a[0], b[0]] = (len(notes), len(pages))
    for most in (1000, 10):
        monkeypatch.setattr(R, "LIST", most)
        got = R.listed_pairs(df, "id", {"notes": "notes", "pages": "pages"}, C("id"), [])
        assert {(r.id_l, r.id_r): (r.shared_notes, r.shared_pages) for r in got.collect()} == want
    assert R.listed_pairs(df.limit(0), "id", {"notes": "notes"}, C("id"), []).count() == 0


def test_relation_types(spark):
    kinds = [("dataset", "model", "evaluated_on_dataset", True), ("model", "method", "uses_method", False), ("method", "model", "uses_method", True), ("metric", "dataset", "related_to", False), ("concept", "concept", "related_to", False), ("other", "model", None, None)]
    df = spark.createDataFrame([k[:2] for k in kinds], "l string, r string").select("l", "r", R.relation_type(C("l"), C("r")).alias("t"))
    assert {(r.l, r.r, r.t and r.t.relation_type, r.t and r.t.swapped) for r in df.collect()} == set(kinds)


def test_freshness(spark):
    tables = spark.createDataFrame([(3, 3, 0, 0, 0), (2, 2, 0, 0, None)], "source long, indexed long, missing long, stale long, orphan long")
    assert R.freshness(tables, True).first().state == "current" and R.freshness(tables, False).first().state == "unavailable"
    assert R.freshness(tables, True, "old model").first().reason == "old model" and R.freshness(tables.limit(0), True).first().complete
    drift = R.freshness(tables.unionByName(spark.createDataFrame([(4, 3, 1, 0, 0)], tables.schema)), True).first()
    assert drift.state == "source_drift" and drift.count_mismatch and drift.drift_count == 1
