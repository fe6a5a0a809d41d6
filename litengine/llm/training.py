"""Bounded samples of labelled rows, for models that are fitted on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a sample holds at most, about, and bytes of one text in it: longer ones are scored, but not learned from.
SAMPLE_BYTES, TEXT_BYTES = 32 << 20, 1 << 20


def sample(rows: DataFrame, bound: int, by: str | None = None) -> pa.Table:
    """About `bound` rows and at most about `SAMPLE_BYTES` of text, chosen by a hash of doc_id, whole texts, in the order of doc_id.

    rows has columns doc_id and text, and bytes (of the text) where rows come from a join, which then needn't carry texts to count them. With `by`, each value of that column may take an equal part of the bounds, so that
    a rare one is learned from as well; its values are to be few (languages).
    """
    if "bytes" not in rows.columns:
        rows = rows.withColumn("bytes", F.octet_length("text"))
    rows = rows.where(F.col("bytes") <= TEXT_BYTES)
    key = F.col(by) if by else F.lit(0)
    sizes = rows.groupBy(key.alias("part")).agg(F.count(F.lit(1)).alias("there"), F.sum("bytes").alias("bytes")).toArrow().to_pylist()
    share = F.lit(0.0)
    for r in sizes:
        own = min(1.0, bound / len(sizes) / r["there"], SAMPLE_BYTES / len(sizes) / max(1, r["bytes"]))
        share = F.when(key.eqNullSafe(F.lit(r["part"])), F.lit(own)).otherwise(share) if by else F.lit(own)
    spot = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(spot < share).drop("bytes").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
