"""The corpus pipeline: five stages from raw documents to a training mixture, each on what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litengine.llm import decontamination, language_id, line_dedup, mixing, ngram_join
from litengine.llm.common import documents, packed, stored, unpacked


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; without letters, or with a null text, none is."""
    return language_id.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, the earliest stay. Documents left without any characters go, n_chars follows the text."""
    kept = line_dedup.without_repeated_lines(docs).where("trim(text) <> ''")
    if "n_chars" not in docs.columns:
        return kept
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return unpacked(kept.select(F.struct("*").withField("n_chars", size).alias("row")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id. Rows without a doc_id stay."""
    groups = ngram_join.similar_sets(docs).where("doc_id <> component_id")
    gone = stored(groups.select("doc_id").distinct(), "near-duplicates")
    return unpacked(packed(docs).join(gone, "doc_id", "left_anti"), docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, word for word or edited, go."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample raked to target weights of sources, languages and topics; adds mix_topic, mix_tokens, mix_p and mix_weight."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_free),
    ("mixing", mixture),
]

#: SQL can't express the language model, so tests/llm/test_pipeline.py tests the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
