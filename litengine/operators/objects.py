"""Objects (methods, datasets, concepts) found by their words, by meaning, by key, or by a chunk that holds them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources.tables import written
from . import fusion, library

C = F.col

# Sizes of recall, of results, and of what is embedded.
RECALL, RESULTS, MOST, LEXICAL_MOST, PROFILE, PASSAGE, PASSAGES = 30, 50, 50, 20, 800, 1200, 50


def compact(x: Column) -> Column:
    """White space of any kind as single spaces, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def unless_any(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The rows where another table has none: looks at one row of it."""
    return rows.join(first.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti")


def lexical_objects(objects: DataFrame, query: str, specs: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """RET38: objects with status candidate whose fields hold every word of a query (words of two characters and more), each key once, best first.

    Both tables have object_key, id, object_name, object_type, aliases, description, evidence, notes and deprecated; objects also status.
    Where no object matches, specs do that hold the query or one of its parts and have evidence. A query without words finds nothing.
    """
    low = " ".join(query.lower().split())
    words = [w for w in low.split() if len(w) >= 2]
    names = [C("object_key"), C("object_name")]
    hay = lambda *c: F.lower(compact(F.concat_ws(" ", *c)))
    every = hay(*names, C("object_type"), C("aliases"), C("description"))
    found = objects.where(C("status") == "candidate").where(F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(every, w)) if words else F.lit(False))
    columns = ["object_key", "id", "object_name", "aliases", "evidence", "notes", "deprecated"]
    found = found.groupBy("object_key").agg(F.min_by(F.struct(*columns[1:]), "id").alias("o")).select("object_key", "o.*")
    if specs is not None and low:
        parts = [p for p in re.split(r"[\s/_:-]+", low) if len(p) >= 2]
        some = F.exists(F.array(*map(F.lit, [low, *parts])), lambda w: F.contains(hay(*names, C("aliases")), w))
        found = found.unionByName(unless_any(specs.where(some & (C("evidence") > 0)).select(*columns), found))
    score = fusion.object_score(query, C("object_name"), C("aliases"), C("evidence"), C("notes"), C("deprecated"))
    return found.withColumn("score", score).orderBy(F.desc("score"), "id").limit(max(1, min(limit, LEXICAL_MOST)))


def object_by_key(objects: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """RET41c: the candidate of a key (trimmed, lower case), else the specification of that key that has evidence, else no row."""
    key = key.strip().lower()
    columns = ["object_key", "id", "object_name", "evidence"]
    found = objects.where((C("object_key") == key) & (C("status") == "candidate")).orderBy("id").limit(1).select(*columns)
    return found.unionByName(unless_any(specs.where((C("object_key") == key) & (C("evidence") > 0)).select(*columns), found))


def objects_for_chunks(spec: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """RET41b: for each chunk that is no metadata, the objects it holds, with the points of their best alias, best first."""
    return library.match_strength(spec, chunks.where(~T.is_metadata(C("text"))), key)


def by_meaning(rows: DataFrame, key: str, text: str, query: str, encode: Callable[..., DataFrame] | None = None) -> DataFrame:
    """UDF4: rows with the cosine of a text and a query, both encoded by the same function of (df, key, text).

    The query is one more row of what is encoded, so any encoder of tables does. Rows without a vector are absent.
    """
    encode = encode or fusion.embedder()
    asked = encode(rows.sparkSession.createDataFrame([(0, query)], "q int, text string"), "q", "text").select(C("vector").alias("_q"))
    found = encode(rows.select(key, text), key, text).join(F.broadcast(asked.limit(1)))
    return rows.join(found.select(key, F.round(V.cosine(C("vector"), C("_q")), 6).alias("score")), key)


def semantic_passages(documents: DataFrame, chunks: DataFrame, query: str, limit: int = 10, document_ids=(), encode: Callable[..., DataFrame] | None = None) -> DataFrame:
    """RET28: the chunks of documents that are read (or mastered) nearest to a query by title, heading and the first 1200 characters of text.

    Chunks without text or with metadata are left out; at most 50 rows, ties to the smaller chunk_id. An empty query is an error.
    """
    query = " ".join(query.split())
    if not query:
        raise ValueError("query must not be empty")
    both = chunks.join(documents.where(C("read_status").isin("read", "mastered")).select("document_id", "title"), "document_id")
    if document_ids:
        both = both.where(C("document_id").isin(list(document_ids)))
    text = compact(C("chunk_text"))
    both = both.where((text != "") & ~T.is_metadata(text))
    parts = F.array(C("title"), compact(C("heading")), F.substring(text, 1, PASSAGE))
    passage = F.array_join(F.filter(parts, lambda p: p != ""), " ")
    # Passages are read twice, to be encoded and to be shown: they are cut once.
    passages = written(both.select("chunk_id", "document_id", passage.alias("passage")), "passages")
    scored = by_meaning(passages, "chunk_id", "passage", query, encode)
    return scored.orderBy(F.desc("score"), "chunk_id").limit(max(1, min(limit, PASSAGES)))


def semantic_objects(objects: DataFrame, query: str, recall: int = RECALL, limit: int = RESULTS, encode: Callable[..., DataFrame] | None = None, rerank: Column | None = None) -> DataFrame:
    """RET35: objects whose profile is nearest to a query; among what is recalled, exact names and aliases first, then by rerank, or by nearness without one.

    objects has id, object_name, aliases and profile. Profiles are cut at 800 characters; those that are empty are left out.
    """
    query = " ".join(query.split())
    if not query:
        raise ValueError("query must not be empty")
    limit = max(1, min(limit, MOST))
    profiles = objects.withColumn("profile", F.substring(compact(C("profile")), 1, PROFILE)).where("profile <> ''")
    found = by_meaning(profiles, "id", "profile", query, encode).orderBy(F.desc("score"), "id").limit(min(max(RECALL, min(recall, MOST), limit), MOST))
    same = lambda x: F.lower(compact(x)) == F.lit(query.lower())
    exact = F.coalesce(same(C("object_name")), F.lit(False)) | F.coalesce(F.exists("aliases", same), F.lit(False))
    return found.withColumn("exact", exact).orderBy(F.desc("exact"), F.desc(rerank if rerank is not None else C("score")), "id").limit(limit)
