"""Vector, hybrid and multi-channel retrieval, reranking and grouping."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

C = F.col
DIMENSIONS = 256


@functools.lru_cache(100_000)
def _buckets(word: str, dimensions: int) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The four buckets that a word adds to, and what it adds to each."""
    h = hashlib.sha256(word.encode()).hexdigest()
    at = tuple(int(h[8 * k : 8 * k + 4], 16) % dimensions for k in range(4))
    return at, tuple((1.0 if int(h[8 * k + 4], 16) % 2 == 0 else -1.0) * (1 + len(word) / 16) for k in range(4))


#: Words that are summed up at once.
WORDS = 500_000


def _unit_vectors(dimensions: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + WORDS, "right")))
                part = batch.slice(start, stop - start)
                sizes = np.diff(ends[start:stop], prepend=done)
                words = part.column(1).flatten().dictionary_encode()
                at, x = (np.array(c).reshape(-1, 4) for c in zip(*(_buckets(w, dimensions) for w in words.dictionary.to_pylist()), strict=True))
                codes = words.indices.to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes) * dimensions
                raw = sum(np.bincount(row + at[codes, k], x[codes, k], len(sizes) * dimensions) for k in range(4)).reshape(-1, dimensions)
                length = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
                unit = np.divide(raw, length, out=raw.copy(), where=length > 0)
                offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dimensions)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(unit.ravel()))], [part.schema.names[0], "vector"])
                start = stop

    return run


def hash_embedding(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """RET15, UDF1: key and a unit vector: every token adds to four buckets taken from its SHA-256, with signs from it too.

    Rows of one key are one text; keys without a token have no vector.
    """
    words = df.select(key, T.hash_tokens(C(text)).alias("w")).where(F.size("w") > 0).groupBy(key).agg(F.flatten(F.collect_list("w")).alias("w"))
    return words.mapInArrow(_unit_vectors(dimensions), f"`{key}` {df.schema[key].dataType.simpleString()}, vector array<double>")


EMBEDDERS: dict[str, Callable[..., DataFrame]] = {"hash-text-v1": hash_embedding}


def embedder(name: str = "hash-text-v1") -> Callable[..., DataFrame]:
    """UDF2: an embedder by name."""
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; there are {sorted(EMBEDDERS)}")
    return EMBEDDERS[name]


def nearest(rows: DataFrame, query: DataFrame, key: str, vector: str, k: int, positive: bool = False, metric: str = "cosine") -> DataFrame:
    """RET16, RET29, TOP5, TOP6: exact top k of a query's vector (a table of one row) by cosine or squared distance."""
    k = min(max(1, k), 50)
    both = rows.join(F.broadcast(query.select(C(vector).alias("_q")).limit(1)))
    score = V.cosine(C(vector), C("_q")) if metric == "cosine" else -F.aggregate(F.zip_with(vector, "_q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    out = both.select(*rows.columns, F.round(score, 9).alias("score"))
    return (out.where("score > 0") if positive else out).orderBy(F.desc("score"), key).limit(k)


def hybrid(keyword: DataFrame, vector: DataFrame, key: str, limit: int) -> DataFrame:
    """RET17, J9: half the inverse rank of the keyword list and half the clamped cosine; a missing one is 0."""
    k = keyword.orderBy(F.desc("score"), key).limit(max(2 * limit, 20)).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), key)))
    v = vector.orderBy(F.desc("score"), key).limit(max(10 * limit, 50))
    both = k.select(key, (1 / C("rank")).alias("k")).join(v.select(key, V.clamp(C("score")).alias("v")), key, "full")
    return both.select(key, F.round(0.5 * F.coalesce("k", F.lit(0.0)) + 0.5 * F.coalesce("v", F.lit(0.0)), 9).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def channel_fusion(channels: dict[str, DataFrame], key: str, limit: int, bonus: float = 0.5) -> DataFrame:
    """RET18, RET19: sums of channel points (the vector channel's best), and a bonus for each channel that names a row.

    keyword has (key, rank) of every list it stands in and gives max(0.2, 3 / rank) each; the others have (key, points).
    """
    parts = []
    for name, df in channels.items():
        points = F.greatest(F.lit(0.2), 3 / C("rank")) if name == "keyword" else C("points")
        fold = F.max if name == "vector" else F.sum
        parts.append(df.select(key, points.cast("double").alias("points")).groupBy(key).agg(fold("points").alias("points")).withColumn("channel", F.lit(name)))
    every = reduce(DataFrame.unionByName, parts)
    out = every.groupBy(key).agg(F.round(F.sum("points") + bonus * F.count(F.lit(1)), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))
    return out.where((C("channels") != "vector") | (C("score") >= 0.15 + bonus)).orderBy(F.desc("score"), key).limit(limit)


def heuristic_score(terms: Sequence[str], text: Column, title: Column, heading: Column, tags: Column, notes: Column, relations: Column, channels: Column, fusion: Column) -> Column:
    """RET20: ten times the covered share of terms, title, heading and tag hits, capped counts, channels and the fused score."""
    has = lambda x, t: F.contains(F.lower(x), F.lit(t.lower())).cast("double")
    share = sum((has(text, t) for t in terms), F.lit(0.0)) / max(1, len(terms))
    some = lambda x: reduce(lambda a, b: F.greatest(a, b), [has(x, t) for t in terms], F.lit(0.0))
    hits = sum((F.regexp_count(F.lower(text), F.lit("\\Q" + t.lower() + "\\E")) for t in terms), F.lit(0))
    five = F.lit(5)
    return F.round(10 * share + 6 * some(title) + 5 * some(heading) + 4 * some(tags) + 1.5 * F.least(hits, five) + 2 * F.least(notes, five) + 2 * F.least(relations, five) + channels + fusion, 6)


# Ways to rerank.
RERANKERS = ("none", "heuristic", "external")


def reranked(results: DataFrame, mode: str, rank: str, ident: str, score: Column | None = None) -> DataFrame:
    """RET21, UDF3: results in the order of a rank, or by a score, with mode, external_called and degraded_reason.

    A reranker is a score of each row (an expression or a pandas UDF); ties keep the rank they had. The external way is off: it keeps the order and says so.
    """
    if mode not in RERANKERS:
        raise ValueError(f"unsupported rerank mode: {mode}")
    out = results.withColumns({"mode": F.lit(mode), "external_called": F.lit(False), "degraded_reason": F.lit("external rerank is disabled" if mode == "external" else None).cast("string")})
    return out.orderBy(F.desc(score), rank, ident) if mode == "heuristic" else out.orderBy(rank, ident)


def grouped_text_score(text: Column, phrase: str, terms: Sequence[str], scale: float = 1.0) -> Column:
    """RET23, RET24: 4 for the phrase, 1.2 for each term as a word."""
    low = F.lower(text)
    words = sum((low.rlike(r"(?<![\p{L}\p{N}])\Q" + t.lower() + r"\E(?![\p{L}\p{N}])").cast("double") for t in terms), F.lit(0.0))
    return F.round((4.0 * F.contains(low, F.lit(phrase.lower())).cast("double") + 1.2 * words) * scale, 6)


# What a section's heading holds, and what that adds to a passage's score.
SECTION_WEIGHTS = (
    (("method", "approach", "architecture", "training details", "residual blocks"), 1.0),
    (("introduction",), 0.25),
    (("conclusion", "challenge", "benchmark", "result", "ntire"), -0.55),
    (("front matter", "标题 / 摘要页"), -0.15),
)


def section_adjustment(section: Column, mechanism: Column) -> Column:
    """RET25: what a passage's section adds where a query asks how something works; nothing for other queries."""
    low, out = F.lower(F.coalesce(section, F.lit(""))), F.lit(0.0)
    for words, weight in reversed(SECTION_WEIGHTS):
        out = F.when(low.rlike("|".join(words)), weight).otherwise(out)
    return F.when(mechanism, out).otherwise(0.0)


# A heading that holds one of these is that of references.
REFERENCE_HEADINGS = ("references", "参考文献", "bibliography")


def tier(score: Column, section: Column) -> Column:
    """RET32: reference by the heading, whatever the score; primary for a positive score, else secondary."""
    low = F.lower(F.coalesce(section, F.lit("")))
    return F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in REFERENCE_HEADINGS]), "reference").when(score > 0, "primary").otherwise("secondary")


def object_score(query: str, name: Column, aliases: Column, evidence: Column, notes: Column, deprecated: Column) -> Column:
    """RET37 to RET39: an exact name or alias (spaces, dashes and underscores ignored), a part of one, evidence and notes; from 0 to 1."""
    flat = lambda x: F.regexp_replace(F.lower(x), r"[\s_-]+", "")
    q = F.lit("".join(c for c in query.lower() if c not in " _-\t\n"))
    exact = (flat(name) == q) | F.exists(aliases, lambda a: flat(a) == q)
    part = F.contains(flat(name), q) | F.exists(aliases, lambda a: F.contains(flat(a), q))
    base = F.when(exact, 0.42).when(part, 0.34).otherwise(0.14)
    return F.round(V.clamp(base + 0.05 * F.least(evidence, F.lit(5)) + 0.03 * F.least(notes, F.lit(5)) - F.when(deprecated, 0.3).otherwise(0.0)), 6)


# Words of a query that ask for a kind of object, marks of made-up titles, and headings of methods and front matter.
INTENTS = (
    (("指标", "metric", "psnr", "fid"), "metric"),
    (("数据集", "benchmark", "div2k"), "dataset"),
    (("方法", "model", "algorithm", "估计"), "method"),
    (("机制", "原理", "怎么", "为什么", "block", "scaling", "约束"), "mechanism"),
    (("问题", "failure", "limitation", "不合理", "脚滑", "穿地"), "problem"),
)
SYNTHETIC, METHOD_HEADINGS, FRONT_HEADINGS = ("mock", "test", "phase"), ("method", "proposed", "approach"), ("front matter", "title page")


def object_scores(objects: DataFrame, query: str) -> DataFrame:
    """RET39: objects with the parts of their score for a query, score (0 to 1, three digits) and label (high, medium, low).

    objects: object_name, object_key, object_type, aliases, source, mapping_status, review_status, confidence, warnings (arrays of
    strings), evidence (structs of snippet, document_title, evidence_role, section_label) and notes (structs of title,
    short_preview). Texts are compared in lower case with single spaces; null ones, and null arrays, are empty.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
    q = " ".join(query.lower().split())
    any_in = lambda words, c: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], F.lit(False))
    count = lambda c, test: F.size(F.filter(c, test))
    aliases = F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), norm), lambda a: a != "")
    names = F.filter(F.concat(F.array(norm(C("object_name")), norm(C("object_key"))), aliases), lambda a: a != "")
    words = re.findall(r"[a-z0-9_\-]+|[\u4e00-\u9fff]{2,}", q)
    alias = F.when(F.lit(q == ""), 0.0).when(F.array_contains(names, q), 0.42).when(F.exists(names, lambda n: F.contains(n, F.lit(q)) | F.contains(F.lit(q), n)), 0.34)
    alias = alias.when(F.exists(names, lambda n: any_in(words, n)), 0.14).otherwise(0.0)
    asked = [kind for terms, kind in INTENTS if any(t in q for t in terms)]
    intent = F.when(any_in(asked, norm(C("object_type"))), 0.1).otherwise(0.0)

    evidence, notes, n = C("evidence"), C("notes"), F.greatest(F.size("evidence"), F.lit(0))
    says = lambda text: (F.contains(text, F.lit(q)) if q else F.lit(False)) | F.exists(aliases, lambda a: F.contains(text, a))
    direct = count(evidence, lambda e: says(F.concat_ws(" ", norm(e["snippet"]), norm(e["document_title"]))))
    roles = count(evidence, lambda e: (norm(e["evidence_role"]) != "") & F.contains(norm(C("object_type")), norm(e["evidence_role"])))
    made_up = F.lit(0) if any(m in q for m in SYNTHETIC) else count(evidence, lambda e: any_in(SYNTHETIC, norm(e["document_title"])))
    most = lambda top, c, each: F.least(F.lit(top), c * each)
    support = F.when(n > 0, F.greatest(F.lit(0.0), most(0.16, n, 0.035) + most(0.1, direct, 0.03) + most(0.04, roles, 0.015) - most(0.12, made_up, 0.04))).otherwise(0.0)
    section = F.greatest(F.lit(0.0), most(0.1, count(evidence, lambda e: any_in(METHOD_HEADINGS, norm(e["section_label"]))), 0.03) - most(0.06, count(evidence, lambda e: any_in(FRONT_HEADINGS, norm(e["section_label"]))), 0.02))
    told = count(notes, lambda x: says(norm(F.concat_ws(" ", F.coalesce(x["title"], F.lit("")), F.coalesce(x["short_preview"], F.lit(""))))))
    noted = F.when(told > 0, most(0.08, told, 0.035)).when(F.size("notes") > 0, most(0.03, F.size("notes"), 0.01)).otherwise(0.0)
    mapped = F.when(C("mapping_status") == "mapped", 0.04).when(C("mapping_status") == "partial", 0.01).when(C("mapping_status") == "failed", -0.05).otherwise(0.0)
    source = F.when(C("source") == "object_candidates", 0.12 + F.when(C("review_status") == "accepted", 0.04).otherwise(0.0) + mapped).otherwise(0.0)
    warned = F.concat(F.transform(F.coalesce("warnings", F.array().cast("array<string>")), norm), F.when(n == 0, F.array(F.lit("no_evidence_refs"))).when(made_up > 0, F.array(F.lit("synthetic_test_document_downranked"))).otherwise(F.array().cast("array<string>")))
    loss = F.aggregate(warned, F.when(F.lower("confidence") == "low", -0.05).otherwise(0.0), lambda s, w: s - F.when(any_in(("source_gap_reason", "no_evidence_refs"), w), 0.14).when(F.contains(w, F.lit("synthetic_test_document_downranked")), 0.05).otherwise(0.0))
    parts = {"alias_direct_match": alias, "object_type_intent": intent, "evidence_support": support, "section_priority": section, "note_support": noted, "source_priority": source, "warning_penalty": F.greatest(F.lit(-0.25), loss)}
    full = objects.withColumns(parts)
    total = V.clamp(reduce(lambda a, b: a + b, [C(c) for c in parts]))
    scored = full.withColumn("_s", F.round(total, 9))
    label = F.when(C("_s") >= 0.7, "high").when(C("_s") >= 0.38, "medium").otherwise("low")
    return scored.withColumns({c: F.round(c, 3) for c in parts} | {"object_score": F.round("_s", 3), "score_label": label}).drop("_s")


def term_points(terms: Sequence[str], text: Column, each: float = 3.0, most: int = 12) -> Column:
    """RET45: points for each of the first terms that a text holds."""
    return sum((F.contains(F.lower(text), F.lit(t.lower())).cast("double") * each for t in list(dict.fromkeys(terms))[:most]), F.lit(0.0))


def library_rank(query: str, key: Column, title: Column, text: Column) -> Column:
    """RET46: 0 for the key itself, 1 for the title, 2 for its beginning, 3 for a part of any field; null for no match."""
    q = query.lower()
    return F.when(F.lower(key) == q, 0).when(F.lower(title) == q, 1).when(F.startswith(F.lower(title), F.lit(q)), 2).when(F.contains(F.lower(text), F.lit(q)), 3)


def note_passage(*parts: Column) -> Column:
    """RET36, RET43: non-empty parts on lines of their own."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")), "\n")


def unified(papers: DataFrame, notes: DataFrame, limit: int, floor: float = 4.0, gap: float = 1.25) -> DataFrame:
    """RET34, RET44, FIL10, FIL11, DUP3: papers near their best score, notes that are relevant enough, each identity once, one order."""
    p = papers.join(F.broadcast(papers.agg(F.max("score").alias("_best")))).where((C("_best") < floor) | (C("score") >= C("_best") - gap)).select("identity", "score", F.lit("pdf").alias("kind"))
    n = notes.where((C("score") >= 0) & ((C("shared") >= 2) | ((C("score") >= 0.5) & (C("semantic") >= 0.65)))).select("identity", "score", F.lit("note").alias("kind"))
    every = p.unionByName(n).withColumn("_r", F.row_number().over(Window.partitionBy("identity").orderBy(F.desc("score"), "kind"))).where("_r = 1").drop("_r")
    return every.orderBy(F.desc("score"), "identity").limit(limit)


def prefilter_state(states: DataFrame) -> DataFrame:
    """RET33: failed over unavailable over applied."""
    return states.agg(F.when(F.bool_or(C("state") == "failed"), "failed").when(F.bool_or(C("state") == "unavailable"), "unavailable").when(F.bool_and(C("state") == "applied"), "applied").otherwise("none").alias("state"))
