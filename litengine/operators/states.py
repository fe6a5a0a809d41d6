"""What an index holds against what it should hold, and which notes and shelf entries count as the same.

Keys are joined once, per-document numbers are sums combined before the shuffle. A null key matches no other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
NO_ORDER = 2147483647  # fixed value: where fragments without an order stand


# --- index against source


def sync_actions(source: DataFrame, index: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """SET3, SET4: each key is to be inserted, updated (one of the fields differs, nulls being equal), skipped, or an orphan."""
    s, i = source.select(key, F.struct(*fields).alias("_s")), index.select(key, F.struct(*fields).alias("_i"))
    same = reduce(and_, [C("_s")[c].eqNullSafe(C("_i")[c]) for c in fields])
    action = F.when(C("_i").isNull(), "insert").when(C("_s").isNull(), "orphan").when(same, "skip").otherwise("update")
    return s.join(i, key, "full").select(key, action.alias("action"))


def sync_stats(actions: DataFrame, dry_run: bool = False, delete_orphans: bool = False) -> DataFrame:
    """SET3: how many rows each action takes; a dry run changes nothing, orphans only go where asked."""
    n = lambda a: F.count_if(C("action") == a)
    none = F.lit(0).cast("long")
    deleted = n("orphan") if delete_orphans else none
    done = [none if dry_run else x for x in (n("insert"), n("update"), deleted)]
    names = ("inserted", "updated", "deleted_orphans")
    return actions.agg(
        F.count_if(C("action") != "orphan").alias("scanned"), n("skip").alias("skipped"), n("orphan").alias("orphans"), *(x.alias(c) for x, c in zip(done, names, strict=True)),
        n("insert").alias("would_insert"), n("update").alias("would_update"), deleted.alias("would_delete"),
    )


def sync_gate(missing: Column, stale: Column, threshold: int, enabled: bool = True) -> Column:
    """STM2: an automatic sync runs where something is missing or stale, but no more than the threshold; orphans don't count."""
    changed = F.coalesce(missing, F.lit(0)) + F.coalesce(stale, F.lit(0))
    return F.lit(enabled) & (changed > 0) & (changed <= threshold)


def fallback_reason(available: Column, reason: Column, manifest: Column, exists: Column, source: Column, indexed: Column, drift: Column) -> Column:
    """SET7: why a vector table can't be read: the store's own reason, the manifest's, a missing table, or drift; null where it can."""
    own = F.when(reason == "vector_manifest_missing", "vector_store_unavailable").otherwise(F.coalesce(F.nullif(reason, F.lit("")), F.lit("vector_store_unavailable")))
    zero = F.lit(0)
    drifted = (F.coalesce(source, zero) != F.coalesce(indexed, zero)) | (F.coalesce(drift, zero) != 0)
    no = lambda x: ~F.coalesce(x, F.lit(False))
    return F.when(no(available), own).when(F.coalesce(manifest, F.lit("")) != "", manifest).when(no(exists), "vector_table_missing").when(drifted, "vector_store_source_drift")


def note_plan(current: DataFrame, previous: DataFrame, key: str, kind: str, content: Sequence[str], snapshot: Sequence[str], valid: str, compatible: bool = True) -> DataFrame:
    """SET8, STM6, STM7: each note is added, removed, changed or reused (same content and a valid vector); of reused ones, those whose other fields changed need their metadata written."""
    fields = list(dict.fromkeys([kind, *content, *snapshot]))
    c, p = current.select(key, F.struct(*fields).alias("_c")), previous.select(key, F.struct(*fields, valid).alias("_p"))
    same = lambda names: reduce(and_, [C("_c")[x].eqNullSafe(C("_p")[x]) for x in names])
    reuse = F.lit(compatible) & same(content) & F.coalesce(C("_p")[valid], F.lit(False))
    state = F.when(C("_p").isNull(), "added").when(C("_c").isNull(), "removed").when(reuse, "reused").otherwise("changed")
    of = F.when(C("_c").isNull(), F.coalesce(C("_p")[kind], F.lit("unknown"))).otherwise(C("_c")[kind])
    out = c.join(p, key, "full").select(key, of.alias(kind), state.alias("state"), (~same(snapshot)).alias("_differs"))
    return out.withColumn("metadata_only", (C("state") == "reused") & C("_differs")).drop("_differs")


def vector_states(expected: DataFrame, indexed: DataFrame, group: str, ident: str) -> DataFrame:
    """SET10, INT7: per document how many ids are expected, indexed, missing, orphans, or indexed more than once."""
    e = expected.select(group, ident).distinct().withColumn("_e", F.lit(1))
    i = indexed.groupBy(group, ident).agg(F.count(F.lit(1)).alias("_i"))
    return e.join(i, [group, ident], "full").groupBy(group).agg(
        F.count("_e").alias("expected"), F.count("_i").alias("indexed"), F.count_if(C("_i").isNull()).alias("missing"),
        F.count_if(C("_e").isNull()).alias("orphans"), F.count_if(C("_i") > 1).alias("duplicates"),
    )


def index_validation(ordinary: DataFrame, others: dict[str, DataFrame], key: str, expected: int | None = None) -> DataFrame:
    """INT3: one row: rows of each table, repeated keys of the ordinary one, and whether these are as they should be."""
    ids = ordinary.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(F.lit("ordinary").alias("t"), "n")
    every = reduce(DataFrame.unionByName, [d.select(F.lit(t).alias("t"), F.lit(1).cast("long").alias("n")) for t, d in others.items()], ids)
    count = lambda t: F.coalesce(F.sum(F.when(C("t") == t, C("n"))), F.lit(0))
    out = every.agg(*(count(t).alias(f"{t}_count") for t in ("ordinary", *others)), F.count_if((C("t") == "ordinary") & (C("n") > 1)).alias("duplicate_ids"))
    match = F.lit(True) if expected is None else reduce(and_, [C(f"{t}_count") == expected for t in ("ordinary", *others)])
    return out.withColumn("count_match", match).withColumn("valid", C("count_match") & (C("duplicate_ids") == 0))


# --- requests and scopes


def request_warnings(asked: DataFrame, documents: DataFrame, key: str, status: str) -> DataFrame:
    """FIL9: asked ids, each once, that no document has, or whose document is archived."""
    known = documents.select(key, F.coalesce(C(status), F.lit("")).alias("_s"))
    code = F.when(C("_s").isNull(), "requested_document_not_found").when(C("_s") == "archived", "requested_document_archived")
    return asked.select(key).where(C(key).isNotNull()).distinct().join(known, key, "left").select(key, code.alias("code")).where("code IS NOT NULL")


def scope_ids(df: DataFrame, group: str, order: str, ident: str, fetch: int = 1001) -> DataFrame:
    """TOP12: of each document the first ids by order, those without one last, and how many there are in all; one more than a page shows that it overflows."""
    w = Window.partitionBy(group).orderBy(F.coalesce(C(order), F.lit(NO_ORDER)), ident)
    totals = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    return df.select(group, ident, F.row_number().over(w).alias("rank")).where(C("rank") <= fetch).join(totals, group)


def distinct_children(child: DataFrame, parents: DataFrame, key: str, ident: str) -> DataFrame:
    """AGG19: how many distinct children the given parents have together."""
    return child.join(parents.select(key), key, "left_semi").agg(F.count_distinct(ident).alias("n"))


def matches_fields(query: str, fields: Sequence[Column]) -> Column:
    """FIL15: whether one of the fields, in lower case and without anything but letters, digits and `_`, holds the query cut the same way."""
    plain = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}_]+", "")
    return reduce(or_, [F.contains(plain(x), plain(F.lit(query))) for x in fields])


# --- notes and shelves


def concept_terms(text: Column) -> Column:
    """FIL11: distinct words of at least three ASCII letters or digits, and pairs of neighbouring CJK characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(low, F.lit("([㐀-鿿]{2,})"))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("([a-z0-9]{3,})")), pairs))


def note_relevant(query: str, text: Column, reranked: Column, semantic: Column) -> Column:
    """FIL11: a note counts unless its rerank score is below 0, if it shares two terms with the query, or scores 0.5 and 0.65."""
    score, near = F.coalesce(reranked, F.lit(0.0)), F.coalesce(semantic, F.lit(0.0))
    shared = F.size(F.array_intersect(concept_terms(F.lit(query)), concept_terms(text)))
    return (score >= 0) & ((shared >= 2) | ((score >= 0.5) & (near >= 0.65)))


def best_of_identity(df: DataFrame, identity: Sequence[str], rank: str) -> DataFrame:
    """DUP3: of rows with one identity, nulls being equal, the one with the least rank: a combined minimum, so a hot identity is no large group."""
    best = df.groupBy(*identity).agg(F.min_by(F.struct(*df.columns), rank).alias("_r"))
    return best.select("_r.*")


def shelf_key(title: Column, path: Column, key: Column) -> Column:
    """DUP8: what entries of a shelf are told apart by: title and file, else title and key, else nothing."""
    low = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    name = F.trim(F.regexp_replace(low(title), r"\s+", " "))
    file = F.replace(low(path), F.lit("\\"), F.lit("/"))
    return F.when((name != "") & (file != ""), F.concat(F.lit("title_pdf:"), name, F.lit("|"), file)).when((name != "") & (low(key) != ""), F.concat(F.lit("title_zotero:"), name, F.lit("|"), low(key)))


def exact_name(query: str, names: Column) -> Column:
    """RET37: whether one of the names is the query, whatever its case, spaces, dashes and underscores; an empty query is none."""
    plain = lambda x: F.regexp_replace(F.lower(x), r"[ \t\r\n_-]", "")
    return (plain(F.lit(query)) != "") & F.coalesce(F.exists(names, lambda x: F.coalesce(plain(x), F.lit("")) == plain(F.lit(query))), F.lit(False))
