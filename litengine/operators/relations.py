"""Relational building blocks over DataFrames: filters, joins, counts, orders, differences and duplicates.

Every operator that orders or limits breaks ties by an id. Joins leave the strategy to the optimizer; null keys match
nothing unless an operator says so.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_folded, fold_ascii

C = F.col


# --- filters


def fragments_where(df: DataFrame, any_of: dict[str, list] | None = None, contains: dict[str, str] | None = None, low: dict[str, float] | None = None, high: dict[str, float] | None = None) -> DataFrame:
    """FIL1: IN lists (an empty one filters nothing), substrings whatever the ASCII case, bounds; a null fails a bound."""
    tests = [C(c).isin(v) for c, v in (any_of or {}).items() if v]
    tests += [contains_folded(C(c), F.lit(v)) for c, v in (contains or {}).items() if v]
    tests += [C(c) >= v for c, v in (low or {}).items()] + [C(c) <= v for c, v in (high or {}).items()]
    return df.where(reduce(and_, tests, F.lit(True)))


def any_contains(df: DataFrame, columns: Sequence[str], term: str, equal: dict[str, str] | None = None) -> DataFrame:
    """FIL2, FIL5, FIL15: rows one of whose columns holds the term, and whose other columns equal what is asked."""
    hit = reduce(or_, [contains_folded(C(c), F.lit(term)) for c in columns])
    return df.where(reduce(and_, [C(c) == v for c, v in (equal or {}).items() if v is not None], hit))


def any_term(df: DataFrame, columns: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """FIL3, FIL4: rows one of whose columns holds one of the terms."""
    return df.where(reduce(or_, [contains_folded(C(c), F.lit(t)) for c in columns for t in terms], F.lit(False)))


def whole_token(df: DataFrame, text: str, key: str, token: str, limit: int) -> DataFrame:
    """FIL6: the first rows that hold a short token as a whole, by key."""
    norm = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return df.where(F.contains(norm, F.lit(f" {token} "))).orderBy(key).limit(limit)


def requested(df: DataFrame, ids: Sequence[int], key: str, archived: str) -> DataFrame:
    """FIL8, FIL9: distinct asked ids in order, each `missing`, `archived` or `found`."""
    asked = df.sparkSession.createDataFrame([(int(i),) for i in sorted(set(ids))], "id long")
    state = asked.join(df.select(C(key).alias("id"), C(archived).alias("gone")), "id", "left")
    return state.select("id", F.when(C("gone").isNull(), "missing").when(C("gone"), "archived").otherwise("found").alias("state"))


def near_best(df: DataFrame, by: str, score: str, kind: str, strict: str, floor: float, gap: float) -> DataFrame:
    """FIL10: where the best score of a kind reaches the floor, its rows more than a gap below the best go; others stay."""
    best = F.max(F.when(C(kind) == strict, C(score))).over(Window.partitionBy(by))
    return df.withColumn("_best", best).where((C(kind) != strict) | (F.coalesce(C("_best"), F.lit(-1e308)) < floor) | (C(score) >= C("_best") - gap)).drop("_best")


# --- joins


def bridged(left: DataFrame, bridge: DataFrame, right: DataFrame, key: str, other: str, kind: Column, label: Column) -> DataFrame:
    """For each left key the distinct labels that a bridge leads to, in the order of (kind, label)."""
    pairs = left.select(key).join(bridge, key).join(right, other).select(key, kind.alias("kind"), label.alias("label"))
    return pairs.groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct("kind", "label"))), lambda x: F.concat(x["kind"], F.lit(":"), x["label"])).alias("labels"))


def merged_scores(a: DataFrame, b: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """All keys of either side with both scores; a missing one is 0."""
    return a.join(b, key, "full").select(key, F.coalesce(first, F.lit(0.0)).alias(first), F.coalesce(second, F.lit(0.0)).alias(second))


def nearest_page(points: DataFrame, pages: DataFrame, key: str, at: str, page: str, ident: str) -> DataFrame:
    """Rows on the same page, else on the next, else on the one before; the least offset that has any, then all its rows."""
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(d).alias("step")) for k, d in enumerate((0, 1, -1))])).alias("s")
    asked = points.select("*", steps).select(*points.columns, (C(at) + C("s.step")).alias(page), C("s.rank").alias("offset_rank"))
    found = asked.join(pages, [key, page])
    best = F.min("offset_rank").over(Window.partitionBy(ident))
    return found.withColumn("_best", best).where("offset_rank = _best").drop("_best")


def without(df: DataFrame, *others: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Rows whose keys stand in none of the others."""
    for other, keys in others:
        df = df.join(other.select(*keys).distinct(), list(keys), "left_anti")
    return df


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """How many rows have a key that no parent has; null keys are no orphans."""
    lost = child.where(C(key).isNotNull()).join(parent.select(C(parent_key).alias(key)).distinct(), key, "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("orphans"))


def wide(df: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """Attribute rows to columns, the least value of each name."""
    return df.groupBy(key).pivot(name, list(names)).agg(F.min(value))


def resolved(df: DataFrame, key: str, candidate: str) -> DataFrame:
    """How many candidates a key has: missing, unique or ambiguous, and the unique one."""
    n = F.count_distinct(candidate)
    return df.groupBy(key).agg(F.when(n == 0, "missing").when(n == 1, "unique").otherwise("ambiguous").alias("status"), F.when(n == 1, F.min(candidate)).alias("candidate"))


def first_source(parts: Sequence[DataFrame], key: str, ident: str) -> DataFrame:
    """J19, J30, DUP6: of prioritised candidate tables, each key's candidates from the first one that has any."""
    every = reduce(DataFrame.unionByName, [p.select(key, ident, F.lit(k).alias("priority")) for k, p in enumerate(parts)])
    return every.withColumn("_best", F.min("priority").over(Window.partitionBy(key))).where("priority = _best").drop("_best").distinct()


def pairs_of_groups(df: DataFrame, group: str, ident: str, extra: Sequence[str] = ()) -> DataFrame:
    """Pairs of distinct rows that share a group, the smaller id on the left. Groups are meant to be small: objects of a chapter."""
    l, r = (df.select(group, *(C(c).alias(f"{c}_{side}") for c in (ident, *extra))) for side in ("l", "r"))
    return l.join(r, group).where(C(f"{ident}_l") < C(f"{ident}_r"))


# Kinds of objects in order, what counts as a method or a concept, and which two kinds make which relation. A
# rule holds either way round; the relation's subject is the first or the second kind of the rule, or the left object.
OBJECT_TYPES = ("research_problem", "method", "algorithm", "model", "concept", "theorem_or_principle", "metric", "dataset", "experiment_candidate", "mechanism_candidate")
METHODS, CONCEPTS = ("method", "algorithm", "model", "experiment_candidate"), ("concept", "theorem_or_principle")
RELATION_RULES = (
    (("research_problem",), METHODS + CONCEPTS, "addresses_problem", "second"),
    (("metric",), METHODS, "evaluates_with_metric", "second"),
    (("dataset",), METHODS, "evaluated_on_dataset", "second"),
    (("mechanism_candidate",), METHODS + CONCEPTS, "suggests_mechanism", "first"),
    (("algorithm", "model"), ("method",), "uses_method", "first"),
    (METHODS, CONCEPTS, "supports", "first"),
    (CONCEPTS, CONCEPTS, "related_to", "left"),
)
#: Objects of an inverted list that meet in one task; longer lists are cut.
LIST = 1000


def relation_type(left: Column, right: Column) -> Column:
    """What kind of relation two objects of these kinds have: relation_type and swapped (is the right one its subject?); null for none."""
    made = lambda kind, swapped: F.struct(F.lit(kind).alias("relation_type"), F.lit(swapped).alias("swapped"))
    cases = []
    for first, second, kind, subject in RELATION_RULES:
        cases.append((left.isin(*first) & right.isin(*second), made(kind, subject == "second")))
        cases.append((right.isin(*first) & left.isin(*second), made(kind, subject == "first")))
    cases.append(((left == "metric") | (right == "metric"), made("related_to", False)))
    return F.coalesce(*[F.when(test, value) for test, value in cases])


def listed_pairs(df: DataFrame, ident: str, lists: dict[str, str], order: Column, extra: Sequence[str], keep: Column | None = None) -> DataFrame:
    """Pairs of rows that stand in the same inverted list, each pair once: columns of both with _l and _r, and shared_<kind> counts.

    lists: kind to an array column. The row that is first in `order` is the left one; `keep`, over the columns of both and
    `kind`, is tested before pairs are gathered. A list of many rows is cut: its left rows are dealt to several tasks, and its
    right rows sent to each of them. Null lists and null entries meet nothing.
    """
    entries = F.array(*[F.struct(F.lit(kind).alias("kind"), F.transform(F.array_distinct(c), lambda x: x.cast("string")).alias("keys")) for kind, c in lists.items()])
    held = df.select(ident, *extra, order.alias("_o"), F.explode(entries).alias("e")).select(ident, *extra, "_o", "e.kind", F.explode("e.keys").alias("key")).where("key is not null")
    sizes = held.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("cuts", F.ceil(C("n") / LIST).cast("int"))
    held = held.join(sizes, ["kind", "key"])
    side = lambda rows, s: rows.select("kind", "key", "_cut", *(C(c).alias(f"{c}_{s}") for c in (ident, "_o", *extra)))
    left = side(held.withColumn("_cut", F.pmod(F.xxhash64(ident), C("cuts"))), "l")
    right = side(held.withColumn("_cut", F.explode(F.sequence(F.lit(0).cast("long"), (C("cuts") - 1).cast("long")))), "r")
    met = left.join(right, ["kind", "key", "_cut"]).where(C("_o_l") < C("_o_r"))
    met = met if keep is None else met.where(keep)
    names = [f"{c}_{s}" for s in "lr" for c in (ident, *extra)]
    return met.groupBy(*names).agg(*(F.count_if(C("kind") == kind).alias(f"shared_{kind}") for kind in lists))


def relation_candidates(objects: DataFrame) -> DataFrame:
    """J20, J21, RES15: relations that approved objects may have: relation_type, subject_id, object_id, basis, confidence.

    objects: id, name, object_type, dedup_group, notes, chunks, pages (arrays), synthetic. Candidates come from the lists of a note's,
    a chunk's or a page's objects; a page alone counts only for kinds that fit each other, and kinds without a rule only by a
    note. Objects of one duplicate group, of one name, or synthetic ones make no pair, nor do those without an id.
    """
    place = F.coalesce(*[F.when(C("object_type") == t, F.lit(k)) for k, t in enumerate(OBJECT_TYPES)], F.lit(999))
    order = F.struct(place, F.lower(F.coalesce("name", F.lit(""))), C("id").cast("string"))
    name = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    apart = (name("name_l") != name("name_r")) & ((F.coalesce("dedup_group_l", F.lit("")) == "") | ~C("dedup_group_l").eqNullSafe(C("dedup_group_r")))
    typed = relation_type(F.coalesce("object_type_l", F.lit("")), F.coalesce("object_type_r", F.lit("")))
    fits = F.coalesce(typed["relation_type"] != "related_to", F.lit(False))
    real = objects.where("id is not null and not coalesce(synthetic, false)")
    pairs = listed_pairs(real, "id", {"notes": "notes", "chunks": "chunks", "pages": "pages"}, order, ["name", "object_type", "dedup_group"], apart & ((C("kind") == "notes") | (typed.isNotNull() & (C("kind") == "chunks")) | fits))
    notes, chunks, pages = (C(f"shared_{k}") > 0 for k in ("notes", "chunks", "pages"))
    pairs = pairs.withColumn("_t", F.coalesce(typed, F.struct(F.lit("related_to").alias("relation_type"), F.lit(False).alias("swapped")))).withColumn("_fits", fits)
    value = F.when(notes & C("_fits"), 0.72).when(chunks & C("_fits"), 0.66).when(notes, 0.58).when(chunks, 0.56).when(pages & C("_fits"), 0.54).otherwise(0.5)
    ends = F.when(C("_t.swapped"), F.struct(C("id_r").alias("s"), C("id_l").alias("o"))).otherwise(F.struct(C("id_l").alias("s"), C("id_r").alias("o")))
    basis = F.when(notes, "shared_source_server_note_id").when(chunks, "shared_evidence_chunk_id").otherwise("same_page_type_compatibility")
    return pairs.select(
        C("_t.relation_type"), ends["s"].alias("subject_id"), ends["o"].alias("object_id"), basis.alias("basis"),
        F.when(C("_t.relation_type") == "related_to", F.least(value, F.lit(0.58))).otherwise(value).alias("confidence"),
    )


def touching(edges: DataFrame, ends: Sequence[tuple[tuple[str, str], str]], ids: DataFrame, ident: str) -> DataFrame:
    """Edges with an asked id at one of their ends, as a union of equi-joins."""
    parts = [edges.join(ids.select(C(ident).alias(c), F.lit(kind).alias(t)), [c, t], "left_semi") for (c, t), kind in ends]
    return reduce(DataFrame.unionByName, parts).distinct()


def same_identity(a: DataFrame, b: DataFrame, columns: Sequence[str], ident: str) -> DataFrame:
    """Rows of a with the least id of b that has the same columns, nulls counting as equal."""
    b = b.groupBy(*(C(c).alias(f"_{c}") for c in columns)).agg(F.min(ident).alias("existing"))
    return a.join(b, reduce(and_, [a[c].eqNullSafe(b[f"_{c}"]) for c in columns]), "left").select(*(a[c] for c in a.columns), "existing")


# --- counts


def counts(parent: DataFrame, child: DataFrame, key: str, **measures: Column) -> DataFrame:
    """AGG1 to AGG5, AGG19: counts of children per parent, pre-aggregated before the join; parents without any have 0."""
    n = child.groupBy(key).agg(*(c.alias(k) for k, c in measures.items()))
    return parent.join(n, key, "left").fillna(0, list(measures))


def by_kind(df: DataFrame, kind: str, kinds: Sequence[str]) -> DataFrame:
    """AGG6, AGG14: counts per kind, with zeros for kinds that do not occur."""
    every = df.sparkSession.createDataFrame([(k,) for k in kinds], f"{kind} string")
    return every.join(df.groupBy(kind).count(), kind, "left").select(kind, F.coalesce("count", F.lit(0)).alias("n"))


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """AGG7, DUP4, SET11: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG13: count, least and mean to four places."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.round(F.avg(value), 4).alias("mean"))


def grouped_passages(df: DataFrame, group: str, tier: str, score: str, ident: str, k: int = 3) -> DataFrame:
    """AGG9, AGG10: per group the best score, tier counts, the best score by rule, and the ids of the k best passages."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), ident))
    primary = F.max(F.when(C(tier) == "primary", C(score)))
    return (
        df.withColumn("_rank", rank).groupBy(group)
        .agg(F.max(score).alias("max_score"), F.count_if(C(tier) == "primary").alias("n_primary"), F.count_if(C(tier) == "secondary").alias("n_secondary"), F.coalesce(primary, F.max(F.when(C(tier) == "secondary", C(score)))).alias("best_score"), F.transform(F.array_sort(F.collect_list(F.when(C("_rank") <= k, F.struct("_rank", ident)))), lambda x: x[ident]).alias("top"))
    )


def group_relevance(df: DataFrame, group: str, score: str, ident: str, k: int = 3) -> DataFrame:
    """AGG11: 0.72 times the best score, 0.18 times the mean of the k best, at most 1."""
    top = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), ident))).where(C("_rank") <= k)
    return top.groupBy(group).agg(F.least(F.lit(1.0), 0.72 * F.max(score) + 0.18 * F.avg(score)).alias("relevance"))


def duplicate_groups(df: DataFrame, key: Column, ident: str) -> DataFrame:
    """AGG15, DUP8: rows that share a key: size, primary (least id) and a group name from the key's hash; null keys stand alone."""
    by = Window.partitionBy("_key")
    out = df.withColumn("_key", key).withColumn("n", F.when(C("_key").isNull(), 1).otherwise(F.count(F.lit(1)).over(by)))
    return out.select(*df.columns, C("n").cast("long"), F.when(C("n") > 1, F.min(ident).over(by)).otherwise(C(ident)).alias("primary_id"), F.when(C("n") > 1, F.substring(F.sha1(C("_key")), 1, 12)).alias("group_id"))


def merged_candidates(df: DataFrame, key: str, order: str, lists: Sequence[str], scalars: Sequence[str]) -> DataFrame:
    """AGG20: rows merged by key: sorted unions of array columns, scalar columns of the first row."""
    return df.groupBy(key).agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists), *(F.min_by(c, order).alias(c) for c in scalars))


def content_hash(df: DataFrame, by: Sequence[str], entry: Column) -> DataFrame:
    """AGG21: a hash of a group's entries in whatever order: of their number and the sums of four pieces of each one's own hash.

    Sums are combined before the shuffle, so a group of any size is a few numbers.
    """
    own = df.select(*by, F.sha2(entry, 256).alias("_h"))
    piece = lambda k: F.sum(F.conv(F.substring("_h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    sums = [F.coalesce(piece(k), F.lit("0")) for k in range(4)]
    return own.groupBy(*by).agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256).alias("hash"))


def top_values(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """AGG23: distinct values by their first occurrence."""
    return df.groupBy(value).agg(F.min(order).alias("first")).orderBy("first", value).limit(k)


# --- windows and order


def ranked(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """WIN1, WIN3, WIN11: a row number within a group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def neighbour_context(df: DataFrame, group: str, order: Sequence[str], text: str, size: int = 600) -> DataFrame:
    """WIN2, CTX1: the tail of the text before and the head of the text after, and whether both, one or none is there."""
    w = Window.partitionBy(group).orderBy(*[F.asc_nulls_last(c) for c in order])
    before = F.trim(F.right(F.lag(text).over(w), F.lit(size)))
    after = F.trim(F.left(F.lead(text).over(w), F.lit(size)))
    out = df.withColumn("context_before", before).withColumn("context_after", after)
    n = C("context_before").isNotNull().cast("int") + C("context_after").isNotNull().cast("int")
    return out.withColumn("context_status", F.when(n == 2, "available").when(n == 1, "partial").otherwise("no_source_context"))


def section_neighbours(df: DataFrame, group: str, order: str, section: str, k: int = 8) -> DataFrame:
    """WIN5, WIN6: up to k rows before and after that belong to the same unbroken run of a section, as lists of orders."""
    w = Window.partitionBy(group).orderBy(order)
    island = F.sum(F.when(C(section).eqNullSafe(F.lag(section).over(w)), 0).otherwise(1)).over(w)
    run = Window.partitionBy(group, "_island").orderBy(order)
    out = df.withColumn("_island", island)
    return out.withColumn("before", F.collect_list(order).over(run.rowsBetween(-k, -1))).withColumn("after", F.collect_list(order).over(run.rowsBetween(1, k))).drop("_island")


def best_runs(df: DataFrame, group: str, order: str, score: str, longest: int = 10) -> DataFrame:
    """WIN7: of all runs of at most so many consecutive rows, the one with the highest sum; then the shorter, then the earlier."""
    w = Window.partitionBy(group).orderBy(order)
    sums = [F.struct((F.round(F.sum(score).over(w.rowsBetween(0, k)), 6)).alias("total"), F.lit(-k).alias("length"), (-C(order)).alias("start")) for k in range(longest)]
    ends = F.max(order).over(Window.partitionBy(group))
    inside = [F.when(C(order) + k <= ends, s) for k, s in enumerate(sums)]
    return df.select(group, F.array_max(F.array(*inside)).alias("best")).groupBy(group).agg(F.max("best").alias("best")).select(group, (-C("best.start")).alias("start"), (1 - C("best.length")).alias("n"), C("best.total").alias("total"))


def near_ties(df: DataFrame, by: str, score: str, gap: float = 0.05) -> DataFrame:
    """WIN9: rows within a gap of the best of their group; ambiguous where there are several."""
    out = df.withColumn("_best", F.max(score).over(Window.partitionBy(by))).where(C(score) >= C("_best") - gap).drop("_best")
    return out.withColumn("ambiguous", F.count(F.lit(1)).over(Window.partitionBy(by)) > 1)


def page_of(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """TOP3, TOP12: one page of an ordered table; limits are 1 to 200, offsets at most 10000."""
    return df.orderBy(*order).offset(min(max(0, offset), 10_000)).limit(min(max(1, limit), 200))


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], k: int, group_order: Sequence[Column] = (), groups: int | None = None) -> DataFrame:
    """TOP7, WIN4, AGG12: the k first rows of each group, of the first groups only where asked."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(C("rank") <= k)
    if groups is None:
        return out
    first = df.groupBy(group).agg(*(c.alias(f"_{i}") for i, c in enumerate(group_order))).orderBy(*[F.desc(f"_{i}") for i in range(len(group_order))], group).limit(groups)
    return out.join(first.select(group), group)


def typed_concat(parts: Sequence[tuple[str, DataFrame]], order: str, limit: int) -> DataFrame:
    """TOP8, RET27: rows of several types, type after type, then the limit."""
    every = reduce(DataFrame.unionByName, [p.withColumn("type", F.lit(t)).withColumn("type_rank", F.lit(k)) for k, (t, p) in enumerate(parts)])
    return every.orderBy("type_rank", order).limit(limit)


def topped_up(df: DataFrame, ident: str, priority: str, limit: int) -> DataFrame:
    """TOP10, RES1: distinct ids by their best priority, whole-query hits before hits of single tokens."""
    return df.groupBy(ident).agg(F.min(priority).alias(priority)).orderBy(priority, ident).limit(limit)


def interleaved(df: DataFrame, variant: str, score: str, ident: str, limit: int) -> DataFrame:
    """TOP11, RET30: result lists of query variants dealt round-robin, each id once, then the limit."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(variant).orderBy(F.desc(score), ident)))
    first = out.groupBy(ident).agg(F.min(F.struct("rank", variant)).alias("at"))
    return first.select(ident, C("at.rank").alias("rank"), C(f"at.{variant}").alias(variant)).orderBy("rank", variant).limit(limit)


# --- differences and duplicates


def difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """SET1, SET3, SET8, J32: each key as added, removed, changed or retained; nulls compare as equal."""
    b, a = before.select(key, C(value).alias("_b"), F.lit(1).alias("_in")), after.select(key, C(value).alias("_a"), F.lit(1).alias("_out"))
    state = F.when(C("_in").isNull(), "added").when(C("_out").isNull(), "removed").when(C("_a").eqNullSafe(C("_b")), "retained").otherwise("changed")
    return b.join(a, key, "full").select(key, state.alias("state"))


def field_changes(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """SET2: for keys on both sides, how many rows changed in each field."""
    b = before.select(key, *(C(c).alias(f"_{c}") for c in fields))
    both = after.select(key, *fields).join(b, key)
    names = F.filter(F.array(*[F.when(~C(c).eqNullSafe(C(f"_{c}")), F.lit(c)) for c in fields]), lambda x: x.isNotNull())
    return both.select(F.explode(names).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def sync_counts(source: DataFrame, index: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """SET4 to SET6, SET9, SET10: source, indexed, missing, orphan and stale rows, and the state these make."""
    s = source.select(key, F.lit(1).alias("_s"), *(C(c).alias(f"_{c}") for c in fields))
    i = index.select(key, F.lit(1).alias("_i"), *fields)
    stale = reduce(or_, [~C(c).eqNullSafe(C(f"_{c}")) for c in fields])
    out = s.join(i, key, "full").agg(
        F.count("_s").alias("source"), F.count("_i").alias("indexed"), F.count_if(C("_i").isNull()).alias("missing"),
        F.count_if(C("_s").isNull()).alias("orphan"), F.count_if(C("_s").isNotNull() & C("_i").isNotNull() & stale).alias("stale"),
    )
    return out.withColumn("state", F.when(C("indexed") == 0, "unavailable").when((C("missing") + C("orphan") + C("stale")) > 0, "source_drift").otherwise("current"))


def freshness(tables: DataFrame, available: bool, manifest_reason: str | None = None) -> DataFrame:
    """SET6: what the counts of some tables (source, indexed, missing, stale, orphan: a row each) say about a store: one row of sums,
    count_mismatch, drift_count, state, reason and complete.

    unavailable before manifest_mismatch, this before source_drift (a table's counts differ, or a sum of missing, stale or orphan
    rows is not 0), else current. Null counts are 0, and so are those of no tables.
    """
    names = ("source", "indexed", "missing", "stale", "orphan")
    count = lambda c: F.coalesce(C(c), F.lit(0).cast("long"))
    sums = tables.agg(*(F.coalesce(F.sum(count(c)), F.lit(0).cast("long")).alias(c) for c in names), F.coalesce(F.max(count("source") != count("indexed")), F.lit(False)).alias("count_mismatch"))
    sums = sums.withColumn("drift_count", C("missing") + C("stale") + C("orphan"))
    drift = C("count_mismatch") | (C("drift_count") > 0)
    state = F.when(F.lit(not available), "unavailable").when(F.lit(manifest_reason is not None), "manifest_mismatch").when(drift, "source_drift").otherwise("current")
    reason = F.when(C("state") == "manifest_mismatch", F.lit(manifest_reason)).when(C("state") == "source_drift", "vector_store_source_drift")
    return sums.withColumn("state", state).withColumn("reason", reason).withColumn("complete", C("state") == "current")


def sync_status(source: DataFrame, index: DataFrame, fields: Sequence[str], order: str) -> DataFrame:
    """SET5: sync_counts of records by source_id, or by vector_id where they have none; of records with one identity the last in an order counts."""
    last = lambda df, ident: df.groupBy(ident.alias("_id")).agg(F.max_by(F.struct(*fields), order).alias("_f")).select("_id", "_f.*")
    known = F.coalesce(F.nullif(C("source_id").cast("string"), F.lit("")), C("vector_id").cast("string"))
    return sync_counts(last(source, C("source_id").cast("string")), last(index, known), "_id", fields)


def ordered_unique(values: Column) -> Column:
    """DUP7: trimmed values that are not empty, each once, in the order they first come; a struct of them and the number left out as repeated."""
    some = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v.isNotNull() & (v != ""))
    return F.struct(F.array_distinct(some).alias("ids"), (F.size(some) - F.size(F.array_distinct(some))).alias("repeated"))


def duplicate_candidates(df: DataFrame, group: str, kind: str, ident: str, kinds: Sequence[str]) -> DataFrame:
    """DUP1: groups that hold exactly the given kinds; each of their rows with its peers."""
    w = Window.partitionBy(group)
    exact = F.array_sort(F.collect_set(kind).over(w)) == F.array(*[F.lit(k) for k in sorted(kinds)])
    out = df.withColumn("duplicate", C(group).isNotNull() & exact)
    return out.withColumn("peers", F.when(C("duplicate"), F.array_sort(F.array_except(F.collect_list(ident).over(w), F.array(ident)))))


def collapsed(df: DataFrame, group: str, order: Sequence[Column], lists: Sequence[str]) -> DataFrame:
    """DUP2, DUP3: the best row of each group with the sorted union of the group's lists; rows without a group stay alone."""
    w = Window.partitionBy(group).orderBy(*order)
    whole = Window.partitionBy(group)
    out = df.withColumn("_rank", F.row_number().over(w))
    for c in lists:
        out = out.withColumn(c, F.when(C(group).isNull(), F.array_sort(c)).otherwise(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c).over(whole))))))
    return out.where((C("_rank") == 1) | C(group).isNull()).drop("_rank")


def import_duplicates(new: DataFrame, known: DataFrame, keys: Sequence[str], ident: str, known_id: str) -> DataFrame:
    """DUP5: known rows that equal a new one in any of several keys: all reasons, the best one first."""
    parts = [new.select(ident, C(k).alias("v")).where(C("v").isNotNull()).join(known.select(known_id, C(k).alias("v")), "v").select(ident, known_id, F.lit(r).alias("rank"), F.lit(k).alias("reason")) for r, k in enumerate(keys)]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(ident, known_id).agg(F.min("rank").alias("priority"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def folded(c: str) -> Column:
    return fold_ascii(C(c))
