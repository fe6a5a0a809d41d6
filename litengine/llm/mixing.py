"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

DataFrame functions only. Documents are summed into cells (source, language, topic) before anything is shuffled; the
fitting works on the cells alone. A source with a third of all rows is a few cells. No cell can give more tokens than it
has: a step of the fitting multiplies the cells of a value by one number and stops each at what it has, with the number
that brings the value to its target, so what full cells can't give is asked of the others.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, stored, unpacked

#: Target shares of a marginal are its shares of tokens to this power, made to sum to 1, where none are given.
TEMPERATURE = 0.7
#: The share of all tokens that the sample should hold.
BUDGET = 0.5
ROUNDS = 12
SEED = "mix-1"

DIMENSIONS = ("source", "lang", "topic")

#: Topics by the first pattern that a text holds. Fixed values, a parameter of the operators below. Before each pattern stand
#: screens: a text that it matches holds all strings of one of these, in any case. No pattern is tried on other texts; where
#: it is None, the screens decide.
TOPICS = (
    ("licence", ((("licensed under",), ("licenced under",), ("all rights reserved",), ("copyright",)), None)),
    ("secret", ((("password", "="), ("token", "="), ("akia",)), r"(?i)password\s*=|token\s*=|AKIA[0-9A-Z]{16}")),
    ("contact", ((("@",), ("+",)), r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.|\+[0-9]")),
    ("table", (((" | ",),), None)),
    ("markup", ((("###",), ("<", ">")), r"<[a-z]+>|###")),
)
OTHER = "prose"


def with_cells(docs: DataFrame, topics=TOPICS) -> DataFrame:
    """row (all columns), doc_id, _source, _lang, _topic (never null: null is `unknown`), _tokens (words between ASCII white space)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = packed(docs, _text=text, _low=F.lower(text))
    topic = F.lit(OTHER)
    for name, (screens, pattern) in reversed(topics):
        held = reduce(or_, (reduce(and_, (F.col("_low").contains(s) for s in screen)) for screen in screens))
        topic = F.when(held & F.col("_text").rlike(pattern) if pattern else held, F.lit(name)).otherwise(topic)
    return rows.select(
        F.col("row"),
        F.col("row").getField("doc_id").alias("doc_id"),
        F.coalesce(F.col("row.source").cast("string"), F.lit("unknown")).alias("_source"),
        F.coalesce(F.col("row.lang").cast("string"), F.lit("unknown")).alias("_lang"),
        topic.alias("_topic"),
        F.size(F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), "")).cast("long").alias("_tokens"),
    )


def _scaled(rows: DataFrame, by: str | None, have: str, x: str, goal: str, order: tuple[str, ...]) -> DataFrame:
    """x of each row of a group times one number, at most `have`, so that the group sums to goal (or to all it has, if that is less).

    The number: in the order of have / x, the rows before a row are full, and the rest share what is left of the goal.
    """
    by_need = Window.partitionBy(F.col(by) if by else F.lit(0)).orderBy(F.col("_r").asc_nulls_last(), *order)
    before, whole = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_r", F.when(F.col(x) > 0, F.col(have) / F.col(x)))
    full = F.coalesce(F.sum(have).over(before), F.lit(0.0))
    rest = F.greatest(F.col(x), F.sum(x).over(whole) - F.coalesce(F.sum(x).over(before), F.lit(0.0)))
    rows = rows.withColumn("_l", F.try_divide(F.col(goal) - full, rest))
    rows = rows.withColumn("_l", F.max(F.when(F.col("_l") <= F.col("_r"), F.col("_l"))).over(whole))
    return rows.withColumn(x, F.when(F.col(x) > 0, F.coalesce(F.least(have, F.col("_l") * F.col(x)), have)).otherwise(0.0)).drop("_r", "_l")


def _targets(cells: DataFrame, dim: str, given: dict[str, float] | None, goal: float) -> DataFrame:
    """Tokens that each value of a marginal is to have in the mixture, `goal` in all.

    Values that are not given keep their own share of what is left. A target beyond the tokens of a value is lowered to
    these, and the others are raised alike.
    """
    own = cells.groupBy(f"_{dim}").agg(F.sum("tokens").cast("double").alias("have")).where("have > 0")
    if given:
        names = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
        own = own.withColumn("w", names[F.col(f"_{dim}")]).withColumn("rest", F.when(F.col("w").isNull(), F.col("have")).otherwise(0.0))
        rest = own.agg(F.sum("rest")).first()[0] or 1.0
        own = own.withColumn("w", F.coalesce("w", F.lit(max(0.0, 1 - sum(given.values()))) * F.col("rest") / F.lit(rest)))
    else:
        own = own.withColumn("w", F.pow("have", F.lit(TEMPERATURE)))
    own = _scaled(own.withColumn("goal", F.lit(goal)), None, "have", "w", "goal", (f"_{dim}",))
    return stored(own.select(f"_{dim}", F.col("w").alias(f"target_{dim}")), "marginal")


def fitted(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """Cells with tokens, docs, their targets by marginal (tokens), weight (share of the mixture) and p, the probability that keeps a document of the cell.

    p is what the fitting asks of a cell over what it has: never above 1, and the same for all documents of a cell. So the
    expected tokens of the mixture are the budget, and its expected marginals the targets, wherever the cells allow both;
    a target that the cells of a value can't reach together with the other marginals is missed by what they lack. Cells
    without tokens have weight 0 and p 0.
    """
    cells = with_cells(docs).groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    cells = stored(cells, "cells")
    goal = budget * (cells.agg(F.sum("tokens")).first()[0] or 0)
    names = tuple(f"_{d}" for d in DIMENSIONS)
    fit = cells.withColumn("have", F.col("tokens").cast("double")).withColumn("x", F.col("have") * F.lit(budget))
    for dim in DIMENSIONS:
        fit = fit.join(_targets(cells, dim, (targets or {}).get(dim), goal), f"_{dim}", "left")
    fit = stored(fit.na.fill(0.0, [f"target_{d}" for d in DIMENSIONS]), "fit")
    for k in range(rounds):
        for dim in DIMENSIONS:
            fit = _scaled(fit, f"_{dim}", "have", "x", f"target_{dim}", names)
        fit = stored(fit, "fit")
    whole = fit.agg(F.sum("x")).first()[0] or 1.0
    p = F.least(F.lit(1.0), F.col("x") / F.col("have"))
    return fit.select(*names, "tokens", "docs", *(f"target_{d}" for d in DIMENSIONS), (F.col("x") / F.lit(whole)).alias("weight"), F.when(F.col("tokens") > 0, p).otherwise(0.0).alias("p"))


def uniform(seed: str = SEED) -> Column:
    """A number in [0, 1) for each doc_id, the same on every run; a null doc_id counts as the text `null`."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, seed: str = SEED) -> DataFrame:
    """The sampled rows of docs, with topic, tokens, p and weight (1 / p) added as mix_topic, mix_tokens, mix_p, mix_weight (in place of any of these names).

    Null sources and languages are cells of their own. Empty and null texts have no tokens and are not sampled. Rows that
    share a doc_id are kept or left together if they share a cell, so repeated rows come as often. Very long texts are
    read whole. An empty table gives an empty one. The cells are few (sources times languages times topics); they are
    broadcast only below Spark's own threshold.
    """
    cells = stored(fitted(docs, targets, budget).select("_source", "_lang", "_topic", "p"), "fitted")
    rows = with_cells(docs).join(cells, ["_source", "_lang", "_topic"]).where(uniform(seed) < F.round("p", 9))
    p = F.round("p", 6)
    more = (F.col("_topic").alias("mix_topic"), F.col("_tokens").alias("mix_tokens"), p.alias("mix_p"), F.round(1 / p, 4).alias("mix_weight"))
    return unpacked(rows, [c for c in docs.columns if c not in ("mix_topic", "mix_tokens", "mix_p", "mix_weight")], *more)


def _sql_scaled(by: str | None, have: str, x: str, goal: str, order: str, source: str) -> str:
    """`_scaled` as a SELECT."""
    group = by or "0"
    before = f"OVER (PARTITION BY {group} ORDER BY r NULLS LAST, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    full = f"coalesce(sum({have}) {before}, 0)"
    rest = f"greatest({x}, sum({x}) OVER (PARTITION BY {group}) - coalesce(sum({x}) {before}, 0))"
    return (
        f"SELECT * EXCLUDE (r, l, m) REPLACE (CASE WHEN {x} > 0 THEN coalesce(CASE WHEN m IS NULL THEN NULL ELSE least({have}, m * {x}) END, {have}) ELSE 0 END AS {x})"
        f" FROM (SELECT *, max(CASE WHEN l <= r THEN l END) OVER (PARTITION BY {group}) AS m FROM (SELECT *, ({goal} - {full}) / nullif({rest}, 0) AS l FROM"
        f" (SELECT *, CASE WHEN {x} > 0 THEN {have} / {x} END AS r FROM {source})))"
    )


def oracle_sql(rounds: int = ROUNDS) -> str:
    """`mixed` with default parameters, less text, as DuckDB SQL."""
    told = lambda screens: " OR ".join("(" + " AND ".join(f"contains(lower(t), '{x}')" for x in screen) + ")" for screen in screens)
    cases = " ".join(f"WHEN {f"regexp_matches(t, '{pattern}')" if pattern else told(screens)} THEN '{name}'" for name, (screens, pattern) in TOPICS)
    steps, last = [], "f0"
    for k in range(rounds):
        for dim in DIMENSIONS:
            now = f"f{k}_{dim}"
            steps.append(f"{now} AS MATERIALIZED ({_sql_scaled(dim, 'have', 'x', f'target_{dim}', ', '.join(DIMENSIONS), last)})")
            last = now
    goal = f"(SELECT {BUDGET} * sum(tokens) FROM cells)"
    targets = ", ".join(
        f"m_{d} AS (SELECT {d}, sum(tokens)::DOUBLE AS have, pow(sum(tokens)::DOUBLE, {TEMPERATURE}) AS w, {goal} AS goal FROM cells GROUP BY {d} HAVING sum(tokens) > 0),"
        f" t_{d} AS (SELECT {d}, w AS target_{d} FROM ({_sql_scaled(None, 'have', 'w', 'goal', d, f'm_{d}')}))"
        for d in DIMENSIONS
    )
    joins = " ".join(f"LEFT JOIN t_{d} USING ({d})" for d in DIMENSIONS)
    return rf"""
    WITH d AS MATERIALIZED (
      SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, CASE {cases} ELSE '{OTHER}' END AS topic,
        len(regexp_extract_all(t, '[^ 	-
]+')) AS n FROM (SELECT *, coalesce(text, '') AS t FROM documents)
    ), cells AS (SELECT source, lang, topic, sum(n)::BIGINT AS tokens FROM d GROUP BY ALL), {targets},
    f0 AS (SELECT * REPLACE (coalesce(target_source, 0) AS target_source, coalesce(target_lang, 0) AS target_lang, coalesce(target_topic, 0) AS target_topic)
      FROM (SELECT *, tokens::DOUBLE AS have, tokens::DOUBLE * {BUDGET} AS x FROM cells {joins})),
    {", ".join(steps)},
    p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, x / have) ELSE 0 END AS p FROM {last})
    SELECT doc_id, topic AS mix_topic, n::BIGINT AS mix_tokens, round(p, 6) AS mix_p, round(1 / round(p, 6), 4) AS mix_weight
    FROM d JOIN p USING (source, lang, topic)
    WHERE ('0x' || substr(md5('{SEED}:' || doc_id), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)} < round(p, 9)
    """
