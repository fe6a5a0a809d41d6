"""Expansion of a table of queries by a table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

# Words that are no terms, words that are terms wherever they stand, and the rules: name, markers, terms, anchors,
# and whether any or all of the anchors are asked for.
STOPWORDS = ("a", "an", "and", "are", "as", "for", "from", "in", "is", "of", "or", "the", "to", "using", "with")
MARKED = ("牛顿", "梯度", "正则化", "对象", "机制", "鲁棒", "残差", "优化")
RULES = (
    (
        "mfa_advantage_cn", ("混合因子分析器", "因子分析器", "mfa", "mixture of factor"),
        ("mixture of factor analyzers", "mixture of PPCA", "low-rank covariance", "low-rank version", "full covariance GMM", "parameter count", "O(KLD)", "O(KD^2)", "O(KD2)", "overfitting", "factor analyzers"),
        ("mixture of factor analyzers", "mixture of PPCA", "factor analyzers"), "any",
    ),
    (
        "regularization_cn_en", ("正则化", "regularization", "regularisation", "weight decay"),
        ("regularization", "regularisation", "weight decay", "overfitting", "generalization", "penalty", "prior"), ("regularization", "regularisation", "weight decay"), "any",
    ),
    (
        "optimization_cn_en", ("optimization", "优化", "梯度", "牛顿", "黑塞", "海森"),
        ("optimization", "gradient descent", "newton", "newton's method", "hessian", "line search", "overfit"), ("optimization", "gradient descent", "newton", "hessian", "line search"), "any",
    ),
    (
        "tice_mice_hierarchy", ("tice", "mice", "分层筛选", "层次筛选"),
        ("TICe", "MICe", "hierarchical screening", "tiered screening", "two-stage screening", "instance complexity", "training instance complexity", "model instance complexity"), ("TICe", "MICe"), "all",
    ),
    ("object_note_neighbor", ("对象", "object", "笔记", "note", "zotero"), ("object", "candidate", "note", "zotero", "annotation"), (), "any"),
    ("robust_motion_diffusion", ("鲁棒", "扩散", "运动", "motion", "diffusion", "residual"), ("robust", "robustness", "diffusion", "motion", "residual", "unknown downsampling"), (), "any"),
)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table: place, rule, markers, terms, anchors, policy."""
    rows = [(k, name, list(markers), list(terms), list(anchors), policy) for k, (name, markers, terms, anchors, policy) in enumerate(rules)]
    return spark.createDataFrame(rows, "place int, rule string, markers array<string>, terms array<string>, anchors array<string>, policy string")


def expanded(queries: DataFrame, rules: DataFrame, ident: str, text: str) -> DataFrame:
    """RET22: each query's terms, the rules that it meets, and their anchors: ident, terms, rules, groups.

    terms: the whole query, its words, then what the rules add, in lower case and each once; rules in the order of their places;
    groups: rule, terms and policy of the rules with anchors. A rule is met where the query holds one of its markers, whatever
    the case. Queries and markers meet by two characters (or the only one), by an equi-join, so neither table has to be small;
    then the whole marker is looked for. Null and blank queries have no terms and no rules; blank markers are met by none.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(C(text), F.lit("")), r"\s+", " "))
    asked = queries.select(ident, clean.alias("_clean"), F.lower(clean).alias("_low"))
    words = F.filter(F.regexp_extract_all("_low", F.lit(r"([a-z0-9_+.^-]+)"), 1), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    marked = F.filter(F.array(*map(F.lit, MARKED)), lambda m: F.contains(C("_clean"), m))
    base = F.filter(F.concat(F.array("_low"), words, marked), lambda t: t != "")

    n = F.length("_low")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    keys = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(F.substring(C("_low"), i, F.lit(1)), F.substring(C("_low"), i, F.lit(2))))))
    markers = rules.select("place", F.explode("markers").alias("m")).select("place", F.lower(F.trim("m")).alias("_marker")).where("_marker <> ''").distinct()
    markers = markers.withColumn("_key", F.substring("_marker", 1, 2))
    wanted = asked.where("_low <> ''").select(ident, "_low", F.explode(keys).alias("_key")).join(markers.select("_key").distinct(), "_key", "left_semi")
    met = wanted.join(markers, "_key").where(F.contains(C("_low"), C("_marker"))).select(ident, "place").distinct()
    found = met.join(rules.drop("markers"), "place").groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("place", "rule", "terms", "anchors", "policy"))).alias("_r"))

    lower = lambda terms: F.transform(terms, lambda t: F.lower(t))
    every = F.coalesce("_r", F.array().cast(found.schema["_r"].dataType))
    groups = F.transform(F.filter(every, lambda r: F.size(r["anchors"]) > 0), lambda r: F.struct(r["rule"].alias("rule"), F.array_distinct(lower(r["anchors"])).alias("terms"), r["policy"].alias("policy")))
    return asked.withColumn("_base", base).join(found, ident, "left").select(
        ident, F.array_distinct(F.concat("_base", lower(F.flatten(F.transform(every, lambda r: r["terms"]))))).alias("terms"), F.transform(every, lambda r: r["rule"]).alias("rules"), groups.alias("groups")
    )
