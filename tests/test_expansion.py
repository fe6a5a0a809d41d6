"""Expansion of queries by rules, by literal cases."""

from litengine.operators import expansion as E


def test_expansion(spark):
    queries = [(1, "  Weight   Decay and MFA "), (2, "牛顿法 with TICe"), (3, "the plain a"), (4, None), (5, " "), (6, "notebook")]
    df = spark.createDataFrame(queries, "id int, text string")
    got = {r.id: r for r in E.expanded(df, E.rules_table(spark), "id", "text").collect()}
    assert got[1].terms[:5] == ["weight decay and mfa", "weight", "decay", "mfa", "mixture of factor analyzers"]
    assert got[1].rules == ["mfa_advantage_cn", "regularization_cn_en"] and len(got[1].terms) == len(set(got[1].terms))
    assert got[2].terms[:3] == ["牛顿法 with tice", "tice", "牛顿"] and got[2].rules == ["optimization_cn_en", "tice_mice_hierarchy"]
    assert [(g.rule, g.terms, g.policy) for g in got[2].groups][1] == ("tice_mice_hierarchy", ["tice", "mice"], "all")
    assert got[3].terms == ["the plain a", "plain"] and got[3].rules == [] and got[3].groups == []
    assert got[4].terms == got[5].terms == [] and got[6].rules == ["object_note_neighbor"] and got[6].groups == []
    odd = E.rules_table(spark, [("one", ("é", " "), ("x",), (), "any"), ("none", (), ("y",), (), "any")])
    assert [r.rules for r in E.expanded(spark.createDataFrame([(1, "cafÉ b")], "id int, text string"), odd, "id", "text").collect()] == [["one"]]
    assert E.expanded(df.limit(0), odd, "id", "text").count() == 0
