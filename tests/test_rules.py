"""Rules with their findings, and what a failing rule does."""

import pytest

from loamgraph.operators import rules as R


@pytest.fixture(scope="module")
def tables(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "subclass": make([("a", "b"), ("b", "a"), ("c", "b"), ("d", "d"), ("e", "p"), ("e", "q"), ("e", "p"), ("s", "t"), ("m", "n")], "src string, dst string"),
        "equivalent": make([("b", "x"), ("t", "s"), ("n", "o"), ("m", "z")], "a string, b string"),
        "disjoint": make([("q", "p"), ("p", "q"), ("a", "x")], "a string, b string"),
        "constraints": make([("c", "u1", "minCardinality", "2"), ("c", "u1", "sh:maxCount", "5"), ("d", "u1", "cardinality", "1"), ("e", "u2", "maxCardinality", "many"), ("f", "u2", "sh:minCount", "1"), ("g", None, "minCardinality", "1")], "on_class string, property_uri string, restriction_type string, restriction_value string"),
        "properties": make([("p1", "u1", "has part", "object"), ("p2", "u1", "has part", "object"), ("p3", "u2", "made by", "object"), ("p4", "u3", "size", "datatype"), ("p5", "u4", "owns", "object")], "key string, uri string, label string, kind string"),
        "domain": make([("p1", "c"), ("p1", "d"), ("p2", "d"), ("p3", "a")], "prop string, class_key string"),
        "range": make([("p1", "c")], "prop string, class_key string"),
        "named": make([("p2", "k9"), ("p5", "k8")], "prop string, class_key string"),
        "classes": make([("k1", "Account"), ("k2", " account's"), ("k3", "Accounts"), ("k4", "Country"), ("k5", "countries"), ("k6", None), ("k7", "K6"), ("k8", "as"), ("k9", "a"), ("k10", "")], "key string, label string"),
        "individuals": make([("i1",), ("i2",), ("i3",)], "key string"),
        "provenance": make([("i1", 3), ("i2", None), ("i1", None)], "key string, start int"),
        "types": make([("i1", "c"), ("i2", "gone"), ("i3", "d"), ("dead", "c")], "src string, dst string"),
        "assertions": make([("i1", "has part"), ("i1", "has part"), ("i3", "has part"), ("i3", "has part"), ("i3", "made by")], "src string, predicate string"),
    }


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.rule, r.severity, r.finding), set()).add((r.role, r.entity))
    return out


def names(df):
    return sorted(found(df))


def test_synonyms_cycles_and_disjoint_parents(tables):
    got = found(R.synonym_triangles(tables))
    assert got[("synonym_triangle", "error", "s|t")] == {("child", "s"), ("parent", "t")}
    assert sorted(k[2] for k in got if k[1] == "warning") == ["a|b|x", "c|b|x", "m|n|o"]
    assert found(R.subclass_cycles(tables)) == {("subclass_cycle", "error", "a"): {("member", "a"), ("member", "b")}, ("subclass_cycle", "error", "d|"): {("member", "d")}}
    assert found(R.disjoint_parents(tables)) == {("disjoint_parents", "error", "e|p|q"): {("child", "e"), ("parent", "p"), ("other", "q")}}


def test_cardinalities_and_ranges(tables):
    assert names(R.cardinalities(tables)) == [("cardinality_max", "error", "d|u1"), ("cardinality_min", "error", "c|u1"), ("cardinality_min", "error", "f|u2")]
    got = found(R.orphan_ranges(tables))
    assert got == {
        ("orphan_range", "warning", "p2|d|k9"): {("property", "p2"), ("domain", "d"), ("range", "k9")},
        ("orphan_range", "warning", "p3|a"): {("property", "p3"), ("domain", "a")},
        ("orphan_range", "error", "p5"): {("property", "p5")},
    }


def test_redundant_classes(tables):
    got = {k[2]: {e for _, e in v} for k, v in found(R.redundant_classes(tables)).items()}
    assert got == {"k1": {"k1", "k2", "k3"}, "k4": {"k4", "k5"}, "k6": {"k6", "k7"}}


def test_individuals(tables):
    assert names(R.ungrounded(tables)) == [("ungrounded_individual", "warning", "i2"), ("ungrounded_individual", "warning", "i3")]
    kinds = {**tables, "classes": tables["constraints"].selectExpr("on_class AS key")}
    assert names(R.dangling_types(kinds)) == [("dangling_type", "error", "i2|gone")]
    assert names(R.individual_cardinalities(tables)) == [("individual_cardinality_max", "error", "i3|has part")]


def test_a_failing_rule_does_not_stop_the_others(spark, tables):
    def broken(t):
        raise ValueError("no")

    def late(t):
        return t["classes"].selectExpr("'late' AS rule", "'error' AS severity", "raise_error('x') AS finding", "'r' AS role", "key AS entity", "'a' AS action")

    own = (R.Rule("broken", broken, ()), R.Rule("late", late, ("classes",)), R.Rule("missing", R.ungrounded, ("nowhere",)), *R.ONTOLOGY_RULES)
    got, report = R.evaluate(spark, tables, own)
    assert report == {"broken": "skipped: ValueError", "late": report["late"], "missing": "absent", **{r.name: "evaluated" for r in R.ONTOLOGY_RULES}} and report["late"].startswith("skipped")
    assert len(found(got)) == 4 + 2 + 1 + 3 + 3 + 3
    rows = R.inbox(got, spark.createDataFrame([("redundant_class", "k1"), ("other", "k4")], "rule string, finding string"))
    assert rows.count() == 15 and {r.status for r in rows.collect()} == {"pending"}
    none, report = R.evaluate(spark, {k: v.limit(0) for k, v in tables.items()}, R.ONTOLOGY_RULES + R.INDIVIDUAL_RULES)
    assert none.count() == 0 and set(report.values()) == {"evaluated"}


def test_consolidation_lists_what_is_to_be_done(spark, tables):
    got, _ = R.evaluate(spark, tables, R.INDIVIDUAL_RULES[:1])
    decayed = spark.createDataFrame([("a", 0.5, 0.4), ("b", 0.5, 0.5), ("c", None, None)], "key string, confidence double, decayed double")
    plan = R.consolidation(got, decayed, spark.createDataFrame([("a", 12.0)], "key string, since double"))
    assert sorted(map(tuple, plan.collect()), key=str) == [("decay", "confidence", "a", 0.5, 0.4), ("rules", "ungrounded_individual", "i2", None, None), ("rules", "ungrounded_individual", "i3", None, None), ("stale", "evidence", "a", 12.0, None)]
