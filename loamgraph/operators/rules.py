"""Rules over ontologies and individuals, with findings as rows.

A finding has a row for each entity it is about: rule, severity, finding (its name), role (what the entity is in it), entity and
action (what a curator is asked to consider).  Rules get a dictionary of tables of live rows, ids as strings, and look at what
they need only; one whose tables are missing finds nothing, and one that fails is named in the report and doesn't stop others.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .components import connected_components
from .core import cut
from .graph import scc

SCHEMA = "rule string, severity string, finding string, role string, entity string, action string"
ERROR, WARNING = "error", "warning"

Tables = dict[str, DataFrame]


def _found(df: DataFrame, rule: str, severity: str | Column, action: str, **roles: str | Column) -> DataFrame:
    """One finding for each row of df, named by its entities; roles: role and its column, nulls have no row."""
    own = {role: (F.col(c) if isinstance(c, str) else c).cast("string") for role, c in roles.items()}
    name = F.concat_ws("|", *own.values())
    entity = F.explode(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(role).alias("role"), c.alias("entity"))) for role, c in own.items()])))
    level = F.lit(severity) if isinstance(severity, str) else severity
    rows = df.select(level.alias("severity"), name.alias("finding"), entity.alias("e"))
    return rows.select(F.lit(rule).alias("rule"), "severity", "finding", "e.role", "e.entity", F.lit(action).alias("action")).distinct()


def _groups(members: DataFrame, rule: str, severity: str, action: str) -> DataFrame:
    """One finding for each group, named by its smallest member.  members: node, component."""
    return members.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("component").cast("string").alias("finding"), F.lit("member").alias("role"), F.col("node").cast("string").alias("entity"), F.lit(action).alias("action"))


def synonym_triangles(t: Tables) -> DataFrame:
    """a below b and b equivalent to c: an error if c is a, else a warning if a below c is missing.  subclass: src, dst; equivalent: a, b."""
    edges = t["subclass"].select("src", "dst").distinct()
    both = t["equivalent"].select("a", "b").unionByName(t["equivalent"].select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    met = edges.join(both.select(F.col("a").alias("dst"), F.col("b").alias("other")), "dst")
    twice = met.where("other = src").select("src", "dst")
    missing = met.where("other <> src").join(twice, ["src", "dst"], "left_anti").join(edges.select("src", F.col("dst").alias("other")), ["src", "other"], "left_anti")
    return _found(twice, "synonym_triangle", ERROR, "redundant", child="src", parent="dst").unionByName(_found(missing, "synonym_triangle", WARNING, "refined", child="src", parent="dst", synonym="other"))


def subclass_cycles(t: Tables) -> DataFrame:
    """Each class below itself, and each strongly connected component of several classes.  subclass: src, dst."""
    edges = t["subclass"]
    comps = cut(scc(edges))
    several = comps.join(comps.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "component")
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.concat("src", F.lit("|")).alias("component")).distinct()
    return _groups(several.select("node", "component").unionByName(loops), "subclass_cycle", ERROR, "contradicted")


def disjoint_parents(t: Tables) -> DataFrame:
    """A class below two parents that are disjoint, in either order.  subclass: src, dst; disjoint: a, b."""
    edges = t["subclass"].select("src", "dst").distinct()
    apart = t["disjoint"].where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = apart.join(edges.select(F.col("src").alias("child"), F.col("dst").alias("a")), "a")
    both = one.join(edges.select(F.col("src").alias("child"), F.col("dst").alias("b")), ["child", "b"])
    return _found(both, "disjoint_parents", ERROR, "contradicted", child="child", parent="a", other="b")


#: How kinds of restrictions bound a count: at least, at most, or both.
LEAST = ("minCardinality", "sh:minCount", "cardinality")
MOST = ("maxCardinality", "sh:maxCount", "cardinality")


def bounds(constraints: DataFrame) -> DataFrame:
    """on_class, property_uri, least and most; the strictest of several holds, values that are no whole numbers are passed over."""
    value = F.expr("try_cast(restriction_value AS BIGINT)")
    own = constraints.where("on_class IS NOT NULL AND property_uri IS NOT NULL").withColumn("value", value).where("value IS NOT NULL")
    kind = F.col("restriction_type")
    out = own.groupBy("on_class", "property_uri").agg(F.max(F.when(kind.isin(*LEAST), F.col("value"))).alias("least"), F.min(F.when(kind.isin(*MOST), F.col("value"))).alias("most"))
    return out.where("least IS NOT NULL OR most IS NOT NULL")


def cardinalities(t: Tables) -> DataFrame:
    """Classes with fewer or more properties of a URI than declared.  constraints; domain: prop, class_key; properties: key, uri."""
    uses = t["domain"].join(t["properties"].select(F.col("key").alias("prop"), F.col("uri").alias("property_uri")), "prop")
    n = uses.groupBy(F.col("class_key").alias("on_class"), "property_uri").agg(F.count("*").alias("n"))
    own = bounds(t["constraints"]).join(n, ["on_class", "property_uri"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = lambda test, name: _found(own.where(test), f"cardinality_{name}", ERROR, "contradicted", **{"class": "on_class", "property": "property_uri"})
    return found("n < least", "min").unionByName(found("n > most", "max"))


def orphan_ranges(t: Tables) -> DataFrame:
    """Object properties without a range: errors without a domain, else warnings, with the class their text names if `named` (prop, class_key) has one.

    properties: key, kind; domain: prop, class_key; range: prop.
    """
    orphans = t["properties"].where("kind = 'object'").select(F.col("key").alias("prop")).join(t["range"].select("prop"), "prop", "left_anti")
    placed = orphans.join(t["domain"].groupBy("prop").agg(F.min("class_key").alias("domain")), "prop", "left")
    named = t["named"].groupBy("prop").agg(F.min("class_key").alias("target")) if "named" in t else placed.select("prop", F.lit(None).cast("string").alias("target")).limit(0)
    level = F.when(F.col("domain").isNull(), ERROR).otherwise(WARNING)
    return _found(placed.join(named, "prop", "left"), "orphan_range", level, "gap_filling", property="prop", domain="domain", range=F.when(F.col("domain").isNotNull(), F.col("target")))


def redundant_classes(t: Tables) -> DataFrame:
    """Classes whose normalised labels (else keys) are equal or each other's plural.  classes: key, label."""
    label = F.when(F.length(F.trim("label")) > 0, F.col("label")).otherwise(F.col("key").cast("string"))
    own = t["classes"].select("key", X.normalise_compact(label).alias("form")).where("form <> ''")
    forms = own.select("form").distinct()
    more = forms.where(F.length("form") >= 4).select(F.col("form").alias("src"), F.explode(X.plural_candidates(F.col("form"))).alias("dst"))
    joins = more.join(forms.withColumnRenamed("form", "dst"), "dst", "left_semi").where("src <> dst")
    comps = connected_components(joins).withColumnRenamed("node", "form").withColumnRenamed("component", "root")
    rooted = cut(own.join(comps, "form", "left").select(F.col("key").alias("node"), F.coalesce("root", "form").alias("root")))
    least = rooted.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1").select("root", "component")
    return _groups(rooted.join(least, "root"), "redundant_class", WARNING, "redundant")


def ungrounded(t: Tables) -> DataFrame:
    """Individuals without any span in a text.  individuals: key; provenance: key, start."""
    spans = t["provenance"].where("start IS NOT NULL").select("key")
    return _found(t["individuals"].join(spans, "key", "left_anti"), "ungrounded_individual", WARNING, "uncertain", individual="key")


def dangling_types(t: Tables) -> DataFrame:
    """Individuals of classes that are not live.  types: src, dst; classes: key."""
    gone = t["types"].join(t["classes"].select(F.col("key").alias("dst")), "dst", "left_anti")
    return _found(gone, "dangling_type", ERROR, "contradicted", individual="src", **{"class": "dst"})


def individual_cardinalities(t: Tables) -> DataFrame:
    """Individuals with fewer or more assertions of a predicate than their class allows.

    constraints; properties: uri, label (what assertions name); types: src, dst; individuals: key; assertions: src, predicate.
    """
    label = t["properties"].groupBy(F.col("uri").alias("property_uri")).agg(F.min("label").alias("predicate"))
    limits = bounds(t["constraints"]).join(label, "property_uri").groupBy("on_class", "predicate").agg(F.max("least").alias("least"), F.min("most").alias("most"))
    live = t["types"].join(t["individuals"].select(F.col("key").alias("src")), "src", "left_semi")
    n = t["assertions"].groupBy("src", "predicate").agg(F.count("*").alias("n"))
    own = live.join(limits, F.col("dst") == F.col("on_class")).join(n, ["src", "predicate"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = lambda test, name: _found(own.where(test), f"individual_cardinality_{name}", ERROR, "contradicted", individual="src", predicate="predicate")
    return found("n < least", "min").unionByName(found("n > most", "max"))


class Rule(NamedTuple):
    name: str
    find: Callable[[Tables], DataFrame]
    needs: tuple[str, ...]


ONTOLOGY_RULES = (
    Rule("synonym_triangle", synonym_triangles, ("subclass", "equivalent")),
    Rule("subclass_cycle", subclass_cycles, ("subclass",)),
    Rule("orphan_range", orphan_ranges, ("properties", "domain", "range")),
    Rule("redundant_class", redundant_classes, ("classes",)),
    Rule("disjoint_parents", disjoint_parents, ("subclass", "disjoint")),
    Rule("cardinality", cardinalities, ("constraints", "domain", "properties")),
)
INDIVIDUAL_RULES = (
    Rule("ungrounded_individual", ungrounded, ("individuals", "provenance")),
    Rule("dangling_type", dangling_types, ("types", "classes")),
    Rule("individual_cardinality", individual_cardinalities, ("constraints", "properties", "types", "individuals", "assertions")),
)


def evaluate(spark: SparkSession, tables: Tables, rules: tuple[Rule, ...] = ONTOLOGY_RULES) -> tuple[DataFrame, dict[str, str]]:
    """All findings, and what became of each rule: evaluated, absent (a table is missing) or skipped with its error.

    Each rule's findings are checkpointed, so an error at run time stops that rule only.
    """
    out, report = spark.createDataFrame([], SCHEMA), {}
    for rule in rules:
        if not set(rule.needs) <= tables.keys():
            report[rule.name] = "absent"
            continue
        try:
            found = cut(rule.find(tables).select(*out.columns))
        except Exception as error:  # noqa: BLE001  any rule may fail in any way
            report[rule.name] = f"skipped: {type(error).__name__}"
            continue
        report[rule.name] = "evaluated"
        out = out.unionByName(found)
    return out, report


def inbox(findings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A pending row for each finding that has none yet: rule, severity, finding, entities, action, status.  known: rule, finding."""
    one = findings.groupBy("rule", "finding").agg(F.first("severity").alias("severity"), F.first("action").alias("action"), F.count("*").alias("entities"), F.min("entity").alias("entity"))
    if known is not None:
        one = one.join(known.select("rule", "finding").distinct(), ["rule", "finding"], "left_anti")
    return one.withColumn("status", F.lit("pending"))


def consolidation(findings: DataFrame, decayed: DataFrame, stale: DataFrame) -> DataFrame:
    """The plan of a pass, a row for each thing to do: stage (rules, decay, stale), what, entity, before and after.

    decayed: key, confidence, decayed (those that change); stale: key, since (when there last was evidence).
    """
    none = F.lit(None).cast("double")
    one = inbox(findings).select(F.lit("rules").alias("stage"), F.col("rule").alias("what"), F.col("finding").alias("entity"), none.alias("before"), none.alias("after"))
    two = decayed.where("NOT confidence <=> decayed").select(F.lit("decay"), F.lit("confidence"), F.col("key").cast("string"), F.col("confidence"), F.col("decayed"))
    three = stale.select(F.lit("stale"), F.lit("evidence"), F.col("key").cast("string"), F.col("since").cast("double"), none)
    return one.union(two).union(three)
