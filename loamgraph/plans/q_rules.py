"""Rule engine, consolidation, stored views and table tags over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import extract as E
from ..operators import migrations as M
from ..operators import rules as R
from ..operators import view as EV
from ..operators.core import new_folder
from .registry import query


def _text(df, *names):
    return df.select(*[F.col(n).cast("string").alias(n) for n in names])


def _ontology(t):
    """Imports as subclass edges, neighbours in a region as equivalents, its first and last nation as disjoint, lines as properties."""
    from pyspark.sql import Window

    region = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    near = t.nation.select(F.col("n_nationkey").alias("a"), F.lead("n_nationkey").over(region).alias("b")).where("b IS NOT NULL")
    apart = t.nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("a"), F.max("n_nationkey").alias("b"))
    kinds = F.explode(F.array(F.struct(F.lit("minCardinality").alias("restriction_type"), F.col("min_count").alias("v")), F.struct(F.lit("sh:maxCount").alias("restriction_type"), F.col("max_count").alias("v"))))
    limits = t.constraints.select("on_class", "property_uri", kinds.alias("k")).select("on_class", "property_uri", "k.restriction_type", F.col("k.v").alias("restriction_value"))
    return {
        "subclass": _text(t.cyclic_edges, "src", "dst"),
        "equivalent": _text(near, "a", "b"),
        "disjoint": _text(apart, "a", "b"),
        "constraints": _text(limits, "on_class", "property_uri", "restriction_type", "restriction_value"),
        "domain": _text(t.property_domain, "prop", "class_key"),
        "properties": _text(t.property_domain, "prop").distinct().select(F.col("prop").alias("key"), F.lit("lines").alias("uri"), F.lit("lines").alias("label"), F.lit("object").alias("kind")),
        "range": _text(t.property_range, "prop", "class_key"),
        "classes": _text(t.classes.where("expired IS NULL"), "key", "label"),
    }


_RULES = """sub AS (SELECT DISTINCT src::VARCHAR AS src, dst::VARCHAR AS dst FROM cyclic_edges),
near AS (SELECT n_nationkey::VARCHAR AS a, (lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::VARCHAR AS b FROM nation), eq AS (SELECT a, b FROM near WHERE b IS NOT NULL UNION SELECT b, a FROM near WHERE b IS NOT NULL),
twice AS (SELECT sub.src, sub.dst FROM sub JOIN eq ON eq.a = sub.dst AND eq.b = sub.src),
tri AS (SELECT s.src, s.dst, eq.b AS other FROM sub s JOIN eq ON eq.a = s.dst WHERE eq.b <> s.src AND NOT EXISTS (SELECT 1 FROM twice w WHERE w.src = s.src AND w.dst = s.dst) AND NOT EXISTS (SELECT 1 FROM sub k WHERE k.src = s.src AND k.dst = eq.b)),
reach(u, v) AS (SELECT src, dst FROM sub UNION SELECT r.u, s.dst FROM reach r JOIN sub s ON s.src = r.v),
scc AS (SELECT x.u AS node, least(x.u, min(x.v)) AS component FROM reach x JOIN reach y ON x.u = y.v AND x.v = y.u GROUP BY x.u), big AS (SELECT component FROM scc GROUP BY 1 HAVING count(*) > 1),
apart AS (SELECT least(min(n_nationkey)::VARCHAR, max(n_nationkey)::VARCHAR) AS a, greatest(min(n_nationkey)::VARCHAR, max(n_nationkey)::VARCHAR) AS b FROM nation GROUP BY n_regionkey HAVING count(*) > 1),
kids AS (SELECT x.src AS child, a, b FROM apart JOIN sub x ON x.dst = a JOIN sub y ON y.dst = b AND y.src = x.src),
uses AS (SELECT class_key AS on_class, count(*) AS n FROM property_domain GROUP BY 1), card AS (SELECT c.on_class::VARCHAR AS c, property_uri AS p, coalesce(n, 0) AS n, min_count, max_count FROM constraints c LEFT JOIN uses u ON u.on_class = c.on_class),
orphan AS (SELECT prop::VARCHAR AS prop, min(class_key::VARCHAR) AS domain FROM property_domain WHERE prop NOT IN (SELECT prop FROM property_range) GROUP BY prop),
form AS (SELECT key::VARCHAR AS key, regexp_replace(regexp_replace(lower(label), '''s\\b', '', 'g'), '[^a-z0-9]', '', 'g') AS f FROM classes WHERE expired IS NULL), forms AS (SELECT DISTINCT f FROM form WHERE f <> ''),
plural AS (SELECT x.f AS u, y.f AS v FROM forms x JOIN forms y ON length(x.f) >= 4 AND x.f <> y.f AND (y.f = x.f || 's' OR y.f = x.f || 'es' OR (right(x.f, 1) = 'y' AND y.f = left(x.f, -1) || 'ies'))),
both_ways AS (SELECT u, v FROM plural UNION SELECT v, u FROM plural), linked(u, v) AS (SELECT f, f FROM forms UNION SELECT l.u, b.v FROM linked l JOIN both_ways b ON b.u = l.v), root AS (SELECT u AS f, min(v) AS root FROM linked GROUP BY 1),
grp AS (SELECT key, min(key) OVER (PARTITION BY root) AS first, count(*) OVER (PARTITION BY root) AS n FROM form JOIN root USING (f)),
found AS (SELECT 'synonym_triangle' AS rule, 'error' AS severity, src || '|' || dst AS finding, unnest([{'role': 'child', 'entity': src}, {'role': 'parent', 'entity': dst}], recursive := true), 'redundant' AS action FROM twice
UNION ALL SELECT 'synonym_triangle', 'warning', src || '|' || dst || '|' || other, unnest([{'role': 'child', 'entity': src}, {'role': 'parent', 'entity': dst}, {'role': 'synonym', 'entity': other}], recursive := true), 'refined' FROM tri
UNION ALL SELECT 'subclass_cycle', 'error', component, 'member', node, 'contradicted' FROM scc JOIN big USING (component)
UNION ALL SELECT 'disjoint_parents', 'error', child || '|' || a || '|' || b, unnest([{'role': 'child', 'entity': child}, {'role': 'parent', 'entity': a}, {'role': 'other', 'entity': b}], recursive := true), 'contradicted' FROM kids
UNION ALL SELECT 'cardinality_min', 'error', c || '|' || p, unnest([{'role': 'class', 'entity': c}, {'role': 'property', 'entity': p}], recursive := true), 'contradicted' FROM card WHERE n < min_count
UNION ALL SELECT 'cardinality_max', 'error', c || '|' || p, unnest([{'role': 'class', 'entity': c}, {'role': 'property', 'entity': p}], recursive := true), 'contradicted' FROM card WHERE n > max_count
UNION ALL SELECT 'orphan_range', 'warning', prop || '|' || domain, unnest([{'role': 'property', 'entity': prop}, {'role': 'domain', 'entity': domain}], recursive := true), 'gap_filling' FROM orphan
UNION ALL SELECT 'redundant_class', 'warning', first, 'member', key, 'redundant' FROM grp WHERE n > 1)"""


@query(f"WITH RECURSIVE {_RULES} SELECT rule, severity, finding, role, entity, action FROM found")
def rule_findings(t):
    """All six rules over one ontology, every finding with its entities."""
    return R.evaluate(t.spark, _ontology(t))[0]


def _individuals(t):
    """Customers as individuals, their orders as assertions and provenance, their nation as type."""
    own = t.customer
    limits = F.explode(F.array(*[F.struct(F.lit(kind).alias("restriction_type"), F.lit(value).alias("restriction_value")) for kind, value in (("sh:minCount", "8"), ("maxCardinality", "20"))]))
    nations = t.nation.select(F.col("n_nationkey").cast("string").alias("on_class"), F.lit("u").alias("property_uri"), limits.alias("k")).select("on_class", "property_uri", "k.*")
    return {
        "individuals": own.select(F.col("c_custkey").cast("string").alias("key")),
        "provenance": t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("key"), F.lit(0).alias("start")),
        "types": own.select(F.col("c_custkey").cast("string").alias("src"), F.col("c_nationkey").cast("string").alias("dst")),
        "classes": t.imports_edges.select(F.col("dst").cast("string").alias("key")).distinct(),
        "constraints": nations,
        "properties": t.spark.sql("SELECT 'u' AS uri, 'ordered' AS label, 'k' AS key"),
        "assertions": t.orders.select(F.col("o_custkey").cast("string").alias("src"), F.lit("ordered").alias("predicate")),
    }


@query("""WITH n AS (SELECT c_custkey::VARCHAR AS k, c_nationkey::VARCHAR AS t, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT 'ungrounded_individual' AS rule, 'warning' AS severity, k AS finding, 'individual' AS role, k AS entity, 'uncertain' AS action FROM n WHERE f = 0
UNION ALL SELECT 'dangling_type', 'error', k || '|' || t, unnest([{'role': 'individual', 'entity': k}, {'role': 'class', 'entity': t}], recursive := true), 'contradicted' FROM n WHERE t NOT IN (SELECT dst::VARCHAR FROM imports_edges)
UNION ALL SELECT 'individual_cardinality_' || CASE WHEN n < 8 THEN 'min' ELSE 'max' END, 'error', k || '|ordered', unnest([{'role': 'individual', 'entity': k}, {'role': 'predicate', 'entity': 'ordered'}], recursive := true), 'contradicted' FROM n WHERE n < 8 OR n > 20""")
def individual_findings(t):
    return R.evaluate(t.spark, _individuals(t), R.INDIVIDUAL_RULES)[0]


_NOW, _STALE = 1_702_000_000.0, 1_701_000_000


@query(f"""WITH RECURSIVE {_RULES}, live AS (SELECT key, confidence, coalesce(last_evidenced_at, created) AS since FROM classes WHERE expired IS NULL)
SELECT 'rules' AS stage, rule AS what, finding AS entity, NULL::DOUBLE AS before, NULL::DOUBLE AS after FROM (SELECT DISTINCT rule, finding FROM found)
UNION ALL SELECT 'decay', 'confidence', key::VARCHAR, confidence, after FROM (SELECT *, round(least(confidence, greatest(0.05, confidence * power(2.0, -greatest({_NOW} - since, 0) / (90 * 86400.0)))), 6) AS after FROM live) WHERE confidence IS DISTINCT FROM after
UNION ALL SELECT 'stale', 'evidence', key::VARCHAR, since, NULL FROM live WHERE since < {_STALE}""")
def consolidation_findings(t):
    """What a consolidation would do: findings to the inbox, confidences that decay, beliefs without recent evidence."""
    live = t.classes.where("expired IS NULL").withColumn("since", F.coalesce("last_evidenced_at", "created"))
    after = S.decayed(F.col("confidence"), F.lit(_NOW) - F.col("since"))
    decayed = live.select("key", "confidence", F.round(after, 6).alias("decayed"))
    return R.consolidation(R.evaluate(t.spark, _ontology(t))[0], decayed, live.where(F.col("since") < _STALE).select("key", "since"))


_CLOSURE = "c(node, depth) AS (SELECT CAST(24 AS BIGINT), 0 UNION SELECT e.dst, c.depth + 1 FROM c JOIN imports_edges e ON e.src = c.node WHERE c.depth < 10), s AS (SELECT node AS source, min(depth) AS depth FROM c GROUP BY node)"
_SPLIT = "TIMESTAMP '2024-01-15 00:00:00'"


@query(f"WITH RECURSIVE {_CLOSURE} SELECT v.uri AS key, event_type AS label, source, depth > 0 AS is_imported FROM entity_versions v JOIN s ON s.source = v.uri % 25 WHERE v.expired IS NULL")
def effective_view_feed(t):
    """A view as of a time, then brought up by a feed of later versions, and by an import that comes at the end."""
    rows = t.entity_versions.select(F.col("uri").alias("key"), F.concat(F.lit("u"), F.col("event_type")).alias("uri"), F.col("event_type").alias("label"), (F.col("uri") % 25).alias("source"), "created", "expired")
    early = rows.where(f"created <= {_SPLIT} AND (expired IS NULL OR expired > {_SPLIT})").withColumn("expired", F.lit(None).cast(rows.schema["expired"].dataType))
    feed = rows.where(f"created > {_SPLIT}").withColumn("seq", F.expr("unix_micros(CAST(created AS TIMESTAMP))"))
    view = EV.EffectiveView(t.spark, new_folder(t.spark, "view"), 24)
    view.create(early, t.imports_edges.where("dst <> 3"))
    view.apply(feed)
    view.apply(feed.limit(0), rows.where("expired IS NULL"), t.imports_edges)
    return view.rows.select("key", "label", "source", "is_imported")


@query(f"SELECT event_type, count(*) AS n FROM entity_versions WHERE created <= {_SPLIT} AND (expired IS NULL OR expired > {_SPLIT}) GROUP BY 1")
def cached_snapshot(t):
    """A snapshot made once and read again from the cache."""
    cache = EV.SnapshotCache(t.spark, new_folder(t.spark, "snapshots"))
    make = lambda: t.entity_versions.where(f"created <= {_SPLIT} AND (expired IS NULL OR expired > {_SPLIT})")
    cache.get("all", 1_705_276_800.0, make)
    return cache.get("all", 1_705_276_800.0, make).groupBy("event_type").agg(F.count("*").alias("n"))


@query(r"""WITH m AS (SELECT ontology_id::VARCHAR AS ontology, key AS doc_id, description AS text, unnest(list_distinct(regexp_extract_all(description, '\b([A-Z][a-zA-Z][a-zA-Z0-9_-]+)\b', 1))) AS label FROM classes),
f AS (SELECT *, row_number() OVER (PARTITION BY ontology, lower(label) ORDER BY doc_id) AS rn FROM m) SELECT ontology, label, doc_id, strpos(lower(text), lower(label)) - 1 AS start FROM f WHERE rn = 1""")
def individuals_of_descriptions(t):
    """Individuals that the extractor by rule finds in descriptions, one for each ontology and label."""
    chunks = t.classes.select(F.col("ontology_id").cast("string").alias("ontology"), F.col("key").alias("doc_id"), F.lit(0).alias("chunk_id"), F.col("description").alias("text"))
    mentions, relations = E.words()(chunks)
    none = t.spark.createDataFrame([], "ontology string, key long, label string")
    made = E.individuals(chunks, mentions, relations, none, guided=False)[0]
    return made.select("ontology", "label", "doc_id", F.col("start").cast("long").alias("start"))


@query("SELECT key, label, coalesce(status, 'tier ' || tier) AS state FROM classes")
def migrated_classes(t):
    """Classes after three migrations: a column that is filled from another one, renamed, and two that are dropped."""
    own = M.Migrator(t.spark, new_folder(t.spark, "migrated"))
    make = M.Step(1, "create", lambda read: {"classes": t.classes.select("key", "label", "status", "tier")})
    narrow = M.Step(4, "narrow", lambda read: {"classes": read("classes").select("key", "label", "state")}, "without tier")
    own.apply([make, M.backfill(2, "classes", "status", "concat('tier ', tier)")])
    own.apply([make, M.backfill(2, "classes", "status", "concat('tier ', tier)"), M.rename_column(3, "classes", "status", "state"), narrow])
    return own.read("classes")


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY key) AS step, ('0x' || substr(sha256(concat(CASE WHEN label IS NULL THEN '-' ELSE length(label) || ':' || label END, length(key::VARCHAR) || ':' || key::VARCHAR)), 1, 15))::BIGINT::HUGEINT AS d FROM classes)
SELECT left(sha256(count(*)::VARCHAR || ':' || sum(d)::VARCHAR || ':' || sum((d * (step % 1000003)) % 2305843009213693951)::VARCHAR), 32) AS etag FROM e""")
def etag_of_table(t):
    """A tag of a whole table, summed by ranges."""
    return t.spark.createDataFrame([(EV.etag(t.classes.select("label", "key"), "key"),)], "etag string")
