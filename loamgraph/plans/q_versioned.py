"""Queries over versioned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import versioned as V
from ..operators.core import hinted
from .registry import query

T1, T2 = "TIMESTAMP_NTZ '2024-01-05 00:00:00'", "TIMESTAMP_NTZ '2024-01-20 00:00:00'"
NOW = 1_800_000_000.0


@query("SELECT event_type, count(*) AS n FROM entity_versions WHERE created <= TIMESTAMP '2024-01-15' AND (expired IS NULL OR expired > TIMESTAMP '2024-01-15') GROUP BY event_type")
def snapshot_live_counts(t):
    return V.as_of(t.entity_versions, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT key, uri, label FROM classes WHERE expired IS NULL AND ontology_id = 1")
def class_scan_live(t):
    return V.live(t.classes).where("ontology_id = 1").select("key", "uri", "label")


@query("SELECT key, uri, label, version FROM classes WHERE expired IS NULL AND key = 17")
def class_point_lookup(t):
    return V.current(t.classes, 17).select("key", "uri", "label", "version")


@query("SELECT key, uri, event_type, value FROM entity_versions WHERE expired IS NULL AND uri = 42")
def current_version_lookup(t):
    return V.current(t.entity_versions, 42, "uri").select("key", "uri", "event_type", "value")


@query("SELECT prop, class_key, 'domain' AS kind FROM property_domain WHERE class_key % 3 = 1 UNION ALL SELECT prop, class_key, 'range' FROM property_range WHERE class_key % 3 = 1")
def property_scan_union(t):
    both = t.property_domain.withColumn("kind", F.lit("domain")).unionByName(t.property_range.withColumn("kind", F.lit("range")), allowMissingColumns=True)
    return both.where("class_key % 3 = 1")


@query("SELECT prop, arg_min(kind, o) AS kind FROM (SELECT prop, 'domain' AS kind, 1 AS o FROM property_domain UNION ALL SELECT prop, 'range', 2 FROM property_range) GROUP BY prop")
def property_table_resolver(t):
    both = t.property_domain.select("prop", F.lit("domain").alias("kind"), F.lit(1).alias("o")).unionByName(t.property_range.select("prop", F.lit("range").alias("kind"), F.lit(2).alias("o")))
    return both.groupBy("prop").agg(F.min_by("kind", "o").alias("kind"))


@query("SELECT key, src, dst, 'relation' AS edge_table FROM relation_edges WHERE key = 12 AND expired IS NULL UNION ALL SELECT src, src, dst, 'imports' FROM imports_edges WHERE src = 12")
def edge_owner_lookup(t):
    own = V.live(t.relation_edges).select("key", "src", "dst", F.lit("relation").alias("edge_table"))
    imports = t.imports_edges.select(F.col("src").alias("key"), "src", "dst", F.lit("imports").alias("edge_table"))
    return own.unionByName(imports).where("key = 12")


@query("SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, 'imports' AS edge_type FROM imports_edges UNION ALL SELECT src, dst, 'subclass_of' FROM subclass_edges")
def edge_scan_tagged(t):
    imports = t.imports_edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.lit("imports").alias("edge_type"))
    return imports.unionByName(t.subclass_edges.withColumn("edge_type", F.lit("subclass_of")))


@query("SELECT e.key, e.edge_type, p.label AS property_label FROM relation_edges e LEFT JOIN classes p ON p.key = e.dst AND p.expired IS NULL WHERE e.expired IS NULL AND e.ontology_id = 2")
def edges_with_properties(t):
    edges = V.live(t.relation_edges).where("ontology_id = 2")
    return edges.join(V.live(t.classes).select(F.col("key").alias("dst"), F.col("label").alias("property_label")), "dst", "left").select("key", "edge_type", "property_label")


_CLOSURE = "WITH RECURSIVE c(src, dst) AS (SELECT src, dst FROM imports_edges WHERE src = 24 UNION SELECT e.src, e.dst FROM c JOIN imports_edges e ON e.src = c.dst)"


@query(_CLOSURE + ", ids AS (SELECT 24 AS id UNION SELECT dst FROM c) SELECT key, ontology_id FROM relation_edges WHERE expired IS NULL AND ontology_id IN (SELECT id FROM ids)")
def edges_across_ontologies(t):
    from ..operators import graph

    ids = graph.closure(t.imports_edges, [24], 50).select(F.col("node").alias("ontology_id"))
    return V.live(t.relation_edges).join(ids, "ontology_id", "left_semi").select("key", "ontology_id")


@query(_CLOSURE + ", ids AS (SELECT 24 AS id UNION SELECT dst FROM c) SELECT prop, kind FROM (SELECT prop, class_key, 'domain' AS kind FROM property_domain UNION ALL SELECT prop, class_key, 'range' FROM property_range) WHERE class_key IN (SELECT id FROM ids)")
def properties_across_ontologies(t):
    from ..operators import graph

    ids = graph.closure(t.imports_edges, [24], 50).select(F.col("node").alias("class_key"))
    both = t.property_domain.withColumn("kind", F.lit("domain")).unionByName(t.property_range.withColumn("kind", F.lit("range")))
    return both.join(ids, "class_key", "left_semi").select("prop", "kind")


@query("SELECT key, CAST(CASE WHEN key % 5 = 0 AND expired IS NULL THEN 1800000000 ELSE expired END AS DOUBLE) AS expired, CAST(CASE WHEN key % 5 = 0 AND expired IS NULL THEN 1807776000 END AS DOUBLE) AS ttl_expire_at FROM classes")
def expire_entities(t):
    return V.expire(t.classes, t.classes.where("key % 5 = 0"), NOW).select("key", "expired", "ttl_expire_at")


@query("SELECT key FROM classes WHERE NOT (key % 5 = 0 AND expired IS NULL)")
def ttl_garbage_collection(t):
    return V.collect_garbage(V.expire(t.classes, t.classes.where("key % 5 = 0"), NOW), NOW + 7_776_000).select("key")


@query("""SELECT key, label, version, created, CASE WHEN key % 11 = 0 AND expired IS NULL THEN CAST(1800000000 AS DOUBLE) ELSE expired END AS expired FROM classes
UNION ALL SELECT key + 1000000, 'new ' || label, version + 1, CAST(1800000000 AS DOUBLE), NULL FROM classes WHERE key % 11 = 0 AND expired IS NULL""")
def update_entities(t):
    changes = t.classes.where("key % 11 = 0").select("key", F.concat(F.lit("new "), "label").alias("label"))
    return V.new_versions(t.classes, changes, NOW, 1_000_000).select("key", "label", "version", "created", "expired")


@query("SELECT key, label, CAST(1 AS BIGINT) AS version, CAST(1800000000 AS DOUBLE) AS created, CAST(NULL AS DOUBLE) AS expired FROM classes")
def create_versions(t):
    return t.classes.select("key", "label", F.lit(1).cast("long").alias("version"), F.lit(NOW).alias("created"), F.lit(None).cast("double").alias("expired"))


@query("""SELECT key, CASE WHEN src % 97 = 0 THEN src + 1000000 ELSE src END AS src, CASE WHEN dst % 97 = 0 THEN dst + 1000000 ELSE dst END AS dst, src % 97 = 0 OR dst % 97 = 0 AS moved FROM relation_edges WHERE expired IS NULL""")
def repoint_edges(t):
    edges = V.live(t.relation_edges)
    nodes = edges.select(F.col("src").alias("old")).union(edges.select("dst")).distinct().where("old % 97 = 0")
    return V.remap_edges(edges, nodes.withColumn("new", F.col("old") + 1_000_000)).select("key", "src", "dst", "moved")


@query("""SELECT DISTINCT l_orderkey AS src, l_partkey AS dst, l_suppkey % 5 AS ontology_id FROM lineitem l WHERE l_returnflag = 'R'
AND NOT EXISTS (SELECT 1 FROM relation_edges e WHERE e.expired IS NULL AND e.src = l.l_orderkey AND e.dst = l.l_partkey AND e.ontology_id = l.l_suppkey % 5)""")
def insert_edges_if_absent(t):
    more = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_suppkey") % 5).alias("ontology_id"))
    return V.insert_absent(t.relation_edges, more, ["src", "dst", "ontology_id"])


@query("SELECT key, src, dst FROM relation_edges WHERE expired IS NULL AND (dst % 50 = 0 OR src % 50 = 0)")
def expire_class_cascade(t):
    keys = t.part.select(F.col("p_partkey").alias("key")).union(t.orders.select("o_orderkey")).where("key % 50 = 0")
    return V.expire_cascade(t.relation_edges, keys).select("key", "src", "dst")


@query("""SELECT on_class, min_count, max_count, 1 AS version FROM constraints WHERE on_class % 4 <> 0
UNION ALL SELECT on_class, min_count + 1, max_count, 2 FROM constraints WHERE on_class % 4 = 0""")
def update_constraints(t):
    base = t.constraints.select(F.col("on_class").alias("key"), "min_count", "max_count", F.lit(1).alias("version"), F.lit(0.0).alias("created"), F.lit(None).cast("double").alias("expired"))
    changed = V.new_versions(base, base.where("key % 4 = 0").select("key", (F.col("min_count") + 1).alias("min_count")), NOW, 0)
    return V.live(changed).select(F.col("key").alias("on_class"), "min_count", "max_count", "version")


@query("SELECT key, event_type, version FROM entity_versions WHERE uri = (SELECT uri FROM entity_versions WHERE key = 5)")
def version_history(t):
    return V.history(t.entity_versions, 5).select("key", "event_type", "version")


@query("""SELECT e.key, row_number() OVER (ORDER BY e.created, e.key)::INTEGER AS nth FROM relation_edges e
JOIN (SELECT src, dst, ontology_id FROM relation_edges WHERE key = (SELECT max(key) FROM relation_edges)) k ON e.src = k.src AND e.dst = k.dst AND e.ontology_id = k.ontology_id""")
def edge_version_history(t):
    newest = t.relation_edges.agg(F.max("key")).head()[0]
    return V.edge_history(t.relation_edges, newest).select("key", "nth")


@query("""SELECT key, uri, created AS at, CASE WHEN version = 1 THEN 'created' ELSE 'updated' END AS event, 'user' AS entity_type FROM entity_versions
UNION ALL SELECT key, uri, expired, 'expired', 'user' FROM entity_versions WHERE expired IS NOT NULL""")
def timeline_events(t):
    return V.timeline(t.entity_versions, "user").select("key", "uri", "at", "event", "entity_type")


_ASOF = "SELECT * FROM entity_versions WHERE created <= TIMESTAMP '{0}' AND (expired IS NULL OR expired > TIMESTAMP '{0}')"


@query(f"WITH a AS ({_ASOF.format('2024-01-05')}), b AS ({_ASOF.format('2024-01-20')}) " + """
SELECT coalesce(a.uri, b.uri) AS uri, CASE WHEN a.uri IS NULL THEN 'added' WHEN b.uri IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.uri = b.uri WHERE a.uri IS NULL OR b.uri IS NULL OR a.event_type IS DISTINCT FROM b.event_type OR a.value IS DISTINCT FROM b.value""")
def temporal_diff(t):
    return V.temporal_diff(t.entity_versions, F.expr(T1), F.expr(T2), "uri", ["event_type", "value"])


@query("""SELECT a.key, a.label IS DISTINCT FROM b.label OR a.description IS DISTINCT FROM b.description AS changed FROM classes a JOIN classes b ON b.key = a.key + 1""")
def change_predicate(t):
    b = t.classes.select((F.col("key") - 1).alias("key"), F.struct("label", "description").alias("b"))
    return t.classes.join(b, "key").select("key", (~F.struct("label", "description").eqNullSafe(F.col("b"))).alias("changed"))


@query("""WITH a AS (SELECT * FROM classes WHERE ontology_id = 0), b AS (SELECT 'urn:part#' || CAST(key + 1 AS VARCHAR) AS uri, label, description FROM classes WHERE ontology_id = 2)
SELECT coalesce(a.uri, b.uri) AS uri, CASE WHEN a.uri IS NULL THEN 'added' WHEN b.uri IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.uri = b.uri WHERE a.uri IS NULL OR b.uri IS NULL OR a.label IS DISTINCT FROM b.label OR a.description IS DISTINCT FROM b.description""")
def schema_diff_by_uri(t):
    a = t.classes.where("ontology_id = 0")
    b = t.classes.where("ontology_id = 2").withColumn("uri", F.concat(F.lit("urn:part#"), (F.col("key") + 1).cast("string")))
    return V.diff(a, b, ["uri"], ["label", "description"])


@query("""WITH a AS (SELECT * FROM constraints WHERE on_class % 5 <> 0), b AS (SELECT on_class, property_uri, min_count + CASE WHEN on_class % 7 = 0 THEN 1 ELSE 0 END AS min_count FROM constraints WHERE on_class % 3 <> 0)
SELECT coalesce(a.on_class, b.on_class) AS on_class, coalesce(a.property_uri, b.property_uri) AS property_uri,
CASE WHEN a.on_class IS NULL THEN 'added' WHEN b.on_class IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.on_class = b.on_class AND a.property_uri = b.property_uri WHERE a.on_class IS NULL OR b.on_class IS NULL OR a.min_count <> b.min_count""")
def constraint_diff(t):
    a = t.constraints.where("on_class % 5 <> 0")
    b = t.constraints.where("on_class % 3 <> 0").withColumn("min_count", F.col("min_count") + F.when(F.col("on_class") % 7 == 0, 1).otherwise(0))
    return V.diff(a, b, ["on_class", "property_uri"], ["min_count"])


@query("""WITH a AS (SELECT * FROM classes WHERE ontology_id = 0), b AS (SELECT 'urn:part#' || CAST(key + 1 AS VARCHAR) AS uri, label FROM classes WHERE ontology_id = 2),
d AS (SELECT CASE WHEN a.uri IS NULL THEN 'added' WHEN b.uri IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.uri = b.uri WHERE a.uri IS NULL OR b.uri IS NULL OR a.label IS DISTINCT FROM b.label)
SELECT 'classes' AS section, change, count(*) AS n FROM d GROUP BY change UNION ALL
SELECT 'constraints', CASE WHEN on_class % 2 = 0 THEN 'added' ELSE 'removed' END, count(*) FROM constraints GROUP BY 2""")
def ontology_diff_summary(t):
    a = t.classes.where("ontology_id = 0")
    b = t.classes.where("ontology_id = 2").withColumn("uri", F.concat(F.lit("urn:part#"), (F.col("key") + 1).cast("string")))
    first = V.diff(a, b, ["uri"], ["label"]).select(F.lit("classes").alias("section"), "change")
    second = V.diff(t.constraints.where("on_class % 2 = 1"), t.constraints.where("on_class % 2 = 0"), ["on_class"], ["min_count"]).select(F.lit("constraints").alias("section"), "change")
    return first.unionByName(second).groupBy("section", "change").agg(F.count("*").alias("n"))


@query("SELECT key + 1000000 AS key, event_type, value, version + 1 AS version, CAST(1800000000 AS DOUBLE) AS created FROM entity_versions WHERE key = 5")
def revert_to_version(t):
    rows = t.entity_versions.withColumn("created", F.expr("CAST(CAST(created AS TIMESTAMP) AS DOUBLE)")).withColumn("expired", F.lit(None).cast("double"))
    at = rows.where("key = 5").select(F.col("key").alias("k"), F.col("created").alias("at"))
    own = rows.join(hinted(at), F.col("key") == F.col("k"))
    return V.revert(own, 5, F.col("at"), NOW, 1_000_000).select("key", "event_type", "value", "version", "created")


@query("""SELECT key, src, dst, src IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) AND dst IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) AS both_ends FROM relation_edges
WHERE created <= TIMESTAMP '1996-01-01' AND (expired IS NULL OR expired > TIMESTAMP '1996-01-01')
AND (src IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) OR dst IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT p_partkey FROM part WHERE p_partkey % 2 = 0))""".replace("src IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) AND dst IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)", "src IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) AND dst IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)"))
def snapshot_edges_as_of(t):
    active = t.orders.select(F.col("o_orderkey").alias("key")).union(t.part.select("p_partkey")).where("key % 2 = 0")
    return V.snapshot_edges(t.relation_edges, active, F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")).select("key", "src", "dst", "both_ends")


@query("""SELECT 'class' AS entity, count(*) AS n FROM classes WHERE created <= 1700900000 AND (expired IS NULL OR expired > 1700900000)
UNION ALL SELECT 'edge', count(*) FROM relation_edges WHERE created <= TIMESTAMP '1996-01-01' AND (expired IS NULL OR expired > TIMESTAMP '1996-01-01')""")
def snapshot_composite(t):
    a = V.as_of(t.classes, F.lit(1700900000.0)).select(F.lit("class").alias("entity"))
    b = V.as_of(t.relation_edges, F.expr("TIMESTAMP_NTZ '1996-01-01 00:00:00'")).select(F.lit("edge").alias("entity"))
    return a.unionByName(b).groupBy("entity").agg(F.count("*").alias("n"))


@query("SELECT key, uri, label FROM classes WHERE created <= 1700900000 AND (expired IS NULL OR expired > 1700900000) AND ontology_id = 1 AND tier = 'domain'")
def as_of_with_filters(t):
    return V.as_of(t.classes, F.lit(1700900000.0), ontology_id=1, tier="domain").select("key", "uri", "label")


@query("SELECT key, action, status, entity FROM (SELECT *, row_number() OVER (PARTITION BY entity, action ORDER BY created DESC, key DESC) AS rn FROM revisions WHERE status IN ('pending', 'applied')) WHERE rn = 1")
def latest_idempotency_row(t):
    from pyspark.sql import Window

    own = t.revisions.where(F.col("status").isin("pending", "applied"))
    order = Window.partitionBy("entity", "action").orderBy(F.col("created").desc(), F.col("key").desc())
    return own.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("key", "action", "status", "entity")


@query("SELECT key, event_type, value FROM (SELECT * FROM entity_versions WHERE ontology_id = 1 ORDER BY created DESC, key DESC LIMIT 30)")
def quality_trend_latest(t):
    return t.entity_versions.where("ontology_id = 1").orderBy(F.col("created").desc(), F.col("key").desc()).limit(30).orderBy("created", "key").select("key", "event_type", "value")
