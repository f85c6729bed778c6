"""Queries over projections, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import relational as R
from ..operators.core import hinted
from .registry import query


@query("SELECT key, uri, label, ontology_id, status, tier, confidence, version FROM classes")
def summary_projection_classes(t):
    return R.project(t.classes, R.CLASS_SUMMARY)


@query("SELECT key, src, dst, ontology_id, edge_type, confidence FROM relation_edges")
def summary_projection_edges(t):
    return R.project(t.relation_edges, R.EDGE_SUMMARY)


@query("SELECT key, label, n_name AS ontology_name FROM classes LEFT JOIN nation ON n_nationkey = ontology_id WHERE expired IS NULL AND contains(lower(label), 'a') AND tier = 'domain' AND confidence >= 0.5")
def multi_predicate_listing(t):
    own = R.listing(t.classes, label="A", equal={"tier": "domain"}, at_least={"confidence": 0.5})
    names = t.nation.select(F.col("n_nationkey").cast("long").alias("ontology_id"), F.col("n_name").alias("ontology_name"))
    return own.join(hinted(names), "ontology_id", "left").select("key", "label", "ontology_name")


@query("SELECT key, verdict, action, status FROM revisions WHERE ontology_id = 1 AND action = 'REVISE' AND status = 'applied' AND created >= TIMESTAMP '2024-01-10'")
def revision_filter(t):
    return R.revisions(t.revisions, 1, action="REVISE", status="applied", since=F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")).select("key", "verdict", "action", "status")


@query("SELECT key, entity FROM revisions WHERE action = 'FLAG_FOR_CURATION' AND status = 'pending' AND ontology_id = 2")
def pending_inbox(t):
    return R.revisions(t.revisions, 2, action="FLAG_FOR_CURATION", status="pending").select("key", "entity")


@query("SELECT on_class, min_count, max_count FROM constraints WHERE on_class % 2 = 0 AND min_count < max_count")
def constraint_filter(t):
    return t.constraints.where((F.col("on_class") % 2 == 0) & (F.col("min_count") < F.col("max_count"))).select("on_class", "min_count", "max_count")


@query("SELECT key FROM classes WHERE ontology_id = 0 AND expired IS NULL AND coalesce(last_evidenced_at, created) < 1701000000")
def stale_beliefs(t):
    return R.stale(t.classes, 0, 1_701_000_000.0).select("key")


@query("SELECT uid AS user_id, count(*) AS unread FROM (SELECT user_id AS uid, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS read FROM events) WHERE read IS NOT true GROUP BY uid")
def unread_count(t):
    m = F.col("event_id") % 3
    read = F.when(m == 0, True).when(m == 1, False)
    return t.events.withColumn("read", read).where(R.differs(F.col("read"), F.lit(True))).groupBy("user_id").agg(F.count("*").alias("unread"))


@query("SELECT key, status FROM classes WHERE status IS DISTINCT FROM 'approved'")
def non_approved(t):
    return t.classes.where(R.differs(F.col("status"), F.lit("approved"))).select("key", "status")


@query("SELECT key, status FROM classes WHERE status = 'approved'")
def approved(t):
    return t.classes.where("status = 'approved'").select("key", "status")


@query("SELECT key, action FROM (SELECT * FROM decisions WHERE action IN ('edit', 'reject') AND run_id IN ('en', 'fr') ORDER BY created_at DESC, key DESC LIMIT 100)")
def feedback_filter(t):
    runs = t.documents.select(F.col("lang").alias("run_id")).distinct().where(F.col("run_id").isin("en", "fr"))
    return R.feedback(t.decisions, runs, 100).select("key", "action")


@query("SELECT key, label FROM classes WHERE lower(trim(brand)) NOT IN ('brand#11', 'brand#22')")
def generic_term_filter(t):
    return R.without_terms(t.classes, "brand", ["brand#11", "brand#22"]).select("key", "label")


@query("SELECT key FROM classes WHERE NOT (len(regexp_split_to_array(trim(kind), '\\s+')) = 1 AND confidence < 0.5)")
def low_confidence_single_words(t):
    return R.without_weak_words(t.classes, "kind").select("key")


@query("SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM classes GROUP BY 1")
def confidence_tiers(t):
    return t.classes.groupBy(S.tier(F.col("confidence")).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE source IS NULL OR source = 'src1'")
def tenant_filter(t):
    return R.tenant(t.documents, "source", "src1").select("doc_id", "source")


@query("SELECT l_orderkey AS key, bool_or(l_quantity > 49) AS grounded FROM lineitem GROUP BY l_orderkey HAVING NOT bool_or(l_quantity > 49)")
def evidence_grounding(t):
    own = t.lineitem.groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(F.struct(F.when(F.col("l_quantity") > 49, F.col("l_partkey")).alias("char_span"))).alias("provenance"))
    return own.where(~R.grounded(F.col("provenance"))).select("key", F.lit(False).alias("grounded"))


@query("SELECT e.key, e.dst FROM relation_edges e LEFT JOIN classes c ON c.key = e.dst WHERE e.expired IS NULL AND (c.key IS NULL OR c.expired IS NOT NULL)")
def dangling_types(t):
    classes = t.classes.select(F.col("key").alias("dst"), F.lit(True).alias("_there"), "expired")
    edges = t.relation_edges.where("expired IS NULL").select("key", "dst")
    return edges.join(classes, "dst", "left").where("_there IS NULL OR expired IS NOT NULL").select("key", "dst")


@query("""WITH k AS (SELECT doc_id, avg((chunk_index % 7 = 3)::INT) AS v, avg((role = 'system')::INT) AS p, avg((length(text) - length(replace(text, '|', '')) > 4)::INT) AS tables, avg(regexp_matches(lower(text), 'specification|requirement|rfc|iso')::INT) AS technical, count(*) AS n FROM chunks GROUP BY 1)
SELECT doc_id, CASE WHEN v >= 0.3 OR p >= 0.5 OR (v > 0 AND p > 0) THEN 'visual_heavy_presentation' WHEN tables > 0.3 THEN 'tabular_structured' WHEN n <= 10 AND technical > 0.2 THEN 'short_technical' WHEN n > 50 THEN 'long_narrative' WHEN technical > 0.2 THEN 'short_technical' ELSE 'default' END AS kind FROM k""")
def document_classifier(t):
    return R.classify_documents(t.chunks, F.col("chunk_index") % 7 == 3, F.col("role") == "system")


@query("SELECT doc_id, avg((role = 'user')::INT) >= 0.3 AS visual_heavy FROM chunks GROUP BY doc_id")
def visual_heavy(t):
    return t.chunks.groupBy("doc_id").agg((F.avg((F.col("role") == "user").cast("int")) >= 0.3).alias("visual_heavy"))


@query("SELECT min_count, max_count FROM constraints WHERE on_class = 7")
def constraints_of_class(t):
    return t.constraints.where("on_class = 7").select("min_count", "max_count")


@query("SELECT key, action FROM revisions WHERE entity = 9")
def revisions_of_entity(t):
    return t.revisions.where("entity = 9").orderBy(F.col("created").desc()).select("key", "action")


@query("SELECT key, uri, label, confidence, status, tier FROM classes WHERE expired IS NULL")
def class_scores(t):
    return t.classes.where("expired IS NULL").select("key", "uri", "label", "confidence", "status", "tier")


@query("SELECT key, action FROM decisions WHERE run_id = 'de' AND action = 'approve'")
def decision_listing(t):
    return t.decisions.where("run_id = 'de' AND action = 'approve'").select("key", "action")


@query("SELECT run_id, action, count(*) AS n FROM decisions GROUP BY run_id, action")
def decision_count(t):
    return t.decisions.groupBy("run_id", "action").agg(F.count("*").alias("n"))


@query("SELECT d.key, c.label FROM decisions d JOIN classes c ON c.key = d.key")
def decision_class_lookup(t):
    return t.decisions.select("key").join(t.classes.select("key", "label"), "key")


@query("SELECT key FROM decisions WHERE ontology_id = 'src1' OR run_id IN (SELECT lang FROM documents WHERE source = 'src1' AND lang <> 'en')")
def run_membership(t):
    runs = t.documents.where("source = 'src1' AND lang <> 'en'").select(F.col("lang").alias("run_id")).distinct()
    return R.member_of(t.decisions, F.col("ontology_id") == "src1", runs, "run_id").select("key")


@query("SELECT l.l_orderkey AS key, l.l_linenumber AS line, coalesce(c.c_name, n.n_name) AS owner FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F' LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey")
def registry_run_document_chain(t):
    o = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    s = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    out = t.lineitem.join(o, "l_orderkey", "left").join(c, "o_custkey", "left").join(s, "l_suppkey", "left").join(hinted(t.nation), "n_nationkey", "left")
    return out.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.coalesce("c_name", "n_name").alias("owner"))


@query("SELECT e.event_id, e.user_id, c.c_name FROM events e LEFT JOIN (SELECT c_nationkey, arg_min(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey) c ON c.c_nationkey = e.user_id % 25")
def bulk_enrichment(t):
    first = t.customer.groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.min_by("c_name", "c_custkey").alias("c_name"))
    return t.events.withColumn("k", F.col("user_id") % 25).join(hinted(first), "k", "left").select("event_id", "user_id", "c_name")


@query("SELECT key, (SELECT min(dst) FROM relation_edges e WHERE e.src = o.o_orderkey AND e.expired IS NULL) AS first_type FROM (SELECT o_orderkey AS key, o_orderkey FROM orders) o")
def first_type_lookup(t):
    types = t.relation_edges.where("expired IS NULL").groupBy(F.col("src").alias("key")).agg(F.min("dst").alias("first_type"))
    return t.orders.select(F.col("o_orderkey").alias("key")).join(types, "key", "left")


@query("SELECT d.class_key, d.prop, r.class_key AS target FROM property_domain d LEFT JOIN property_range r ON r.prop = d.prop WHERE d.class_key = 5")
def class_properties(t):
    return R.class_properties(t.property_domain.where("class_key = 5"), t.property_range)


@query("SELECT d.class_key AS src, r.class_key AS dst, count(*) AS n FROM property_domain d JOIN property_range r ON r.prop = d.prop GROUP BY 1, 2")
def domain_range_edges(t):
    return R.domain_range(t.property_domain, t.property_range).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("SELECT class_key, string_agg(prop::VARCHAR, ',' ORDER BY prop::VARCHAR) AS props FROM (SELECT DISTINCT class_key, prop FROM property_domain) GROUP BY class_key")
def property_labels_by_class(t):
    own = t.property_domain.groupBy("class_key").agg(F.array_sort(F.collect_set(F.col("prop").cast("string"))).alias("p"))
    return own.select("class_key", F.array_join("p", ",").alias("props"))


_KIDS = "kids AS (SELECT l_orderkey AS child, l_suppkey AS parent FROM lineitem GROUP BY 1, 2), dis AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier)"


@query(f"WITH {_KIDS} SELECT x.child, d.a, d.b FROM dis d JOIN kids x ON x.parent = d.a JOIN kids y ON y.parent = d.b AND y.child = x.child")
def disjoint_violation(t):
    kids = t.lineitem.select(F.col("l_orderkey").alias("child"), F.col("l_suppkey").alias("parent")).distinct()
    dis = t.supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return R.disjoint_violations(kids, dis)


_STAGE = "s AS (SELECT * FROM classes WHERE ontology_id = 0), d AS (SELECT *, 'urn:part#' || CAST(key - 1 AS VARCHAR) AS u FROM classes WHERE ontology_id = 1)"


@query(f"WITH {_STAGE} SELECT s.key AS staging, d.key AS domain FROM s JOIN d ON s.uri = d.u WHERE s.status IS DISTINCT FROM d.status AND s.status IS NOT NULL")
def same_uri_conflicts(t):
    s, d = _staging(t)
    return R.conflicts(s, d, "status").where("value IS NOT NULL").select("staging", "domain")


def _staging(t):
    return t.classes.where("ontology_id = 0"), t.classes.where("ontology_id = 1").withColumn("uri", F.concat(F.lit("urn:part#"), (F.col("key") - 1).cast("string")))


@query(f"WITH {_STAGE} SELECT s.key AS staging, d.key AS domain FROM s JOIN d ON s.uri = d.u WHERE s.kind IS DISTINCT FROM d.kind")
def range_conflicts(t):
    return R.conflicts(*_staging(t), "kind").select("staging", "domain")


@query(f"WITH {_STAGE} SELECT s.key AS staging, d.key AS domain FROM s JOIN d ON s.uri = d.u WHERE s.size % 10 IS DISTINCT FROM d.size % 10")
def range_conflicts_datatype(t):
    s, d = _staging(t)
    return R.conflicts(s.withColumn("r", F.col("size") % 10), d.withColumn("r", F.col("size") % 10), "r").select("staging", "domain")


@query("WITH a AS (SELECT prop, class_key FROM property_range WHERE prop % 2 = 0), b AS (SELECT prop + 1 AS prop, class_key FROM property_range WHERE prop % 2 = 1) SELECT DISTINCT a.prop, a.class_key AS left_range, b.class_key AS right_range FROM a JOIN b ON a.prop = b.prop AND a.class_key <> b.class_key")
def range_conflicts_object(t):
    a = t.property_range.where("prop % 2 = 0").select("prop", F.col("class_key").alias("left_range"))
    b = t.property_range.where("prop % 2 = 1").select((F.col("prop") + 1).alias("prop"), F.col("class_key").alias("right_range"))
    return a.join(b, "prop").where("left_range <> right_range").distinct()


@query("WITH l AS (SELECT o_custkey AS child, max(o_orderkey) AS parent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), d AS (SELECT o_custkey AS child, max(o_orderkey) AS parent FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT l.child, l.parent AS local_parent, d.parent AS domain_parent FROM l JOIN d ON l.child = d.child WHERE l.parent <> d.parent")
def hierarchy_conflicts(t):
    side = lambda s, name: t.orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("child")).agg(F.max("o_orderkey").alias(name))
    return side("F", "local_parent").join(side("O", "domain_parent"), "child").where("local_parent <> domain_parent")


@query("SELECT o.o_orderkey AS child, c.c_custkey AS parent, c.c_custkey IS NULL AS unmatched FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING'")
def extension_edges(t):
    c = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("parent"))
    return t.orders.join(c, "o_custkey", "left").select(F.col("o_orderkey").alias("child"), "parent", F.col("parent").isNull().alias("unmatched"))


@query("SELECT key, CASE WHEN src % 10 = 0 THEN src + 500000 ELSE src END AS src, CASE WHEN dst % 10 = 0 THEN dst + 500000 ELSE dst END AS dst FROM relation_edges WHERE src % 10 = 0 OR dst % 10 = 0")
def edge_promotion(t):
    from ..operators import versioned as V

    keys = t.relation_edges.select(F.col("src").alias("old")).union(t.relation_edges.select("dst")).distinct().where("old % 10 = 0")
    return V.remap_edges(t.relation_edges, keys.withColumn("new", F.col("old") + 500000)).where("moved").select("key", "src", "dst")


@query("SELECT key, CASE WHEN src IN (1, 2, 3) THEN 100 ELSE src END AS src, CASE WHEN dst IN (1, 2, 3) THEN 100 ELSE dst END AS dst FROM relation_edges WHERE expired IS NULL")
def merge_repointing(t):
    from ..operators import versioned as V

    mapping = t.spark.range(1, 4).select(F.col("id").alias("old"), F.lit(100).cast("long").alias("new"))
    return V.remap_edges(t.relation_edges.where("expired IS NULL"), hinted(mapping)).select("key", "src", "dst")


@query("SELECT src, dst FROM (SELECT CASE WHEN src = 4 THEN 5 ELSE src END AS src, CASE WHEN dst = 4 THEN 5 ELSE dst END AS dst FROM imports_edges) WHERE src <> dst")
def individual_merge(t):
    from ..operators import versioned as V

    mapping = t.spark.range(4, 5).select(F.col("id").alias("old"), F.lit(5).cast("long").alias("new"))
    return V.remap_edges(t.imports_edges, hinted(mapping)).where("src <> dst").select("src", "dst")


@query("SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT src FROM imports_edges WHERE src % 4 = 1 UNION SELECT dst FROM imports_edges WHERE src % 4 = 1)")
def orphan_classes(t):
    return R.without_edges(t.nation.select(F.col("n_nationkey").alias("node")), t.imports_edges.where("src % 4 = 1"))


@query("SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT dst FROM relation_edges WHERE quantity > 49.5)")
def island_classes(t):
    edges = t.relation_edges.where("quantity > 49.5").select("dst", F.col("dst").alias("src"))
    return R.without_edges(t.part.select(F.col("p_partkey").alias("node")), edges)


@query("SELECT DISTINCT prop FROM property_domain WHERE prop NOT IN (SELECT prop FROM property_range)")
def orphan_properties(t):
    return t.property_domain.select("prop").distinct().join(t.property_range, "prop", "left_anti")


@query("SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> c_custkey % 3")
def cross_ontology_extends(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).where("o_orderkey % 3 <> c_custkey % 3").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_orderkey AS doc_id, l_suppkey % 5 AS ontology_id FROM lineitem WHERE l_returnflag <> 'R'")
def document_ontologies(t):
    return t.relation_edges.where("expired IS NULL").select(F.col("src").alias("doc_id"), "ontology_id").distinct()


@query("SELECT ontology_id, src AS doc_id, count(*) AS edge_count FROM relation_edges WHERE expired IS NULL GROUP BY 1, 2")
def ontology_documents(t):
    return t.relation_edges.where("expired IS NULL").groupBy("ontology_id", F.col("src").alias("doc_id")).agg(F.count("*").alias("edge_count"))


@query("SELECT DISTINCT e.dst AS class_key, c.doc_id, c.chunk_index FROM relation_edges e JOIN chunks c ON c.doc_id = e.src")
def class_provenance(t):
    docs = t.relation_edges.select(F.col("dst").alias("class_key"), F.col("src").alias("doc_id")).distinct()
    return docs.join(t.chunks, "doc_id").select("class_key", "doc_id", "chunk_index")


@query("SELECT DISTINCT e.key, c.doc_id, c.chunk_index FROM (SELECT key, unnest([src % 50, src % 50 + 1]) AS chunk FROM relation_edges) e JOIN chunks c ON c.doc_id = e.chunk")
def edge_provenance(t):
    ids = t.relation_edges.select("key", F.explode(F.array(F.col("src") % 50, F.col("src") % 50 + 1)).alias("doc_id")).distinct()
    return ids.join(t.chunks, "doc_id").select("key", "doc_id", "chunk_index").distinct()


@query("SELECT o.o_orderkey AS entity, c.c_name AS run, n.n_name AS document, count(l.l_orderkey) AS chunks FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2, 3")
def entity_provenance_chain(t):
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(hinted(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("chunks"))
    return o.join(n, "o_orderkey", "left").select(F.col("o_orderkey").alias("entity"), F.col("c_name").alias("run"), F.col("n_name").alias("document"), F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))


@query("WITH a AS (SELECT uri, label, description FROM classes WHERE key % 3 <> 0), b AS (SELECT uri, CASE WHEN key % 5 = 0 THEN upper(label) ELSE label END AS label, description FROM classes WHERE key % 4 <> 0) SELECT coalesce(a.uri, b.uri) AS uri, CASE WHEN b.uri IS NULL THEN 'removed' WHEN a.uri IS NULL THEN 'added' WHEN a.label = b.label THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.uri = b.uri")
def curation_diff(t):
    a = t.classes.where("key % 3 <> 0").select("uri", F.struct("label", "description").alias("a"))
    b = t.classes.where("key % 4 <> 0").select("uri", F.struct(F.when(F.col("key") % 5 == 0, F.upper("label")).otherwise(F.col("label")).alias("label"), "description").alias("b"))
    state = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return a.join(b, "uri", "full_outer").select("uri", state.alias("state"))


@query("SELECT c.on_class, s.s_name AS class_name, p.first_prop FROM constraints c LEFT JOIN supplier s ON s.s_suppkey = c.on_class LEFT JOIN (SELECT class_key, min(prop) AS first_prop FROM property_domain GROUP BY 1) p ON p.class_key = c.on_class")
def constraint_enrichment(t):
    s = t.supplier.select(F.col("s_suppkey").alias("on_class"), F.col("s_name").alias("class_name"))
    p = t.property_domain.groupBy(F.col("class_key").alias("on_class")).agg(F.min("prop").alias("first_prop"))
    return t.constraints.join(s, "on_class", "left").join(p, "on_class", "left").select("on_class", "class_name", "first_prop")


@query("SELECT uri, min(key) AS key FROM classes WHERE expired IS NULL AND tier = 'domain' GROUP BY uri")
def domain_class_by_uri(t):
    order = Window.partitionBy("uri").orderBy("key")
    return t.classes.where("expired IS NULL AND tier = 'domain'").withColumn("rn", F.row_number().over(order)).where("rn = 1").select("uri", "key")


@query(f"WITH {_STAGE} SELECT 'status' AS field, count(*) AS n FROM s JOIN d ON s.uri = d.u WHERE s.status IS DISTINCT FROM d.status UNION ALL SELECT 'kind', count(*) FROM s JOIN d ON s.uri = d.u WHERE s.kind IS DISTINCT FROM d.kind")
def conflict_composite(t):
    s, d = _staging(t)
    both = R.conflicts(s, d, "status").select(F.lit("status").alias("field")).unionByName(R.conflicts(s, d, "kind").select(F.lit("kind").alias("field")))
    return both.groupBy("field").agg(F.count("*").alias("n"))


@query("SELECT d.prop, CASE WHEN r.prop IS NULL AND d.prop % 2 = 0 THEN 'repairable' WHEN r.prop IS NULL THEN 'unrecoverable' END AS state FROM (SELECT DISTINCT prop FROM property_domain) d LEFT JOIN (SELECT DISTINCT prop FROM property_range) r ON r.prop = d.prop WHERE r.prop IS NULL")
def orphan_range_rule(t):
    orphans = t.property_domain.select("prop").distinct().join(t.property_range, "prop", "left_anti")
    return orphans.select("prop", F.when(F.col("prop") % 2 == 0, "repairable").otherwise("unrecoverable").alias("state"))


@query("SELECT DISTINCT b.batch, e.dst AS class_key FROM (SELECT DISTINCT doc_id, doc_id // 10 AS batch FROM chunks) b JOIN relation_edges e ON e.src = b.doc_id")
def classes_for_batch(t):
    batches = t.chunks.select(F.col("doc_id").alias("src"), F.floor(F.col("doc_id") / 10).alias("batch")).distinct()
    return t.relation_edges.join(batches, "src").select("batch", F.col("dst").alias("class_key")).distinct()


@query("SELECT doc_id, coalesce(CASE WHEN lang IN ('en', 'fr') THEN lang END, 'general') AS domain FROM documents")
def chunk_domain_map(t):
    allowed = t.documents.select("lang").distinct().where(F.col("lang").isin("en", "fr")).withColumn("domain", F.col("lang"))
    return t.documents.join(hinted(allowed), "lang", "left").select("doc_id", F.coalesce("domain", F.lit("general")).alias("domain"))


@query("SELECT u.uri, c.key FROM (SELECT 'urn:part#' || CAST(p_partkey * 2 AS VARCHAR) AS uri FROM part) u LEFT JOIN classes c ON c.uri = u.uri AND c.ontology_id = 2")
def uri_class_resolution(t):
    uris = t.part.select(F.concat(F.lit("urn:part#"), (F.col("p_partkey") * 2).cast("string")).alias("uri"))
    return uris.join(t.classes.where("ontology_id = 2").select("uri", "key"), "uri", "left")


@query("SELECT k.prop, d.class_key IS NOT NULL AS has_domain, r.class_key IS NOT NULL AS has_range FROM (SELECT DISTINCT l_orderkey * 10 + 1 AS prop FROM lineitem) k LEFT JOIN (SELECT prop, min(class_key) AS class_key FROM property_domain GROUP BY 1) d ON d.prop = k.prop LEFT JOIN (SELECT prop, min(class_key) AS class_key FROM property_range GROUP BY 1) r ON r.prop = k.prop")
def uri_property_resolution(t):
    keys = t.lineitem.select((F.col("l_orderkey") * 10 + 1).alias("prop")).distinct()
    flag = lambda df, name: df.select("prop", F.lit(True).alias(name)).distinct()
    out = keys.join(flag(t.property_domain, "has_domain"), "prop", "left").join(flag(t.property_range, "has_range"), "prop", "left")
    return out.select("prop", F.coalesce("has_domain", F.lit(False)).alias("has_domain"), F.coalesce("has_range", F.lit(False)).alias("has_range"))


@query("SELECT c.key, n.n_name AS source_collection FROM classes c LEFT JOIN nation n ON n.n_nationkey = c.key % 40")
def provenance_stamp(t):
    own = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("source_collection"))
    return t.classes.withColumn("k", F.col("key") % 40).join(hinted(own), "k", "left").select("key", "source_collection")


@query("SELECT 'class' AS kind, count(*) AS n FROM classes WHERE ontology_id = 1 UNION ALL SELECT 'edge', count(*) FROM relation_edges WHERE ontology_id = 1")
def staging_graph(t):
    a = t.classes.where("ontology_id = 1").select(F.lit("class").alias("kind"))
    return a.unionByName(t.relation_edges.where("ontology_id = 1").select(F.lit("edge").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS key, CASE WHEN c_nationkey = 3 AND c_mktsegment = 'BUILDING' THEN 'same' WHEN c_nationkey = 3 THEN 'host_differs' ELSE 'different' END AS provenance FROM customer")
def provenance_compatibility(t):
    return t.customer.select(F.col("c_custkey").alias("key"), R.provenance(F.col("c_nationkey"), F.lit(3), F.col("c_mktsegment"), F.lit("BUILDING")).alias("provenance"))


@query("SELECT key, label AS before_label, 'edited ' || label AS after_label, 'label' AS changed_fields FROM classes WHERE status = 'approved'")
def field_edit_diff(t):
    own = t.classes.where("status = 'approved'")
    return own.select("key", F.col("label").alias("before_label"), F.concat(F.lit("edited "), "label").alias("after_label"), F.lit("label").alias("changed_fields"))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, role FROM chunks UNION ALL SELECT conv_id, role FROM conversations) GROUP BY doc_id")
def evidence_union(t):
    both = t.chunks.groupBy("doc_id").agg(F.collect_list("role").alias("a")).join(t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.collect_list("role").alias("b")), "doc_id")
    return both.select("doc_id", F.size(F.concat("a", "b")).cast("long").alias("n"))


@query("SELECT on_class::VARCHAR || '|' || property_uri || '|' || min_count::VARCHAR AS k FROM constraints WHERE on_class IS NOT NULL")
def constraint_key(t):
    return t.constraints.where("on_class IS NOT NULL").select(F.concat_ws("|", F.col("on_class").cast("string"), "property_uri", F.col("min_count").cast("string")).alias("k"))
