"""Queries over sources, sinks, and composed steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..operators import quality as Q
from ..operators import versioned as V
from ..operators.core import hinted, new_folder
from ..sources import rdf, schemas, turtle
from ..sources.derived import BASE
from .registry import query

RDFT, LABEL, COMMENT = rdf.RDF + "type", rdf.RDFS + "label", rdf.RDFS + "comment"


@query(f"SELECT uri AS s, '{RDFT}' AS p, '{rdf.OWL}Class' AS o, 'iri' AS kind FROM classes UNION ALL SELECT uri, '{LABEL}', label, 'literal' FROM classes UNION ALL SELECT uri, '{COMMENT}', description, 'literal' FROM classes")
def class_triples(t):
    return rdf.class_triples(t.classes).select("s", "p", "o", "kind")


@query(f"SELECT 'urn:n' || src::VARCHAR AS s, '{rdf.OWL}imports' AS p, 'urn:n' || dst::VARCHAR AS o FROM imports_edges UNION ALL SELECT 'urn:' || src, '{rdf.RDFS}subClassOf', 'urn:' || dst FROM subclass_edges")
def edge_triples(t):
    a = t.imports_edges.select(F.concat(F.lit("urn:n"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("urn:n"), F.col("dst").cast("string")).alias("dst"), F.lit("imports").alias("edge_type"))
    b = t.subclass_edges.select(F.concat(F.lit("urn:"), "src").alias("src"), F.concat(F.lit("urn:"), "dst").alias("dst"), F.lit("subclass_of").alias("edge_type"))
    return rdf.edge_triples(a.unionByName(b)).select("s", "p", "o")


@query("SELECT uri, label, description FROM classes")
def ntriples_round_trip(t):
    """Classes written as lines of N-Triples, read back and pivoted into classes."""
    lines = rdf.to_ntriples(rdf.class_triples(t.classes))
    return rdf.classes_of(rdf.parse_ntriples(lines))


@query("SELECT uri, label, description FROM classes")
def turtle_round_trip(t):
    """Classes written as a folder of Turtle files, read back and pivoted into classes."""
    folder = new_folder(t.spark, "turtle")
    turtle.write_turtle(rdf.class_triples(t.classes), folder, {"part": "urn:part#"})
    return rdf.classes_of(turtle.read_turtle(t.spark, folder, scoped=False).where("error IS NULL"))


@query("SELECT 'urn:' || src AS src, 'urn:' || dst AS dst FROM subclass_edges")
def rdf_import_subclasses(t):
    edges = t.subclass_edges.select(F.concat(F.lit("urn:"), "src").alias("src"), F.concat(F.lit("urn:"), "dst").alias("dst"), F.lit("subclass_of").alias("edge_type"))
    return rdf.subclass_edges_of(rdf.parse_ntriples(rdf.to_ntriples(rdf.edge_triples(edges))))


def _constraints(t):
    low = t.constraints.select(F.concat(F.lit("urn:s"), F.col("on_class").cast("string")).alias("on_class"), F.lit("urn:lines").alias("property_uri"), F.lit("minCardinality").alias("kind"), F.col("min_count").cast("string").alias("value"))
    high = t.constraints.select(F.concat(F.lit("urn:s"), F.col("on_class").cast("string")).alias("on_class"), F.lit("urn:lines").alias("property_uri"), F.lit("maxCardinality").alias("kind"), F.col("max_count").cast("string").alias("value"))
    return low.unionByName(high)


_CON = "SELECT 'urn:s' || on_class::VARCHAR AS on_class, 'urn:lines' AS property_uri, '{0}' AS kind, min_count::VARCHAR AS value FROM constraints UNION ALL SELECT 'urn:s' || on_class::VARCHAR, 'urn:lines', '{1}', max_count::VARCHAR FROM constraints"


@query(_CON.format("minCardinality", "maxCardinality"))
def owl_restrictions(t):
    return rdf.restrictions_of(rdf.parse_ntriples(rdf.to_ntriples(rdf.restriction_triples(_constraints(t)))))


@query(_CON.format("minCount", "maxCount"))
def shacl_shapes(t):
    own = _constraints(t).withColumn("kind", F.when(F.col("kind") == "minCardinality", "minCount").otherwise("maxCount"))
    return rdf.shapes_of(rdf.parse_ntriples(rdf.to_ntriples(rdf.shape_triples(own))))


@query("SELECT 'n' || r_regionkey::VARCHAR AS head, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS position, n_name AS item FROM nation JOIN region ON n_regionkey = r_regionkey")
def rdf_lists(t):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    own = t.nation.withColumn("k", F.row_number().over(w) - 1).withColumn("last", F.count("*").over(Window.partitionBy("n_regionkey")) - 1)
    cell = lambda k: F.when(k == 0, F.concat(F.lit("n"), F.col("n_regionkey").cast("string"))).otherwise(F.concat_ws("_", F.lit("n"), F.col("n_regionkey").cast("string"), k.cast("string")))
    k = F.col("k")
    following = F.when(k == F.col("last"), rdf.RDF + "nil").otherwise(cell(k + 1))
    triples = rdf.from_rows(own, rdf.triple(cell(k), rdf.RDF + "first", F.col("n_name"), "literal"), rdf.triple(cell(k), rdf.RDF + "rest", following))
    return rdf.rdf_list(triples, own.where("k = 0").select(cell(k).alias("head")))


@query("SELECT 'k' AS field, 'xsd:integer' AS xsd, count(*) AS n FROM events")
def json_field_inference(t):
    return schemas.json_fields(t.events, "props")


@query("SELECT p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN 'xsd:date' WHEN p_size % 2 = 0 THEN 'xsd:integer' ELSE 'xsd:string' END AS xsd FROM part")
def jsonschema_types(t):
    return t.part.select(F.col("p_partkey").alias("key"), schemas.jsonschema_type(F.when(F.col("p_size") % 3 == 0, "date"), F.when(F.col("p_size") % 2 == 0, "integer")).alias("xsd"))


@query("SELECT table_name AS \"table\", column_name AS field, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type, true AS nullable FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'part', 'orders')")
def relational_schema(t):
    return schemas.table_fields({n: getattr(t, n) for n in ("region", "nation", "part", "orders")}, t.spark)


@query("SELECT s_name AS \"table\", 'id' AS field, 'maxCount' AS kind, 1 AS value FROM supplier WHERE s_suppkey % 2 = 0")
def unique_index_constraints(t):
    fields = F.when(F.col("s_suppkey") % 3 >= 0, F.array(F.lit("id")))
    return schemas.unique_fields(t.supplier.select(F.col("s_name").alias("table"), fields.alias("fields"), (F.col("s_suppkey") % 2 == 0).alias("is_unique")))


@query("SELECT s_name AS on_class, 'a' AS field, 'minCount' AS kind, '1' AS value FROM supplier UNION ALL SELECT s_name, 'a', 'datatype', 'string' FROM supplier UNION ALL SELECT s_name, 'a', 'in', 'x|y' FROM supplier")
def schema_rule_constraints(t):
    rule = F.lit('{"required": ["a"], "properties": {"a": {"type": "string", "enum": ["x", "y"]}}}')
    return schemas.rule_constraints(t.supplier.select(F.col("s_name").alias("on_class"), rule.alias("rule")))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_source(t):
    return t.pages.select("page_id", schemas.html_text(F.col("html")).alias("text"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'markdown' END AS kind FROM pages")
def mime_dispatch(t):
    m = F.col("page_id") % 4
    mime = F.when(m == 0, "application/pdf").when(m == 1, "application/vnd.openxmlformats-officedocument.wordprocessingml.document").when(m == 2, "text/plain").otherwise("image/png")
    return t.pages.select("page_id", schemas.mime_kind(mime).alias("kind"))


@query("SELECT p_partkey::VARCHAR || ',' || p_name || ',' || p_brand AS line FROM part")
def csv_export(t):
    return schemas.csv_lines(t.part, ["p_partkey", "p_name", "p_brand"])


@query("SELECT count(*) FILTER (WHERE d.class_key IS NULL)::BIGINT AS no_property, count(*) FILTER (WHERE e.src IS NULL)::BIGINT AS no_parent FROM supplier s LEFT JOIN (SELECT DISTINCT class_key FROM property_domain) d ON d.class_key = s_suppkey LEFT JOIN (SELECT DISTINCT src FROM imports_edges) e ON e.src = s_suppkey")
def structural_health(t):
    own = t.supplier.select(F.col("s_suppkey").alias("k"))
    d = t.property_domain.select(F.col("class_key").alias("k"), F.lit(1).alias("d")).distinct()
    e = t.imports_edges.select(F.col("src").alias("k"), F.lit(1).alias("e")).distinct()
    return own.join(d, "k", "left").join(e, "k", "left").agg(F.sum(F.col("d").isNull().cast("int")).cast("long").alias("no_property"), F.sum(F.col("e").isNull().cast("int")).cast("long").alias("no_parent"))


@query("""WITH c AS (SELECT p_partkey AS key, 'urn:part#' || p_partkey AS uri, p_name AS label FROM part WHERE p_size <= 30), b AS (SELECT label, min(key) AS k FROM c GROUP BY 1),
l AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS key, l_partkey, l_suppkey, CASE l_suppkey % 4 WHEN 0 THEN 'urn:part#' || l_partkey WHEN 1 THEN 'x/' || l_partkey WHEN 2 THEN upper(p_name) ELSE '' END AS target, CASE WHEN l_suppkey % 4 = 3 THEN 'made for the ' || p_name || '.' END AS text FROM lineitem JOIN part ON p_partkey = l_partkey),
m AS (SELECT l.key, u.key AS u, f.key AS f, b.k AS n, x.k AS t FROM l LEFT JOIN c u ON u.uri = l.target LEFT JOIN c f ON f.key::VARCHAR = regexp_replace(l.target, '^.*[#/]', '') LEFT JOIN b ON b.label = lower(l.target) LEFT JOIN b x ON l.text = 'made for the ' || x.label || '.')
SELECT key, coalesce(u, f, n, t) AS class_key, CASE WHEN u IS NOT NULL THEN 'uri' WHEN f IS NOT NULL THEN 'fragment' WHEN n IS NOT NULL THEN 'label' WHEN t IS NOT NULL THEN 'text' ELSE 'miss' END AS tier FROM m""")
def range_resolver(t):
    """Targets of links by URI, its last part, label, and what the link's text names."""
    from ..operators import materialise as M

    classes = t.part.where("p_size <= 30").select(F.col("p_partkey").alias("key"), F.concat(F.lit("urn:part#"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_name").alias("label"))
    m, part = F.col("l_suppkey") % 4, F.col("l_partkey").cast("string")
    target = F.when(m == 0, F.concat(F.lit("urn:part#"), part)).when(m == 1, F.concat(F.lit("x/"), part)).when(m == 2, F.upper("p_name")).otherwise("")
    text = F.when(m == 3, F.concat(F.lit("made for the "), "p_name", F.lit(".")))
    links = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_partkey", "l_suppkey").alias("id"), F.lit(-1).cast("long").alias("owner"), target.alias("target"), text.alias("text")).distinct()
    return M.resolve_targets(links, classes).select("id.key", "class_key", "tier")


@query("WITH w AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1), x AS (SELECT conv_id, turn, ' ' || regexp_replace(lower(text || ' with a Red Gear, and blue bolt'), '[^\\p{L}\\p{N}]+', ' ', 'g') || ' ' AS body FROM conversations), m AS (SELECT x.conv_id, x.turn, w.k, row_number() OVER (PARTITION BY x.conv_id, x.turn ORDER BY length(w.p_name) DESC, w.k) AS rn FROM x JOIN w ON contains(x.body, ' ' || w.p_name || ' ')) SELECT conv_id, turn, k AS class_key FROM m WHERE rn = 1")
def orphan_range_matcher(t):
    """The longest class label that a text names."""
    from ..operators import materialise as M

    classes = t.part.groupBy(F.col("p_name").alias("label")).agg(F.min("p_partkey").alias("key")).select("key", "label", F.lit("").alias("uri"))
    links = t.conversations.select(F.struct("conv_id", "turn").alias("id"), F.lit(-1).cast("long").alias("owner"), F.lit("?").alias("target"), F.concat("text", F.lit(" with a Red Gear, and blue bolt")).alias("text"))
    return M.resolve_targets(links, classes).where("tier = 'text'").select("id.conv_id", "id.turn", "class_key")


_NEST = """c AS (SELECT key, 'urn:part#' || key AS uri, label, CASE WHEN key % 5 = 0 THEN 'urn:part#' || (key // 5) END AS parent, brand, kind, size, key % 4 AS r FROM classes),
l AS (SELECT label, min(key::VARCHAR) AS k FROM c GROUP BY 1), k AS (SELECT DISTINCT key FROM c)"""


@query(f"""WITH {_NEST} SELECT 'classes' AS name, key::VARCHAR AS src, uri AS dst FROM c UNION ALL SELECT 'datatype_properties', key || '_brand_name', 'xsd:string' FROM c UNION ALL SELECT 'datatype_properties', key || '_kind', 'xsd:string' FROM c
UNION ALL SELECT 'object_properties', key || '_made_of', CASE r WHEN 0 THEN 'urn:part#' || size WHEN 1 THEN 'other#' || size WHEN 2 THEN label ELSE '?' END FROM c
UNION ALL SELECT 'rdfs_domain', key || p, key::VARCHAR FROM c, (SELECT unnest(['_brand_name', '_kind', '_made_of']) AS p)
UNION ALL SELECT 'rdfs_range_class', c.key || '_made_of', coalesce(CASE WHEN r <= 1 THEN k.key::VARCHAR END, l.k) FROM c LEFT JOIN k ON k.key = c.size LEFT JOIN l ON l.label = c.label AND c.r = 2 WHERE (r <= 1 AND k.key IS NOT NULL) OR r = 2
UNION ALL SELECT 'subclass_of', c.key::VARCHAR, k.key::VARCHAR FROM c JOIN k ON c.key % 5 = 0 AND k.key = c.key // 5 WHERE c.key <> k.key
UNION ALL SELECT 'extracted_from', key::VARCHAR, (key % 7)::VARCHAR FROM c UNION ALL SELECT DISTINCT 'produced_by', (key % 3)::VARCHAR, 'run-' || key % 7 FROM c""")
def graph_materialisation(t):
    """Nested results to vertex and edge rows: name of the table, src and dst (for vertices the key and what it has)."""
    from ..operators import materialise as M

    k = F.col("key").cast("string")
    size = F.col("size").cast("string")
    m = F.col("key") % 4
    target = F.when(m == 0, F.concat(F.lit("urn:part#"), size)).when(m == 1, F.concat(F.lit("other#"), size)).when(m == 2, F.col("label")).otherwise(F.lit("?"))
    attribute = lambda label: F.struct(F.lit(label).alias("label"), F.lit("xsd:string").alias("range"))
    results = t.classes.select(
        (F.col("key") % 7).alias("doc_id"), F.concat(F.lit("run-"), (F.col("key") % 7).cast("string")).alias("run_id"), (F.col("key") % 3).alias("ontology_id"), F.concat(F.lit("urn:part#"), k).alias("uri"), "label", "description",
        F.when(F.col("key") % 5 == 0, F.concat(F.lit("urn:part#"), F.floor(F.col("key") / 5).cast("string"))).alias("parent_uri"),
        F.array(attribute("Brand name"), attribute("Kind")).alias("attributes"),
        F.array(F.struct(F.lit("made of").alias("label"), target.alias("target"), F.lit(None).cast("string").alias("text"))).alias("relationships"),
    )
    tables = M.materialise(results, 1_800_000_000.0)
    ends = {"classes": ("key", "uri"), "datatype_properties": ("key", "range"), "object_properties": ("key", "target")}
    rows = [df.select(F.lit(name).alias("name"), *[F.col(c).cast("string").alias(x) for c, x in zip(ends.get(name, ("src", "dst")), ("src", "dst"))]) for name, df in tables.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


_FEAT = "f AS (SELECT p_partkey AS key, (p_partkey % 100)::DOUBLE / 100 AS score, p_size / 50.0::DOUBLE AS fuzzy, p_size % 17 = 0 AS contradicted, p_size % 13 = 0 AS linked, p_size = 50 AS uri, p_size >= 45 AS label, p_partkey % 11 = 0 AS suffix, p_partkey % 19 = 0 AS poly, p_partkey % 4 AS shared, p_partkey % 3 = 0 AS subs FROM part)"


@query(f"""WITH {_FEAT} SELECT key, CASE WHEN contradicted THEN 'CONTRADICTED' WHEN linked THEN 'REINFORCED' WHEN uri OR (label AND score >= 0.55) THEN 'REDUNDANT' WHEN suffix AND fuzzy > 0 THEN 'UNCERTAIN'
WHEN (poly OR shared >= 2) AND fuzzy > 0 OR (fuzzy >= 0.5 AND subs) THEN 'GAP-FILLING' WHEN fuzzy >= 0.4 THEN 'REFINED' ELSE 'UNCERTAIN' END AS verdict,
CASE WHEN contradicted THEN 'FLAG_FOR_CURATION' WHEN linked THEN 'REINFORCE' WHEN uri OR (label AND score >= 0.55) THEN 'REVISE' WHEN suffix AND fuzzy > 0 THEN 'FLAG_FOR_CURATION'
WHEN ((poly OR shared >= 2) AND fuzzy > 0 OR (fuzzy >= 0.5 AND subs)) AND score >= 0.30 THEN 'GAP_FILL' ELSE 'FLAG_FOR_CURATION' END AS action FROM f""")
def verdict_classifier(t):
    from ..operators.revise import classify

    k, size = F.col("p_partkey"), F.col("p_size")
    label = F.concat("p_name", F.when(k % 11 == 0, "Status").otherwise("x"))
    found = classify((k % 100) / 100.0, F.when(size == 50, 1.0).otherwise(0.0), F.when(size >= 45, 1.0).otherwise(0.0), size / 50.0, label, size % 17 == 0, size % 13 == 0, F.when(k % 19 == 0, 1).otherwise(0), k % 4, k % 3 == 0)
    return t.part.select(k.alias("key"), found.alias("f")).select("key", "f.verdict", "f.action")


@query("SELECT key, least(1, confidence + 0.1) AS confidence, 2 AS evidence FROM classes WHERE status = 'approved'")
def reinforce(t):
    """Evidence is appended in place and the confidence rises to 1 at most."""
    return t.classes.where("status = 'approved'").select("key", F.least(F.lit(1.0), F.col("confidence") + 0.1).alias("confidence"), F.size(F.concat(F.array("label"), F.array(F.lit("new quote")))).alias("evidence"))


_REQ = """q AS (SELECT key AS nth, verdict AS doc, entity, CASE WHEN key % 6 = 0 THEN 'RETRACT' WHEN key % 10 = 3 THEN 'GAP_FILL' ELSE action END AS action, CASE WHEN key % 9 <> 0 THEN 'renamed ' || key END AS new_label, CASE WHEN key % 4 <> 0 THEN entity END AS src, status FROM revisions),
lg AS (SELECT DISTINCT doc, entity, action FROM q WHERE status = 'applied'), o AS (SELECT q.*, row_number() OVER (PARTITION BY q.doc, q.entity, q.action ORDER BY nth) > 1 AS again, lg.doc IS NOT NULL AS logged, c.key IS NOT NULL AS live FROM q LEFT JOIN lg USING (doc, entity, action) LEFT JOIN (SELECT key FROM classes WHERE expired IS NULL) c ON c.key = q.entity WHERE q.status = 'pending'),
p AS (SELECT *, CASE WHEN again OR logged THEN 'repeated' WHEN action = 'GAP_FILL' AND src IS NULL THEN 'no edge' WHEN action IN ('REINFORCE', 'REVISE', 'RETRACT') AND NOT live THEN 'no live version' WHEN action = 'REVISE' AND new_label IS NULL THEN 'no payload' END AS why FROM o),
a AS (SELECT *, CASE WHEN why IS NULL AND action IN ('REVISE', 'RETRACT') AND row_number() OVER (PARTITION BY entity, CASE WHEN why IS NULL AND action IN ('REVISE', 'RETRACT') THEN 1 ELSE 0 END ORDER BY nth) > 1 THEN 'no live version' ELSE why END AS reason FROM p),
s AS (SELECT *, CASE WHEN reason = 'repeated' THEN 'skipped' WHEN reason IS NOT NULL THEN 'failed' ELSE 'applied' END AS outcome FROM a)"""


def _superseded(t):
    from ..operators.revise import supersede

    key = F.col("key")
    action = F.when(key % 6 == 0, "RETRACT").when(key % 10 == 3, "GAP_FILL").otherwise(F.col("action"))
    own = t.revisions.select(key.alias("nth"), F.col("verdict").alias("doc"), "entity", action.alias("action"), F.array(F.concat(F.lit("quote "), key.cast("string"))).alias("evidence"), (key % 10 / 10.0).alias("confidence_after"),
        F.when(key % 9 != 0, F.concat(F.lit("renamed "), key.cast("string"))).alias("new_label"), F.when(key % 4 != 0, F.col("entity")).alias("src"), F.lit(1).cast("long").alias("dst"), "status")
    entities = t.classes.select("key", "label", F.array("label").alias("evidence"), "confidence", "last_evidenced_at", "version", "created", "expired")
    edges = t.property_domain.select(F.col("prop").alias("src"), F.col("class_key").alias("dst"), F.lit(0.0).alias("created"), F.lit(None).cast("double").alias("expired"))
    return supersede(entities, edges, own.where("status = 'pending'").drop("status"), own.where("status = 'applied'"), 1_800_000_000.0, 10_000_000)


@query(f"WITH {_REQ} SELECT nth, doc, entity, action, outcome AS status, reason, CASE WHEN outcome = 'applied' AND action IN ('REVISE', 'RETRACT') THEN entity END AS old_version, CASE WHEN outcome = 'applied' AND action = 'REVISE' THEN entity + 10000000 WHEN outcome = 'applied' AND action = 'REINFORCE' THEN entity END AS new_version FROM s")
def supersede_dispatch(t):
    """The audit rows of a batch of revisions."""
    return _superseded(t).audit


@query(f"""WITH {_REQ}, r AS (SELECT entity, count(*) AS n, arg_max(nth % 10 / 10.0, nth) AS c FROM s WHERE outcome = 'applied' AND action = 'REINFORCE' GROUP BY 1), v AS (SELECT entity, new_label FROM s WHERE outcome = 'applied' AND action = 'REVISE'), x AS (SELECT entity FROM s WHERE outcome = 'applied' AND action = 'RETRACT'),
b AS (SELECT c.key, c.label, CASE WHEN c.expired IS NULL THEN coalesce(r.c, c.confidence) ELSE c.confidence END::DOUBLE AS confidence, 1 + CASE WHEN c.expired IS NULL THEN coalesce(r.n, 0) ELSE 0 END AS quotes, c.version, c.expired, v.new_label, v.entity IS NOT NULL AS revised, x.entity IS NOT NULL AS gone FROM classes c LEFT JOIN r ON r.entity = c.key LEFT JOIN v ON v.entity = c.key LEFT JOIN x ON x.entity = c.key)
SELECT key, label, confidence, quotes, version, CASE WHEN expired IS NULL AND (revised OR gone) THEN 1800000000::DOUBLE ELSE expired END AS expired FROM b UNION ALL SELECT key + 10000000, new_label, confidence, quotes, version + 1, NULL FROM b WHERE revised AND expired IS NULL""")
def supersede_entities(t):
    """The entities after a batch of revisions."""
    return _superseded(t).entities.select("key", "label", F.col("confidence").cast("double").alias("confidence"), F.size("evidence").cast("long").alias("quotes"), "version", "expired")


@query(f"""WITH {_REQ}, v AS (SELECT entity FROM s WHERE outcome = 'applied' AND action = 'REVISE')
SELECT prop AS src, class_key AS dst, CASE WHEN v.entity IS NOT NULL OR w.entity IS NOT NULL THEN 1800000000::DOUBLE END AS expired FROM property_domain LEFT JOIN v ON v.entity = class_key LEFT JOIN v w ON w.entity = prop
UNION ALL SELECT CASE WHEN w.entity IS NOT NULL THEN prop + 10000000 ELSE prop END, CASE WHEN v.entity IS NOT NULL THEN class_key + 10000000 ELSE class_key END, NULL FROM property_domain LEFT JOIN v ON v.entity = class_key LEFT JOIN v w ON w.entity = prop WHERE v.entity IS NOT NULL OR w.entity IS NOT NULL
UNION ALL SELECT src, 1, NULL FROM s WHERE outcome = 'applied' AND action = 'GAP_FILL'""")
def supersede_edges(t):
    """The edges after a batch of revisions."""
    return _superseded(t).edges.select("src", "dst", "expired")


@query("SELECT 'rule' AS stage, count(*) AS n FROM constraints WHERE min_count > max_count UNION ALL SELECT 'decay', count(*) FROM classes WHERE expired IS NULL AND confidence > 0.05 UNION ALL SELECT 'stale', count(*) FROM classes WHERE expired IS NULL AND coalesce(last_evidenced_at, created) < 1701000000")
def consolidation_plan(t):
    rule = t.constraints.where("min_count > max_count").select(F.lit("rule").alias("stage"))
    decay = t.classes.where("expired IS NULL AND confidence > 0.05").select(F.lit("decay").alias("stage"))
    stale = t.classes.where("expired IS NULL AND coalesce(last_evidenced_at, created) < 1701000000").select(F.lit("stale").alias("stage"))
    names = t.spark.sql("SELECT * FROM VALUES ('rule'), ('decay'), ('stale') AS v(stage)")
    n = rule.unionAll(decay).unionAll(stale).groupBy("stage").agg(F.count("*").alias("n"))
    return names.join(n, "stage", "left").select("stage", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT 'min' AS rule, count(*) AS n FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) l JOIN constraints c ON c.on_class = l_suppkey WHERE n < min_count UNION ALL SELECT 'max', count(*) FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) l JOIN constraints c ON c.on_class = l_suppkey WHERE n > max_count AND n >= min_count")
def rule_engine(t):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("on_class")).agg(F.count("*").alias("n"))
    broken = Q.cardinality_violations(t.constraints, n).groupBy(F.col("broken").alias("rule")).agg(F.count("*").alias("n"))
    names = t.spark.sql("SELECT * FROM VALUES ('min'), ('max') AS v(rule)")
    return names.join(broken, "rule", "left").select("rule", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT 'ungrounded' AS rule, count(*) AS n FROM relation_edges WHERE expired IS NULL AND confidence IS NULL UNION ALL SELECT 'dangling', count(*) FROM relation_edges e JOIN classes c ON c.key = e.dst WHERE e.expired IS NULL AND c.expired IS NOT NULL")
def abox_rules(t):
    live = t.relation_edges.where("expired IS NULL")
    a = live.where("confidence IS NULL").select(F.lit("ungrounded").alias("rule"))
    b = live.join(t.classes.where("expired IS NOT NULL").select(F.col("key").alias("dst")), "dst", "left_semi").select(F.lit("dangling").alias("rule"))
    return a.unionAll(b).groupBy("rule").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT class_key AS key, count(*) FILTER (prop % 2 = 0) AS dt, count(*) FILTER (prop % 2 = 1) AS ob FROM property_domain GROUP BY 1), p AS (SELECT DISTINCT src AS key FROM imports_edges), h AS (SELECT DISTINCT dst AS key FROM imports_edges),
r AS (SELECT DISTINCT class_key AS key FROM property_range), s AS (SELECT dst AS key, count(*) AS n FROM relation_edges GROUP BY 1), t AS (SELECT description, count(*) AS copies FROM classes GROUP BY 1),
m AS (SELECT c.key, c.confidence AS agreement, CASE WHEN c.key % 3 = 0 THEN 0.8 END AS faith, c.description, coalesce(d.dt, 0) AS dt, coalesce(d.ob, 0) AS ob, p.key IS NOT NULL AS par, h.key IS NOT NULL AS chi, r.key IS NOT NULL AS ran, coalesce(s.n, 0) AS n, t.copies
FROM classes c LEFT JOIN d USING (key) LEFT JOIN p USING (key) LEFT JOIN h USING (key) LEFT JOIN r USING (key) LEFT JOIN s USING (key) LEFT JOIN t ON t.description = c.description),
g AS (SELECT key, least(1, greatest(0, agreement)) AS a, coalesce(faith, 0.5) AS f, least(1.0, (dt > 0)::INT * 0.15::DOUBLE + least(ob * 0.10::DOUBLE, 0.30) + par::INT * 0.20::DOUBLE + chi::INT * 0.15::DOUBLE + (ob > 0 OR ran)::INT * 0.20::DOUBLE) AS st,
least(length(description) / 100.0, 1.0) * 0.7 + CASE WHEN length(description) >= 20 AND copies <= 1 THEN 0.3 ELSE 0 END AS de, least(n / 3.0, 1.0) AS pr FROM m)
SELECT key, round_even(0.18 * a + 0.18 * f + 0.13 * 0.5 + 0.13 * st + 0.09 * de + 0.09 * pr + 0.09 + 0.06 + 0.05, 3) AS confidence FROM g""")
def multi_signal_recompute(t):
    """Confidence of every class from all signals."""
    from ..operators import materialise as M

    none = F.lit(None).cast("double")
    classes = t.classes.select("key", F.col("confidence").alias("agreement"), F.when(F.col("key") % 3 == 0, 0.8).alias("faithfulness"), none.alias("validity"), none.alias("property_agreement"), "description")
    domain = t.property_domain.select("class_key", F.when(F.col("prop") % 2 == 0, "datatype").otherwise("object").alias("kind"))
    return M.multi_signal_confidence(classes, domain, t.imports_edges, t.property_range, t.relation_edges.select(F.col("dst").alias("class_key")))


@query("SELECT key + 5000000 AS key, uri, label, 'production' AS tier FROM classes WHERE status = 'approved' AND expired IS NULL")
def promotion(t):
    return t.classes.where("status = 'approved' AND expired IS NULL").select((F.col("key") + 5_000_000).alias("key"), "uri", "label", F.lit("production").alias("tier"))


@query("WITH RECURSIVE c(node) AS (SELECT CAST(3 AS BIGINT) UNION SELECT e.src FROM c JOIN imports_edges e ON e.dst = c.node) SELECT (SELECT count(*) - 1 FROM c) AS dependents, (SELECT count(*) FROM classes WHERE key % 25 = 3 AND expired IS NULL) AS live_classes, (SELECT count(*) - 1 FROM c) = 0 AS safe")
def deletion_impact(t):
    from ..operators import graph

    deps = graph.closure(t.imports_edges, [3], 50, reverse=True).where("depth > 0").agg(F.count("*").alias("dependents"))
    own = t.classes.where("key % 25 = 3 AND expired IS NULL").agg(F.count("*").alias("live_classes"))
    return deps.join(F.broadcast(own)).select("dependents", "live_classes", (F.col("dependents") == 0).alias("safe"))


@query("SELECT entity AS key, status FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY created DESC, key DESC) AS rn FROM revisions) WHERE rn = 1")
def revision_status_fold(t):
    return t.revisions.groupBy(F.col("entity").alias("key")).agg(F.max_by("status", F.struct("created", "key")).alias("status"))


@query("""SELECT 'document' AS kind, doc_id, NULL::DOUBLE AS expired FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'chunk', doc_id, NULL FROM chunks WHERE doc_id % 3 <> 0
UNION ALL SELECT 'edge', src, CASE WHEN src % 3 = 0 AND expired IS NULL THEN 1800000000::DOUBLE WHEN expired IS NOT NULL THEN 1.0 END FROM relation_edges""")
def document_delete_cascade(t):
    """Documents and chunks go, live provenance edges expire."""
    from ..operators import materialise as M

    provenance = t.relation_edges.select(F.col("src").alias("doc_id"), F.when(F.col("expired").isNotNull(), 1.0).alias("expired"))
    gone = t.documents.select("doc_id").union(t.relation_edges.select("src")).where("doc_id % 3 = 0")
    documents, chunks, edges = M.delete_documents(t.documents.select("doc_id"), t.chunks.select("doc_id"), provenance, gone, 1_800_000_000.0)
    none = F.lit(None).cast("double").alias("expired")
    return documents.select(F.lit("document").alias("kind"), "doc_id", none).unionByName(chunks.select(F.lit("chunk").alias("kind"), "doc_id", none)).unionByName(edges.select(F.lit("edge").alias("kind"), "doc_id", "expired"))


@query("SELECT d.doc_id, (SELECT count(*) FROM chunks c WHERE c.doc_id = d.doc_id) AS chunks, (SELECT count(*) FROM relation_edges e WHERE e.src = d.doc_id AND e.expired IS NULL) AS edges FROM documents d WHERE d.doc_id % 3 = 0")
def document_delete_report(t):
    """What an unconfirmed deletion would touch."""
    from ..operators import materialise as M

    return M.deletion_report(t.chunks, t.relation_edges.select(F.col("src").alias("doc_id"), "expired"), t.documents.where("doc_id % 3 = 0"))


@query("SELECT key, CASE WHEN src % 20 = 0 AND expired IS NULL THEN true ELSE false END AS tombstone FROM relation_edges")
def expire_provenance_edges(t):
    docs = t.orders.select(F.col("o_orderkey").alias("src")).where("src % 20 = 0").withColumn("_gone", F.lit(True))
    return t.relation_edges.join(docs, "src", "left").select("key", (F.coalesce("_gone", F.lit(False)) & F.col("expired").isNull()).alias("tombstone"))


@query("SELECT r_name AS use_case, n_name AS question, n_nationkey % 3 AS priority FROM region JOIN nation ON n_regionkey = r_regionkey")
def cq_flattening(t):
    cases = t.nation.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("question"), (F.col("n_nationkey") % 3).alias("priority"))).alias("questions"))
    spec = t.region.join(cases, F.col("n_regionkey") == F.col("r_regionkey"))
    return spec.select(F.col("r_name").alias("use_case"), F.explode("questions").alias("q")).select("use_case", "q.question", "q.priority")


@query("SELECT r_name AS use_case, string_agg(n_name, '; ' ORDER BY n_nationkey % 3, n_name) AS outline FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def cq_scope_outline(t):
    own = t.nation.join(hinted(t.region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("use_case")).agg(F.array_sort(F.collect_list(F.struct((F.col("n_nationkey") % 3).alias("p"), "n_name"))).alias("q"))
    return own.select("use_case", F.array_join("q.n_name", "; ").alias("outline"))


@query("SELECT key, label, least(1, greatest(0, confidence * 2)) AS confidence FROM classes")
def llm_payload_parse(t):
    """Model answers in fenced JSON, with clamped confidence."""
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct("key", "label", (F.col("confidence") * 2).alias("confidence"))), F.lit("\n```"))
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    own = t.classes.select(F.from_json(inner, "key long, label string, confidence double").alias("x")).select("x.*")
    return own.withColumn("confidence", S.clamp(F.col("confidence")))


@query("SELECT key, CASE WHEN key % 7 = 3 THEN 0.5 ELSE CASE key % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 WHEN 3 THEN 0.1 ELSE 0.5 END END::DOUBLE AS score FROM classes")
def judge_payload_parse(t):
    """Ratings out of a judge's answers, a batch of five classes each; some are fenced, some broken, some leave classes out."""
    from ..operators import materialise as M

    word = F.element_at(F.array(*map(F.lit, ("EXPLICIT", "inferred", "PLAUSIBLE", "HALLUCINATED", "PERHAPS", ""))), (F.col("key") % 6 + 1).cast("int"))
    own = t.classes.select("key", "uri", word.alias("rating"), F.concat(F.floor(F.col("key") / 35), F.lit("-"), F.col("key") % 7).alias("batch"))
    entry = F.collect_list(F.when(F.col("rating") != "", F.struct("uri", "rating")))
    body = own.groupBy("batch").agg(F.to_json(F.struct(entry.alias("results"))).alias("json"))
    raw = F.when(F.endswith("batch", F.lit("-3")), F.concat(F.lit("no json: "), "json")).when(F.endswith("batch", F.lit("-1")), F.concat(F.lit("```json\n"), "json", F.lit("\n```"))).otherwise(F.col("json"))
    scores = M.judge_scores(body.select("batch", raw.alias("raw")), own.select("batch", "uri"))
    return own.join(scores, ["batch", "uri"]).select("key", "score")


@query("SELECT doc_id, min(lang) AS domain FROM (SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id + 1, lang FROM documents) WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY 1".replace("min(lang)", "arg_min(lang, o)").replace("SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id + 1, lang FROM", "SELECT doc_id, lang, 0 AS o FROM documents UNION ALL SELECT doc_id + 1, lang, 1 FROM"))
def domain_payload_parse(t):
    """Assignments of a chunk to domains: unknown chunks are dropped, the first assignment holds."""
    both = t.documents.select("doc_id", "lang", F.lit(0).alias("o")).unionAll(t.documents.select(F.col("doc_id") + 1, "lang", F.lit(1)))
    return both.join(t.documents.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by("lang", "o").alias("domain"))


@query("SELECT label AS a, arg_max(key, confidence * 100000 - key) AS kept, count(*) AS n FROM classes GROUP BY label")
def keep_best_dedup(t):
    order = F.col("confidence") * 100000 - F.col("key")
    return t.classes.groupBy(F.col("label").alias("a")).agg(F.max_by("key", order).alias("kept"), F.count("*").alias("n"))


@query("SELECT a.key, b.version AS next_version FROM entity_versions a JOIN entity_versions b ON b.uri = a.uri AND b.version = a.version + 1")
def supersede_chain(t):
    b = t.entity_versions.select("uri", (F.col("version") - 1).alias("version"), F.col("version").alias("next_version"))
    return t.entity_versions.join(b, ["uri", "version"]).select("key", "next_version")


@query("SELECT name, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS name FROM {name}" for name in BASE) + ") GROUP BY 1")
def collection_inventory(t):
    """Rows of every table."""
    rows = reduce(lambda a, b: a.unionAll(b), [getattr(t, name).select(F.lit(name).alias("name")) for name in BASE])
    return rows.groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT conv_id AS doc_id, turn AS section, CASE WHEN turn % 3 = 0 AND length(trim(text)) = 0 THEN 'visual' WHEN turn % 3 = 0 THEN 'mixed' ELSE 'text' END AS chunk_kind,
list_filter([CASE WHEN turn % 4 > 0 THEN 'a' END, CASE WHEN turn % 4 > 1 THEN 'b' END], lambda x: x IS NOT NULL)::VARCHAR AS assets FROM conversations""")
def visual_context_backfill(t):
    """Kind of each chunk by its lines, and the assets that its section names; indexes out of range are left out."""
    from ..operators import materialise as M

    body = F.concat(F.when(F.col("turn") % 3 == 0, "[Visual (caption): a chart]\n").otherwise(""), F.col("text"))
    chunks = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section"), body.alias("text"))
    assets = F.when(F.col("turn") % 4 > 1, F.array(F.lit("a"), F.lit("b"))).when(F.col("turn") % 4 > 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    sections = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section"), F.array(F.lit(0), F.lit(1), F.lit(7)).alias("asset_indexes"), assets.alias("assets"))
    own = M.visual_context(chunks, sections)
    return own.select("doc_id", "section", "chunk_kind", F.concat(F.lit("["), F.array_join("visual_assets", ", "), F.lit("]")).alias("assets"))


@query("SELECT conv_id AS doc_id, len(list_filter(list_transform(regexp_split_to_array(text || chr(10) || chr(10) || role, '\\n\\s*\\n'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> ''))::INTEGER AS n, turn FROM conversations")
def section_paragraphs(t):
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.size(X.paragraphs(F.concat("text", F.lit("\n\n"), "role"))).alias("n"), "turn")


@query("SELECT broken AS reason, on_class AS entity, 'pending' AS status FROM (SELECT c.on_class, CASE WHEN n < min_count THEN 'min' WHEN n > max_count THEN 'max' END AS broken FROM constraints c JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_suppkey = c.on_class) WHERE broken IS NOT NULL")
def violations_to_inbox(t):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("on_class")).agg(F.count("*").alias("n"))
    return Q.cardinality_violations(t.constraints, n).select(F.col("broken").alias("reason"), F.col("on_class").alias("entity"), F.lit("pending").alias("status"))


@query("SELECT key AS entity, 'stale' AS reason, 'pending' AS status FROM classes WHERE expired IS NULL AND coalesce(last_evidenced_at, created) < 1701000000")
def stale_to_inbox(t):
    own = V.live(t.classes).where(F.coalesce("last_evidenced_at", "created") < 1_701_000_000)
    return own.select(F.col("key").alias("entity"), F.lit("stale").alias("reason"), F.lit("pending").alias("status"))


@query("SELECT label, min(key) AS keep, count(*) - 1 AS dropped FROM entities GROUP BY label HAVING count(*) > 1")
def abox_canonicalise(t):
    """Individuals of one label become one: the smallest key stays."""
    return t.entities.groupBy("label").agg(F.min("key").alias("keep"), (F.count("*") - 1).alias("dropped")).where("dropped > 0")


@query("SELECT doc_id, label, strpos(lower(text), label) - 1 AS start FROM (SELECT doc_id, text, unnest(['the', 'que', 'der']) AS label FROM documents) WHERE strpos(lower(text), label) > 0")
def abox_extraction(t):
    """Individuals of given labels with their spans; the extractor is a column function, a model can take its place."""
    own = t.documents.select("doc_id", "text", F.explode(F.array(*map(F.lit, ("the", "que", "der")))).alias("label"))
    return own.withColumn("s", X.locate_span(F.col("text"), F.col("label"))).where("s IS NOT NULL").select("doc_id", "label", F.col("s.start").cast("long").alias("start"))
