"""Graph traversal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import incremental as I
from ..operators.core import hinted
from .registry import query


@query("WITH RECURSIVE c(node, depth) AS (SELECT CAST(24 AS BIGINT), 0 UNION SELECT e.dst, c.depth + 1 FROM c JOIN imports_edges e ON e.src = c.node WHERE c.depth < 50) SELECT node, min(depth)::INTEGER AS depth FROM c GROUP BY node")
def imports_closure(t):
    return G.closure(t.imports_edges, [24], 50)


@query("WITH RECURSIVE c(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.src, c.depth + 1 FROM c JOIN imports_edges e ON e.dst = c.node WHERE c.depth < 10) SELECT node, min(depth)::INTEGER AS depth FROM c WHERE depth > 0 GROUP BY node")
def transitive_dependents(t):
    return G.closure(t.imports_edges, [1], 10, reverse=True).where("depth > 0")


@query("SELECT DISTINCT src AS dependent FROM imports_edges WHERE dst = 3")
def direct_dependents(t):
    return t.imports_edges.where("dst = 3").select(F.col("src").alias("dependent")).distinct()


@query("SELECT dst AS imported FROM imports_edges WHERE src = 12")
def direct_imports(t):
    return t.imports_edges.where("src = 12").select(F.col("dst").alias("imported"))


@query("SELECT e.src, e.dst, a.n_name AS src_name, b.n_name AS dst_name FROM imports_edges e JOIN nation a ON a.n_nationkey = e.src JOIN nation b ON b.n_nationkey = e.dst")
def full_imports_dag(t):
    a = t.nation.select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_name").alias("src_name"))
    b = t.nation.select(F.col("n_nationkey").cast("long").alias("dst"), F.col("n_name").alias("dst_name"))
    return t.imports_edges.join(hinted(a), "src").join(hinted(b), "dst").select("src", "dst", "src_name", "dst_name")


@query("WITH RECURSIVE c(node, depth) AS (SELECT CAST(6 AS BIGINT), 0 UNION SELECT CASE WHEN e.src = c.node THEN e.dst ELSE e.src END, c.depth + 1 FROM c JOIN imports_edges e ON e.src = c.node OR e.dst = c.node WHERE c.depth < 2) SELECT DISTINCT e.src, e.dst FROM imports_edges e WHERE e.src IN (SELECT node FROM c WHERE depth < 2) OR e.dst IN (SELECT node FROM c WHERE depth < 2)")
def rooted_dag_any(t):
    both = t.imports_edges.unionByName(t.imports_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    inner = G.closure(both, [6], 2).where("depth < 2").select("node")
    a = t.imports_edges.join(inner.withColumnRenamed("node", "src"), "src", "left_semi")
    b = t.imports_edges.join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    return a.unionByName(b).distinct()


@query("WITH RECURSIVE c(node, depth) AS (SELECT CAST(13 AS BIGINT), 0 UNION SELECT e.dst, c.depth + 1 FROM c JOIN imports_edges e ON e.src = c.node WHERE c.depth < 3) SELECT e.src, e.dst FROM imports_edges e JOIN (SELECT node, min(depth) AS d FROM c GROUP BY node) n ON n.node = e.src AND n.d < 3")
def rooted_dag_out(t):
    inner = G.closure(t.imports_edges, [13], 3).where("depth < 3").select(F.col("node").alias("src"))
    return t.imports_edges.join(inner, "src", "left_semi")


@query("WITH RECURSIVE c(a, b) AS (SELECT src, dst FROM cyclic_edges UNION SELECT c.a, e.dst FROM c JOIN cyclic_edges e ON e.src = c.b) SELECT count(*) > 0 AS has_cycle FROM c WHERE a = b")
def cycle_existence(t):
    return G.cycle_nodes(t.cyclic_edges).agg((F.count("*") > 0).alias("has_cycle"))


@query("WITH RECURSIVE c(a, b) AS (SELECT src, dst FROM cyclic_edges UNION SELECT c.a, e.dst FROM c JOIN cyclic_edges e ON e.src = c.b), m AS (SELECT x.a, x.b FROM c x JOIN c y ON x.a = y.b AND x.b = y.a) SELECT a AS node, least(min(b), a) AS component FROM m GROUP BY a")
def scc_cycle_report(t):
    return G.scc(t.cyclic_edges)


@query("WITH RECURSIVE w(way) AS (SELECT DISTINCT [src, dst] FROM cyclic_edges WHERE src < dst UNION SELECT list_append(w.way, e.dst) FROM w JOIN cyclic_edges e ON e.src = w.way[-1] WHERE e.dst > w.way[1] AND NOT list_contains(w.way, e.dst)) SELECT way::VARCHAR AS cycle FROM w JOIN (SELECT DISTINCT src, dst FROM cyclic_edges) e ON e.src = w.way[-1] AND e.dst = w.way[1] UNION ALL SELECT DISTINCT [src]::VARCHAR FROM cyclic_edges WHERE src = dst")
def merge_induced_cycles(t):
    return G.core_cycles(t.cyclic_edges).select(F.concat(F.lit("["), F.array_join(F.col("cycle").cast("array<string>"), ", "), F.lit("]")).alias("cycle"))


@query("SELECT p_partkey AS key, CASE WHEN p_partkey % 7 <= p_partkey % 5 AND p_partkey % 7 <= p_partkey % 3 THEN [p_partkey % 7, p_partkey % 5, p_partkey % 3] WHEN p_partkey % 5 < p_partkey % 7 AND p_partkey % 5 <= p_partkey % 3 THEN [p_partkey % 5, p_partkey % 3, p_partkey % 7] ELSE [p_partkey % 3, p_partkey % 7, p_partkey % 5] END::VARCHAR AS cycle FROM part")
def cycle_canonical(t):
    nodes = F.array(*[F.col("p_partkey") % m for m in (7, 5, 3)])
    at = F.array_position(nodes, F.array_min(nodes)).cast("int")
    turned = F.concat(F.slice(nodes, at, F.lit(3)), F.slice(nodes, F.lit(1), at - 1))
    return t.part.select(F.col("p_partkey").alias("key"), F.concat(F.lit("["), F.array_join(turned.cast("array<string>"), ", "), F.lit("]")).alias("cycle"))


@query("WITH RECURSIVE c(a, b, d) AS (SELECT src, dst, 1 FROM imports_edges UNION SELECT c.a, e.dst, c.d + 1 FROM c JOIN imports_edges e ON e.src = c.b WHERE c.d < 10), k AS (SELECT a.n_nationkey AS importer, b.n_nationkey AS imported FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey) SELECT importer, imported FROM k WHERE importer = imported OR EXISTS (SELECT 1 FROM c WHERE c.a = k.imported AND c.b = k.importer)")
def import_cycle_guard(t):
    n = t.nation.select(F.col("n_nationkey").alias("importer"), F.col("n_regionkey").alias("r"))
    m = t.nation.select(F.col("n_nationkey").alias("imported"), F.col("n_regionkey").alias("r"))
    wanted = n.join(m, "r").select("importer", "imported")
    reach = G.closure_pairs(t.imports_edges, 10).select(F.col("src").cast("int").alias("imported"), F.col("dst").cast("int").alias("importer"))
    return wanted.where("importer = imported").unionByName(wanted.where("importer <> imported").join(reach, ["importer", "imported"], "left_semi"))


@query("WITH RECURSIVE c(node, depth) AS (SELECT DISTINCT dst, 0 FROM subclass_edges WHERE dst NOT IN (SELECT src FROM subclass_edges) UNION SELECT e.src, c.depth + 1 FROM c JOIN subclass_edges e ON e.dst = c.node WHERE c.depth < 20) SELECT max(depth)::INTEGER AS max_depth FROM c")
def max_hierarchy_depth(t):
    return G.depths(t.subclass_edges, 20).agg(F.max("depth").alias("max_depth"))


@query("WITH RECURSIVE c(node, depth) AS (SELECT DISTINCT dst, 0 FROM subclass_edges WHERE dst NOT IN (SELECT src FROM subclass_edges) UNION SELECT e.src, c.depth + 1 FROM c JOIN subclass_edges e ON e.dst = c.node WHERE c.depth < 20) SELECT depth::INTEGER AS depth, count(*) AS n FROM c GROUP BY depth")
def hierarchy_depths(t):
    return G.depths(t.subclass_edges, 20).groupBy("depth").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE c(node, path, depth) AS (SELECT dst, dst, 0 FROM (SELECT DISTINCT dst FROM subclass_edges WHERE dst LIKE 'r%') UNION ALL SELECT e.src, c.path || '/' || e.src, c.depth + 1 FROM c JOIN subclass_edges e ON e.dst = c.node WHERE c.depth < 2) SELECT path, depth::INTEGER AS depth FROM c")
def hierarchy_tree_paths(t):
    roots = t.subclass_edges.where("dst LIKE 'r%'").select(F.col("dst").alias("node")).distinct()
    return G.paths(t.subclass_edges, roots, 2).select(F.array_join("path", "/").alias("path"), "depth")


@query("SELECT r_name AS sort_key, '- ' || r_name AS line FROM region UNION ALL SELECT r_name || '/' || n_name, '  - ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def indented_outline(t):
    labels = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"), F.col("r_name").alias("label")).unionByName(t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_name").alias("label")))
    edges = t.subclass_edges.where("src LIKE 'n%'")
    return G.outline(edges, labels.where("node LIKE 'r%'").select("node"), labels)


@query("""WITH RECURSIVE i(node) AS (SELECT 24::BIGINT UNION SELECT e.dst FROM i JOIN imports_edges e ON e.src = i.node), o AS (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey IN (SELECT node FROM i))
SELECT n_name AS sort_key, '- ' || n_name AS line FROM o UNION ALL SELECT n_name || '/' || c_name, '  - ' || c_name FROM o JOIN customer ON c_nationkey = k""")
def effective_outline(t):
    """The outline of each ontology in the import closure of one."""
    sources = G.closure(t.imports_edges, [24], 50).withColumnRenamed("node", "n_nationkey")
    labels = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_name").alias("label"), "n_nationkey")
    own = labels.join(hinted(sources), "n_nationkey", "left_semi").select("node", "label")
    customers = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_name").alias("label"))
    return G.outline(t.subclass_edges.where("src LIKE 'c%'"), own.select("node"), own.unionByName(customers))


@query("WITH p AS (SELECT src AS node, string_agg(DISTINCT dst::VARCHAR, ',' ORDER BY dst::VARCHAR) AS parents FROM imports_edges GROUP BY src), c AS (SELECT dst AS node, string_agg(DISTINCT src::VARCHAR, ',' ORDER BY src::VARCHAR) AS children FROM imports_edges GROUP BY dst), d AS (SELECT class_key AS node, count(DISTINCT prop) AS n_props FROM property_domain GROUP BY class_key) SELECT coalesce(p.node, c.node, d.node) AS node, parents, children, n_props FROM p FULL JOIN c ON p.node = c.node FULL JOIN d ON d.node = coalesce(p.node, c.node)")
def class_neighbourhood(t):
    out = G.neighbourhood(t.imports_edges, t.property_domain)
    text = lambda c: F.array_join(F.array_sort(F.col(c).cast("array<string>")), ",")
    return out.select("node", text("parents").alias("parents"), text("children").alias("children"), F.when(F.col("props").isNotNull(), F.size("props")).cast("long").alias("n_props"))


_COMPONENTS = "WITH RECURSIVE e AS (SELECT {src} AS u, {dst} AS v FROM {table} WHERE {where}), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(u, v) AS (SELECT u, u FROM b UNION SELECT r.u, b.v FROM r JOIN b ON b.u = r.v)"


@query(_COMPONENTS.format(src="src", dst="dst + 100000", table="relation_edges", where="confidence >= 0.97") + " SELECT u AS node, min(v) AS component FROM r GROUP BY u")
def connected_components_er(t):
    edges = t.relation_edges.where("confidence >= 0.97").select("src", (F.col("dst") + 100000).alias("dst"))
    return G.connected_components(edges)


@query(_COMPONENTS.format(src="src", dst="dst + 100000", table="relation_edges", where="confidence >= 0.96 AND expired IS NULL") + " SELECT u AS node, min(v) AS component FROM r GROUP BY u")
def components_kept_up(t):
    """Components of edges of 0.98 and more, then those from 0.96 come, and all that have expired go."""
    edges = t.relation_edges.select(F.col("src").alias("a"), (F.col("dst") + 100000).alias("b"), "confidence", "expired")
    state = I.kept_up(edges.where("confidence >= 0.98"), loops=True)
    state.apply(edges.where("confidence >= 0.96 AND confidence < 0.98"), edges.limit(0))
    live, gone = (I.as_pairs(edges.where(x), loops=True).select(F.col("u").alias("a"), F.col("v").alias("b")) for x in ("confidence >= 0.96 AND expired IS NULL", "expired IS NOT NULL"))
    state.apply(edges.limit(0), gone.join(live, ["a", "b"], "left_anti"))
    return state.components


@query(_COMPONENTS.format(src="src", dst="dst", table="imports_edges", where="src % 5 <> 0") + ", k AS (SELECT u AS node, min(v) AS component FROM r GROUP BY u) SELECT component, count(*) AS size FROM k GROUP BY component HAVING count(*) >= 2")
def connected_components_alignment(t):
    own = G.connected_components(t.imports_edges.where("src % 5 <> 0"))
    return own.groupBy("component").agg(F.count("*").alias("size")).where("size >= 2")


@query(_COMPONENTS.format(src="src", dst="dst", table="imports_edges", where="src % 3 <> 0") + ", k AS (SELECT u AS node, min(v) AS component FROM r GROUP BY u), d AS (SELECT n_nationkey AS a, n_nationkey + 6 AS b FROM nation) SELECT d.a, d.b, x.component FROM d JOIN k x ON x.node = d.a JOIN k y ON y.node = d.b AND x.component = y.component")
def disjoint_pair_in_component(t):
    comps = G.connected_components(t.imports_edges.where("src % 3 <> 0"))
    pairs = t.nation.select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_nationkey") + 6).cast("long").alias("b"))
    x = comps.select(F.col("node").alias("a"), "component")
    y = comps.select(F.col("node").alias("b"), F.col("component").alias("other"))
    return pairs.join(x, "a").join(y, "b").where("component = other").select("a", F.col("b").cast("int").alias("b"), "component").select(F.col("a").cast("int").alias("a"), "b", "component")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_quantity > 48 AND l_partkey <> l_suppkey")
def disjoint_pairs(t):
    own = t.lineitem.where("l_quantity > 48 AND l_partkey <> l_suppkey")
    return own.select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query("WITH RECURSIVE b AS (SELECT src AS u, dst AS v FROM imports_edges UNION SELECT dst, src FROM imports_edges), p(node, way) AS (SELECT 24::BIGINT, [24::BIGINT] UNION ALL SELECT b.v, list_append(p.way, b.v) FROM p JOIN b ON b.u = p.node WHERE NOT list_contains(p.way, b.v)), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY len(way), way) AS rn FROM p) SELECT node, array_to_string(way, ',') AS path FROM r WHERE rn = 1")
def shortest_path(t):
    return G.shortest_paths(t.imports_edges, 24).select("node", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


@query("""WITH RECURSIVE c(node, depth) AS (SELECT CAST(24 AS BIGINT), 0 UNION SELECT e.dst, c.depth + 1 FROM c JOIN imports_edges e ON e.src = c.node WHERE c.depth < 50), s AS (SELECT node, min(depth) AS depth FROM c GROUP BY node)
SELECT k.key, k.label, s.node AS source_id, n.n_name AS source_name, s.node <> 24 AS is_imported FROM classes k JOIN s ON s.node = k.key % 25 JOIN nation n ON n.n_nationkey = s.node WHERE k.expired IS NULL""")
def effective_view(t):
    sources = G.closure(t.imports_edges, [24], 50).select(F.col("node").alias("source_id"))
    names = t.nation.select(F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_name").alias("source_name"))
    own = t.classes.where("expired IS NULL").withColumn("source_id", F.col("key") % 25)
    return own.join(hinted(sources), "source_id").join(hinted(names), "source_id").select("key", "label", "source_id", "source_name", (F.col("source_id") != 24).alias("is_imported"))


@query("""WITH RECURSIVE o(node, depth) AS (SELECT 9::BIGINT, 0 UNION SELECT e.dst, o.depth + 1 FROM o JOIN cyclic_edges e ON e.src = o.node WHERE o.depth < 3), i(node, depth) AS (SELECT 9::BIGINT, 0 UNION SELECT e.src, i.depth + 1 FROM i JOIN cyclic_edges e ON e.dst = i.node WHERE i.depth < 3),
f AS (SELECT DISTINCT 'full' AS part, src, dst FROM cyclic_edges), r AS (SELECT DISTINCT e.src, e.dst FROM cyclic_edges e JOIN o ON o.node = e.src AND o.depth < 3 UNION SELECT DISTINCT e.src, e.dst FROM cyclic_edges e JOIN i ON i.node = e.dst AND i.depth < 3)
SELECT part, src, dst FROM f UNION ALL SELECT 'rooted', src, dst FROM r""")
def imports_dag_dispatch(t):
    """The whole imports graph, and what lies within three steps of one ontology on either side."""
    names = t.nation.select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_name").alias("name"))
    full, rooted = G.imports_dag(t.cyclic_edges, names)[1], G.imports_dag(t.cyclic_edges, names, 9, "both", 3)[1]
    return full.select(F.lit("full").alias("part"), "src", "dst").unionByName(rooted.select(F.lit("rooted").alias("part"), "src", "dst"))


@query("""WITH RECURSIVE i(node, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT e.src, i.depth + 1 FROM i JOIN imports_edges e ON e.dst = i.node WHERE i.depth < 50) SELECT DISTINCT node, n_name AS name FROM i JOIN nation ON n_nationkey = node""")
def imports_dag_nodes(t):
    """What imports one ontology, to any depth, with names."""
    names = t.nation.select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_name").alias("name"))
    return G.imports_dag(t.imports_edges, names, 3, "inbound", 1000)[0]
