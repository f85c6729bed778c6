"""Quality metric queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import quality as Q
from ..operators.core import hinted
from .registry import query

R6 = lambda c: F.round(c, 6)


@query("SELECT c.ontology_id, count(*) AS n_classes, count(DISTINCT uri) AS n_uris, round(avg(confidence), 6) AS avg_confidence, round(avg((length(description) > 20)::INT), 6) AS described, (SELECT count(*) FROM relation_edges e WHERE e.ontology_id = c.ontology_id AND e.expired IS NULL) AS n_edges FROM classes c WHERE expired IS NULL GROUP BY c.ontology_id")
def ontology_quality(t):
    out = Q.class_metrics(t.classes, t.relation_edges)
    return out.withColumns({k: R6(k) for k in ("avg_confidence", "described")})


@query("SELECT ontology_id, edge_type, count(*) AS n FROM relation_edges WHERE expired IS NULL GROUP BY 1, 2")
def edge_counts(t):
    return t.relation_edges.where("expired IS NULL").groupBy("ontology_id", "edge_type").agg(F.count("*").alias("n"))


@query("SELECT ontology_id, count(DISTINCT dst) AS n FROM relation_edges GROUP BY 1")
def distinct_endpoints(t):
    return t.relation_edges.groupBy("ontology_id").agg(F.countDistinct("dst").alias("n"))


@query("SELECT count(*) AS n FROM (SELECT prop FROM property_domain UNION SELECT prop FROM property_range)")
def union_distinct_count(t):
    return t.property_domain.select("prop").union(t.property_range.select("prop")).distinct().agg(F.count("*").alias("n"))


@query("SELECT edge_type, count(*) AS n, count(confidence)::BIGINT AS with_evidence, count(confidence)::DOUBLE / count(*) AS share FROM relation_edges GROUP BY ROLLUP (edge_type)")
def evidence_coverage(t):
    return Q.coverage(t.relation_edges, ["edge_type"], F.col("confidence").isNotNull())


@query("SELECT ontology_id, count(*) AS n, count(*) FILTER (WHERE confidence > 0.5)::BIGINT AS with_evidence, count(*) FILTER (WHERE confidence > 0.5)::DOUBLE / count(*) AS share FROM classes GROUP BY ontology_id")
def evidence_conditional_sums(t):
    return Q.coverage(t.classes, ["ontology_id"], F.col("confidence") > 0.5).where("ontology_id IS NOT NULL")


@query("SELECT round(avg((q > 49)::INT), 6) AS grounded_rate, round(avg((n > 3)::INT), 6) AS typed_rate FROM (SELECT l_orderkey, max(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1)")
def abox_metrics(t):
    own = t.lineitem.groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.count("*").alias("n"))
    return own.agg(R6(F.avg((F.col("q") > 49).cast("int"))).alias("grounded_rate"), R6(F.avg((F.col("n") > 3).cast("int"))).alias("typed_rate"))


@query("WITH n AS (SELECT ontology_id, count(*) AS c, avg((length(description) > 20)::INT) AS annotated FROM classes GROUP BY 1), e AS (SELECT ontology_id, count(*) AS r FROM relation_edges GROUP BY 1) SELECT n.ontology_id, round(r::DOUBLE / (r + c), 6) AS relationship_richness, round(annotated, 6) AS annotated FROM n JOIN e USING (ontology_id)")
def schema_richness(t):
    n = t.classes.groupBy("ontology_id").agg(F.count("*").alias("c"), F.avg((F.length("description") > 20).cast("int")).alias("annotated"))
    e = t.relation_edges.groupBy("ontology_id").agg(F.count("*").alias("r"))
    return n.join(e, "ontology_id").select("ontology_id", R6(F.col("r") / (F.col("r") + F.col("c"))).alias("relationship_richness"), R6("annotated").alias("annotated"))


@query("WITH m AS (SELECT ontology_id, count(*) AS n, count(*) FILTER (WHERE key % 13 = 0) AS orphans FROM classes GROUP BY 1) SELECT ontology_id, greatest(0, least(100, round_even((0.8 * 0.20 + 0.25 * 0.20 + greatest(0, 1 - CASE WHEN ontology_id = 1 THEN 0.3 ELSE 0 END - orphans::DOUBLE / n) * 0.15 + 0.5 * 0.20 + 2.0 / 3 * 0.15 + 0.5 * 0.10) * 100, 0)::INTEGER)) AS health FROM m")
def health_score(t):
    m = t.classes.groupBy("ontology_id").agg(F.count("*").alias("n"), F.sum((F.col("key") % 13 == 0).cast("int")).alias("orphans"))
    return m.select("ontology_id", S.health_score(F.lit(0.8), F.lit(0.25), F.col("ontology_id") == 1, F.col("orphans"), F.col("n"), F.lit(0.5), F.col("n") * 2, F.col("n") / 2).alias("health"))


@query("SELECT ontology_id, count(*) FILTER (WHERE action = 'approve')::BIGINT AS accepted, count(*) FILTER (WHERE action = 'reject')::BIGINT AS rejected, count(*) FILTER (WHERE action = 'edit')::BIGINT AS edited, count(*) FILTER (WHERE action = 'approve')::DOUBLE / count(*) AS rate FROM decisions GROUP BY 1")
def acceptance_rate(t):
    return Q.acceptance(t.decisions, ["ontology_id"])


_CAL = "WITH h AS (SELECT CASE WHEN confidence >= 1 THEN 9 ELSE floor(confidence * 10) END::INTEGER AS bucket, count(*) AS n, avg(confidence) AS confidence, avg((action = 'approve')::INT) AS accepted FROM decisions GROUP BY 1) "


@query(_CAL + "SELECT bucket, n, round(confidence, 6) AS confidence, round(accepted, 6) AS accepted FROM h")
def calibration_histogram(t):
    return Q.calibration(t.decisions).withColumns({"confidence": R6("confidence"), "accepted": R6("accepted")})


@query(_CAL + "SELECT round(sum(n * abs(confidence - accepted)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM h")
def calibration_error(t):
    return Q.calibration_error(Q.calibration(t.decisions)).select(R6("ece").alias("ece"), "n")


@query("SELECT count(*) AS ontologies, sum(n)::BIGINT AS classes, round(avg(c), 6) AS mean_confidence FROM (SELECT ontology_id, count(*) AS n, avg(confidence) AS c FROM classes GROUP BY 1)")
def cross_ontology_summary(t):
    own = t.classes.groupBy("ontology_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    return own.agg(F.count("*").alias("ontologies"), F.sum("n").alias("classes"), R6(F.avg("c")).alias("mean_confidence"))


@query("WITH m AS (SELECT source, avg(least(n_chars, 5000) / 5000.0::DOUBLE) AS conf, avg((n_chars < 300)::INT) AS orphan FROM documents GROUP BY 1) SELECT source, 'low_confidence' AS alert FROM m WHERE conf < 0.5 UNION ALL SELECT source, 'orphans' FROM m WHERE orphan > 0.3")
def dashboard_alerts(t):
    m = t.documents.groupBy("source").agg(F.avg(F.least("n_chars", F.lit(5000)) / 5000.0).alias("conf"), F.avg((F.col("n_chars") < 300).cast("int")).alias("orphan"))
    alerts = F.array_compact(F.array(F.when(F.col("conf") < 0.5, "low_confidence"), F.when(F.col("orphan") > 0.3, "orphans")))
    return m.select("source", F.explode(alerts).alias("alert"))


@query("SELECT c.ontology_id, c.n, d.decisions FROM (SELECT ontology_id, count(*) AS n FROM classes GROUP BY 1) c JOIN (SELECT key % 3 AS ontology_id, count(*) AS decisions FROM decisions GROUP BY 1) d USING (ontology_id)")
def quality_report(t):
    c = t.classes.groupBy("ontology_id").agg(F.count("*").alias("n"))
    return c.join(t.decisions.groupBy((F.col("key") % 3).alias("ontology_id")).agg(F.count("*").alias("decisions")), "ontology_id")


@query("SELECT ontology_id, sum(n)::BIGINT AS n FROM (SELECT ontology_id, count(*) AS n FROM relation_edges GROUP BY 1 UNION ALL SELECT ontology_id, count(*) FROM classes GROUP BY 1) GROUP BY 1")
def grouped_union_counts(t):
    return t.relation_edges.select("ontology_id").unionAll(t.classes.select("ontology_id")).groupBy("ontology_id").agg(F.count("*").alias("n"))


@query("SELECT verdict, action, status, count(*) AS n, grouping_id(verdict, action, status)::INTEGER AS level FROM revisions GROUP BY CUBE (verdict, action, status)")
def revisions_summary(t):
    return Q.marginals(t.revisions, ["verdict", "action", "status"])


@query("SELECT ontology_id, count(last_evidenced_at) AS n, max(last_evidenced_at) AS newest FROM classes GROUP BY 1")
def decay_status(t):
    return t.classes.groupBy("ontology_id").agg(F.count("last_evidenced_at").alias("n"), F.max("last_evidenced_at").alias("newest"))


@query("SELECT ontology_id, count(*) AS n FROM revisions WHERE status = 'pending' AND action = 'FLAG_FOR_CURATION' GROUP BY 1")
def inbox_size(t):
    return t.revisions.where("status = 'pending' AND action = 'FLAG_FOR_CURATION'").groupBy("ontology_id").agg(F.count("*").alias("n"))


@query("SELECT run_id, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at, round(count(*) / nullif(max(created_at) - min(created_at), 0) * 3600, 6) AS per_hour FROM decisions WHERE created_at >= 10000 GROUP BY 1")
def curation_throughput(t):
    own = t.decisions.where("created_at >= 10000").groupBy("run_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    span = F.col("last_at") - F.col("first_at")
    return own.withColumn("per_hour", R6(F.col("n") / F.when(span != 0, span) * 3600))


@query("SELECT k AS name, coalesce(n, 0)::BIGINT AS n FROM (VALUES ('classes'), ('edges'), ('individuals')) v(k) LEFT JOIN (SELECT 'classes' AS k2, count(*) AS n FROM classes WHERE expired IS NULL UNION ALL SELECT 'edges', count(*) FROM relation_edges WHERE expired IS NULL) c ON c.k2 = k")
def live_counts_by_table(t):
    names = t.spark.sql("SELECT * FROM VALUES ('classes'), ('edges'), ('individuals') AS v(name)")
    rows = t.classes.where("expired IS NULL").select(F.lit("classes").alias("name")).unionAll(t.relation_edges.where("expired IS NULL").select(F.lit("edges").alias("name")))
    return names.join(rows.groupBy("name").agg(F.count("*").alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT count(DISTINCT user_id) AS n FROM events WHERE user_id % 3 = 1 OR event_type = 'error'")
def distinct_run_count(t):
    tags = F.array("event_type", F.lit("x"))
    return t.events.where((F.col("user_id") % 3 == 1) | F.array_contains(tags, "error")).agg(F.countDistinct("user_id").alias("n"))


@query("SELECT count(*) FILTER (WHERE user_id % 3 = 1)::BIGINT AS as_target, count(*) FILTER (WHERE event_type = 'view')::BIGINT AS as_domain, count(*) AS total FROM events")
def run_summary(t):
    c = lambda x: F.sum(x.cast("int")).cast("long")
    return t.events.agg(c(F.col("user_id") % 3 == 1).alias("as_target"), c(F.col("event_type") == "view").alias("as_domain"), F.count("*").alias("total"))


@query("SELECT issue, count(*) AS n FROM (SELECT unnest([action, run_id]) AS issue FROM decisions) GROUP BY 1")
def action_issue_histogram(t):
    return t.decisions.select(F.explode(F.array("action", "run_id")).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("SELECT src, dst, copies, count(*) AS n FROM (SELECT src, dst, count(*) OVER (PARTITION BY src, dst) AS copies FROM relation_edges WHERE expired IS NULL) WHERE copies > 1 GROUP BY ALL")
def duplicate_edge_groups(t):
    return Q.duplicates(t.relation_edges, ["src", "dst"]).groupBy("src", "dst", "copies").agg(F.count("*").alias("n"))


@query("SELECT src, dst, min(created) AS kept FROM relation_edges WHERE expired IS NULL GROUP BY src, dst HAVING count(*) > 1")
def keep_first_dedup(t):
    return Q.duplicates(t.relation_edges, ["src", "dst"]).where("rank = 1").select("src", "dst", F.col("created").alias("kept"))


@query("SELECT brand AS k, count(DISTINCT ontology_id) AS n_sources, count(*)::INTEGER AS n_members FROM classes GROUP BY 1 HAVING count(DISTINCT ontology_id) >= 2")
def uri_conflict_groups(t):
    return Q.label_groups(t.classes, F.col("brand")).select("k", "n_sources", F.size("members").alias("n_members"))


@query("SELECT lower(trim(label)) AS k, count(DISTINCT ontology_id) AS n_sources, string_agg(key::VARCHAR, ',' ORDER BY key) AS members FROM classes GROUP BY 1 HAVING count(DISTINCT ontology_id) >= 2")
def label_conflict_groups(t):
    return Q.label_groups(t.classes, F.lower(F.trim("label"))).select("k", "n_sources", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("SELECT lower(trim(label)) AS k, count(*) AS n FROM classes WHERE expired IS NULL GROUP BY 1 HAVING count(*) > 1")
def redundant_classes(t):
    return t.classes.where("expired IS NULL").groupBy(F.lower(F.trim("label")).alias("k")).agg(F.count("*").alias("n")).where("n > 1")


@query("WITH e AS (SELECT n_nationkey AS a, n_nationkey + 1 AS b FROM nation WHERE n_nationkey % 4 = 1), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e) SELECT DISTINCT i.src AS x, i.dst AS y, s.b AS z FROM imports_edges i JOIN s ON s.a = i.dst WHERE s.b <> i.src AND NOT EXISTS (SELECT 1 FROM imports_edges k WHERE k.src = i.src AND k.dst = s.b)")
def synonym_triangles(t):
    e = t.nation.where("n_nationkey % 4 = 1").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_nationkey") + 1).cast("long").alias("b"))
    return Q.synonym_triangles(t.imports_edges, e).select("x", "y", F.col("z").cast("int").alias("z"))


@query("SELECT c.on_class, coalesce(n, 0)::BIGINT AS n, CASE WHEN coalesce(n, 0) < min_count THEN 'min' ELSE 'max' END AS broken FROM constraints c LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l.l_suppkey = c.on_class WHERE coalesce(n, 0) < min_count OR coalesce(n, 0) > max_count")
def cardinality_bounds(t):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("on_class")).agg(F.count("*").alias("n"))
    return Q.cardinality_violations(t.constraints, n).select("on_class", "n", "broken")


@query("SELECT p_partkey AS on_class, coalesce(n, 0)::BIGINT AS n, 'min' AS broken FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY 1) l ON l.l_partkey = p_partkey WHERE coalesce(n, 0) < 4")
def abox_cardinality(t):
    bounds = t.part.select(F.col("p_partkey").alias("on_class"), F.lit(4).alias("min_count"), F.lit(1000).alias("max_count"))
    n = t.lineitem.where("l_quantity > 40").groupBy(F.col("l_partkey").alias("on_class")).agg(F.count("*").alias("n"))
    return Q.cardinality_violations(bounds, n).select("on_class", "n", "broken")


@query("SELECT c.on_class, s.s_name AS label, c.min_count, c.max_count FROM constraints c JOIN supplier s ON s.s_suppkey = c.on_class")
def abox_bounds(t):
    return t.constraints.join(t.supplier.select(F.col("s_suppkey").alias("on_class"), F.col("s_name").alias("label")), "on_class").select("on_class", "label", "min_count", "max_count")


@query("WITH v AS (SELECT source, lang, count(*) AS votes, min(doc_id) AS f FROM documents GROUP BY 1, 2) SELECT source, lang, votes FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY votes DESC, f) AS rn FROM v) WHERE rn = 1")
def majority_vote(t):
    return Q.majority(t.documents, ["source"], "lang", "doc_id").select("source", "lang", "votes")


@query("SELECT lang FROM (SELECT lang, count(*) AS n, sum(n_chars) AS s FROM documents GROUP BY 1) ORDER BY n DESC, s DESC, lang LIMIT 1")
def dominant_domain(t):
    own = t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("s"))
    return own.orderBy(F.col("n").desc(), F.col("s").desc(), "lang").limit(1).select("lang")


@query("SELECT role AS domain, count(*) AS n FROM chunks GROUP BY 1")
def domain_chunk_counts(t):
    return t.chunks.groupBy(F.col("role").alias("domain")).agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT source, lang, avg(least(n_chars, 5000)) / 5000 AS conf FROM documents GROUP BY 1, 2), d AS (SELECT source, max(conf) AS top FROM m GROUP BY 1) SELECT m.source, m.lang FROM m JOIN d USING (source) WHERE conf >= 0.5 OR (top < 0.5 AND conf = top)")
def qualifying_domains(t):
    m = t.documents.groupBy("source", "lang").agg((F.avg(F.least("n_chars", F.lit(5000))) / 5000).alias("conf"))
    top = F.max("conf").over(Window.partitionBy("source"))
    return m.withColumn("top", top).where("conf >= 0.5 OR (top < 0.5 AND conf = top)").select("source", "lang")


@query("SELECT uri, count(DISTINCT pass) AS n_passes, round(count(DISTINCT pass) / 3, 6) AS ratio FROM passes GROUP BY 1 HAVING count(DISTINCT pass) >= 2")
def cross_pass_agreement(t):
    return Q.agreement(t.passes, 2, 3).withColumn("ratio", R6("ratio"))


@query("SELECT uri, arg_max(attr, weight * 100000 - attr) AS attr FROM passes GROUP BY uri")
def merge_descriptions(t):
    return t.passes.groupBy("uri").agg(F.max_by("attr", F.col("weight") * 100000 - F.col("attr")).alias("attr"))


@query("SELECT uri, attr, max(weight) AS longest, round(avg(greatest(0, least(1, weight / 50))), 3) AS confidence FROM passes GROUP BY uri, attr")
def merge_attributes(t):
    return t.passes.groupBy("uri", "attr").agg(F.max("weight").alias("longest"), F.round(F.avg(S.clamp(F.col("weight") / 50)), 3).alias("confidence"))


@query("SELECT uri, pass, attr, count(*) AS n, max(weight) AS best FROM passes GROUP BY 1, 2, 3")
def merge_relationships(t):
    return t.passes.groupBy("uri", "pass", "attr").agg(F.count("*").alias("n"), F.max("weight").alias("best"))


@query("SELECT uri, string_agg(attr::VARCHAR, ',' ORDER BY f, attr) AS evidence FROM (SELECT uri, attr, min(pass) AS f FROM passes GROUP BY 1, 2) GROUP BY 1")
def merge_evidence(t):
    own = t.passes.groupBy("uri", "attr").agg(F.min("pass").alias("f"))
    out = own.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("f", "attr"))).alias("e"))
    return out.select("uri", F.array_join(F.col("e.attr").cast("array<string>"), ",").alias("evidence"))


@query("WITH s AS (SELECT uri, pass, list_distinct(list(attr)) AS s FROM passes GROUP BY 1, 2), p AS (SELECT a.uri, len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) AS j FROM s a JOIN s b ON a.uri = b.uri AND a.pass < b.pass) SELECT u.uri, round(coalesce(avg(j), 1), 6) AS score FROM (SELECT DISTINCT uri FROM passes) u LEFT JOIN p ON p.uri = u.uri GROUP BY 1")
def pairwise_jaccard(t):
    return Q.pairwise_jaccard(t.passes).withColumn("score", R6("score"))


@query("SELECT round(count(*) FILTER (WHERE n = 3)::DOUBLE / count(*), 6) AS rate FROM (SELECT uri, count(DISTINCT pass) AS n FROM passes GROUP BY 1)")
def pass_agreement_rate(t):
    own = t.passes.groupBy("uri").agg(F.countDistinct("pass").alias("n"))
    return own.agg(R6(F.avg((F.col("n") == 3).cast("int"))).alias("rate"))


@query("SELECT lang AS model, round(sum(n_chars) / 1000000 * CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 15 ELSE 1 END, 6) AS cost FROM documents GROUP BY lang")
def run_cost(t):
    rates = t.spark.sql("SELECT * FROM VALUES ('en', 3), ('fr', 15) AS r(lang, rate)")
    own = t.documents.groupBy("lang").agg(F.sum("n_chars").alias("tokens")).join(hinted(rates), "lang", "left")
    return own.select(F.col("lang").alias("model"), R6(F.col("tokens") / 1_000_000 * F.coalesce("rate", F.lit(1))).alias("cost"))


_PRF = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"
_PR = "j AS (SELECT coalesce(p.doc, g.doc) AS doc, p.item AS p, g.item AS g FROM predicted p FULL JOIN gold g ON p.item = g.item AND p.doc = g.doc), c AS (SELECT {0} count(*) FILTER (WHERE p IS NOT NULL AND g IS NOT NULL)::DOUBLE AS tp, count(*) FILTER (WHERE g IS NULL)::DOUBLE AS fp, count(*) FILTER (WHERE p IS NULL)::DOUBLE AS fn FROM j {1})"


def _rounded(df):
    return df.withColumns({k: R6(k) for k in ("precision", "recall", "f1")})


@query("WITH p AS (SELECT DISTINCT item FROM predicted), g AS (SELECT DISTINCT item FROM gold), j AS (SELECT p.item AS p, g.item AS g FROM p FULL JOIN g ON p.item = g.item), c AS (SELECT count(*) FILTER (WHERE p IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (WHERE g IS NULL) AS fp, count(*) FILTER (WHERE p IS NULL) AS fn FROM j) SELECT tp, fp, fn, " + _PRF + " FROM c")
def set_prf(t):
    return _rounded(Q.set_scores(t.predicted, t.gold, ["item"]))


@query("WITH " + _PR.format("doc,", "GROUP BY doc") + ", d AS (SELECT doc, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, " + _PRF + " FROM c) SELECT * FROM d")
def prf_per_document(t):
    return _rounded(Q.set_scores(t.predicted, t.gold, ["item"], ["doc"]))


@query("WITH " + _PR.format("doc,", "GROUP BY doc") + ", d AS (SELECT tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM c) SELECT round(sum(tp) / sum(tp + fp), 6) AS micro_precision, round(sum(tp) / sum(tp + fn), 6) AS micro_recall, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall FROM d")
def micro_macro_report(t):
    d = Q.set_scores(t.predicted, t.gold, ["item"], ["doc"])
    return d.agg(R6(F.sum("tp") / F.sum(F.col("tp") + F.col("fp"))).alias("micro_precision"), R6(F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("micro_recall"), R6(F.avg("precision")).alias("macro_precision"), R6(F.avg("recall")).alias("macro_recall"))


_CURVE = """WITH p AS (SELECT p_partkey AS item, p_retailprice AS confidence FROM part), g AS (SELECT DISTINCT item, 1 AS g FROM gold), m AS (SELECT p.*, g.g FROM p LEFT JOIN g USING (item)),
b AS (SELECT count(*) AS n, coalesce(sum(g), 0) AS tp FROM m WHERE confidence >= 1500), k AS (SELECT count(*) AS n FROM g),
r AS (SELECT item, row_number() OVER w AS step, coalesce(sum(g) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS hits FROM m WHERE confidence < 1500 WINDOW w AS (ORDER BY confidence DESC, item)),
c AS (SELECT step::INTEGER AS step, (hits + b.tp)::BIGINT AS tp, (b.n - b.tp)::BIGINT AS fp, (k.n - hits - b.tp)::BIGINT AS fn FROM r, b, k) """


def _curve(t):
    p = t.part.select(F.col("p_partkey").alias("item"), F.col("p_retailprice").alias("confidence"))
    return Q.interaction_curve(p, t.gold, 1500.0).select("step", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"), R6("f1").alias("f1"))


@query(_CURVE + "SELECT step, tp, fp, fn, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def interaction_curve(t):
    return _curve(t)


@query(_CURVE + "SELECT min(step) AS steps FROM c WHERE round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) >= 0.2")
def interactions_to_target(t):
    return _curve(t).where("f1 >= 0.2").agg(F.min("step").alias("steps"))


@query("SELECT source AS use_case, lang AS priority, count(*) AS n, round(avg((n_chars > 500)::INT) * 100, 1) AS pct FROM documents GROUP BY GROUPING SETS ((source), (lang), ())")
def coverage_report(t):
    d = t.documents.withColumn("ok", (F.col("n_chars") > 500).cast("int"))
    return d.groupingSets([[F.col("source")], [F.col("lang")], []], "source", "lang").agg(F.count("*").alias("n"), F.round(F.avg("ok") * 100, 1).alias("pct")).select(F.col("source").alias("use_case"), F.col("lang").alias("priority"), "n", "pct")


@query("SELECT coalesce(round(avg((n_chars > 500)::INT) * 100, 1), 100) AS pct, coalesce(avg((n_chars > 500)::INT) * 100, 100) >= 80 AS passed FROM documents WHERE lang IN ('en', 'fr')")
def release_gate(t):
    d = t.documents.where(F.col("lang").isin("en", "fr")).agg(F.avg((F.col("n_chars") > 500).cast("int")).alias("share"))
    pct = F.coalesce(F.col("share") * 100, F.lit(100.0))
    return d.select(F.round(pct, 1).alias("pct"), (pct >= 80).alias("passed"))


@query("WITH old AS (SELECT md5(doc_id::VARCHAR) AS k FROM documents WHERE doc_id % 3 = 0), new AS (SELECT md5(doc_id::VARCHAR) AS k FROM documents WHERE doc_id % 2 = 0) SELECT coalesce(old.k, new.k) AS k, CASE WHEN new.k IS NULL THEN 'resolved' WHEN old.k IS NULL THEN 'open' ELSE 'reopened' END AS status FROM old FULL JOIN new ON old.k = new.k")
def gap_backlog_upsert(t):
    side = lambda m, name: t.documents.where(F.col("doc_id") % m == 0).select(F.md5(F.col("doc_id").cast("string")).alias("k"), F.lit(True).alias(name))
    status = F.when(F.col("new").isNull(), "resolved").when(F.col("old").isNull(), "open").otherwise("reopened")
    return side(3, "old").join(side(2, "new"), "k", "full_outer").select("k", status.alias("status"))


@query("SELECT role, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM chunks GROUP BY 1")
def visual_diagnostics(t):
    return t.chunks.groupBy("role").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query("SELECT source, avg((n_chars < 300)::INT) > 0.3 AND count(*) >= 20 AS warn FROM documents GROUP BY 1")
def orphan_risk_warning(t):
    return t.documents.groupBy("source").agg(((F.avg((F.col("n_chars") < 300).cast("int")) > 0.3) & (F.count("*") >= 20)).alias("warn"))


@query("SELECT entity, count(*) FILTER (WHERE status = 'applied')::BIGINT AS applied, count(*) FILTER (WHERE status = 'pending')::BIGINT AS pending, count(*) FILTER (WHERE status = 'failed')::BIGINT AS failed FROM revisions GROUP BY 1")
def revision_outcomes(t):
    c = lambda s: F.sum((F.col("status") == s).cast("int")).cast("long").alias(s)
    return t.revisions.groupBy("entity").agg(c("applied"), c("pending"), c("failed"))


@query("SELECT ontology_id, count(*) AS revisions, count(*) FILTER (WHERE status = 'pending')::BIGINT AS inbox, max(created) AS newest FROM revisions GROUP BY 1")
def revision_dashboard(t):
    return t.revisions.groupBy("ontology_id").agg(F.count("*").alias("revisions"), F.sum((F.col("status") == "pending").cast("int")).cast("long").alias("inbox"), F.max("created").alias("newest"))


@query("SELECT verdict, action, count(*) AS n FROM revisions GROUP BY 1, 2")
def verdict_batch_counts(t):
    return t.revisions.groupBy("verdict", "action").agg(F.count("*").alias("n"))


@query("SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def multi_domain_warning(t):
    return t.documents.groupBy("source").agg(F.countDistinct("lang").alias("n")).where("n > 1")


@query("SELECT uri, attr, arg_max(pass, weight * 10 - pass) AS kind FROM passes GROUP BY uri, attr")
def merge_properties(t):
    return t.passes.groupBy("uri", "attr").agg(F.max_by("pass", F.col("weight") * 10 - F.col("pass")).alias("kind"))
