"""Entity resolution and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..operators import resolve as R
from ..operators.core import hinted
from .registry import query

R6 = lambda c: F.round(c, 6)
_T = "list_filter(list_distinct(string_split(lower(trim({0})), ' ')), lambda w: w <> '')"
_J = "(len(list_intersect({0}, {1}))::DOUBLE / greatest(1, len(list_distinct(list_concat({0}, {1})))))"
_E = f"e AS (SELECT key, ontology_id, label, description, kind, confidence, {_T.format('label')} AS lt, {_T.format('description')} AS dt FROM entities)"
_SCORE = "round(0.6 * " + _J.format("x.lt", "y.lt") + " + 0.4 * " + _J.format("x.dt", "y.dt") + ", 6)"


@query(f"WITH {_E} SELECT DISTINCT x.key AS a, y.key AS b FROM e x JOIN e y ON x.key < y.key AND len(list_intersect(x.lt, y.lt)) > 0")
def er_blocking(t):
    return R.candidate_pairs(R.blocks(t.entities))


@query(f"WITH {_E} SELECT x.key AS a, y.key AS b, {_SCORE} AS score FROM e x JOIN e y ON x.key < y.key WHERE {_SCORE} >= 0.7")
def er_pair_scores(t):
    return R.scored_join(t.entities, None, 0.6999999).withColumn("score", R6("score")).where("score >= 0.7")


_CC = "b AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p), r(u, v) AS (SELECT u, u FROM b UNION SELECT r.u, b.v FROM r JOIN b ON b.u = r.v)"
_PAIRS = f"p AS (SELECT x.key AS a, y.key AS b FROM e x JOIN e y ON x.key < y.key WHERE {_SCORE} >= 0.7)"


@query(f"WITH RECURSIVE {_E}, {_PAIRS}, {_CC}, c AS (SELECT u AS node, min(v) AS component FROM r GROUP BY u) SELECT component AS cluster, count(*) AS size, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM c GROUP BY 1")
def er_pipeline(t):
    pairs = R.scored_join(t.entities, None, 0.6999999).where("round(score, 6) >= 0.7")
    return R.clusters(pairs).select("cluster", "size", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"WITH RECURSIVE {_E}, {_PAIRS}, {_CC}, c AS (SELECT u AS node, min(v) AS component FROM r GROUP BY u) SELECT component AS cluster, count(*) AS size FROM c GROUP BY 1 ORDER BY 2 DESC")
def er_clusters_by_size(t):
    pairs = R.scored_join(t.entities, None, 0.6999999).where("round(score, 6) >= 0.7")
    return R.clusters(pairs).select("cluster", "size").orderBy(F.col("size").desc(), "cluster")


@query(f"WITH RECURSIVE {_E}, {_PAIRS}, {_CC}, c AS (SELECT u AS key, min(v) AS cluster FROM r GROUP BY u) SELECT cluster, arg_max(description, length(description) * 100000 - key) AS golden FROM c JOIN e USING (key) GROUP BY 1")
def er_golden_records(t):
    pairs = R.scored_join(t.entities, None, 0.6999999).where("round(score, 6) >= 0.7")
    members = R.connected_components(pairs, "a", "b").select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    return R.golden(t.entities, members, "description")


@query(f"WITH {_E} SELECT x.key AS a, y.key AS b, round(0.4 * {_J.format('x.lt', 'y.lt')} + 0.3 * {_J.format('x.dt', 'y.dt')} + 0.2 * (x.kind = y.kind)::INT, 6) AS score FROM e x JOIN e y ON x.key < y.key AND len(list_intersect(x.lt, y.lt)) > 0")
def er_explain(t):
    pairs = R.candidate_pairs(t.entities.select("key", F.explode(X.tokens(F.col("label"))).alias("token")))
    both = R.with_sides(pairs, t.entities, t.entities, ["label", "description", "kind"])
    w = S.ER_WEIGHTS
    score = X.token_overlap(F.col("label_a"), F.col("label_b")) * w["label"] + X.token_overlap(F.col("description_a"), F.col("description_b")) * w["description"] + F.when(F.col("kind_a") == F.col("kind_b"), 1).otherwise(0) * w["uri"]
    return both.select("a", "b", R6(score).alias("score"))


@query(f"WITH {_E} SELECT x.key AS a, y.key AS b, {_SCORE} AS score FROM e x JOIN e y ON x.ontology_id = 0 AND y.ontology_id = 1 WHERE {_SCORE} >= 0.5")
def cross_tier_candidates(t):
    left, right = t.entities.where("ontology_id = 0"), t.entities.where("ontology_id = 1")
    return R.scored_join(left, right, 0.4999999).withColumn("score", R6("score")).where("score >= 0.5")


@query(f"WITH {_E} SELECT x.key AS a, y.key AS b, CASE WHEN {_SCORE} >= 0.9 THEN 'equivalent' ELSE 'related' END AS kind FROM e x JOIN e y ON x.ontology_id < y.ontology_id WHERE {_SCORE} >= 0.5")
def n_source_candidates(t):
    return _alignment(t).select("a", "b", F.when(F.col("score") >= 0.9, "equivalent").otherwise("related").alias("kind"))


def _alignment(t):
    own = R.scored_join(t.entities, None, 0.4999999).withColumn("score", R6("score")).where("score >= 0.5")
    oid = t.entities.select("key", "ontology_id")
    both = own.join(oid.select(F.col("key").alias("a"), F.col("ontology_id").alias("oa")), "a").join(oid.select(F.col("key").alias("b"), F.col("ontology_id").alias("ob")), "b").where("oa <> ob")
    first = F.col("oa") < F.col("ob")
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), "score")


@query(f"WITH {_E}, s AS (SELECT x.key AS a, y.key AS b, {_SCORE} AS score FROM e x JOIN e y ON x.ontology_id = 0 AND y.ontology_id = 2 WHERE {_SCORE} >= 0.3), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INTEGER AS rank FROM s) SELECT * FROM r WHERE rank <= 3")
def touchpoints_top_k(t):
    left, right = t.entities.where("ontology_id = 0"), t.entities.where("ontology_id = 2")
    own = R.scored_join(left, right, 0.2999999).withColumn("score", R6("score")).where("score >= 0.3")
    return R.best_per(own, "a", 3, F.col("score").desc(), F.col("b"))


@query(f"WITH {_E} SELECT x.key AS a, y.key AS b FROM e x JOIN e y ON x.ontology_id = 1 AND y.ontology_id = 2 WHERE {_SCORE} >= 0.85")
def extracted_vs_existing(t):
    own = R.scored_join(t.entities.where("ontology_id = 1"), t.entities.where("ontology_id = 2"), 0.8499999)
    return own.where("round(score, 6) >= 0.85").select("a", "b")


@query(f"WITH {_E} SELECT CASE WHEN x.confidence >= y.confidence THEN x.key ELSE y.key END AS keep, CASE WHEN x.confidence >= y.confidence THEN y.key ELSE x.key END AS dropped FROM e x JOIN e y ON x.key < y.key AND x.kind = y.kind WHERE {_SCORE} >= 0.6")
def same_type_duplicates(t):
    own = R.scored_join(t.entities, None, 0.5999999).where("round(score, 6) >= 0.6")
    both = R.with_sides(own.select("a", "b"), t.entities, t.entities, ["kind", "confidence"]).where("kind_a <=> kind_b")
    first = F.col("confidence_a") >= F.col("confidence_b")
    return both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("dropped"))


@query("WITH n AS (SELECT src AS k, list_distinct(list(dst)) AS p FROM imports_edges GROUP BY 1), c AS (SELECT dst AS k, list_distinct(list(src)) AS c FROM imports_edges GROUP BY 1), a AS (SELECT n_nationkey::BIGINT AS k, coalesce(n.p, []) AS p, coalesce(c.c, []) AS c FROM nation LEFT JOIN n ON n.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey) SELECT x.k AS a, y.k AS b, round(0.30 * " + _J.format("x.p", "y.p") + " + 0.15 * " + _J.format("x.c", "y.c") + ", 6) AS score FROM a x JOIN a y ON x.k < y.k")
def topological_similarity(t):
    p = t.imports_edges.groupBy(F.col("src").alias("k")).agg(F.collect_set("dst").alias("p"))
    c = t.imports_edges.groupBy(F.col("dst").alias("k")).agg(F.collect_set("src").alias("c"))
    none = F.array().cast("array<bigint>")
    a = t.nation.select(F.col("n_nationkey").cast("long").alias("k")).join(p, "k", "left").join(c, "k", "left").select("k", F.coalesce("p", none).alias("p"), F.coalesce("c", none).alias("c"))
    x, y = a.select(F.col("k").alias("a"), F.col("p").alias("pa"), F.col("c").alias("ca")), a.select(F.col("k").alias("b"), F.col("p").alias("pb"), F.col("c").alias("cb"))
    pairs = x.join(hinted(y), F.col("a") < F.col("b"))
    score = S.topology_similarity(F.lit(0.0), X.jaccard(F.col("pa"), F.col("pb")), X.jaccard(F.col("ca"), F.col("cb")), F.lit(0.0))
    return pairs.select("a", "b", R6(score).alias("score"))


@query(f"WITH {_E}, s AS (SELECT x.key AS a, y.key AS b, {_SCORE} AS score FROM e x JOIN e y ON x.ontology_id < y.ontology_id WHERE {_SCORE} >= 0.5) SELECT a, b, CASE WHEN (a + b) % 2 = 0 AND score >= 0.6 THEN 'grounded' WHEN (a + b) % 2 = 0 THEN 'hallucination' WHEN score >= 0.6 THEN 'disagreement' ELSE 'none' END AS outcome FROM s")
def adjudication(t):
    verdict = F.when((F.col("a") + F.col("b")) % 2 == 0, "equivalent").otherwise("unrelated")
    return _alignment(t).select("a", "b", R.adjudicate(verdict, F.col("score")).alias("outcome"))


@query("SELECT key, CASE key % 5 WHEN 0 THEN 'owl:equivalentClass' WHEN 1 THEN 'rdfs:subClassOf' WHEN 2 THEN 'rdfs:subClassOf' ELSE 'skos:related' END AS kind, CASE key % 5 WHEN 1 THEN 'up' WHEN 2 THEN 'down' END AS direction FROM classes")
def verdict_to_type(t):
    verdict = F.element_at(F.array(*map(F.lit, ("equivalent", "subclass", "superclass", "related", "unheard of"))), (F.col("key") % 5 + 1).cast("int"))
    return t.classes.select("key", R.relation_of(verdict).alias("kind"), R.direction_of(verdict).alias("direction"))


def _disjoint(t):
    """The first and the last entity of each label that several ontologies have."""
    return t.entities.groupBy("label").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("x", "y")


@query()
def coherence_repair(t):
    own = _alignment(t).select("a", "b", F.col("score").alias("confidence"))
    return R.repair(own.where("confidence >= 0.8"), _disjoint(t))[0]


@query()
def coherence_removals(t):
    """The edges that a repair takes out, and the conflict that each resolves."""
    own = _alignment(t).select("a", "b", F.col("score").alias("confidence"))
    return R.repair(own.where("confidence >= 0.8"), _disjoint(t))[1]


@query()
def coherence_dry_run(t):
    own = _alignment(t).select("a", "b", F.col("score").alias("confidence"))
    return R.coherence_report(own.where("confidence >= 0.8"), _disjoint(t))


@query()
def greedy_one_to_one(t):
    return R.greedy_match(R.scored_join(t.entities.where("ontology_id = 0"), t.entities.where("ontology_id = 1"), 0.5))


_RAW = "0.6 * " + _J.format("x.lt", "y.lt") + " + 0.4 * " + _J.format("x.dt", "y.dt")


@query(f"""WITH RECURSIVE {_E}, p AS (SELECT x.key AS a, y.key AS b, round({_RAW}, 6) AS s FROM e x JOIN e y ON x.ontology_id = 0 AND y.ontology_id = 1), o AS (SELECT *, row_number() OVER (ORDER BY s DESC, a, b) AS rn FROM p WHERE s >= 0.5),
w(rn, ua, ub, a, b) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT UNION ALL SELECT o.rn, CASE WHEN fits THEN list_append(ua, o.a) ELSE ua END, CASE WHEN fits THEN list_append(ub, o.b) ELSE ub END, CASE WHEN fits THEN o.a END, CASE WHEN fits THEN o.b END
  FROM (SELECT o.*, w.ua, w.ub, NOT list_contains(w.ua, o.a) AND NOT list_contains(w.ub, o.b) AS fits FROM w JOIN o ON o.rn = w.rn + 1) o) SELECT a, b FROM w WHERE a IS NOT NULL""")
def greedy_pairs(t):
    """The one-to-one pairs that the greedy order over all scored pairs takes."""
    own = R.scored_join(t.entities.where("ontology_id = 0"), t.entities.where("ontology_id = 1"), 0.4999999).withColumn("score", R6("score")).where("score >= 0.5")
    return R.greedy_match(own).select("a", "b")


@query(f"WITH RECURSIVE {_E}, p AS (SELECT x.key AS a, y.key AS b FROM e x JOIN e y ON x.ontology_id < y.ontology_id WHERE {_SCORE} >= 0.92), {_CC}, c AS (SELECT u AS key, min(v) AS component FROM r GROUP BY u) SELECT component, min(label) AS label, count(*) AS n FROM c JOIN e USING (key) GROUP BY 1")
def master_materialise(t):
    """One class for each component of accepted correspondences, with its smallest label."""
    comps = R.connected_components(_alignment(t).where("score >= 0.92"), "a", "b")
    return comps.join(t.entities.select(F.col("key").alias("node"), "label"), "node").groupBy("component").agg(F.min("label").alias("label"), F.count("*").alias("n"))


@query(f"WITH {_E}, n AS (SELECT * REPLACE (CASE WHEN key % 10 = 0 THEN list_distinct(list_append(lt, 'gear')) ELSE lt END AS lt) FROM e), s AS (SELECT x.key AS a, y.key AS b, {_SCORE} AS score FROM n x JOIN n y ON x.key < y.key WHERE {_SCORE} >= 0.7) SELECT a, b, score FROM s")
def alignment_refresh(t):
    """The labels of every tenth key have changed: only pairs with such a key are made anew."""
    changed = F.col("key") % 10 == 0
    rows = t.entities.withColumn("label", F.when(changed, F.concat("label", F.lit(" gear"))).otherwise(F.col("label")))
    before = R.scored_join(t.entities, None, 0.6999999)
    return R.rescored(before, rows.where(changed).select("key"), rows, 0.6999999).withColumn("score", R6("score")).where("score >= 0.7")


@query(f"WITH {_E} SELECT x.ontology_id AS left_id, y.ontology_id AS right_id, count(*) AS n FROM e x JOIN e y ON x.ontology_id < y.ontology_id WHERE {_SCORE} >= 0.5 GROUP BY 1, 2")
def alignment_session(t):
    oid = t.entities.select("key", "ontology_id")
    own = _alignment(t).join(oid.select(F.col("key").alias("a"), F.col("ontology_id").alias("left_id")), "a").join(oid.select(F.col("key").alias("b"), F.col("ontology_id").alias("right_id")), "b")
    return own.groupBy("left_id", "right_id").agg(F.count("*").alias("n"))


@query(f"WITH {_E}, p AS (SELECT x.key AS a, y.key AS b FROM e x JOIN e y ON x.ontology_id < y.ontology_id WHERE {_SCORE} >= 0.6), g AS (SELECT x.key AS a, y.key AS b FROM e x JOIN e y ON x.ontology_id < y.ontology_id AND x.label = y.label), c AS (SELECT (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM p JOIN g USING (a, b)) AS tp), m AS (SELECT *, CASE WHEN np > 0 THEN tp::DOUBLE / np ELSE 0 END AS p, CASE WHEN ng > 0 THEN tp::DOUBLE / ng ELSE 0 END AS r FROM c) SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, tp, np - tp AS fp, ng - tp AS fn FROM m")
def alignment_prf(t):
    gold = t.entities.select("label", F.col("key").alias("a"), F.col("ontology_id").alias("oa")).join(t.entities.select("label", F.col("key").alias("b"), F.col("ontology_id").alias("ob")), "label").where("oa < ob").select("a", "b")
    return R.prf(_alignment(t).where("score >= 0.6"), gold, ["a", "b"])


@query(f"WITH {_E}, s AS (SELECT x.key AS a, y.key AS b, {_SCORE} AS score FROM e x JOIN e y ON x.key < y.key WHERE {_SCORE} >= 0.6) SELECT a, b, score FROM s ORDER BY score DESC, a, b LIMIT 20 OFFSET 10")
def er_candidate_page(t):
    own = R.scored_join(t.entities, None, 0.5999999).withColumn("score", R6("score")).where("score >= 0.6")
    return own.orderBy(F.col("score").desc(), "a", "b").offset(10).limit(20)


@query("SELECT key, decision FROM (SELECT entity AS key, status AS decision, row_number() OVER (PARTITION BY entity ORDER BY created DESC, key DESC) AS rn FROM revisions WHERE status <> 'pending') WHERE rn = 1")
def decision_log_fold(t):
    """The last decision on each entity; accepting or rejecting twice changes nothing."""
    return R.best_per(t.revisions.where("status <> 'pending'"), "entity", 1, F.col("created").desc(), F.col("key").desc()).select(F.col("entity").alias("key"), F.col("status").alias("decision"))
