"""Entity resolution and alignment: blocking, scoring, clustering, adjudication and repair.

Scored joins go through a prefix filter: of each label and each description only the rarest tokens block, as many as a pair
needs to have one in common if its similarity reaches the threshold, so nothing above it is lost and frequent tokens make
no pairs.  Pairs are unordered (a < b).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .components import connected_components
from .core import cut


def blocks(df: DataFrame, key: str = "key", label: str = "label") -> DataFrame:
    """token, key of every label; tokens of one or two letters don't block."""
    return df.select(F.col(key).alias("key"), F.explode(X.blocking_tokens(F.col(label))).alias("token")).where(F.length("token") > 2).distinct()


def candidate_pairs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """Distinct pairs a, b with a common token; within one table a < b."""
    b = (left if right is None else right).select(F.col("key").alias("b"), "token")
    pairs = left.select(F.col("key").alias("a"), "token").join(b, "token")
    return (pairs.where("a < b") if right is None else pairs).select("a", "b").distinct()


def with_sides(pairs: DataFrame, left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of both rows, with _a and _b after their names."""
    a = left.select(F.col("key").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = right.select(F.col("key").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairs.join(a, "a").join(b, "b")


def label_description_score(label_weight: float = 0.6, description_weight: float = 0.4) -> Column:
    return X.token_overlap(F.col("label_a"), F.col("label_b")) * label_weight + X.token_overlap(F.col("description_a"), F.col("description_b")) * description_weight


def rare_tokens(df: DataFrame, column: str, least: float, frequency: DataFrame) -> DataFrame:
    """key, token and size: of each row's n distinct tokens the rarest n - ceil(least n) + 1 (ties by token), and n.

    Two sets with a Jaccard similarity of at least `least` have one of these in common.
    """
    own = df.select("key", F.array_distinct(X.tokens(F.col(column))).alias("ws")).select("key", F.size("ws").alias("size"), F.explode("ws").alias("token"))
    ranked = own.join(frequency, "token").withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("n", "token")))
    return ranked.where(F.col("rank") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select("key", "token", "size")


def similar_candidates(left: DataFrame, right: DataFrame | None, column: str, least: float) -> DataFrame:
    """Distinct pairs a, b that may have token sets of `column` with a Jaccard similarity of at least `least` (> 0)."""
    words = lambda df: df.select("key", F.explode(F.array_distinct(X.tokens(F.col(column)))).alias("token"))
    every = words(left) if right is None else words(left).unionByName(words(right))
    frequency = every.groupBy("token").agg(F.count("*").alias("n"))
    a = rare_tokens(left, column, least, frequency)
    b = a if right is None else rare_tokens(right, column, least, frequency)
    pairs = a.select(F.col("key").alias("a"), "token", F.col("size").alias("m")).join(b.select(F.col("key").alias("b"), "token", F.col("size").alias("n")), "token")
    fits = F.least("m", "n") >= F.greatest("m", "n") * least - 1e-9
    return pairs.where(fits if right is not None else fits & (F.col("a") < F.col("b"))).select("a", "b").distinct()


def scored_join(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """a, b, score of pairs that score at least so much (0 < least <= 1) over labels and descriptions.

    The score is a weighted mean of two similarities, so one of them reaches the threshold in every pair that does.
    """
    if least <= 0:
        raise ValueError("the threshold must be positive")
    pairs = similar_candidates(left, right, "label", least).unionByName(similar_candidates(left, right, "description", least)).distinct()
    out = with_sides(pairs, left, left if right is None else right, ["label", "description"])
    return out.withColumn("score", label_description_score()).where(F.col("score") >= least).select("a", "b", "score")


def rescored(scores: DataFrame, changed: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """scores (a, b, score of all pairs within rows) after the keys of `changed` got new labels or descriptions, or left.

    Pairs that touch a changed key are dropped; only pairs of a changed key with another row are made anew; the others stay.
    """
    keys = changed.select("key").distinct()
    touched = lambda side: keys.select(F.col("key").alias(side))
    kept = scores.join(touched("a"), "a", "left_anti").join(touched("b"), "b", "left_anti").select("a", "b", "score")
    fresh = scored_join(rows.join(keys, "key", "left_semi"), rows, least).where("a <> b")
    return kept.unionByName(fresh.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").distinct())


def prf(predicted: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """One row: precision, recall, f1 (4 digits), tp, fp, fn of two tables as sets of their keys."""
    both = predicted.select(*keys).distinct().withColumn("p", F.lit(1)).join(reference.select(*keys).distinct().withColumn("r", F.lit(1)), keys, "full_outer")
    n = lambda cond: F.count(F.when(cond, 1))
    counts = both.agg(n(F.col("p").isNotNull() & F.col("r").isNotNull()).alias("tp"), n(F.col("r").isNull()).alias("fp"), n(F.col("p").isNull()).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    out = counts.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select(F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(f1, 4).alias("f1"), "tp", "fp", "fn")


# fixed values: the relation of a verdict; both directions of a subclass have one relation
RELATION = {"equivalent": "owl:equivalentClass", "subclass": "rdfs:subClassOf", "superclass": "rdfs:subClassOf", "related": "skos:related"}


def relation_of(verdict: Column, fallback: Column | str = "skos:related") -> Column:
    """Relation of a verdict, the fallback for others."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, relation in RELATION.items():
        out = out.when(verdict == name, relation)
    return out.otherwise(fallback)


def direction_of(verdict: Column) -> Column:
    """up: the left side is the subclass; down: the right side is; null for verdicts without a direction."""
    return F.when(verdict == "subclass", "up").when(verdict == "superclass", "down")


def clusters(pairs: DataFrame, least_size: int = 2) -> DataFrame:
    """cluster (smallest member), size and members of the components of pairs a, b."""
    out = connected_components(pairs, "a", "b").groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members"))
    return out.where(F.col("size") >= least_size)


def best_per(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def golden(df: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """Of each cluster the longest value, of equals that of the smallest key.  members: key, cluster."""
    order = Window.partitionBy("cluster").orderBy(F.length(column).desc(), "key")
    return members.join(df.select("key", column), "key").withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("cluster", F.col(column).alias("golden"))


def adjudicate(verdict: Column, anchor_score: Column, threshold: float = 0.6) -> Column:
    """grounded: a match with an anchor; hallucination: a match without; disagreement: an anchor that was not called a match; none."""
    match = verdict.isin("equivalent", "subclass", "superclass", "related")
    anchored = anchor_score >= threshold
    return F.when(match & anchored, "grounded").when(match & ~anchored, "hallucination").when(~match & anchored, "disagreement").otherwise("none")


def priority(kind: Column) -> Column:
    return F.when(kind == "disagreement", 2).when(kind == "hallucination", 1).otherwise(0)


def connecting_paths(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """x, y and nodes of one shortest path between each x and y: the smallest of equals by its nodes.  edges: a, b, undirected.

    All searches go on together, from both ends in turn, until the two frontiers of a pair meet; so a hub that lies between
    is entered, but not gone through.  Pairs without a path have no row.
    """
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next"))).distinct())
    ends = ends.where("x <> y")
    walk = {side: ends.select("x", "y", F.col(side).alias("node"), F.array(side).alias("nodes")) for side in ("x", "y")}
    known, out, side, other = {k: v.select("x", "y", "node") for k, v in walk.items()}, [], "x", "y"
    while True:
        way = F.concat("nodes", F.array("next")) if side == "x" else F.concat(F.array("next"), "nodes")
        step = walk[side].join(both, "node").select("x", "y", F.col("next").alias("node"), way.alias("nodes"))
        new = step.join(known[side], ["x", "y", "node"], "left_anti").groupBy("x", "y", "node").agg(F.min("nodes").alias("nodes"))
        new = cut(new.join(walk[other].withColumnRenamed("nodes", "rest"), ["x", "y", "node"], "left"))
        if not new.limit(1).count():
            return reduce(DataFrame.unionByName, out) if out else new.select("x", "y", "nodes")
        first, last = ("nodes", "rest") if side == "x" else ("rest", "nodes")
        ended = new.where("rest IS NOT NULL").groupBy("x", "y").agg(F.min(F.concat(first, F.slice(last, F.lit(2), F.size(last)))).alias("nodes"))
        out.append(ended)
        walk[side] = new.drop("rest").join(ended.select("x", "y"), ["x", "y"], "left_anti")
        walk[other] = walk[other].join(ended.select("x", "y"), ["x", "y"], "left_anti")
        known[side] = known[side].unionByName(new.select("x", "y", "node"))
        side, other = other, side


#: Conflicts of a component in a round times its edges, at most: what all their searches may reach together.
REACH = 5_000_000


def repair(correspondences: DataFrame, disjoint: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept correspondences (a, b, confidence), and removals (a, b, confidence, and the conflict x, y that each resolves).

    As long as a disjoint pair (x, y) shares a component, the edge of a shortest path between the two with the lowest
    confidence (null: 0), of equals the smallest (a, b), is removed.  A round takes the smallest conflicts of each component,
    one in the first round and twice as many in each further one, within REACH; of those whose paths share an edge the
    smallest goes first, and the others wait.  Paths without a common edge don't change each other, so it is as if one
    conflict after the other had been resolved.  Every round removes an edge, so the rounds end.
    """
    left, gone, most = cut(correspondences.select("a", "b", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))), None, 1
    pairs = cut(disjoint.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
    while True:
        comps = cut(connected_components(left, "a", "b"))
        x = pairs.join(comps.select(F.col("node").alias("x"), F.col("component").alias("cx")), "x")
        shared = cut(x.join(comps.select(F.col("node").alias("y"), F.col("component").alias("cy")), "y").where("cx = cy").select("x", "y", F.col("cx").alias("component")))
        if not shared.limit(1).count():
            break
        inside = cut(left.join(comps.select(F.col("node").alias("a"), "component"), "a").join(shared.select("component").distinct(), "component", "left_semi"))
        sizes = inside.groupBy("component").agg(F.greatest(F.lit(1), F.least(F.lit(most), F.floor(REACH / F.count("*")))).alias("turns"))
        first = shared.withColumn("nth", F.row_number().over(Window.partitionBy("component").orderBy("x", "y"))).join(sizes, "component").where("nth <= turns")
        found = connecting_paths(inside, cut(first.select("x", "y")))
        steps = found.select("x", "y", F.explode(F.transform(F.slice("nodes", F.lit(1), F.size("nodes") - 1), lambda n, i: F.struct(F.least(n, F.element_at("nodes", i + 2)).alias("u"), F.greatest(n, F.element_at("nodes", i + 2)).alias("v")))).alias("e"))
        edge = inside.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min(F.struct("confidence", "a", "b")).alias("edge"))
        used = cut(steps.select("x", "y", "e.u", "e.v").join(edge, ["u", "v"]))
        owner = used.groupBy("u", "v").agg(F.min(F.struct("x", "y")).alias("owner"))
        free = used.join(owner, ["u", "v"]).groupBy("x", "y").agg(F.min("edge").alias("e"), F.min((F.struct("x", "y") == F.col("owner")).cast("int")).alias("own")).where("own = 1")
        now = cut(free.select("e.a", "e.b", "e.confidence", "x", "y"))
        gone, most = now if gone is None else gone.unionByName(now), 2 * most
        left = cut(left.join(now.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "confidence"))
    return left, left.select("a", "b", "confidence", F.col("a").alias("x"), F.col("b").alias("y")).limit(0) if gone is None else gone


def coherence_report(correspondences: DataFrame, disjoint: DataFrame) -> DataFrame:
    """One row without changing anything: coherent (before repair), disjoint_axioms, removed_count and kept_count."""
    kept, gone = repair(correspondences, disjoint)
    axioms = disjoint.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    named = [df.select(F.lit(name).alias("what")) for name, df in (("axiom", axioms), ("removed", gone), ("kept", kept))]
    n = lambda name: F.count(F.when(F.col("what") == name, 1))
    return named[0].unionAll(named[1]).unionAll(named[2]).agg((n("removed") == 0).alias("coherent"), n("axiom").alias("disjoint_axioms"), n("removed").alias("removed_count"), n("kept").alias("kept_count"))


def _mutual(left: DataFrame) -> DataFrame:
    """Pairs that are the best of both their rows."""
    best_a = left.groupBy("a").agg(F.max(F.struct("score", (-F.col("b")).alias("k"))).alias("m")).select("a", (-F.col("m.k")).alias("b"))
    best_b = left.groupBy("b").agg(F.max(F.struct("score", (-F.col("a")).alias("k"))).alias("m")).select("b", (-F.col("m.k")).alias("a"))
    return left.join(best_a.join(best_b, ["a", "b"]), ["a", "b"])


def _along_chains(left: DataFrame) -> DataFrame:
    """Pairs that are the best of both their rows, and those that follow from them along chains.

    A pair with only one better pair in its rows is taken if and only if that one is not.  Such pairs point at their better
    one; pointers are doubled until they stand still, so a chain of n pairs is decided in log n steps.  What points at a pair
    with several better ones stays open.
    """
    top = lambda own, other: F.row_number().over(Window.partitionBy(own).orderBy(F.col("score").desc(), other))
    ranked = left.withColumn("ra", top("a", "b")).withColumn("rb", top("b", "a"))
    ranked = cut(ranked.select("a", "b", "score", "ra", "rb"))
    of_a, of_b = (ranked.where(f"{r} = 1").select(F.col(k).alias("row"), F.struct("a", "b").alias("better")) for r, k in (("ra", "a"), ("rb", "b")))
    one = ranked.where("ra + rb = 3").withColumn("row", F.when(F.col("ra") == 2, F.col("a")).otherwise(F.col("b")))
    after = one.where("ra = 2").join(of_a, "row").unionByName(one.where("rb = 2").join(of_b, "row"))
    pair = F.struct("a", "b").alias("pair")
    ends = ranked.where("ra + rb <> 3").select(pair, F.struct("a", "b").alias("to"), F.lit(0).alias("odd"), F.when(F.col("ra") + F.col("rb") == 2, True).alias("taken"))
    known = cut(after.select(pair, F.col("better").alias("to"), F.lit(1).alias("odd"), F.lit(None).cast("boolean").alias("taken")).unionByName(ends))
    while True:
        on = known.select(F.col("pair").alias("to"), F.col("to").alias("next"), F.col("odd").alias("more"))
        moved = known.join(on, "to").select("pair", F.col("next").alias("to"), F.when(F.col("next") == F.col("to"), F.col("odd")).otherwise((F.col("odd") + F.col("more")) % 2).alias("odd"), "taken", (F.col("next") != F.col("to")).alias("moved"))
        moved = cut(moved)
        known = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    last = known.where("pair = to AND taken").select("to")
    return known.join(last, "to").where("odd = 0").select("pair.a", "pair.b").join(left, ["a", "b"])


#: Rounds of best pairs only, before chains are followed.
PLAIN_ROUNDS = 3


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs (a, b, score): the best pair of both its rows is taken, its rows leave, and so on.

    A pair is taken in a round if it is the best of a and the best of b (ties by smaller a, then b), which is what the greedy
    order over all pairs takes too; of repeated pairs the best score counts.  Where that goes on for more than a few rounds, every round also takes what follows along
    chains of rising scores, so a chain ends after as many steps as its length has bits.
    """
    left, out, rounds = cut(pairs.groupBy("a", "b").agg(F.max("score").alias("score"))), None, 0
    while left.limit(1).count():
        taken = cut(_mutual(left) if rounds < PLAIN_ROUNDS else _along_chains(left))
        rounds += 1
        out = taken if out is None else out.unionByName(taken)
        left = cut(left.join(taken.select("a"), "a", "left_anti").join(taken.select("b"), "b", "left_anti"))
    return pairs.select("a", "b", "score").limit(0) if out is None else out.select("a", "b", "score")
