"""Quality, calibration and agreement metrics.

Each is one grouped pass over all ontologies at once, rather than a set of queries for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import running


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(a / F.when(b != 0, b), F.lit(0.0))


def class_metrics(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per ontology: live classes, distinct uris, mean confidence, described share and edge count."""
    own = classes.where("expired IS NULL").groupBy("ontology_id").agg(
        F.count("*").alias("n_classes"), F.countDistinct("uri").alias("n_uris"), F.avg("confidence").alias("avg_confidence"), F.avg((F.length("description") > 20).cast("int")).alias("described")
    )
    counts = edges.where("expired IS NULL").groupBy("ontology_id").agg(F.count("*").alias("n_edges"))
    return own.join(counts, "ontology_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0).cast("long")))


def coverage(df: DataFrame, keys: list[str], has: Column) -> DataFrame:
    """Rows, rows with evidence and their share per group, with a total where keys are null."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), F.sum(has.cast("int")).cast("long").alias("with_evidence")).withColumn("share", ratio(F.col("with_evidence"), F.col("n")))


def acceptance(decisions: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda a: F.sum((F.col("action") == a).cast("int")).cast("long")
    return decisions.groupBy(*keys).agg(n("approve").alias("accepted"), n("reject").alias("rejected"), n("edit").alias("edited")).withColumn("rate", ratio(F.col("accepted"), F.col("accepted") + F.col("rejected") + F.col("edited")))


def calibration(decisions: DataFrame, buckets: int = 10) -> DataFrame:
    """bucket, n, mean confidence and acceptance rate of equal-width buckets; 1 falls into the last."""
    bucket = F.when(F.col("confidence") >= 1, buckets - 1).otherwise(F.floor(F.col("confidence") * buckets)).cast("int")
    return decisions.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg((F.col("action") == "approve").cast("int")).alias("accepted"))


def calibration_error(histogram: DataFrame) -> DataFrame:
    return histogram.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accepted"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def marginals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of every combination and all marginals; level tells which keys are summed over."""
    return df.cube(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def duplicates(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups with several live rows, with their rank by (created, key); rank 1 is kept."""
    w = Window.partitionBy(*keys)
    own = edges.where("expired IS NULL").withColumn("copies", F.count("*").over(w)).where("copies > 1")
    return own.withColumn("rank", F.row_number().over(w.orderBy("created", "key")))


def label_groups(classes: DataFrame, key: Column, least: int = 2) -> DataFrame:
    """Groups of one key with rows of several sources: members in order."""
    own = classes.groupBy(key.alias("k")).agg(F.countDistinct("ontology_id").alias("n_sources"), F.array_sort(F.collect_list("key")).alias("members"))
    return own.where(F.col("n_sources") >= least)


def synonym_triangles(subclass: DataFrame, equivalent: DataFrame) -> DataFrame:
    """a < b and b = c, but no a < c: a, b, c."""
    both = equivalent.select("a", "b").unionByName(equivalent.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    found = subclass.select(F.col("src").alias("x"), F.col("dst").alias("y")).join(both.select(F.col("a").alias("y"), F.col("b").alias("z")), "y").where("x <> z")
    known = subclass.select(F.col("src").alias("x"), F.col("dst").alias("z")).distinct()
    return found.join(known, ["x", "z"], "left_anti").select("x", "y", "z").distinct()


def cardinality_violations(bounds: DataFrame, counts: DataFrame) -> DataFrame:
    """on_class, n and the broken bound; the strictest of several bounds holds, no rows count as 0."""
    own = bounds.groupBy("on_class").agg(F.max("min_count").alias("least"), F.min("max_count").alias("most"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    out = own.join(counts, "on_class", "left").withColumn("n", n)
    return out.withColumn("broken", F.when(F.col("n") < F.col("least"), "min").when(F.col("n") > F.col("most"), "max")).where("broken IS NOT NULL")


def agreement(passes: DataFrame, least: int, total: int) -> DataFrame:
    """Items that at least so many passes have, with their share of all passes."""
    own = passes.groupBy("uri").agg(F.countDistinct("pass").alias("n_passes"))
    return own.where(F.col("n_passes") >= least).withColumn("ratio", F.col("n_passes") / total)


def pairwise_jaccard(passes: DataFrame, item: str = "attr") -> DataFrame:
    """Mean Jaccard over the pairs of an item's passes; 1 for a single pass."""
    sets = passes.groupBy("uri", "pass").agg(F.collect_set(item).alias("s"))
    a, b = sets.select("uri", F.col("pass").alias("p"), F.col("s").alias("a")), sets.select("uri", F.col("pass").alias("q"), F.col("s").alias("b"))
    pairs = a.join(b, "uri").where("p < q").select("uri", (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("j"))
    return sets.select("uri").distinct().join(pairs.groupBy("uri").agg(F.avg("j").alias("score")), "uri", "left").select("uri", F.coalesce("score", F.lit(1.0)).alias("score"))


def set_scores(predicted: DataFrame, gold: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of distinct rows, in all or per group; empty against empty is 0."""
    by = by or []
    p = predicted.select(*by, *keys).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*by, *keys).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, [*by, *keys], "full_outer")
    count = lambda a, b: F.coalesce(F.sum(F.when(a & b, 1)), F.lit(0)).cast("long")
    in_p, in_g = F.col("_p").isNotNull(), F.col("_g").isNotNull()
    own = (both.groupBy(*by) if by else both).agg(count(in_p, in_g).alias("tp"), count(in_p, ~in_g).alias("fp"), count(~in_p, in_g).alias("fn"))
    return with_prf(own)


def with_prf(df: DataFrame) -> DataFrame:
    out = df.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def interaction_curve(candidates: DataFrame, gold: DataFrame, band: float) -> DataFrame:
    """Precision, recall and f1 after each answer: candidates of the band are taken at once, the others by falling confidence.

    The order is global; it is made by ranges of confidence.
    """
    n_gold = gold.select("item").distinct().count()
    marked = candidates.select("item", "confidence").join(gold.select("item").distinct().withColumn("_g", F.lit(1)), "item", "left")
    base = marked.where(F.col("confidence") >= band).agg(F.count("*").alias("n"), F.coalesce(F.sum("_g"), F.lit(0)).alias("tp")).head()
    run = running(marked.where(F.col("confidence") < band), [F.col("confidence").desc(), F.col("item")], {"hits": "_g"})
    tp = F.col("hits") + base["tp"]
    out = run.select(F.col("step").cast("int").alias("step"), "item", tp.alias("tp"), F.lit(base["n"] - base["tp"]).alias("fp"), (F.lit(n_gold) - tp).alias("fn"))
    return with_prf(out)


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals the one that is seen first."""
    own = df.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.col("votes").desc(), "_first")
    return own.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_first")
