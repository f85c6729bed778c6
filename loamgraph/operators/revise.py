"""Belief revision: verdicts on how new concepts touch existing ones."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import co_classifier_suffix
from . import versioned as V
from .core import cut

# fixed values: thresholds
AUTO_APPLY, SUBTYPE_FUZZY, REFINED_FUZZY, REDUNDANT_LABEL = 0.30, 0.50, 0.40, 0.55


def classify(score: Column, uri_exact: Column, label_exact: Column, label_fuzzy: Column, label: Column, contradicted: Column, linked: Column, polymorphic: Column, shared: Column, has_subclasses: Column) -> Column:
    """verdict and action of a touchpoint; the first rule that fits wins.

    Contradictions come first and are never applied by themselves; then links that are there already, equal concepts, labels
    with a companion suffix, the three kinds of gaps (applied from a score of AUTO_APPLY on), naming alone, and the rest.
    """
    out = lambda verdict, action: F.struct(F.lit(verdict).alias("verdict"), (action if isinstance(action, Column) else F.lit(action)).alias("action"))
    flag = "FLAG_FOR_CURATION"
    named = label_fuzzy > 0
    gap = out("GAP-FILLING", F.when(score >= AUTO_APPLY, "GAP_FILL").otherwise(flag))
    return (
        F.when(contradicted, out("CONTRADICTED", flag))
        .when(linked, out("REINFORCED", "REINFORCE"))
        .when(uri_exact >= 0.99, out("REDUNDANT", "REVISE"))
        .when((label_exact >= 0.99) & (score >= REDUNDANT_LABEL), out("REDUNDANT", "REVISE"))
        .when(co_classifier_suffix(label).isNotNull() & named, out("UNCERTAIN", flag))
        .when(((polymorphic >= 1) | (shared >= 2)) & named, gap)
        .when((label_fuzzy >= SUBTYPE_FUZZY) & has_subclasses, gap)
        .when(label_fuzzy >= REFINED_FUZZY, out("REFINED", flag))
        .otherwise(out("UNCERTAIN", flag))
    )


def published_action(action: Column, published: Column) -> Column:
    """Structural actions on published entities go to curation."""
    return F.when(action.isin("REVISE", "RETRACT", "GAP_FILL") & F.coalesce(published, F.lit(False)), "FLAG_FOR_CURATION").otherwise(action)


ACTIONS = ("REINFORCE", "REVISE", "GAP_FILL", "RETRACT", "FLAG_FOR_CURATION")


class Revised(NamedTuple):
    entities: DataFrame
    edges: DataFrame
    audit: DataFrame


def supersede(entities: DataFrame, edges: DataFrame, requests: DataFrame, log: DataFrame, now: float, key_step: int) -> Revised:
    """entities and edges after the requests, and an audit row for each request (nth, doc, entity, action, status, reason, old_version, new_version).

    entities: key, label, evidence (array), confidence, last_evidenced_at, version, created, expired.  edges: src, dst,
    created, expired.  requests: nth (their order), doc, entity, action, evidence (array), confidence_after, new_label, src, dst.
    log: doc, entity, action of earlier ones.

    A request with an earlier one of the same doc, entity and action, in the log or among the requests, is skipped.  REINFORCE
    appends evidence in place, in order, and takes the last confidence given; REVISE expires the live version and appends one
    with the new label and the next version number, to which live edges move; RETRACT expires; GAP_FILL adds an edge;
    FLAG_FOR_CURATION only leaves its audit row.  Of an entity's REVISE and RETRACT requests the first is applied.  A request
    fails without a live version, without its payload, or with an unknown action.
    """
    first = Window.partitionBy("doc", "entity", "action").orderBy("nth")
    known = log.select("doc", "entity", "action", F.lit(True).alias("_logged")).distinct()
    live = entities.where("expired IS NULL").select(F.col("key").alias("entity"), F.lit(True).alias("_live"))
    own = requests.withColumn("_again", F.row_number().over(first) > 1).join(known, ["doc", "entity", "action"], "left").join(live, "entity", "left")
    skipped = F.col("_again") | F.coalesce("_logged", F.lit(False))
    changes = F.col("action").isin("REVISE", "RETRACT")
    reason = (
        F.when(skipped, "repeated")
        .when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "unknown action")
        .when((F.col("action") == "GAP_FILL") & (F.col("src").isNull() | F.col("dst").isNull()), "no edge")
        .when(F.col("action").isin("REINFORCE", "REVISE", "RETRACT") & F.col("_live").isNull(), "no live version")
        .when((F.col("action") == "REVISE") & F.col("new_label").isNull(), "no payload")
    )
    own = own.withColumn("_reason", reason)
    order = Window.partitionBy("entity", F.when(changes & F.col("_reason").isNull(), 1).otherwise(0)).orderBy("nth")
    own = own.withColumn("_reason", F.when(F.col("_reason").isNull() & changes & (F.row_number().over(order) > 1), "no live version").otherwise(F.col("_reason")))
    own = cut(own.withColumn("status", F.when(F.col("_reason") == "repeated", "skipped").when(F.col("_reason").isNotNull(), "failed").otherwise("applied")).drop("_again", "_logged", "_live"))
    done = own.where("status = 'applied'")

    quotes = done.where("action = 'REINFORCE'").groupBy(F.col("entity").alias("key")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.coalesce("evidence", F.array().cast("array<string>")).alias("q")))), lambda x: x["q"])).alias("_more"),
        F.max_by("confidence_after", F.when(F.col("confidence_after").isNotNull(), F.col("nth"))).alias("_confidence"),
    )
    there = F.col("expired").isNull() & F.col("_more").isNotNull()
    evidence = F.concat(F.coalesce("evidence", F.array().cast("array<string>")), F.col("_more"))
    reinforced = entities.join(quotes, "key", "left").withColumns({
        "evidence": F.when(there, evidence).otherwise(F.col("evidence")),
        "confidence": F.when(there, F.coalesce("_confidence", "confidence")).otherwise(F.col("confidence")),
        "last_evidenced_at": F.when(there, F.lit(now)).otherwise(F.col("last_evidenced_at")),
    }).select(*entities.columns)
    revised = V.new_versions(reinforced, done.where("action = 'REVISE'").select(F.col("entity").alias("key"), F.col("new_label").alias("label")), now, key_step)
    after = V.expire(revised, done.where("action = 'RETRACT'").select(F.col("entity").alias("key")), now, 0).select(*entities.columns)

    moved = done.where("action = 'REVISE'").select(F.col("entity").alias("old"), (F.col("entity") + key_step).alias("new"))
    again = V.remap_edges(V.live(edges), moved).where("moved")
    ends = cut(moved.select("old")).withColumn("_m", F.lit(True))
    stale = edges.join(ends.withColumnRenamed("old", "src").withColumnRenamed("_m", "_a"), "src", "left").join(ends.withColumnRenamed("old", "dst").withColumnRenamed("_m", "_b"), "dst", "left")
    stale = stale.withColumn("expired", F.when(F.col("expired").isNull() & (F.col("_a").isNotNull() | F.col("_b").isNotNull()), F.lit(now)).otherwise(F.col("expired")))
    stamp = lambda df: df.select("src", "dst", F.lit(now).alias("created"), F.lit(None).cast("double").alias("expired"))
    out_edges = stale.select("src", "dst", "created", "expired").unionByName(stamp(again)).unionByName(stamp(done.where("action = 'GAP_FILL'")))

    applied = F.col("status") == "applied"
    old = F.when(applied & changes, F.col("entity"))
    new = F.when(applied & (F.col("action") == "REVISE"), F.col("entity") + key_step).when(applied & (F.col("action") == "REINFORCE"), F.col("entity"))
    return Revised(after, out_edges, own.select("nth", "doc", "entity", "action", "status", F.col("_reason").alias("reason"), old.alias("old_version"), new.alias("new_version")))
