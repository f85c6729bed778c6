"""Components that are kept up as pairs come and go.

A removed pair can only split the component it was in, so the components of removed pairs are made anew from their remaining
pairs.  An added pair can only join components, so components are joined by their numbers alone.  All other components, and
the pairs inside them, are left as they are; the joins that pick out what is touched are against a few rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stored
from .components import connected_components
from .core import cut, hinted, new_folder

class Update(NamedTuple):
    pairs: DataFrame  # u < v, and u = v with loops
    components: DataFrame  # node, component (its smallest node)
    changed: DataFrame  # node, before, after (null: the node has no pairs)


def as_pairs(rows: DataFrame, a: str = "a", b: str = "b", loops: bool = False) -> DataFrame:
    """Distinct u < v; nulls are left out, and without loops pairs of equal ends, too."""
    fit = F.col(a).isNotNull() & F.col(b).isNotNull() if loops else F.col(a) != F.col(b)
    return rows.where(fit).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()


def _components(pairs: DataFrame, loops: bool) -> DataFrame:
    """node, component of pairs (u, v); with loops, also of nodes that are only in a pair with themselves."""
    own = connected_components(pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    if not loops:
        return own
    own = cut(own)
    alone = pairs.where("u = v").select(F.col("u").alias("node")).join(own, "node", "left_anti")
    return own.unionByName(alone.select("node", F.col("node").alias("component")))


def update(pairs: DataFrame, components: DataFrame, added: DataFrame, removed: DataFrame, loops: bool = False) -> Update:
    """The state after added and removed pairs (a, b); of a pair that is in both it stays or comes.

    pairs (u, v) and components (node, component) are a state that `connected_components` or an update gave.  Removing what
    is not there and adding what is there change nothing.  The component of a node is the smallest node it is joined with, as
    for a new computation; nodes without pairs leave.  With loops, a pair of equal ends keeps its node, alone if it has no other.
    """
    come = cut(as_pairs(added, loops=loops))
    gone = cut(as_pairs(removed, loops=loops).join(come, ["u", "v"], "left_anti").join(pairs, ["u", "v"], "left_semi"))
    new = cut(come.join(pairs, ["u", "v"], "left_anti"))
    kept = pairs.join(hinted(gone), ["u", "v"], "left_anti")

    # components that lost a pair, made anew from their remaining pairs
    touched = cut(_ends(gone).join(components, "node").select("component").distinct())
    members = cut(components.join(hinted(touched), "component", "left_semi").select("node", F.col("component").alias("before")))
    inner = kept.join(hinted(members.select(F.col("node").alias("u"))), "u", "left_semi")
    again = cut(_components(inner, loops))
    # of the nodes that lost all pairs those that get a new one go on alone
    lone = members.join(again, "node", "left_anti").join(_ends(new), "node", "left_semi").select("node", F.col("node").alias("component"))
    redone = cut(again.unionByName(lone))

    # components that new pairs join, by their numbers
    near = cut(_ends(new))
    old = components.join(hinted(near), "node", "left_semi").join(hinted(members), "node", "left_anti").unionByName(redone.join(near, "node", "left_semi"))
    number = cut(near.join(old, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    at = lambda end: number.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    joins = new.join(hinted(at("u")), "u").join(hinted(at("v")), "v").where("cu <> cv").select(F.col("cu").alias("src"), F.col("cv").alias("dst"))
    merged = cut(connected_components(joins).withColumnRenamed("node", "old").withColumnRenamed("component", "merged"))

    # what changes: members of touched components, of joined ones, and new nodes
    moved = components.join(hinted(merged.where("old <> merged").select("old")), F.col("component") == F.col("old"), "left_semi")
    affected = members.unionByName(moved.select("node", F.col("component").alias("before"))).distinct()
    affected = affected.unionByName(near.join(components, "node", "left_anti").select("node", F.lit(None).cast(components.schema["component"].dataType).alias("before")))
    own = affected.join(hinted(redone.withColumnRenamed("component", "again")), "node", "left").join(members.select("node", F.lit(True).alias("split")), "node", "left")
    fresh = F.when(F.col("split"), F.col("again")).otherwise(F.coalesce("before", "node"))
    own = own.select("node", "before", fresh.alias("old")).join(hinted(merged), "old", "left").select("node", "before", F.coalesce("merged", "old").alias("after"))
    changed = cut(own.where("NOT before <=> after"))
    rest = components.join(hinted(changed.select("node")), "node", "left_anti")
    return Update(kept.unionByName(new), rest.unionByName(changed.where("after IS NOT NULL").select("node", F.col("after").alias("component"))), changed)


def cluster_changes(changed: DataFrame, components: DataFrame, least_size: int = 2) -> tuple[DataFrame, DataFrame]:
    """Clusters that a change leaves or makes: the numbers of those that went or have other members now, and the new ones (cluster, size, members).

    components: after the update.  Only the components that changed nodes were or are in are gathered.
    """
    stale = changed.select(F.explode(F.array("before", "after")).alias("cluster")).where("cluster IS NOT NULL").distinct()
    stale = cut(stale)
    own = components.join(hinted(stale), F.col("component") == F.col("cluster"), "left_semi")
    made = own.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")).where(F.col("size") >= least_size)
    return stale, made


class Components:
    """Pairs and components in a folder, by hashes of nodes; an update writes the parts with a change, all others stay.  loops: see `update`."""

    def __init__(self, spark: SparkSession, path: str, loops: bool = False):
        self.spark, self.path, self.loops = spark, path, loops

    @property
    def pairs(self) -> DataFrame:
        return stored.read(self.spark, f"{self.path}/pairs")

    @property
    def components(self) -> DataFrame:
        return stored.read(self.spark, f"{self.path}/components")

    def create(self, pairs: DataFrame) -> None:
        own = cut(as_pairs(pairs, loops=self.loops))
        stored.write(own, f"{self.path}/pairs", "u")
        stored.write(_components(own, self.loops), f"{self.path}/components", "node")

    def apply(self, added: DataFrame, removed: DataFrame) -> DataFrame:
        """Takes the change into the folder; the changed nodes as `update` gives them.  Applying a change twice changes nothing more."""
        now = update(self.pairs, self.components, added, removed, self.loops)
        nodes, ends = stored.parts_of(now.changed, "node"), stored.parts_of(as_pairs(added, loops=self.loops).unionByName(as_pairs(removed, loops=self.loops)), "u")
        if nodes:
            stored.write(now.components, f"{self.path}/components", "node", nodes)
        if ends:
            stored.write(now.pairs, f"{self.path}/pairs", "u", ends)
        return now.changed


def kept_up(pairs: DataFrame, loops: bool = False) -> Components:
    """A new store beside the checkpoints."""
    own = Components(pairs.sparkSession, new_folder(pairs.sparkSession, "components"), loops)
    own.create(pairs)
    return own
