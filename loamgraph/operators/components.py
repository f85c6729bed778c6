"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import cut

#: Edges with whole-number ends that one task takes at once (16 bytes each); more go through distributed rounds.
ONE_TASK = 1_000_000


def _unite(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each one's component, for nodes 0..n-1 and edges a, b, by hooking and pointer jumping."""
    n = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if np.array_equal(new, root):
            return root
        root = new


def _in_one_task(e: DataFrame) -> DataFrame:
    def run(batches):
        pairs = [(np.asarray(x.column("u")), np.asarray(x.column("v"))) for x in batches]
        if pairs:
            u, v = (np.concatenate(x) for x in zip(*pairs))
            nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = _unite(back[: len(u)], back[len(u) :])
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])

    return e.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component (smallest node reachable) for every node of an edge; self loops and nulls are ignored.

    Up to ONE_TASK edges, by count, go to one task.  Else each round ends in a checkpoint; the number of rounds grows with
    the logarithm of the longest path.  A hub's edges are reduced by partial aggregates and skew joins, so no task holds a
    whole component.
    """
    e = edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct()
    e, before = cut(e), None
    if {f.dataType.simpleString() for f in e.schema.fields} <= {"int", "bigint"} and not e.offset(ONE_TASK).limit(1).count():
        return _in_one_task(e.select(F.col("u").cast("long"), F.col("v").cast("long")))
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
