"""Inverted-file index of vectors for cosine search, stored as Parquet.

Vectors are scaled to length one and assigned to the nearest of `lists` centroids, which k-means finds on a bounded sample.
The folder holds `centroids` (list, centroid, radius: the farthest member's distance, n) and `rows` (list, id, unit vector),
partitioned by ranges of lists and sorted by list within, so a search reads only the partitions and row groups of the lists
it probes.  A member x of a list with centroid c and radius r scores q.c + r at most with a unit query q: that bound makes an
exact search of the few lists whose bound reaches the kth score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import dot
from .core import cut, hinted

#: Lists at most, so that centroids stay a small table; beyond 1.2 million vectors lists grow longer instead.
MAX_LISTS = 16_384
#: Vectors of the sample for each list, about.
PER_LIST = 64
#: Folders of the index at most.
PARTS = 512
#: Rows of a group of lists, and queries of a block, that an exact search scores at once, about.
GROUP, BLOCK = 50_000, 16_384
ROUNDS = 25


def n_lists(n: int) -> int:
    """15 times the root of the number of vectors, as many as there are at most."""
    return max(1, min(int(15 * math.sqrt(n)), n, MAX_LISTS))


def n_probes(lists: int) -> int:
    return max(1, int(math.sqrt(lists)))


def unit(vector: Column) -> Column:
    """The vector as doubles of length one; null for null, empty and zero vectors and for null or non-finite components."""
    own = vector.cast("array<double>")
    size = F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + x * x))
    return F.when((size > 0) & (size < float("inf")), F.transform(own, lambda x: x / size))


def centroids_of(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, centroids and radii of the lists, MAX_LISTS at most."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return np.array([r.list for r in rows], np.int64), np.array([r.centroid for r in rows]), np.array([r.radius for r in rows])


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, seed: int = 11) -> None:
    """Writes the index of vectors to the folder path, over what is there.

    Null ids, vectors without a direction (see `unit`) and those of another length than most have no place in it; repeated
    rows have one each.  An empty table gives an empty index.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    own = cut(own)
    most = own.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    n = most[0][1] if most else 0
    own = own.where(F.size("vector") == (most[0][0] if most else 0))
    k = min(lists or n_lists(n), MAX_LISTS, max(n, 1))
    if n:
        share = min(1.0, PER_LIST * k / n)
        sample = own.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
        model = KMeans(k=k, maxIter=ROUNDS, seed=seed, initMode="random").fit(cut(sample.select(array_to_vector("vector").alias("features"))))
        heads = np.array(model.clusterCenters())
        heads = heads[np.lexsort(heads.T[::-1])]
    else:
        heads = np.zeros((0, 0))
    per_part = max(1, -(-max(len(heads), 1) // PARTS))

    def assign(batches):
        square = (heads**2).sum(axis=1)[None, :]
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near, far = np.zeros(len(flat), np.int64), np.zeros(len(flat))
            for at in range(0, len(flat), 1024):
                some = flat[at : at + 1024]
                near[at : at + 1024] = (square - 2 * some @ heads.T).argmin(axis=1)
                far[at : at + 1024] = np.sqrt(((some - heads[near[at : at + 1024]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(near), pa.array(far), pa.array((near // per_part).astype(np.int32))], ["id", "vector", "list", "far", "part"])

    kind = own.schema["id"].dataType.simpleString()
    placed = cut(own.mapInArrow(assign, f"id {kind}, vector array<double>, list long, far double, part int"))
    sizes = placed.groupBy("list").agg((F.max("far") * (1 + 1e-9)).alias("radius"), F.count("*").alias("n"))
    known = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(heads)], "list long, centroid array<double>")
    known.join(sizes, "list").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    # a list that holds many rows is cut by hash, so no task gets it whole
    heavy = hinted(cut(placed.groupBy("part").agg(F.ceil(F.count("*") / 500_000).alias("files"))))
    dealt = placed.join(heavy, "part").withColumn("file", F.pmod(F.xxhash64("id"), "files")).repartition("part", "file")
    dealt.sortWithinPartitions("part", "list", "id").select("part", "list", "id", "vector").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")


def probed(queries: DataFrame, heads: tuple[np.ndarray, np.ndarray, np.ndarray], probes: int) -> DataFrame:
    """query_id, query, list, turn (from 0) and bound of every list, where turn < probes are the nearest lists.  queries: query_id, query (unit)."""
    number, centres, radius = heads
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            query = batch.column("query").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            near = query @ centres.T
            order = np.argsort(-near, axis=1, kind="stable")
            turn = np.empty_like(order)
            np.put_along_axis(turn, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
            for i in range(len(query)):
                m = len(number)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(pa.array(np.full(m, i))), batch.column("query").take(pa.array(np.full(m, i))), pa.array(number), pa.array(turn[i].astype(np.int32)), pa.array(near[i] + radius + 1e-9)],
                    ["query_id", "query", "list", "turn", "bound"],
                )

    fitting = queries.where(F.size("query") == (centres.shape[1] if len(number) else -1))
    return fitting.mapInArrow(run, f"query_id {kind}, query array<double>, list long, turn int, bound double")


def _scored(spark: SparkSession, path: str, visits: DataFrame, lists: int, k: int, other: bool) -> DataFrame:
    """query_id, id, cosine of the k best rows of each query within its lists.  visits: query_id, query, list."""
    if not lists:
        return visits.limit(0).select("query_id", F.col("query_id").alias("id"), F.lit(0.0).alias("cosine"), F.lit(1).alias("rank"))
    rows = spark.read.parquet(f"{path}/rows")
    wanted = [r[0] for r in visits.select("list").distinct().collect()]  # MAX_LISTS numbers at most
    if len(wanted) < lists:
        per_part = max(1, -(-lists // PARTS))
        rows = rows.where(F.col("part").isin(sorted({x // per_part for x in wanted})) & F.col("list").isin(wanted))
    met = rows.join(hinted(visits), "list")
    met = met.where("id <> query_id") if other else met
    best = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return met.select("query_id", "id", dot(F.col("vector"), F.col("query")).alias("cosine")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _groups(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """First group and number of groups of each list, by its rows: consecutive lists share a group, a list of more than GROUP rows has several."""
    size = max(1, min(GROUP, -(-int(n.sum()) // 64)))  # small indexes have 64 groups, too, for as many tasks
    parts = np.maximum(1, -(-n // GROUP))
    first, at, held = np.zeros(len(n), np.int64), -1, size
    for i, (rows, m) in enumerate(zip(n.tolist(), parts.tolist())):
        if held >= size or m > 1:
            at, held = at + 1, 0
        first[i], held = at, held + rows
        if m > 1:
            at, held = at + m - 1, size
    return first, parts, at + 1


def _dealt(heads, first: np.ndarray, parts: np.ndarray, probes: int | None):
    """The function of batches (query_id, query, floor) that gives a row for each group with a list to visit; lists: those of the probes, or null for all whose bound reaches the floor."""
    _, centres, radius = heads

    def run(batches):
        for batch in batches:
            query = batch.column("query").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            floor = batch.column("floor").to_numpy(zero_copy_only=False)
            for at in range(0, len(query), 256):
                some = query[at : at + 256]
                near = some @ centres.T
                if probes:
                    m = min(probes, near.shape[1])
                    pairs = np.argpartition(-near, m - 1, axis=1)[:, :m]
                    who, lists = np.repeat(np.arange(len(some)), m), pairs.ravel()
                else:
                    who, lists = np.nonzero(near + radius + 1e-9 >= floor[at : at + 256, None])
                m = parts[lists]
                turn = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                who, groups, lists = np.repeat(who, m), np.repeat(first[lists], m) + turn, np.repeat(lists, m)
                order = np.lexsort((lists, groups, who))
                who, groups, lists = who[order], groups[order], lists[order]
                starts = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(groups, prepend=-1) != 0))
                rows = pa.array(at + who[starts])
                named = pa.ListArray.from_arrays(pa.array(np.append(starts, len(lists)), pa.int32()), pa.array(lists.astype(np.int32))) if probes else pa.nulls(len(starts), pa.list_(pa.int32()))
                for a in range(0, len(starts), 10_000):
                    z = slice(a, a + 10_000)
                    own = rows[z]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(own) for c in ("query_id", "query", "floor", "block")), pa.array(groups[starts[z]].astype(np.int32)), named[z]], ["query_id", "query", "floor", "block", "group", "lists"])

    return run


def _best_of(heads, k: int, other: bool):
    """The function of a group's rows and a block's queries that gives each query's k best rows among the lists it visits there."""
    number, centres, radius = heads

    def best(found):
        table = pa.concat_tables(found).sort_by([("who", "ascending"), ("cosine", "descending"), ("id", "ascending")])
        who = table.column("who").to_numpy()
        starts = np.flatnonzero(np.diff(who, prepend=-1))
        rank = np.arange(len(who)) - np.repeat(starts, np.diff(np.append(starts, len(who))))
        return table.filter(pa.array(rank < k))

    def run(rows, queries):
        matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False)
        rows = rows.sort_by("list")
        at, ids, asked = rows.column("list").to_numpy(), rows.column("id"), queries.column("query_id")
        width = centres.shape[1]
        vectors, query = matrix(rows.column("vector")).reshape(-1, width), matrix(queries.column("query")).reshape(-1, width)
        floor = queries.column("floor").to_numpy()
        visits = queries.column("lists").combine_chunks()
        by = {}
        if len(query) and not visits.null_count:
            who, lists = np.repeat(np.arange(len(query)), np.diff(visits.offsets.to_numpy())), visits.flatten().to_numpy()
            order = np.argsort(lists, kind="stable")
            who, lists = who[order], lists[order]
            cuts = np.flatnonzero(np.diff(lists, prepend=-1))
            by = {lists[a]: who[a:z] for a, z in zip(cuts, np.append(cuts[1:], len(lists)))}
        found, n = [], 0
        starts = np.flatnonzero(np.diff(at, prepend=-1)) if len(query) else []
        for a, z in zip(starts, [*starts[1:], len(at)]):
            i = int(np.searchsorted(number, at[a]))
            active = by.get(i, ()) if by else np.flatnonzero(query @ centres[i] + radius[i] + 1e-9 >= floor)
            step = max(1, 2_000_000 // (z - a))
            for b in range(0, len(active), step):
                some = active[b : b + step]
                w, r = np.nonzero(query[some] @ vectors[a:z].T >= floor[some, None] - 1e-9)
                w, r = some[w], r + a
                # the same sum for equal vectors, wherever they are
                cosine = np.concatenate([np.zeros(0), *((vectors[r[x : x + 50_000]] * query[w[x : x + 50_000]]).sum(axis=1) for x in range(0, len(w), 50_000))])
                own = pa.table({"who": w, "query_id": asked.take(pa.array(w)), "id": ids.take(pa.array(r)), "cosine": cosine})
                found, n = [*found, own.filter(pc.not_equal(own.column("id"), own.column("query_id"))) if other else own], n + len(w)
                if n > 2_000_000:
                    found = [best(found)]
                    n = found[0].num_rows
        none = pa.table({"query_id": asked[:0], "id": ids[:0], "cosine": np.zeros(0)})
        return best(found).select(["query_id", "id", "cosine"]) if found else none

    return run


def _visited(spark: SparkSession, path: str, heads, queries: DataFrame, k: int, other: bool, probes: int | None) -> DataFrame:
    """query_id, id, cosine and rank of the k best rows of each query: in its nearest lists, or in all whose bound reaches its floor.

    queries: query_id, query (unit), floor.  Groups of lists meet blocks of queries, so a task holds GROUP rows and BLOCK
    queries; a query goes to the groups that have a list for it.
    """
    own = queries.where(F.size("query") == heads[1].shape[1])
    n = {r.list: r.n for r in spark.read.parquet(f"{path}/centroids").select("list", "n").collect()}  # MAX_LISTS rows at most
    first, parts, _ = _groups(np.array([n[x] for x in heads[0].tolist()], np.int64))
    blocks = max(1, -(-own.count() // BLOCK))
    a, b = (queries.schema[c].dataType.simpleString() for c in ("query_id", "query"))
    asked = own.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).mapInArrow(_dealt(heads, first, parts, probes), f"query_id {a}, query {b}, floor double, block int, group int, lists array<int>")
    where = spark.createDataFrame([(int(x), int(f), int(p)) for x, f, p in zip(heads[0], first, parts)], "list long, first long, parts long")
    rows = spark.read.parquet(f"{path}/rows").join(F.broadcast(where), "list").withColumn("group", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int"))
    rows = rows.select("group", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "list", "id", "vector")
    met = rows.groupBy("group", "block").cogroup(asked.groupBy("group", "block")).applyInArrow(_best_of(heads, k, other), f"query_id {a}, id {rows.schema['id'].dataType.simpleString()}, cosine double")
    best = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, id_col: str = "query_id", vector_col: str = "vector", other: bool = False) -> DataFrame:
    """query_id, rank (from 1), id and cosine of each query's k best vectors in its `probes` nearest lists; ties go to smaller ids.

    exact: lists whose bound reaches the kth cosine of that first look are read, too, so nothing better is missed.  other:
    rows with the query's own id don't count.  Queries without a direction or of another length give no rows; a query id
    counts once.
    """
    heads = centroids_of(spark, path)
    lists = int(heads[0].max()) + 1 if len(heads[0]) else 0
    own = queries.select(F.col(id_col).alias("query_id"), unit(F.col(vector_col)).alias("query")).where("query_id IS NOT NULL AND query IS NOT NULL").dropDuplicates(["query_id"])
    if exact and lists:
        own = cut(own)
        look = _visited(spark, path, heads, own.withColumn("floor", F.lit(-2.0)), k, other, probes or n_probes(lists))
        floor = cut(look.where(F.col("rank") == k).select("query_id", F.col("cosine").alias("floor")))
        known = own.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        return _visited(spark, path, heads, known.select("query_id", "query", "floor"), k, other, None).select("query_id", "rank", "id", "cosine")
    near = cut(probed(own, heads, probes or n_probes(lists)).where(F.col("turn") < (probes or n_probes(lists))))
    first = _scored(spark, path, near.where(F.col("turn") < (probes or n_probes(lists))).select("query_id", "query", "list"), lists, k, other)
    return first.select("query_id", "rank", "id", "cosine")
