"""Exact top-k search by inner product with dual cover trees.

Vectors are assigned to the nearest of at most PIVOTS pivots, which are the top level of a cover tree; each pivot's vectors
make blocks of about BLOCK, each with a cover tree of its own, and so do the queries.  With centres c and p and covering
radii R and r, no query of one node scores more than c.p + R|p| + r|c| + Rr with a vector of the other; if that is below
the worst kth score of the node's queries, the pair of nodes is pruned.  Every block of queries first meets one block of the
pivot with the highest bound, which gives its kth scores; then only pivots whose bound reaches them are visited.  Within two
blocks the trees are walked together, nodes with high bounds first, and what is left is scored by matrix products.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hinted

BLOCK = 4096
QUERY_BLOCK = 512
#: Points of a leaf, of vectors and of queries: leaves of queries are small, since a wide one prunes nothing.
LEAF, QUERY_LEAF = 32, 4
#: Pivots of each vector length at most; they are a bounded sample, while all vectors are assigned and searched.
PIVOTS = 256
#: Blocks of queries that come with one copy of a block of vectors.
STRIPE = 64
#: Below this the products of whole numbers are exact in floating point.
EXACT = float(1 << 53)
#: The kth score of a query with fewer than k rows so far.
NONE = np.iinfo(np.int64).min


def _sizes(points: np.ndarray) -> np.ndarray:
    return np.sqrt((points**2).sum(axis=1))


class CoverTree:
    """Points in tree order; node i holds the points first[i]..last[i]-1, its children are kids[i]..kids_end[i]-1 (none: a leaf).

    The children of a node at scale s are its centre and a maximal set of points with distances over s / 2, each with the
    points nearest to it in order of choice; radius[i] is the largest distance from the node's centre.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order, first, last, kids, kids_end, centre, radius = [], [0], [len(ids)], [0], [0], [], []
        points = vectors.astype(np.float64)
        members = {0: np.arange(len(ids))}
        middle = points.mean(axis=0) if len(ids) else np.zeros(vectors.shape[1])
        centre.append(int(np.argmin(((points - middle) ** 2).sum(axis=1))) if len(ids) else 0)
        queue = [0]
        placed = np.zeros(len(ids), np.int64)
        for i in queue:
            own = members.pop(i)
            far = _sizes(points[own] - points[centre[i]]) if len(own) else np.zeros(0)
            radius.append(float(far.max(initial=0.0)))
            at = first[i]
            placed[at : at + len(own)] = own
            if len(own) <= leaf or radius[i] == 0:
                continue
            scale = radius[i] / 2
            kids[i] = len(first)
            rest, near, head, held = own, far, centre[i], points[own]
            while len(rest):
                take = near <= scale
                first.append(at)
                last.append(at := at + int(take.sum()))
                kids.append(0)
                kids_end.append(0)
                centre.append(int(head))
                members[len(first) - 1] = rest[take]
                queue.append(len(first) - 1)
                rest, held = rest[~take], held[~take]
                if len(rest):
                    head = rest[0]
                    near = _sizes(held - points[head])
            kids_end[i] = len(first)
        self.ids, self.vectors, self.points = ids[placed], vectors[placed], points[placed]
        self.first, self.last, self.kids, self.kids_end = (np.array(x, np.int64) for x in (first, last, kids, kids_end))
        self.centre, self.radius = points[centre] if len(ids) else points, np.array(radius) * (1 + 1e-12)
        self.norm = _sizes(self.centre)

    def packed(self) -> bytes:
        """Without the floating-point copies, and numbers in as few bytes as they need."""
        state = self.__dict__ | {"points": None, "centre": None, "norm": None}
        state["vectors"] = self.vectors.astype(np.min_scalar_type(-int(np.abs(self.vectors).max(initial=1)) - 1))
        state["centre"] = self.centre.astype(state["vectors"].dtype)
        return pickle.dumps(state)

    @staticmethod
    def unpacked(raw: bytes) -> CoverTree:
        out = CoverTree.__new__(CoverTree)
        out.__dict__ = pickle.loads(raw)
        out.vectors, out.points, out.centre = out.vectors.astype(np.int64), out.vectors.astype(np.float64), out.centre.astype(np.float64)
        out.norm = _sizes(out.centre)
        return out


def reach(centre: np.ndarray, radius: float, norm: float, centres: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores between one ball and several; rounding never lowers them."""
    whole = (norm + radius) * (norms + radii)
    return centres @ centre + radius * norms + radii * norm + radius * radii + 1e-9 * whole + 1e-6


def search(queries: CoverTree, data: CoverTree, k: int, floor: np.ndarray | None = None, seen: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (in tree order) its best points of the data (in tree order) and their scores; ties go to smaller ids.

    floor: whole-number scores below which a query needs nothing (NONE: none); seen: gets the numbers of node pairs that were pruned and scored.
    """
    n, nq = len(data.ids), len(queries.ids)
    if not n or not nq:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * nq
    exact = float(np.abs(queries.points).max(initial=0)) * float(np.abs(data.points).max(initial=0)) * data.points.shape[1] < EXACT
    left, right = (queries.points, data.points) if exact else (queries.vectors, data.vectors)
    none = -np.inf if exact else NONE
    place = np.empty(n, np.int64)
    place[np.argsort(data.ids, kind="stable")] = np.arange(n)
    best = np.full((nq, k), none, left.dtype)  # scores, falling
    who = np.full((nq, k), n, np.int64)  # places of their ids; n: none
    least = np.full(nq, none, left.dtype) if floor is None else np.where(floor == NONE, none, floor).astype(left.dtype)

    def kth(a: int, b: int) -> np.ndarray:
        return np.maximum(best[a:b, -1], least[a:b])

    def score(a: int, b: int, points: np.ndarray) -> None:
        got = left[a:b] @ right[points].T
        same = queries.ids[a:b, None] == data.ids[points][None, :]
        ok = (got >= kth(a, b)[:, None]) & ~same
        for r in np.flatnonzero(ok.any(axis=1)).tolist():
            good = np.flatnonzero(ok[r])
            s = np.concatenate([best[a + r], got[r, good]])
            w = np.concatenate([who[a + r], place[points[good]]])
            top = np.lexsort((w, -s if exact else ~s))[:k]
            best[a + r], who[a + r] = s[top], w[top]

    def bound(q: int, nodes: np.ndarray) -> np.ndarray:
        return reach(queries.centre[q], queries.radius[q], queries.norm[q], data.centre[nodes], data.radius[nodes], data.norm[nodes])

    seen = [0, 0] if seen is None else seen
    stack = [(0, np.array([0]))]
    while stack:
        q, nodes = stack.pop()
        a, b = int(queries.first[q]), int(queries.last[q])
        top = bound(q, nodes)
        worst = float(kth(a, b).min())
        seen[0] += int((top < worst).sum())
        nodes = nodes[top >= worst][np.argsort(-top[top >= worst], kind="stable")]
        if not len(nodes):
            continue
        inner = data.kids_end[nodes] > data.kids[nodes]
        if queries.kids_end[q] > queries.kids[q] and (not inner.any() or queries.radius[q] >= data.radius[nodes].max()):
            stack += [(int(c), nodes) for c in range(int(queries.kids[q]), int(queries.kids_end[q]))]
            continue
        leaves = nodes[~inner]
        if len(leaves):  # some at a time, so that the first ones prune the others
            score(a, b, np.concatenate([np.arange(data.first[x], data.last[x]) for x in leaves[:16]]))
            tail = leaves[16:]
            some = bound(q, tail) >= float(kth(a, b).min())
            seen[0] += int((~some).sum())
            tail = tail[some]
            for at in range(0, len(tail), 1024):
                score(a, b, np.concatenate([np.arange(data.first[x], data.last[x]) for x in tail[at : at + 1024]]))
            seen[1] += min(16, len(leaves)) + len(tail)
        if inner.any():
            stack.append((q, np.concatenate([np.arange(data.kids[x], data.kids_end[x]) for x in nodes[inner]])))
    back = np.argsort(data.ids, kind="stable")
    return [(back[who[i][who[i] < n]], best[i][who[i] < n].astype(np.int64)) for i in range(nq)]


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def valid(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd


def pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length one different vector for about BLOCK vectors, up to PIVOTS: the smallest hash of each bucket of hashes."""
    few = hinted(cut(vectors.groupBy("n_dims").agg(F.least(F.lit(PIVOTS), F.ceil(F.count("*") / BLOCK)).alias("wanted"))))
    hashed = vectors.select("n_dims", "vector", F.xxhash64("vector").alias("h"))
    least = hashed.join(few, "n_dims").groupBy("n_dims", F.pmod("h", "wanted").alias("bucket")).agg(F.min("h").alias("h"))
    chosen = hashed.join(hinted(cut(least.select("n_dims", "h"))), ["n_dims", "h"]).groupBy("n_dims", "h").agg(F.first("vector").alias("vector"))
    out: dict[int, list] = {}
    for d, _, vector in sorted(chosen.collect()):
        out.setdefault(d, []).append(vector)
    return {d: np.array(x, np.float64) for d, x in out.items()}


def assigned(vectors: DataFrame, heads: dict[int, np.ndarray]) -> DataFrame:
    """vectors (vec_id, vector, n_dims, is_query) with the number of the nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            n_dims = np.asarray(batch.column("n_dims"))
            pivot, far = np.zeros(len(n_dims), np.int32), np.zeros(len(n_dims))
            for d in np.unique(n_dims).tolist():
                at = np.flatnonzero(n_dims == d)
                own = batch.column("vector").take(pa.array(at)).flatten().to_numpy().reshape(-1, d).astype(np.float64)
                square = (heads[d] ** 2).sum(axis=1)[None, :] - 2 * own @ heads[d].T
                pivot[at] = square.argmin(axis=1)
                far[at] = _sizes(own - heads[d][pivot[at]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(far)], [*batch.schema.names, "pivot", "far"])

    return vectors.mapInArrow(run, "vec_id long, vector array<long>, n_dims int, is_query boolean, pivot int, far double")


def trees(vectors: DataFrame, size: int, leaf: int = LEAF) -> DataFrame:
    """vectors (vec_id, vector, n_dims, pivot, far) as cover trees of about `size` each: n_dims, pivot, part, tree."""
    counts = vectors.groupBy("n_dims", "pivot").agg(F.ceil(F.count("*") / size).alias("parts"))
    dealt = vectors.join(hinted(cut(counts)), ["n_dims", "pivot"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), "parts"))

    def build(key, table):
        flat = table.column("vector").combine_chunks().flatten().to_numpy()
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        tree = CoverTree(ids[order], flat.reshape(len(ids), -1)[order], leaf)
        return pa.table({"n_dims": pa.array([key[0].as_py()], pa.int32()), "pivot": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([key[2].as_py()], pa.int64()), "tree": pa.array([tree.packed()], pa.binary())})

    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = dealt.select("n_dims", "pivot", "part", "vec_id", "vector").repartition(tasks, "n_dims", "pivot", "part")  # a stated number, which isn't coalesced
    return apart.groupBy("n_dims", "pivot", "part").applyInArrow(build, "n_dims int, pivot int, part long, tree binary")


_VISIT = pa.schema([("n_dims", pa.int32()), ("asked_pivot", pa.int32()), ("asked_part", pa.int64()), ("pivot", pa.int32()), ("part", pa.int64()), ("floor", pa.binary())])
_KEYS = "n_dims int, asked_pivot int, asked_part long, pivot int, part long, floor binary"


def _walk(k: int):
    """Rows sorted by stripe: a block of vectors (tree), then the blocks of queries (asked, floor) that meet it.

    A row for each block of queries: its keys, what was found, and the queries' kth scores as the new floor.
    """

    def run(batches):
        data = None
        for batch in batches:
            trees_, asked, floors = batch.column("tree"), batch.column("asked"), batch.column("floor")
            for i in range(batch.num_rows):
                if trees_[i].is_valid:
                    data = CoverTree.unpacked(trees_[i].as_py())
                    continue
                q = CoverTree.unpacked(asked[i].as_py())
                found = search(q, data, k, np.frombuffer(floors[i].as_py(), np.int64) if floors[i].is_valid else None)
                size = [len(w) for w, _ in found]
                hits = pa.StructArray.from_arrays([pa.array(np.repeat(q.ids, size)), pa.array(data.ids[np.concatenate([w for w, _ in found])]), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "vec_id", "score"])
                floor = np.array([s[k - 1] if len(s) >= k else NONE for _, s in found], np.int64)
                keys = [batch.column(c).slice(i, 1) for c in _VISIT.names[:-1]]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([floor.tobytes()]), pa.ListArray.from_arrays([0, len(hits)], hits)], [*_VISIT.names, "hits"])

    return run


def met(data: DataFrame, asked: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """The keys of visits, hits (query_id, vec_id, score: the k best of each query in the block) and the kth scores as floor.

    visits: n_dims, asked_pivot, asked_part, pivot, part, floor.  A task holds one block of vectors and one of queries at a
    time.  A block of vectors comes once for every STRIPE blocks of queries or so, so no task gets all queries.
    """
    keys = ["n_dims", "pivot", "part"]
    striped = visits.withColumn("stripe", F.xxhash64(*keys, F.floor(F.xxhash64("asked_pivot", "asked_part") / F.lit(1 << 62)), F.floor(F.col("asked_part") / STRIPE)))
    queries = striped.join(asked.select("n_dims", F.col("pivot").alias("asked_pivot"), F.col("part").alias("asked_part"), F.col("tree").alias("asked")), ["n_dims", "asked_pivot", "asked_part"])
    blocks = striped.select(*keys, "stripe").distinct().join(data, keys)
    rows = queries.withColumn("turn", F.lit(1)).unionByName(blocks.withColumn("turn", F.lit(0)), allowMissingColumns=True)
    tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(tasks, "stripe").sortWithinPartitions("stripe", "turn")
    return ordered.select(*_VISIT.names, "tree", "asked").mapInArrow(_walk(k), f"{_KEYS}, hits array<struct<query_id: long, vec_id: long, score: long>>")


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k highest inner products of each query with every row but its own.

    Ties go to smaller ids; fewer rows give fewer results.  Null ids and vectors that are null, empty or hold null or
    non-finite components take no part; vectors of different lengths don't meet; repeated rows are candidates each, and a
    repeated query counts once.  Of an id that comes with several vectors each is a query, and the best k of all count.
    Scores are exact as long as a long holds all inner products; beyond that they wrap modulo 2**64, and which rows are
    found is not defined.
    """
    rows = embeddings.where(F.col(id_col).isNotNull() & valid(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = cut(rows.withColumn("n_dims", F.size("vector")).select("vec_id", "vector", "n_dims", "is_query"))
    heads = pivots(rows)
    near = cut(assigned(rows, heads))
    data = cut(trees(near, BLOCK))
    asked = cut(trees(near.where("is_query").dropDuplicates(["vec_id", "vector"]), QUERY_BLOCK, QUERY_LEAF))
    norms = {d: _sizes(x) for d, x in heads.items()}
    balls, parts = ({d: np.zeros(len(x)) for d, x in heads.items()} for _ in range(2))
    for d, p, far in near.groupBy("n_dims", "pivot").agg(F.max("far")).collect():  # covering radii, at most PIVOTS a length
        balls[d][p] = far * (1 + 1e-9)
    for d, p, n in data.groupBy("n_dims", "pivot").agg(F.count("*")).collect():
        parts[d][p] = n

    def bounds(q: CoverTree, d: int) -> np.ndarray:
        return np.where(parts[d] > 0, reach(q.centre[0], q.radius[0], q.norm[0], heads[d], balls[d], norms[d]), -np.inf)

    def opening(batches):
        for batch in batches:
            for d, p, part, raw in zip(*(batch.column(c).to_pylist() for c in ("n_dims", "pivot", "part", "tree"))):
                at = int(np.argmax(bounds(CoverTree.unpacked(raw), d)))
                yield pa.RecordBatch.from_pylist([{"n_dims": d, "asked_pivot": p, "asked_part": part, "pivot": at, "part": part % int(parts[d][at]), "floor": None}], _VISIT)

    def further(batches):
        for batch in batches:
            for raw, floor, d, p, part, at0, b0 in zip(*(batch.column(c).to_pylist() for c in ("asked", "floor", "n_dims", "asked_pivot", "asked_part", "pivot", "part"))):
                worst = float(np.frombuffer(floor, np.int64).min())
                for at in np.flatnonzero(bounds(CoverTree.unpacked(raw), d) >= worst).tolist():
                    some = [{"n_dims": d, "asked_pivot": p, "asked_part": part, "pivot": at, "part": b, "floor": floor} for b in range(int(parts[d][at])) if (at, b) != (at0, b0)]
                    yield pa.RecordBatch.from_pylist(some, _VISIT)

    first = cut(met(data, asked, asked.mapInArrow(opening, _KEYS), k))
    again = first.drop("hits").join(asked.select("n_dims", F.col("pivot").alias("asked_pivot"), F.col("part").alias("asked_part"), F.col("tree").alias("asked")), ["n_dims", "asked_pivot", "asked_part"])
    second = met(data, asked, cut(again.mapInArrow(further, _KEYS)), k)
    found = first.select("hits").unionByName(second.select("hits")).select(F.explode("hits").alias("hit")).select("hit.*")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
