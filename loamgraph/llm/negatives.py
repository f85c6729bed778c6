"""Hard negatives by product quantisation with stored residual norms.

A vector x is stored as one centroid of each pair of dimensions and the norm r of what they leave.  For an anchor a a table
gives the product with every centroid, so the sum of looked-up products is the score within |a| r.  An anchor's windows are
ranges of scores with their k best rows: the first window has all rows of its label, and gives the positives, the further ones
a range below each positive and rows of other labels.  A row is scored exactly, in whole numbers, only if its bounds reach
into the range of one of the anchor's windows, above the worst of k rows found there; all others are ruled out by the bounds.

The centroids are fitted on a bounded sample; all rows are encoded and searched.  Anchors stay in a task as blocks, and
blocks of rows pass by, so a window keeps its k best over many blocks.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hinted
from .topk import valid, whole_numbers

#: Rows of each vector length that the centroids are fitted on, at most.
SAMPLE = 4096
CENTROIDS = 256
#: Rows of a block: as many as keep all tasks busy, within these bounds.  Anchors of a block at most, and of a table of products.
LEAST, MOST, ANCHORS, CHUNK = 1024, 32_768, 16_384, 256
#: Blocks that pass by one copy of a block of anchors, at most.
STRIPE = 64
EXACT = 1 << 53
NONE = np.iinfo(np.int64).min


def fit(points: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Centroids of each pair of dimensions (pairs x CENTROIDS x 2), by Lloyd's rounds from distinct points."""
    points = np.pad(points.astype(np.float64), ((0, 0), (0, points.shape[1] % 2)))
    book = np.zeros((points.shape[1] // 2, CENTROIDS, 2))
    for m in range(len(book)):
        own = points[:, 2 * m : 2 * m + 2]
        heads = np.unique(own, axis=0)
        heads = heads[np.linspace(0, len(heads) - 1, min(CENTROIDS, len(heads))).astype(int)]
        for _ in range(rounds):
            near = ((heads**2).sum(axis=1)[None, :] - 2 * own @ heads.T).argmin(axis=1)
            count = np.bincount(near, minlength=len(heads))
            for axis in (0, 1):
                heads[:, axis] = np.where(count, np.bincount(near, own[:, axis], len(heads)) / np.maximum(count, 1), heads[:, axis])
        book[m, : len(heads)] = heads
        book[m, len(heads) :] = heads[0]
    return book


def encode(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroid of each pair of dimensions, and the residual's norm, with what rounding may add to a sum of products of single precision."""
    points = np.pad(vectors.astype(np.float64), ((0, 0), (0, vectors.shape[1] % 2)))
    code, square = np.zeros((len(points), len(book)), np.uint8), np.zeros(len(points))
    for m, heads in enumerate(book):
        own = points[:, 2 * m : 2 * m + 2]
        code[:, m] = ((heads**2).sum(axis=1)[None, :] - 2 * own @ heads.T).argmin(axis=1)
        square += ((own - heads[code[:, m]]) ** 2).sum(axis=1)
    rest = np.sqrt(square)
    size = np.sqrt((points**2).sum(axis=1))
    return code, rest * (1 + 1e-6) + (len(book) + 8) * 2.0**-22 * (size + rest)


class Windows:
    """The k best rows of each window; window w belongs to anchor of[w] and takes scores from low[w] to high[w]."""

    def __init__(self, of: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, anchors: int):
        self.of, self.low, self.high, self.k, self.anchors = of, low, high, k, anchors
        self.score = np.full((len(of), k), NONE)
        self.id = np.full((len(of), k), np.iinfo(np.int64).max)
        self.first = np.searchsorted(of, np.arange(anchors + 1))

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor the lowest and the highest score that one of its windows can use."""
        least = np.full(self.anchors, np.inf)
        np.minimum.at(least, self.of, np.maximum(self.low, self.score[:, -1]).astype(np.float64))
        most = np.full(self.anchors, -np.inf)
        np.maximum.at(most, self.of, self.high.astype(np.float64))
        return least, most

    def add(self, anchor: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        count = np.diff(self.first)[anchor]
        pair = np.repeat(np.arange(len(anchor)), count)
        w = self.first[anchor][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        s, r = score[pair], row[pair]
        good = (s >= self.low[w]) & (s <= self.high[w]) & (s >= self.score[w, -1])
        w, s, r = w[good], s[good], r[good]
        if not len(w):
            return
        touched = np.unique(w)
        w = np.concatenate([np.repeat(touched, self.k), w])
        s, r = np.concatenate([self.score[touched].ravel(), s]), np.concatenate([self.id[touched].ravel(), r])
        order = np.lexsort((r, ~s, w))
        w, s, r = w[order], s[order], r[order]
        begins = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        place = np.arange(len(w)) - np.repeat(begins, np.diff(np.append(begins, len(w))))
        top = place < self.k
        self.score[w[top], place[top]], self.id[w[top], place[top]] = s[top], r[top]


def largest(vectors: np.ndarray) -> int:
    return max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))


def scan(asked: dict, block: dict, book: np.ndarray, windows: Windows, same: bool, seen: list[int] | None = None) -> None:
    """Rows of the block (ids, names and label of rows, vectors, code, rest) into the windows of the anchors asked (the same but code and rest).

    same: rows of the anchor's label, else of others.  seen: gets the numbers of pairs and of those scored exactly.
    """
    bound = largest(asked["vectors"]) * largest(block["vectors"]) * asked["vectors"].shape[1]
    if bound >= 1 << 63:
        raise OverflowError("inner products of these vectors may not fit a long")
    wide = np.float64 if bound < EXACT else np.int64
    fine = np.float32 if bound < 1e30 else np.float64
    number = {x: i for i, x in enumerate(block["names"])}
    label = np.array([number.get(x, -1) for x in asked["names"]])[asked["label"]]
    ids, code, rest = block["ids"], block["code"].astype(np.intp), block["rest"].astype(fine) * fine(1 + 1e-6)
    pairs = len(book)
    for a in range(0, windows.anchors, CHUNK):
        b = min(a + CHUNK, windows.anchors)
        own = asked["vectors"][a:b].astype(np.float64)
        norm = (np.sqrt((own**2).sum(axis=1)) * (1 + 1e-6)).astype(fine)
        points = np.pad(own, ((0, 0), (0, own.shape[1] % 2))).reshape(b - a, pairs, 2)
        table = np.einsum("mkd,amd->mka", book, points).astype(fine)
        at, step = 0, 128
        while at < len(ids):
            to = min(at + step, len(ids))
            score = np.zeros((to - at, b - a), fine)
            for m in range(pairs):
                score += table[m].take(code[at:to, m], axis=0)
            least, most = windows.reach()
            least = np.nextafter(least[a:b].astype(fine), fine(-np.inf))
            most = np.nextafter(most[a:b].astype(fine), fine(np.inf))
            slack = rest[at:to, None] * norm[None, :]
            ok = (score + slack >= least) & (score - slack <= most) & ((label[None, a:b] == block["label"][at:to, None]) == same)
            i, j = np.nonzero(ok)
            i, j = i + at, j + a
            apart = ids[i] != asked["ids"][j]
            i, j = i[apart], j[apart]
            if seen is not None:
                seen[0] += ok.size
                seen[1] += len(i)
            for c in range(0, len(i), 1 << 16):
                x, y = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                exact = np.einsum("nd,nd->n", block["vectors"][x].astype(wide), asked["vectors"][y].astype(wide)).astype(np.int64)
                windows.add(y, exact, ids[x])
            at, step = to, min(4 * step, 1024)


def _narrow(vectors: np.ndarray) -> np.ndarray:
    return vectors.astype(np.min_scalar_type(-largest(vectors) - 1)) if largest(vectors) < 1 << 62 else vectors


def _packed(table: pa.Table) -> dict:
    names, label = np.unique(np.array(table.column("label").to_pylist(), object), return_inverse=True)
    flat = table.column("vector").combine_chunks().flatten().to_numpy()
    return {"ids": table.column("vec_id").to_numpy(), "names": names.tolist(), "label": label.astype(np.int32), "vectors": _narrow(flat.reshape(table.num_rows, -1))}


def sampled(rows: DataFrame) -> DataFrame:
    """n_dims and vector of up to SAMPLE rows of each length: the smallest hash of each bucket of hashes."""
    hashed = rows.select("n_dims", "vector", F.xxhash64("vector").alias("h"))
    least = hashed.groupBy("n_dims", F.pmod("h", F.lit(SAMPLE)).alias("bucket")).agg(F.min("h").alias("h"))
    return hashed.join(hinted(cut(least.select("n_dims", "h"))), ["n_dims", "h"]).dropDuplicates(["n_dims", "h"]).select("n_dims", "vector")


def codebooks(rows: DataFrame) -> DataFrame:
    """n_dims and book, fitted on a bounded sample of each vector length."""

    def run(key, table):
        flat = table.column("vector").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        flat = flat[np.lexsort(flat.T)]
        return pa.table({"n_dims": pa.array([key[0].as_py()], pa.int32()), "book": pa.array([pickle.dumps(fit(flat))], pa.binary())})

    return sampled(rows).groupBy("n_dims").applyInArrow(run, "n_dims int, book binary")


def dealt(rows: DataFrame, least: int, most: int) -> DataFrame:
    """rows with their block's number `part`: blocks of `least` to `most` rows, about one for each task if that is between."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.count("*")
    counts = rows.groupBy("n_dims").agg(F.greatest(F.ceil(n / most), F.least(F.ceil(n / least), F.lit(tasks))).alias("parts"))
    return rows.join(hinted(cut(counts)), "n_dims").withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), "parts")).drop("parts")


def row_blocks(rows: DataFrame, books: DataFrame) -> DataFrame:
    """n_dims, part and block (encoded rows)."""

    def pack(key, table):
        return pa.table({"n_dims": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "block": pa.array([pickle.dumps(_packed(table))], pa.binary())})

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, book = pickle.loads(batch.column("block")[i].as_py()), pickle.loads(batch.column("book")[i].as_py())
                block["code"], block["rest"] = encode(block["vectors"], book)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in ("n_dims", "part")), pa.array([pickle.dumps(block)], pa.binary())], ["n_dims", "part", "block"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = dealt(rows, LEAST, MOST).select("n_dims", "part", "vec_id", "label", "vector").repartition(tasks, "n_dims", "part")
    raw = apart.groupBy("n_dims", "part").applyInArrow(pack, "n_dims int, part long, block binary")
    return raw.join(hinted(books, 32), "n_dims").select("n_dims", "part", "block", "book").mapInArrow(run, "n_dims int, part long, block binary")


_WINDOW = "window: int, low: long, high: long"


def anchor_blocks(anchors: DataFrame, books: DataFrame) -> DataFrame:
    """n_dims, asked_part, asked (with `no` and windows) and book.  anchors: vec_id, no, label, vector, n_dims, windows."""

    def pack(key, table):
        out = _packed(table)
        windows = table.column("windows").combine_chunks()
        count = windows.value_lengths().to_numpy()
        fields = windows.flatten()
        out |= {"no": table.column("no").to_numpy(), "of": np.repeat(np.arange(table.num_rows), count)}
        out |= {name: fields.field(name).to_numpy() for name in ("window", "low", "high")}
        return pa.table({"n_dims": pa.array([key[0].as_py()], pa.int32()), "asked_part": pa.array([key[1].as_py()], pa.int64()), "asked": pa.array([pickle.dumps(out)], pa.binary())})

    apart = dealt(anchors, ANCHORS, ANCHORS).withColumnRenamed("part", "asked_part")
    return apart.groupBy("n_dims", "asked_part").applyInArrow(pack, "n_dims int, asked_part long, asked binary").join(hinted(books, 32), "n_dims")


def best_in_windows(data: DataFrame, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor_id, no, window, row_id and score: at least the k best rows of every window, some more for each stripe of blocks."""
    tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripes = F.greatest(F.ceil(F.col("blocks") / STRIPE), F.least(F.col("blocks"), F.ceil(F.lit(tasks) / F.col("askers"))))
    sizes = data.groupBy("n_dims").agg(F.count("*").alias("blocks")).join(asked.groupBy("n_dims").agg(F.count("*").alias("askers")), "n_dims").select("n_dims", stripes.alias("stripes"))
    keys = asked.select("n_dims", "asked_part").join(hinted(cut(sizes)), "n_dims")
    held = asked.join(keys, ["n_dims", "asked_part"]).withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)))
    passing = data.join(hinted(cut(keys)), "n_dims").withColumn("stripe", F.pmod("part", "stripes"))
    rows = held.select("n_dims", "asked_part", "stripe", F.lit(0).alias("turn"), "asked", "book", F.lit(None).cast("binary").alias("block"))
    rows = rows.unionByName(passing.select("n_dims", "asked_part", "stripe", F.lit(1).alias("turn"), F.lit(None).cast("binary").alias("asked"), F.lit(None).cast("binary").alias("book"), "block"))

    def found(asked: dict, windows: Windows) -> pa.RecordBatch:
        w, place = np.nonzero(windows.score > NONE)
        a = windows.of[w]
        return pa.RecordBatch.from_arrays([pa.array(asked["ids"][a]), pa.array(asked["no"][a]), pa.array(asked["window"][w].astype(np.int32)), pa.array(windows.id[w, place]), pa.array(windows.score[w, place])], ["anchor_id", "no", "window", "row_id", "score"])

    def run(batches):
        own = windows = book = None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("asked")[i].is_valid:
                    if own:
                        yield found(own, windows)
                    own, book = pickle.loads(batch.column("asked")[i].as_py()), pickle.loads(batch.column("book")[i].as_py())
                    windows = Windows(own["of"], own["low"], own["high"], k, len(own["ids"]))
                else:
                    scan(own, pickle.loads(batch.column("block")[i].as_py()), book, windows, same)
        if own:
            yield found(own, windows)

    ordered = rows.repartition(tasks, "n_dims", "asked_part", "stripe").sortWithinPartitions("n_dims", "asked_part", "stripe", "turn")
    return ordered.select("asked", "book", "block").mapInArrow(run, "anchor_id long, no long, window int, row_id long, score long")


def hard_negatives(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    An anchor's positives are its best other rows of the same label; for each of them the best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score, ranked from 1.  Scores are inner products of
    floor(scale * x); ties go to smaller ids; fewer rows give fewer results.  Rows with a null id or label, or a vector that
    is null, empty or holds null or non-finite components, take no part; vectors of different lengths don't meet.  Rows of
    the anchor's id are no candidates; repeated rows are candidates each, and a repeated anchor counts once.  An empty table
    gives no rows.  Vectors whose inner products may not fit a long raise an OverflowError.
    """
    rows = embeddings.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & valid(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), whole_numbers(F.col(vector_col), scale).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = cut(rows.withColumn("n_dims", F.size("vector")))
    books = cut(codebooks(rows))
    data = cut(row_blocks(rows, books))
    anchors = cut(rows.where("is_anchor").drop("is_anchor").dropDuplicates(["vec_id", "label", "vector"]).withColumn("no", F.xxhash64("label", "vector")))

    every = F.array(F.struct(F.lit(0).alias("window"), F.lit(NONE + 1).alias("low"), F.lit(-(NONE + 1)).alias("high")))
    near = best_in_windows(data, cut(anchor_blocks(anchors.withColumn("windows", every), books)), positives, True)
    best = Window.partitionBy("anchor_id", "no").orderBy(F.col("score").desc(), "row_id")
    near = cut(near.withColumn("window", F.row_number().over(best)).where(F.col("window") <= positives))

    # whole hundreds apart, so that nothing overflows
    hundreds, rest = F.expr("score DIV 100 - CAST(score % 100 < 0 AS INT)"), F.pmod("score", F.lit(100))
    least, most = (hundreds * low + F.ceil(rest * low / 100)).cast("long"), (hundreds * high + F.floor(rest * high / 100)).cast("long")
    asked = near.groupBy("anchor_id", "no").agg(F.sort_array(F.collect_list(F.struct("window", least.alias("low"), most.alias("high")))).alias("windows"))
    again = anchors.join(asked.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "no"])
    far = best_in_windows(data, cut(anchor_blocks(again, books)), negatives, False)
    order = Window.partitionBy("anchor_id", "no", "window").orderBy(F.col("score").desc(), "row_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "no", "window", "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    chosen = near.select("anchor_id", "no", "window", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(chosen, ["anchor_id", "no", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
p AS (SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5),
n AS (SELECT p.*, s.row_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.row_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
