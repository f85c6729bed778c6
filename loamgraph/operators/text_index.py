"""Stored postings for BM25 search, with block maxima and early stopping.

Documents that one task reads after another make chunks of CHUNK, so a task makes its blocks by itself, and only these are
dealt out, packed and compressed, never words.  A block holds the postings of one word of one field in one chunk, so
even a word of every document has no long list anywhere, and its `top`: the highest value that a document of the block gives
the word.  A posting is a document's place in its chunk, the word's count and the document's size; a row without a word holds
a chunk's ids.  The folder holds `blocks` (partitioned by hashes of words, sorted by word and chunk; ids are in IDS), `terms` (documents of each
word) and `fields` (documents, average size).  A search reads the blocks of its words only.  For the k best it reads the
blocks' headers first: the sum of tops is a bound for every document of a chunk, so after a first look at the chunks with the
highest bounds only those that reach the kth score are read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import cut
from .stored import files

#: Documents of a chunk, at most; folders that words are dealt into; the folder of ids.
CHUNK, PARTS, IDS = 1024, 64, -1
#: Rows of blocks that go on at once.
ROWS = 100_000
#: Chunks of the first look, for every document that is wanted.
FIRST = 2


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _part(word: Column) -> Column:
    return F.pmod(F.crc32(word.cast("binary")), F.lit(PARTS)).cast("int")


def _packed(rows: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(rows)
    return out.getvalue().to_pybytes()


def _unpacked(batches):
    for batch in batches:
        for part, packed in zip(batch.column("part").to_pylist(), batch.column("packed")):
            for rows in pa.ipc.open_stream(packed.as_buffer()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, part, np.int32)), *rows.columns], ["part", *rows.schema.names])


_POSTINGS = "struct<nth: array<smallint>, tf: array<int>, size: array<int>>"


def _blocks_of(average: dict[str, float], k1: float, b: float, most: int):
    """The function of batches (id, words of each field, doc: ids that count from a multiple of 2**33 on) that gives the blocks of each chunk and its ids, packed by part."""
    lists = lambda starts, *values: [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), x) for x in values]

    def blocks(chunk, parts):
        docs = pa.Table.from_batches(parts).combine_chunks()
        for field in average:
            words = docs.column(field).combine_chunks()
            size = np.diff(words.offsets.to_numpy()).astype(np.int64)
            coded = words.flatten().dictionary_encode()
            pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * most + np.repeat(np.arange(len(size)), size), return_counts=True)
            code, nth = pairs // most, pairs % most
            if not len(pairs):
                continue
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[nth] / average[field]))
            top, ends, word = np.maximum.reduceat(value, starts), np.append(starts, len(code)), coded.dictionary.take(pa.array(code[starts]))
            for at in range(0, len(starts), ROWS):
                some = ends[at : at + ROWS + 1]
                one = slice(some[0], some[-1])
                m = len(some) - 1
                posting = lists(some - some[0], pa.array(nth[one].astype(np.int16)), pa.array(tf[one].astype(np.int32)), pa.array(size[nth[one]].astype(np.int32)))
                yield [pa.array([field] * m), word.slice(at, m), pa.array(np.full(m, chunk)), pa.array(top[at : at + m]), pa.array(np.diff(some)), pa.StructArray.from_arrays(posting, ["nth", "tf", "size"]), None]
        ids = docs.column("id").combine_chunks()
        yield [pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([chunk]), pa.nulls(1, pa.float64()), pa.array([len(ids)]), None, lists([0, len(ids)], ids)[0]]

    def run(batches):
        names, kind = ["field", "word", "chunk", "top", "n", "postings", "ids"], pa.struct([("nth", pa.list_(pa.int16())), ("tf", pa.list_(pa.int32())), ("size", pa.list_(pa.int32()))])
        chunk, parts = None, []

        def whole():
            for *rest, postings, ids in blocks(chunk, parts) if parts else ():
                m = len(rest[0])
                own = pa.RecordBatch.from_arrays([*rest, pa.nulls(m, kind) if postings is None else postings, pa.nulls(m, pa.list_(parts[0].schema.field("id").type)) if ids is None else ids], names)
                part = np.array([IDS if w is None else crc32(w.encode()) % PARTS for w in own.column("word").to_pylist()], np.int32)
                order = np.argsort(part, kind="stable")
                own, part = own.take(pa.array(order)), part[order]
                starts = np.flatnonzero(np.diff(part, prepend=IDS - 1))
                blobs = [_packed(own.slice(a, z - a)) for a, z in zip(starts, np.append(starts[1:], m))]
                yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(np.full(len(starts), chunk % 16, np.int32)), pa.array(blobs, pa.binary())], ["part", "cell", "packed"])

        for batch in batches:
            at = batch.column("doc").to_numpy() // most
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            for a, z in zip(edges, edges[1:]):
                if a == z:
                    continue
                if at[a] != chunk:
                    yield from whole()
                    chunk, parts = int(at[a]), []
                parts.append(batch.slice(a, z - a))
        yield from whole()

    return run


def build(rows: DataFrame, path: str, id_col: str, fields: dict[str, Column], k1: float = 1.2, b: float = 0.75) -> None:
    """Writes the index of the fields' texts to the folder path, over what is there.

    Every row is a document of its own, also where ids repeat or are null; null texts are empty.  k1 and b are those of all
    searches, since the maxima depend on them.
    """
    own = rows.select(F.col(id_col).alias("id"), *[words_of(text).alias(f) for f, text in fields.items()])
    sizes = [F.avg(F.size(f)).alias(f) for f in fields]
    whole = own.agg(F.count("*").alias("n"), *sizes)
    stack = ", ".join(f"'{f}', n, `{f}`" for f in fields)
    stats = cut(whole.selectExpr(f"stack({len(fields)}, {stack}) AS (field, n, average)").withColumns({"k1": F.lit(k1), "b": F.lit(b)}))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/fields")
    known = stats.collect()  # a row for each field
    n, average = known[0].n, {r.field: r.average for r in known}
    few = own.coalesce(max(1, n // CHUNK))  # as many tasks as there are full chunks, at most
    made = few.withColumn("doc", F.monotonically_increasing_id()).mapInArrow(_blocks_of(average, k1, b, CHUNK), "part int, cell int, packed binary")
    kind = f"part int, field string, word string, chunk long, top double, n long, postings {_POSTINGS}, ids array<{own.schema['id'].dataType.simpleString()}>"
    blocks = made.repartition("part", "cell").mapInArrow(_unpacked, kind)
    blocks.sortWithinPartitions("part", "word", "field", "chunk").write.mode("overwrite").partitionBy("part").parquet(f"{path}/blocks")
    system, where = files(rows.sparkSession, f"{path}/blocks")
    if not any(s.getPath().getName().startswith("part=") for s in system.listStatus(where)):  # no documents at all
        blocks.limit(0).write.mode("overwrite").parquet(f"{path}/blocks")
    terms = rows.sparkSession.read.parquet(f"{path}/blocks").where("word IS NOT NULL").groupBy("field", "word").agg(F.sum("n").alias("df"))
    terms.withColumn("part", _part(F.col("word"))).repartition("part").sortWithinPartitions("part", "word").write.mode("overwrite").parquet(f"{path}/terms")


def _words(spark: SparkSession, path: str, words: list[str], boosts: dict[str, float]) -> DataFrame:
    """field, word, weight (boost times idf), average, k1 and b for the words of the query that are known: a row for each, at most."""
    rate = F.create_map(*[x for f, boost in boosts.items() for x in (F.lit(f), F.lit(float(boost)))])
    terms = spark.read.parquet(f"{path}/terms").where(F.col("word").isin(words) & F.col("field").isin(list(boosts)))
    known = terms.join(F.broadcast(spark.read.parquet(f"{path}/fields")), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return known.select("field", "word", (rate[F.col("field")] * idf).alias("weight"), "average", "k1", "b")


def _blocks(spark: SparkSession, path: str, words: list[str], known: DataFrame) -> DataFrame:
    parts = [r[0] for r in spark.createDataFrame([(w,) for w in words], "word string").select(_part(F.col("word"))).distinct().collect()]  # PARTS at most
    own = spark.read.parquet(f"{path}/blocks").where(F.col("part").isin(parts) & F.col("word").isin(words))
    return own.join(F.broadcast(known), ["field", "word"])  # as many rows as the query has words and fields


def _scores(blocks: DataFrame) -> DataFrame:
    """chunk, nth and score of the documents of blocks."""
    hits = blocks.select("weight", "average", "k1", "b", "chunk", F.explode(F.arrays_zip("postings.nth", "postings.tf", "postings.size")).alias("hit")).select("weight", "average", "k1", "b", "chunk", "hit.*")
    value = F.col("weight") * F.col("tf") * (F.col("k1") + 1) / (F.col("tf") + F.col("k1") * (1 - F.col("b") + F.col("b") * F.col("size") / F.col("average")))
    return hits.groupBy("chunk", "nth").agg(F.sum(value).alias("score"))


def _ids(spark: SparkSession, path: str) -> DataFrame:
    """chunk, nth and id of all documents."""
    rows = spark.read.parquet(f"{path}/blocks").where(F.col("part") == IDS)
    return rows.select("chunk", F.posexplode("ids").alias("nth", "id")).select("chunk", F.col("nth").cast("short").alias("nth"), "id")


def search(spark: SparkSession, path: str, words: list[str], boosts: dict[str, float], k: int | None = None) -> DataFrame:
    """id and score of the documents that have any of the words, or rank, id and score of the k best (ties: smaller id).

    boosts: field and what its score is multiplied by.  Equals a scan of all texts; words in lower case, each counts once.
    """
    words = sorted(set(words))
    known = cut(_words(spark, path, words, boosts))
    blocks = _blocks(spark, path, words, known)
    if k is None:
        return _scores(blocks).join(_ids(spark, path), ["chunk", "nth"]).select("id", "score")
    bounds = cut(blocks.groupBy("chunk").agg((F.sum(F.col("weight") * F.col("top")) * (1 + 1e-9)).alias("bound"), F.sum("n").alias("n")))
    first = cut(bounds.orderBy(F.col("bound").desc(), "chunk").limit(FIRST * max(1, -(-k // 8))))

    def of(chunks: DataFrame) -> DataFrame:
        some = [r[0] for r in chunks.select("chunk").limit(10_001).collect()]
        near = lambda df: df.where(F.col("chunk").isin(some)) if len(some) <= 10_000 else df.join(chunks.select("chunk"), "chunk", "left_semi")
        return _scores(near(blocks)).join(near(_ids(spark, path)), ["chunk", "nth"])

    best = Window.orderBy(F.col("score").desc(), "id", "chunk", "nth")
    one = cut(of(first).orderBy(F.col("score").desc(), "id", "chunk", "nth").limit(k))
    floor = one.agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    rest = bounds.join(first.select("chunk"), "chunk", "left_anti").join(F.broadcast(floor)).where("floor IS NULL OR bound >= floor")
    two = of(cut(rest)).orderBy(F.col("score").desc(), "id", "chunk", "nth").limit(k)
    both = one.unionByName(two).orderBy(F.col("score").desc(), "id", "chunk", "nth").limit(k)  # 2k rows at most, so one window may order them
    return both.withColumn("rank", F.row_number().over(best)).select("rank", "id", "score")
