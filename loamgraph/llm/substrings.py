"""Substring dedup with difference-cover anchors.

A window is `width` consecutive words of one document.  Positions whose number modulo 7 is in {0, 1, 3} form a
difference cover: for any two positions some shift below 7 takes both into the cover.  So two equal windows of 13 words
share an anchor, 7 words from a cover position on, at the same place in both.  Anchors that only one document has are
dropped; around the others the match extends to whole windows, and each window's smallest document decides.

Texts are dealt by hash into chunks.  A chunk sends each hash range (bucket) one packed array of its distinct hashes, and
hears back which of them matter, so a passage that many documents share counts once a chunk and no task gets all of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, ragged, span_hashes, text_parts, word_spans

PERIOD, COVER = 7, (0, 1, 3)
WIDTH = 13
ANCHOR = WIDTH - PERIOD + 1
CHUNK_BYTES = 2 << 20
LAST = (1 << 63) - 1  # stands for a null id

_ENTRY = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<i8")])


def _rolled(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of `width` words from each word on; what runs over the end is short and must be left out."""
    n = max(len(hashes) - width + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(base) + hashes[k : k + n]
    return mix(out)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash; sorted hashes have sorted buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Chunk:
    """Words of a chunk's documents."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id")
        self.docs = table.column("doc_id").fill_null(LAST).to_numpy().astype(np.int64)
        self.data, self.bounds = text_parts(table.column("text"))
        self.start, self.end, self.first = word_spans(self.data, self.bounds)
        self.hashes = span_hashes(self.data, self.start, self.end)
        self.text = np.repeat(np.arange(len(self.docs)), np.diff(self.first))
        self.place = np.arange(len(self.hashes)) - self.first[:-1][self.text]

    def inside(self, width: int) -> np.ndarray:
        """Words from which a document still has `width` words."""
        n = max(len(self.text) - width + 1, 0)
        return np.flatnonzero(self.text[:n] == self.text[width - 1 : width - 1 + n])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions and their anchors' hashes."""
        at = self.inside(ANCHOR)
        at = at[np.isin(self.place[at] % PERIOD, COVER)]
        return at, _rolled(self.hashes, ANCHOR, 0x9E3779B97F4A7C15)[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows start, and 96 bits of hash, from two independent hashes of the words."""
        at = self.inside(WIDTH)
        other = span_hashes(self.data, self.start, self.end, 1)
        return at, _rolled(self.hashes, WIDTH, 0xD1B54A32D192ED03)[at], _rolled(other, WIDTH, 0xA0761D6478BD642F)[at].astype(np.uint32)


def _rows(chunk: int, sorted_: np.ndarray, bucket: np.ndarray) -> pa.Table:
    """One row for each bucket with entries: bucket, chunk, packed entries."""
    names, first = np.unique(bucket, return_index=True)
    ends = np.append(first[1:], len(bucket))
    blobs = [sorted_[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist())]
    return pa.table({"bucket": pa.array(names, pa.int64()), "chunk": pa.array(np.full(len(names), chunk), pa.int64()), "entries": pa.array(blobs, pa.binary())})


def _minima(h: np.ndarray, g: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first entry of each distinct (h, g), in order of (h, g, doc), and each entry's smallest doc."""
    order = np.lexsort((doc, g, h))
    new = np.ones(len(h), bool)
    new[1:] = (h[order[1:]] != h[order[:-1]]) | (g[order[1:]] != g[order[:-1]])
    least = np.empty(len(h), np.int64)
    least[order] = doc[order[new]][np.cumsum(new) - 1]
    return order[new], least


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space); keep_text adds kept_text.

    A word is removed if a window that covers it also starts in a document with a smaller id; all windows are those of the
    input.  Null and empty texts have no words; a null id is larger than any other; rows of one id don't remove each
    other's words; repeated rows give repeated results; other columns of docs don't matter.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_bytes = base.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(-(-n_bytes // CHUNK_BYTES), tasks)
    buckets = max(chunks // 4, min(tasks, chunks))
    dealt = base.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    by_chunk = lambda: dealt.groupBy("chunk")

    def anchors(key, table):
        own = Chunk(table)
        at, h = own.anchors()
        doc = own.docs[own.text[at]]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        other = np.zeros(len(h), bool)
        other[1:] = ~new[1:] & (doc[1:] != doc[:-1])
        many = np.bincount(np.cumsum(new) - 1, weights=other, minlength=int(new.sum())) > 0
        h = h[new]
        h = (h & ~np.uint64(1)) | many.astype(np.uint64)  # the lowest bit: whether two documents here have it
        return _rows(key[0].as_py(), h, _bucket(h, buckets))

    def shared(key, table):
        blobs = table.column("entries").to_pylist()
        sizes = np.array([len(b) // 8 for b in blobs])
        h = np.frombuffer(b"".join(blobs), np.uint64)
        row = np.repeat(np.arange(len(blobs)), sizes)
        many, h = (h & np.uint64(1)) > 0, h & ~np.uint64(1)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        hit = many.copy()
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        at = np.flatnonzero(hit)
        ends = np.searchsorted(row[at], np.arange(len(blobs) + 1))
        chosen = [i for i in range(len(blobs)) if ends[i] < ends[i + 1]]
        return pa.table({"chunk": table.column("chunk").take(pa.array(chosen, pa.int64())), "entries": pa.array([h[at[ends[i] : ends[i + 1]]].tobytes() for i in chosen], pa.binary())})

    def extended(key, table, found):
        own = Chunk(table)
        wanted = np.sort(np.frombuffer(b"".join(found.column("entries").to_pylist()), np.uint64))
        at, h = own.anchors()
        h &= ~np.uint64(1)
        if len(wanted):
            at = at[wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h]
        else:
            at = at[:0]
        near = np.zeros(len(own.text) + 1, np.int32)
        np.add.at(near, np.maximum(at - (WIDTH - ANCHOR), 0), 1)
        np.add.at(near, at + 1, -1)
        start, h, g = own.windows()
        some = np.cumsum(near[:-1])[start] > 0
        start, h, g = start[some], h[some], g[some]
        doc = own.docs[own.text[start]]
        one, _ = _minima(h, g, doc)
        entries = np.empty(len(one), _ENTRY)
        entries["h"], entries["g"], entries["doc"] = h[one], g[one], doc[one]
        return _rows(key[0].as_py(), entries, _bucket(entries["h"], buckets))

    def smallest(key, table):
        blobs = table.column("entries").to_pylist()
        entries = np.frombuffer(b"".join(blobs), _ENTRY)
        row = np.repeat(np.arange(len(blobs)), [len(b) // _ENTRY.itemsize for b in blobs])
        _, least = _minima(entries["h"], entries["g"], entries["doc"])
        at = np.flatnonzero(least < entries["doc"])
        out = entries[at].copy()
        out["doc"] = least[at]
        ends = np.searchsorted(row[at], np.arange(len(blobs) + 1))
        chosen = [i for i in range(len(blobs)) if ends[i] < ends[i + 1]]
        return pa.table({"chunk": table.column("chunk").take(pa.array(chosen, pa.int64())), "entries": pa.array([out[ends[i] : ends[i + 1]].tobytes() for i in chosen], pa.binary())})

    def removed(key, table, found):
        own = Chunk(table)
        start, h, g = own.windows()
        doc = own.docs[own.text[start]]
        heard = np.frombuffer(b"".join(found.column("entries").to_pylist()), _ENTRY)
        _, least = _minima(np.concatenate([h, heard["h"]]), np.concatenate([g, heard["g"]]), np.concatenate([doc, heard["doc"]]))
        at = start[least[: len(doc)] < doc]
        step = np.zeros(len(own.text) + 1, np.int32)
        step[at] += 1
        step[at + WIDTH] -= 1
        keep = np.cumsum(step[:-1]) == 0
        n = np.diff(own.first)
        left = np.diff(np.concatenate([[0], np.cumsum(keep)])[own.first])
        size = (own.end - own.start + 1)[keep]
        index = ragged(own.start[keep], size)
        index[np.cumsum(size) - 1] = len(own.data)
        out = memoryview(np.append(own.data, np.uint8(32))[index].tobytes())
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(left)])].tolist()
        texts = [out[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:])]
        columns = {"doc_id": own.ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - left, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
        if keep_text:
            columns["kept_text"] = pa.array([str(t, "utf-8") for t in texts], pa.string())
        return pa.table(columns)

    packed = "bucket long, chunk long, entries binary"
    answer = "chunk long, entries binary"
    common = by_chunk().applyInArrow(anchors, packed).groupBy("bucket").applyInArrow(shared, answer)
    whole = by_chunk().cogroup(common.groupBy("chunk")).applyInArrow(extended, packed)
    least = whole.groupBy("bucket").applyInArrow(smallest, answer)
    return by_chunk().cogroup(least.groupBy("chunk")).applyInArrow(removed, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i+12], ' ')) AS h FROM p),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first_doc FROM h),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM m WHERE first_doc < doc_id),
g AS (SELECT doc_id, list(k) AS ks FROM r GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(g.ks), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_select(d.w, list_filter(range(1, len(d.w) + 1), lambda k: NOT coalesce(list_contains(g.ks, k), false))), ' '), '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""
