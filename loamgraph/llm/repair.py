"""Token ids in binary shards under Re-Pair grammars.

A shard holds the ids of consecutive documents.  Frequent pairs of neighbouring ids (never across documents) become
nonterminals, round after round, until no pair comes min_count times.  The shard stores its rules, each rule's expansion
length, the reduced sequence, and each document's place in it, so one document is read without expanding the others.

Layout (little endian): b"LGRP", uint32 version, n_docs, n_nameless, n_rules, n_symbols, first_nonterminal (the first n_nameless
documents have no id); then doc ids int64,
places uint32 (n_docs + 1), rules uint32 x 2, expansion lengths uint32, and the sequence as uint16 low halves and uint16
high halves.  A shard is one row of a Parquet table (part, seq, n_tokens, payload), so Spark's committers write it to
any store and lost executors leave no half-written file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, checkpoint_dir, hinted, ragged, text_parts
from .token_counts import library

MAGIC, VERSION = b"LGRP", 2
HEAD = struct.Struct("<4s6I")

#: A pair that comes at least so often in a shard becomes a rule: a rule takes 12 bytes, and each use saves a symbol of 4.
MIN_COUNT = 4

#: Bytes of text in a shard, about.
SHARD_BYTES = 4 << 20

#: Pieces that a worker remembers, about, at some 120 bytes each; with the encoder's own number twice as many are encoded again.
CACHE = 1_600_000


def _frequent(left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (left, right) those that come at least so often: which, their ranks by falling count, and the distinct ones in that order."""
    width, bits = int(max(left.max(), right.max())).bit_length(), len(left).bit_length()
    pair = left.astype(np.int64)
    pair <<= width
    pair |= right
    if 2 * width + bits < 64:  # pair and place in one number, which sorts much faster than an order of the pairs
        pair <<= bits
        pair |= np.arange(len(left))
        pair.sort()
        order = pair & ((1 << bits) - 1)
        pair >>= bits
    else:
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
    begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]]))
    count = np.diff(begin)
    good = np.flatnonzero(count >= least)
    good = good[np.argsort(-count[good], kind="stable")]
    by_pair = np.full(len(count), -1, np.int32)
    by_pair[good] = np.arange(len(good), dtype=np.int32)
    rank = np.empty(len(left), np.int32)
    rank[order] = np.repeat(by_pair, count)
    own, one = np.flatnonzero(rank >= 0), order[begin[good]]
    return own, rank[own], np.stack([left[one], right[one]], 1)


def compress(ids: np.ndarray, doc: np.ndarray, first_symbol: int, least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of ids (doc: each id's document number): the reduced sequence, its document numbers, the rules and their expansion lengths.

    A round replaces all frequent pairs at once; where two overlap, the more frequent one wins, in runs of one pair every
    other.  A pair's symbol stands in its first place, and links lead past the second.  The first round counts all pairs,
    the later ones those that hold a nonterminal of the last round and the frequent ones that lost to an overlap: no other
    pair can come so often, as its count has not risen since it was too low.
    """
    n = len(ids)
    seq, rules, top, pays = ids.astype(np.int32), [], first_symbol, min(least, MIN_COUNT)
    mark, alive = np.append(doc[:-1] == doc[1:], [False, False])[: n + 1], np.ones(n, bool)
    at, last = np.flatnonzero(mark), np.flatnonzero(~mark[:n])
    mark[at] = False
    # place n stands for both ends of every document
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[last], before[last + 1], before[:1] = n, n, n
    while len(at):
        follow = after[at]
        own, rank, pairs = _frequent(seq[at], seq[follow], least)
        if not len(own):
            break
        at, follow = at[own], follow[own]
        beside = follow[:-1] == at[1:]  # the pair overlaps with the next one
        left, right = np.full(len(at), len(pairs), np.int32), np.full(len(at), len(pairs), np.int32)
        np.copyto(left[1:], rank[:-1], where=beside)
        np.copyto(right[:-1], rank[1:], where=beside)
        take = (rank < left) & (rank < right)
        tie = np.flatnonzero((left == rank) | (right == rank))
        if len(tie):
            new = left[tie] != rank[tie]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(tie)), 0))
            even = (np.arange(len(tie)) - begin) % 2 == 0
            take[tie] = even & (rank[tie] <= left[tie]) & (rank[tie] <= right[tie])
        some = np.flatnonzero(take)
        kind = rank[some]
        uses = np.bincount(kind, minlength=len(pairs))
        if uses.max() >= pays:  # pairs that lose too many uses to others wait for a round without them
            uses[uses < pays] = 0
            enough = np.flatnonzero(uses[kind])
            some, kind = some[enough], kind[enough]
        used = np.flatnonzero(uses)
        number = np.zeros(len(pairs), np.int32)
        number[used] = top + np.arange(len(used), dtype=np.int32)
        rules.append(pairs[used].astype(np.int64))
        top += len(used)
        chosen, gone = at[some], follow[some]
        seq[chosen] = number[kind]
        alive[gone] = False
        follow = after[gone]
        after[chosen], before[follow] = follow, chosen
        last = np.where(alive[last], last, before[last])
        some = np.concatenate([at, before[chosen]])
        mark[some] = True
        mark[gone] = mark[last] = mark[n] = False
        if 32 * len(some) > n:
            at = np.flatnonzero(mark)
        else:
            some = np.sort(some[mark[some]])
            at = some[np.flatnonzero(np.diff(some, prepend=-1))]
        mark[at] = False
    alive = np.flatnonzero(alive)
    return seq[alive], doc[alive], np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), lengths_of(rules, first_symbol)


def lengths_of(rules: list[np.ndarray], first_symbol: int) -> np.ndarray:
    """Ids that each nonterminal stands for, from the rules of every round; they refer to those of earlier rounds only."""
    out, done = np.ones(sum(map(len, rules)), np.int64), 0
    for some in rules:
        inner = some - first_symbol
        out[done : done + len(some)] = np.where(inner >= 0, out[np.maximum(inner, 0)], 1).sum(axis=1)
        done += len(some)
    return out


def expand(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_symbol: int) -> np.ndarray:
    """The ids that a piece of a reduced sequence stands for: its distinct nonterminals are opened until none is left, then copied."""
    big = np.flatnonzero(seq >= first_symbol)
    if not len(big):
        return seq
    if len(big) < len(rules) >> 4:
        used, back = np.unique(seq[big], return_inverse=True)
    else:
        back = seq[big] - first_symbol
        used = np.flatnonzero(np.bincount(back, minlength=len(rules)))
        place = np.zeros(len(rules), np.int64)
        place[used] = np.arange(len(used))
        used, back = used + first_symbol, place[back]
    flat = used
    while (open_ := flat >= first_symbol).any():
        width = np.where(open_, 2, 1)
        out = np.repeat(flat, width)
        at = (np.cumsum(width) - width)[open_]
        rule = rules[flat[open_] - first_symbol]
        out[at], out[at + 1] = rule[:, 0], rule[:, 1]
        flat = out
    sizes = lengths[used - first_symbol]
    size, start = np.ones(len(seq), np.int64), np.arange(len(seq)) + len(flat)
    size[big], start[big] = sizes[back], (np.cumsum(sizes) - sizes)[back]
    return np.concatenate([flat, seq])[ragged(start, size)]


def pack(doc_ids: np.ndarray, ids: np.ndarray, first: np.ndarray, first_symbol: int, least: int = MIN_COUNT, nameless: int = 0) -> bytes:
    """A shard of documents: ids one after the other, first: each document's place (n + 1); the first `nameless` ones have no id."""
    doc = np.repeat(np.arange(len(doc_ids)), np.diff(first))
    seq, doc, rules, lengths = compress(ids, doc, first_symbol, least)
    places = np.searchsorted(doc, np.arange(len(doc_ids) + 1))
    head = HEAD.pack(MAGIC, VERSION, len(doc_ids), nameless, len(rules), len(seq), first_symbol)
    low, high = (seq & 0xFFFF).astype("<u2"), (seq >> 16).astype("<u2")
    return b"".join([head, doc_ids.astype("<i8").tobytes(), places.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), low.tobytes(), high.tobytes()])


class Shard:
    """A packed shard: doc_ids (of the first `nameless` ones 0), document(i) for one document's ids, and all()."""

    def __init__(self, payload: bytes):
        magic, version, n, self.nameless, r, s, self.first_symbol = HEAD.unpack_from(payload)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of this format")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.places = take("<i8", n), take("<u4", n + 1).astype(np.int64)
        self.rules, self.lengths = take("<u4", 2 * r).reshape(r, 2).astype(np.int64), take("<u4", r).astype(np.int64)
        self.seq = take("<u2", s).astype(np.int64)
        self.seq |= take("<u2", s).astype(np.int64) << 16

    def _size(self, seq: np.ndarray) -> np.ndarray:
        out = np.ones(len(seq), np.int64)
        big = seq >= self.first_symbol
        out[big] = self.lengths[seq[big] - self.first_symbol]
        return out

    def document(self, i: int) -> np.ndarray:
        return expand(self.seq[self.places[i] : self.places[i + 1]], self.rules, self.lengths, self.first_symbol)

    def slice(self, i: int, start: int, end: int) -> np.ndarray:
        """Ids start..end-1 of a document; only the symbols that reach into them are expanded."""
        seq = self.seq[self.places[i] : self.places[i + 1]]
        ends = np.cumsum(self._size(seq))
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, end, side="left")) + 1
        begun = int(ends[a - 1]) if a else 0
        return expand(seq[a:b], self.rules, self.lengths, self.first_symbol)[start - begun : end - begun]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each document's place in them (n + 1)."""
        places = np.concatenate([[0], np.cumsum(self._size(self.seq))])[self.places]
        return expand(self.seq, self.rules, self.lengths, self.first_symbol), places


def write_shards(docs: DataFrame, path: str, out: str, end_id: int = 2, first_symbol: int = 1 << 17, least: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes whole texts (null: empty), appends end_id, and writes shards in ascending id order to the folder out.

    One shuffle, by ranges of ids; each task encodes and packs about SHARD_BYTES of text at a time.  Rows with a null id
    come first; rows of one id keep the order of their texts.
    """

    def run(batches):
        own, part, seq = library(path, CACHE), TaskContext.get().partitionId(), 0
        held, size = [], 0

        def shard():
            nonlocal seq
            ids = np.concatenate([x[1] for x in held])
            counts = np.concatenate([x[2] for x in held])
            names = pa.concat_arrays([x[0] for x in held])
            payload = pack(names.fill_null(0).to_numpy(), ids, np.concatenate([[0], np.cumsum(counts)]), first_symbol, least, names.null_count)
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["part", "seq", "n_tokens", "payload"])

        for batch in batches:
            for piece in by_bytes(batch, text_col):
                data, bounds = text_parts(piece.column(text_col))
                ids, first = own.ids(data, bounds)
                n = len(bounds) - 1
                with_end = np.full(len(ids) + n, end_id, np.int32)
                with_end[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(first))] = ids
                held.append((piece.column(id_col), with_end, np.diff(first) + 1))
                size += len(data)
                if size >= SHARD_BYTES:
                    yield shard()
                    held, size = [], 0
        if held:
            yield shard()

    ordered = docs.select(F.col(id_col).cast("long").alias(id_col), text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    ordered.mapInArrow(run, "part int, seq long, n_tokens long, payload binary").write.mode("overwrite").option("compression", "zstd").parquet(out)


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids).

    Offsets come from the shards' counts: sums within a part, and over the parts, of which the writer had one for each task.
    """

    def run(batches):
        for batch in batches:
            for payload, base in zip(batch.column("payload"), batch.column("base").to_pylist()):
                shard = Shard(payload.as_buffer())
                ids, place = shard.all()
                raw, at = memoryview(ids.astype("<u4").tobytes()), (place * 4).tolist()
                n = len(shard.doc_ids)
                crc = [zlib.crc32(raw[at[i] : at[i + 1]]) for i in range(n)]
                names = pa.array(shard.doc_ids, pa.int64(), mask=np.arange(n) < shard.nameless)
                yield pa.RecordBatch.from_arrays([names, pa.array(base + place[:-1], pa.int64()), pa.array(np.diff(place), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.parquet(out)
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    bases = sizes.select("part", "seq", inner.alias("inner")).join(parts, "part").select("part", "seq", (F.col("inner") + F.col("before")).alias("base"))
    return shards.select("part", "seq", "payload").join(hinted(bases), ["part", "seq"]).select("payload", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def shard_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/shards-{uuid.uuid4().hex}"
