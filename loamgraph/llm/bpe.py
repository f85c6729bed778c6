"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token that is itself a token, many at once.
Tier two: the other pre-tokens are merged by rank with a heap over a linked list of their bytes.
Null texts are empty; an empty text has no ids; ids and decoded bytes of equal texts are equal.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, mix, ragged, span_hashes, text_parts
from .segments import Encoder


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys take the slots 0..n-1, with one small displacement for each bucket of about four keys."""

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 4)
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(counts)
        self.shift = np.zeros(self.buckets, np.uint64)
        taken = np.zeros(n, bool)
        for b in np.argsort(-counts, kind="stable").tolist():
            size = int(counts[b])
            if not size:
                break
            own = keys[order[ends[b] - size : ends[b]]]
            base = 0
            while True:  # many displacements at once
                tries = np.arange(base, base + 256, dtype=np.uint64)
                at = self._slot(own[None, :], tries[:, None])
                fits = ~taken[at].any(axis=1)
                if size > 1:
                    ordered = np.sort(at, axis=1)
                    fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                found = np.flatnonzero(fits)
                if len(found):
                    self.shift[b] = tries[found[0]]
                    taken[at[found[0]]] = True
                    break
                base += 256

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys + shift * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return self._slot(keys, self.shift[self._bucket(keys)])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Ranks of byte strings, their perfect hash, and the merges of other pre-tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[t] for t in tokens], np.int64)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        keys = span_hashes(self.data, self.starts, self.starts + self.sizes)
        self.hash = PerfectHash(keys)
        slot = self.hash.slot(keys)
        self.slot_token = np.zeros(len(tokens), np.int64)
        self.slot_token[slot] = np.arange(len(tokens))
        self.place = np.full(int(self.ids.max()) + 1, -1, np.int64)
        self.place[self.ids] = np.arange(len(tokens))

    def whole(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tier one: ids of the spans that are tokens, else -1; every hit is compared byte by byte."""
        token = self.slot_token[self.hash.slot(span_hashes(data, start, end))]
        size = end - start
        fits = np.flatnonzero(self.sizes[token] == size)
        own, n = ragged(start[fits], size[fits]), size[fits]
        same = data[own] == self.data[ragged(self.starts[token[fits]], n)]
        wrong = np.bincount(np.repeat(np.arange(len(fits)), n)[~same], minlength=len(fits))
        out = np.full(len(start), -1, np.int64)
        good = fits[wrong == 0]
        out[good] = self.ids[token[good]]
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: the pair of lowest rank merges first, the leftmost of equals; the heap holds pairs of a linked list of bytes."""
        get = self.ranks.get
        n = len(piece)
        part = [piece[i : i + 1] for i in range(n)]
        if n == 1:
            return [self.ranks[piece]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = get(part[i] + part[i + 1])
            if rank is not None:
                heap.append((rank, i, part[i] + part[i + 1]))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            rank, i, whole = pop(heap)
            left = part[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or left + part[j] != whole:
                continue
            part[i], part[j] = whole, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = get(whole + part[k])
                if rank is not None:
                    push(heap, (rank, i, whole + part[k]))
            h = before[i]
            if h >= 0:
                rank = get(part[h] + whole)
                if rank is not None:
                    push(heap, (rank, h, part[h] + whole))
        ranks = self.ranks
        return [ranks[x] for x in part if x is not None]

    def encoder(self) -> Encoder:
        return Encoder(lambda found: [self.merge(x) for x in found], self.whole)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, one token after the other, and where each id's bytes begin (n + 1)."""
        place = self.place[ids]
        size = self.sizes[place]
        return self.data[ragged(self.starts[place], size)], np.concatenate([[0], np.cumsum(size)])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[Vocabulary, Encoder]:
    """One for each Python worker."""
    own = Vocabulary(read_ranks(path))
    return own, own.encoder()


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 (bytes decoded from the ids).

    keep_ids adds ids (binary, the same layout).  Rows are independent: repeated rows and ids give repeated results,
    null and empty texts no ids.  No shuffle; a worker holds about 1 MB of text, or one longer text, at a time.
    """

    def run(batches):
        own, encoder = vocabulary(path)
        for batch in batches:
            for part in by_bytes(batch, text_col):
                data, bounds = text_parts(part.column(text_col))
                ids, first = encoder.ids(data, bounds)
                raw = memoryview(ids.astype("<u4").tobytes())
                back, place = own.decode(ids)
                back, cut = memoryview(back.tobytes()), place[first].tolist()
                at = (first * 4).tolist()
                n = len(first) - 1
                columns = [
                    part.column(id_col),
                    pa.array(np.diff(first), pa.int64()),
                    pa.array([hashlib.sha256(raw[at[i] : at[i + 1]]).hexdigest() for i in range(n)], pa.string()),
                    pa.array([hashlib.sha256(back[cut[i] : cut[i + 1]]).hexdigest() for i in range(n)], pa.string()),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns.append(pa.array([bytes(raw[at[i] : at[i + 1]]) for i in range(n)], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)
