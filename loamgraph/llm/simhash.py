"""Near-duplicate groups by SimHash fingerprints, found by deletion-variant signatures.

A fingerprint has 64 bits.  Of its two halves one differs by at most one bit if two fingerprints differ by at most three, so
each distinct fingerprint is indexed under the 64 variants of its halves with one bit deleted, and an equality join of
variants brings all links together.  Where a half is equal, the variant without its first bit is enough; under any other one
only fingerprints that differ in the deleted bit have to meet.

Fingerprints of one variant differ in 33 bits at most.  Up to LIMIT of them are compared in blocks.  A variant with more is
cut again: the other half has two quarters, one of which differs by at most one bit.  Under these 32 variants of the variant
fingerprints differ in 18 bits, so there are 2**18 at most, however hot the group; the neighbours of each are looked up by
flipping up to three bits.  Groups return trees of links, not all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import _unite, connected_components
from .common import by_bytes, cut, hinted, text_parts, word_spans
from .near_dups import _pairs, _whole_groups

#: Differing bits of a link; the variants below are for this many.
DISTANCE = 3
#: Fingerprints of a variant that are compared at once.
LIMIT = 4096
#: Groups up to this size are compared many at a time.
FEW = 64
SEED = 42

#: The bits of a byte, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_FLIPS = np.array([sum(1 << b for b in bits) for size in range(1, DISTANCE + 1) for bits in combinations(range(18), size)])


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of each text, repeats included, and how many each text has.

    Words are lower-cased in A-Z and joined by one space; a text with fewer words than `width` has its whole sequence as one shingle, without words none.
    """
    start, end, first = word_spans(data, bounds)
    mark = np.zeros(len(data) + 2, np.int8)
    mark[start] += 1
    mark[end] -= 1
    held = np.append(data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32), np.uint8(32))
    taken = np.cumsum(mark[:-1], dtype=np.int8) > 0
    size = end - start
    at = np.cumsum(size) - size  # without any white space
    words = held[taken]
    spaced = np.full(len(words) + len(size), 32, np.uint8)
    spaced[np.arange(len(words)) + np.repeat(np.arange(len(size)), size)] = words
    at = at + np.arange(len(size))  # with one space after each word
    n = np.diff(first)
    many = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), many)
    lead = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    last = np.minimum(lead + width, first[1:][text]) - 1
    raw, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(raw[a:b], SEED) for a, b in zip(at[lead].tolist(), (at[last] + size[last]).tolist())]
    return np.array(hashes, np.uint64), many


def majorities(hashes: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each text the bits that over half of its hashes have; zero without hashes."""
    out = np.zeros((len(many), 64), bool)
    full = np.flatnonzero(many)
    if len(full):
        n = many[full]
        blocks = -(-n // 255)  # so that the bytes don't overflow
        place = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begins = np.repeat(np.cumsum(n) - n, blocks) + 255 * place
        sums = np.add.reduceat(_SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)], begins, axis=0)
        bits = np.add.reduceat(sums.view(np.uint8).reshape(len(begins), 64), np.cumsum(blocks) - blocks, axis=0, dtype=np.int64)
        out[full] = 2 * bits > n[:, None]
    return np.packbits(out, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and fp, the fingerprint's bits as a long."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                fp = majorities(*shingle_hashes(*text_parts(part.column("text")), width))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """fp, key (number of the deleted bit, then the half without it) and bit (the deleted one), 64 rows for each fp."""
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    half = F.expr("shiftrightunsigned(fp, p & 32) & 4294967295L")
    rows = rows.select("fp", "p", half.alias("half"))
    return rows.select("fp", F.expr("shiftleft(CAST(p AS BIGINT), 32) | (half & ~shiftleft(1L, p & 31))").alias("key"), F.expr("shiftright(half, p & 31) & 1L").alias("bit"))


def finer(rows: DataFrame) -> DataFrame:
    """The 32 variants of each variant's other half by quarters: fp and group (key, number of the second deleted bit, the quarter without it)."""
    cross = rows.select("fp", "key", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("p2"))
    quarter = F.expr("shiftrightunsigned(fp, (32 - (CAST(shiftright(key, 32) AS INT) & 32)) + (p2 & 16)) & 65535L")
    cross = cross.select("fp", "key", "p2", quarter.alias("quarter"))
    return cross.select("fp", F.expr("shiftleft(key, 21) | shiftleft(CAST(p2 AS BIGINT), 16) | (quarter & ~shiftleft(1L, p2 & 15))").alias("group"))


def free_bits(group: int) -> list[int]:
    """The 18 bits in which fingerprints of one of the finer groups may differ."""
    p, p2 = group >> 53, (group >> 16) & 31
    other = 32 - (p & 32)
    rest = other + 16 - (p2 & 16)
    return [p, other + p2, *range(rest, rest + 16)]


def _blockwise(x: np.ndarray) -> np.ndarray:
    """For each of the fingerprints x the first one of its component; x are compared in blocks."""
    root = np.arange(len(x))
    for low in range(0, len(x), 256):
        i, j = np.nonzero(np.bitwise_count(x[low : low + 256, None] ^ x[None, low:]) <= DISTANCE)
        root = _joined(root, i + low, j + low)
        if not root.any():
            break
    return root


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = root[i], root[j]
    new = a != b
    return _unite(np.concatenate([np.arange(len(root)), a[new]]), np.concatenate([root, b[new]])) if new.any() else root


def _by_flips(x: np.ndarray, free: list[int]) -> np.ndarray:
    """As _blockwise, for fingerprints that differ in the free bits only: up to three of them are flipped and looked up."""
    place = sum(((x >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << t for t, bit in enumerate(free))
    held = np.full(1 << len(free), -1)
    held[place] = np.arange(len(x))
    root = np.arange(len(x))
    for flip in _FLIPS:
        j = held[place ^ flip]
        i = np.flatnonzero(j >= 0)
        root = _joined(root, i, j[i])
        if not root.any():
            break
    return root


def links_in_groups(groups: DataFrame, flips: bool = False) -> DataFrame:
    """x, y: links that join what is linked within groups, fewer than a group has members.  groups: group, fp, without repeats.

    Members are sorted, so a task that runs again after a lost executor chooses the same links.
    """

    def run(batches):
        for table in _whole_groups(batches):
            group, x = table.column("group").to_numpy(), table.column("rep").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            sizes = np.diff(np.append(starts, len(group)))
            root = np.arange(len(x))
            small = np.flatnonzero((sizes > 1) & (sizes <= FEW))
            at, done = 0, np.cumsum(sizes[small].astype(np.int64) ** 2)
            while at < len(small):  # about a million pairs at a time
                to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + 2_000_000, side="right")))
                some = small[at:to]
                rows = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[some].tolist(), sizes[some].tolist())])
                i, j = _pairs(sizes[some])
                near = np.bitwise_count(x[rows[i]] ^ x[rows[j]]) <= DISTANCE
                root[rows] = rows[_joined(np.arange(len(rows)), i[near], j[near])]
                at = to
            for g in np.flatnonzero(sizes > FEW).tolist():
                a, n = int(starts[g]), int(sizes[g])
                own = x[a : a + n]
                root[a : a + n] = a + (_by_flips(own, free_bits(int(group[a]))) if flips and n > 1024 else _blockwise(own))
            rows = np.flatnonzero(root != np.arange(len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(x[rows].view(np.int64)), pa.array(x[root[rows]].view(np.int64))], ["x", "y"])

    rows = groups.select("group", F.col("fp").alias("rep"))
    return rows.repartition("group").sortWithinPartitions("group", "rep").mapInArrow(run, "x long, y long")


def linked(fps: DataFrame) -> DataFrame:
    """x, y: links between distinct fingerprints with the same components as all pairs of at most three differing bits."""
    rows = variants(fps)
    count = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("bit").alias("ones"))
    live = cut(count.where("n > 1 AND (shiftright(key, 32) & 31 = 0 OR ones BETWEEN 1 AND n - 1)").select("key", "n"))
    met = rows.select("fp", "key").join(hinted(live, 300_000), "key")
    few = links_in_groups(met.where(F.col("n") <= LIMIT).select(F.col("key").alias("group"), "fp"))
    if not live.where(F.col("n") > LIMIT).limit(1).count():
        return few
    return few.unionByName(links_in_groups(finer(met.where(F.col("n") > LIMIT)), flips=True))


def simhash_groups(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest id reachable over links, itself included).

    Rows of one fingerprint are one class, so repeated rows and copies are linked.  Null and empty texts have fingerprint
    zero, which is linked like any other.  A row with a null id links others; its component_id is null if its component has
    no id.  An empty table gives no rows.
    """
    base = cut(fingerprints(docs, width, id_col, text_col))
    classes = cut(base.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = cut(linked(classes.select("fp")).distinct())
    comps = cut(connected_components(links, "x", "y"))
    named = cut(classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    own = named.join(least, "component").select("fp", "component_id")
    return base.join(own, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
