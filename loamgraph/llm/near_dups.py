"""Near-duplicate groups by a chosen-path set similarity join.

Documents with equal shingle sets become one class first.  Each of TREES trees starts with all classes in one node.  A node
with more than LIMIT classes branches on the minwise token of one or (in one case of four) two coordinates that its key
chooses, 1 / 0.8 on average, so two sets of similarity 0.8 stay together with some chance in each tree; a smaller node is
compared exhaustively by sketches.  A node that is still large at the last level is dealt into blocks, each with the node's
smallest class.  Candidates are confirmed on full sets.  Three rounds: every class proposes its best partner and its smallest
one; then its best partner in another component; then full sets meet within their nodes, for all pairs of components that
are still apart; classes outside a large node's main component meet all its classes, in tiles of bounded size.

With 16 trees a pair of similarity 0.8 misses all of them with a probability of about 1e-7 at level 3, 1e-6 at level 4 and
1e-5 at level 6, and its sketch with about 1e-6; higher similarities miss far less, and components mostly hold together by
several links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import by_bytes, cut, hinted, mix, span_hashes, text_parts, word_spans

#: Minwise coordinates to branch on (16 bits each), and those of the sketch (a byte each).
COORDINATES = 96
SKETCH = 64
TREES = 16
LIMIT = 200
#: Similarity of unrelated documents, about: so deep a tree thins them out that a node is large only if its classes are related.
BACKGROUND = 0.07
#: Sketch bytes that must agree: 0.8 less five standard deviations.
AGREE = 35
PERCENT = 80

_TWO = np.uint64(1 << 62)  # one case of four


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and each text's place (n + 1).

    Words are lower-cased in A-Z.  A text with fewer words than `width` has its whole sequence as one shingle, without words none.
    """
    upper = (data >= 65) & (data <= 90)
    data = data + (upper * 32).astype(np.uint8)
    start, end, first = word_spans(data, bounds)
    hashes = span_hashes(data, start, end)
    n, total = np.diff(first), len(hashes)
    size = max(total - width + 1, 0)
    out = np.zeros(size, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + size]
    text = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(text[:size] == text[width - 1 : width - 1 + size])
    own, of = mix(out[inside]), text[inside]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = np.array([np.uint64(int.from_bytes(hashlib.blake2b(hashes[first[i] : first[i + 1]].tobytes(), digest_size=8).digest(), "little")) for i in short], np.uint64)
        own, of = np.concatenate([own, whole]), np.concatenate([of, short])
    order = np.lexsort((own, of))
    own, of = own[order], of[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
    return own[new], np.searchsorted(of[new], np.arange(len(n) + 1))


def minhashes(sets: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each set's minwise tokens as bytes: two for each branching coordinate, one for each of the sketch; empty sets have zeros."""
    x = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    factors = mix(np.arange(1, COORDINATES + SKETCH + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    full = np.flatnonzero(np.diff(place))
    least = np.zeros((len(place) - 1, len(factors)), np.uint32)
    at = place[:-1][full]
    for k, factor in enumerate(factors if len(at) else ()):
        y = x * factor
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        least[full, k] = np.minimum.reduceat(y, at) * np.uint32(0x9E3779B1)
    wide = (least[:, :COORDINATES] >> np.uint32(16)).astype("<u2")
    return np.concatenate([wide.view(np.uint8), (least[:, COORDINATES:] >> np.uint32(24)).astype(np.uint8)], axis=1)


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, h (hash of the text), text where the id is null, n_shingles, a and b (128 bits of the set's hash) and sig."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                data, bounds = text_parts(part.column("text"))
                sets, place = shingle_sets(data, bounds, width)
                sig = minhashes(sets, place)
                n = len(bounds) - 1
                ends = place.tolist()
                keys = np.frombuffer(b"".join(hashlib.blake2b(sets[ends[i] : ends[i + 1]].tobytes(), digest_size=16).digest() for i in range(n)), np.int64).reshape(n, 2)
                nameless = np.flatnonzero(part.column("doc_id").is_null().to_numpy(zero_copy_only=False)).tolist()
                text = [None] * n
                for i in nameless:
                    text[i] = part.column("text")[i].as_py()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(text, pa.string()), pa.array(np.diff(place), pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "h", "text", "n_shingles", "a", "b", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    return rows.mapInArrow(run, "doc_id long, h long, text string, n_shingles long, a long, b long, sig binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def branches(paths: DataFrame) -> DataFrame:
    """rep and its nodes one level below those of paths (rep, key, sig); a null key stands for the roots of all trees."""

    def run(batches):
        for batch in batches:
            sig = np.ascontiguousarray(_matrix(batch.column("sig"))[:, : 2 * COORDINATES]).view("<u2")
            rep, root = np.asarray(batch.column("rep")), np.asarray(batch.column("key").is_null())
            key = np.asarray(batch.column("key").fill_null(0)).view(np.uint64)
            new, old = np.flatnonzero(root), np.flatnonzero(~root)
            row = np.concatenate([old, np.repeat(new, TREES)])
            key = np.concatenate([key[old], np.tile(mix(np.arange(TREES, dtype=np.uint64) + np.uint64(0xC0FFEE)), len(new))])
            one = mix(key ^ np.uint64(1)) % np.uint64(COORDINATES)
            two = mix(key ^ np.uint64(2)) % np.uint64(COORDINATES)
            both = np.flatnonzero((mix(key ^ np.uint64(3)) < _TWO) & (one != two))
            row, key, coordinate = np.concatenate([row, row[both]]), np.concatenate([key, key[both]]), np.concatenate([one, two[both]])
            key = mix(key ^ mix((coordinate << np.uint64(16)) + sig[row, coordinate.astype(np.int64)].astype(np.uint64) + np.uint64(1 << 32)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[row]), pa.array(key.view(np.int64))], ["rep", "key"])

    return paths.select("rep", "key", "sig").mapInArrow(run, "rep long, key long")


def depth_for(n: int) -> int:
    """Levels after which n unrelated classes are thinned out to small nodes."""
    return max(1, math.ceil(math.log(max(n, 1) / LIMIT) / math.log(1 / BACKGROUND)))


def leaves(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Small nodes (group, rep), and the large ones of the last level (node, blocks, rep, least: its smallest class), or None.

    Only the paths that stand in large nodes go on to the next level; these are checkpointed rows of a class and its node.
    """
    small, levels = None, depth_for(reps.count())
    paths = reps.select("rep", F.lit(None).cast("long").alias("key"), "sig")
    for level in range(1, levels + 1):
        rows = branches(paths)
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least")).where("n > 1")
        got = cut(rows.join(sizes, "key").select(F.col("key").alias("group"), "rep", "n", "least"))
        part = got.where(F.col("n") <= LIMIT).select("group", "rep")
        small = part if small is None else small.unionByName(part)
        large = got.where(F.col("n") > LIMIT)
        if not large.limit(1).count():
            return small, None
        if level == levels:
            return small, large.select(F.col("group").alias("node"), F.ceil(F.col("n") / LIMIT).alias("blocks"), "rep", "least")
        paths = large.select("rep", F.col("group").alias("key")).join(reps.select("rep", "sig"), "rep")


def in_blocks(dense: DataFrame) -> DataFrame:
    """group, rep of the blocks of large nodes: each class in its own one, the smallest class in all."""
    own = dense.select(F.xxhash64("node", F.pmod(F.xxhash64("node", "rep"), "blocks")).alias("group"), "rep")
    every = dense.where("rep = least").select("node", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    return own.unionByName(every.select(F.xxhash64("node", "block").alias("group"), "rep")).distinct()


def in_tiles(held: DataFrame) -> DataFrame:
    """group, rep: every pair of a large node's classes meets in a group unless both are of the node's largest component.

    held: node, rep, comp.  Classes outside that component meet each other within their node, in pairs of tiles of about
    LIMIT.  They meet the component's classes once for all nodes in which it is the largest: those that are outside in any
    of these nodes, in tiles of five times LIMIT, with those that are inside in any, in tiles of LIMIT.  So groups are small
    whatever a node's size; their number grows with outside x all classes / LIMIT^2.
    """
    comps = held.groupBy("node", "comp").agg(F.count("*").alias("n"))
    main = comps.groupBy("node").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("total"))
    main = main.select("node", F.col("m.comp").alias("main"), F.ceil((F.col("total") - F.col("m.n")) / LIMIT).alias("tiles")).where("tiles > 0")
    rows = cut(held.join(main, "node").withColumn("out", F.col("comp") != F.col("main")))

    def upto(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("other")

    within = rows.where("out").select("node", "rep", "tiles", F.pmod(F.xxhash64("node", "rep"), "tiles").alias("tile")).select("node", "rep", "tile", upto("tiles"))
    both = within.select(F.xxhash64("node", F.lit("out"), F.least("tile", "other"), F.greatest("tile", "other")).alias("group"), "rep")
    sides = rows.select("main", "rep", "out").distinct()
    sizes = sides.groupBy("main").agg(F.ceil(F.sum(F.col("out").cast("int")) / (5 * LIMIT)).alias("outside"), F.ceil(F.sum((~F.col("out")).cast("int")) / LIMIT).alias("inside"))
    tiled = cut(sides.join(sizes, "main").withColumn("tile", F.pmod(F.xxhash64("main", "rep"), F.when(F.col("out"), F.col("outside")).otherwise(F.col("inside")))))
    visits = tiled.where("out").select("main", "rep", "tile", upto("inside")).select(F.xxhash64("main", F.lit("in"), "tile", "other").alias("group"), "rep")
    hosts = tiled.where("NOT out").select("main", "rep", "tile", upto("outside")).select(F.xxhash64("main", F.lit("in"), "other", "tile").alias("group"), "rep")
    return both.unionByName(visits).unionByName(hosts)


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All i < j within consecutive groups of the given sizes."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(int(sizes.sum())) - first
    left = np.repeat(np.arange(len(place)), place)  # the later one
    right = np.arange(len(left)) - np.repeat(np.cumsum(place) - place, place) + np.repeat(first, place)
    return right, left


def _likely(group: np.ndarray, n: np.ndarray, comp: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i, j of one group and different components that may be linked, and their sketch bytes that agree; whole groups."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(starts, len(group)))
    found = []
    at = 0
    while at < len(sizes):  # groups with about a quarter of a million pairs at a time
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:].astype(np.int64) ** 2), 500_000)))
        i, j = _pairs(sizes[at:to])
        i, j = i + starts[at], j + starts[at]
        ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        agree = (sketch[i] == sketch[j]).sum(axis=1, dtype=np.int16)
        ok = agree >= AGREE
        found.append((i[ok], j[ok], agree[ok]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found))


def _whole_groups(batches):
    """Tables of whole groups from batches that are sorted by group."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        group = rest.column("group").to_numpy()
        whole = int(np.searchsorted(group, group[-1])) if len(group) else 0  # the last group may go on
        if whole:
            yield rest.slice(0, whole)
            rest = rest.slice(whole)
    if rest is not None and rest.num_rows:
        yield rest


def _by_group(groups: DataFrame, *columns: str) -> DataFrame:
    return groups.select("group", "rep", *columns).repartition("group").sortWithinPartitions("group", "rep")


def proposals(groups: DataFrame) -> DataFrame:
    """x < y and the bytes that agree: each class's best partner in another component of a group, and its smallest one.

    groups: group, rep, n, comp, sketch.
    """

    def run(batches):
        for table in _whole_groups(batches):
            rep = table.column("rep").to_numpy()
            i, j, agree = _likely(table.column("group").to_numpy(), table.column("n").to_numpy(), table.column("comp").to_numpy(), _matrix(table.column("sketch")))
            a, b, s = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([agree, agree])
            chosen = [np.zeros(0, np.int64)]
            for order in (np.lexsort((rep[b], -s, a)), np.lexsort((rep[b], a))):
                chosen.append(order[np.append(True, a[order[1:]] != a[order[:-1]])] if len(order) else order)
            x = np.unique(np.concatenate(chosen))
            a, b, s = a[x], b[x], s[x]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[a], rep[b])), pa.array(np.maximum(rep[a], rep[b])), pa.array(s.astype(np.int32))], ["x", "y", "agree"])

    return _by_group(groups, "n", "comp", "sketch").mapInArrow(run, "x long, y long, agree int")


def undecided(groups: DataFrame) -> DataFrame:
    """group and rep of classes that may be linked with one of another component in their group.  groups: as for proposals."""

    def run(batches):
        for table in _whole_groups(batches):
            i, j, _ = _likely(table.column("group").to_numpy(), table.column("n").to_numpy(), table.column("comp").to_numpy(), _matrix(table.column("sketch")))
            rows = pa.array(np.unique(np.concatenate([i, j])))
            yield table.select(["group", "rep"]).take(rows).combine_chunks().to_batches()[0] if len(rows) else pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["group", "rep"])

    return _by_group(groups, "n", "comp", "sketch").mapInArrow(run, "group long, rep long")


def _common(sets: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sizes of all intersections of a group's sets, by products of incidence matrices of the shingles that two or more have."""
    m = len(place) - 1
    _, back, count = np.unique(sets, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    shared = np.flatnonzero(count[back] > 1)
    column, row = number[back[shared]], np.repeat(np.arange(m), np.diff(place))[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out, step = np.zeros((m, m), np.float32), 4096
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        a, b = np.searchsorted(column, (low, low + step))
        matrix = np.zeros((m, step), np.float32)
        matrix[row[a:b], column[a:b] - low] = 1
        out += matrix @ matrix.T
    return out.astype(np.int64)


def linked_in_groups(groups: DataFrame, width: int) -> DataFrame:
    """x, y: of each two components of a group one pair of classes whose full sets have the similarity.  groups: group, rep, comp, text."""

    def run(batches):
        for table in _whole_groups(batches):
            group = table.column("group").to_numpy()
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist()
            for a, b in zip(starts, [*starts[1:], len(group)]):
                part = table.slice(a, b - a)
                rep, comp = part.column("rep").to_numpy(), part.column("comp").to_numpy()
                sets, place = shingle_sets(*text_parts(part.column("text")), width)
                n, common = np.diff(place), _common(sets, place)
                i, j = np.nonzero((100 * common >= PERCENT * (n[:, None] + n[None, :] - common)) & (common > 0) & (comp[:, None] < comp[None, :]))
                _, one = np.unique(np.stack([comp[i], comp[j]]), axis=1, return_index=True)
                x, y = rep[i[one]], rep[j[one]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])

    return _by_group(groups, "comp", "text").mapInArrow(run, "x long, y long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs x, y whose full shingle sets have the similarity.  texts: rep, text."""

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text_x"):
                left, left_place = shingle_sets(*text_parts(part.column("text_x")), width)
                right, right_place = shingle_sets(*text_parts(part.column("text_y")), width)
                n = part.num_rows
                sizes = np.diff(left_place) + np.diff(right_place)
                pair = np.concatenate([np.repeat(np.arange(n), np.diff(left_place)), np.repeat(np.arange(n), np.diff(right_place))])
                both = np.concatenate([left, right])
                order = np.lexsort((both, pair))
                both, pair = both[order], pair[order]
                common = np.bincount(pair[1:][(both[1:] == both[:-1]) & (pair[1:] == pair[:-1])], minlength=n)
                good = (sizes > 0) & (100 * common >= PERCENT * (sizes - common))
                yield part.filter(pa.array(good)).select(["x", "y"])

    one = pairs.select("x", "y").join(texts.select(F.col("rep").alias("x"), F.col("text").alias("text_x")), "x")
    two = one.join(texts.select(F.col("rep").alias("y"), F.col("text").alias("text_y")), "y")
    return two.select("x", "y", "text_x", "text_y").mapInArrow(run, "x long, y long")


def _few_per_class(pairs: DataFrame) -> DataFrame:
    """Of all proposals each class keeps its best one and the one with its smallest partner."""
    both = pairs.select(F.col("x").alias("u"), F.col("y").alias("v"), "agree").unionByName(pairs.select(F.col("y").alias("u"), F.col("x").alias("v"), "agree"))
    best = both.groupBy("u").agg(F.max(F.struct("agree", (-F.col("v")).alias("v"))).alias("best"), F.min("v").alias("least"))
    out = best.select("u", F.explode(F.array(-F.col("best.v"), F.col("least"))).alias("v"))
    return out.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y")).distinct()


def _grouped(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, h (hash of the text), n_shingles, component_id, kept, and stays: whether one_of_each leaves it.

    A class is named by its smallest id; one whose ids are all null by a number above all ids, which is no component_id.
    """
    base = cut(signatures(docs, width, id_col, text_col))
    top = max(base.agg(F.max("doc_id")).head()[0] or 0, 0)
    surrogate = F.lit(top + 1) + F.pmod(F.xxhash64("a", "b"), F.lit(max((1 << 63) - 2 - top, 1)))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "h", "n_shingles", "sig", "text")).alias("m")
    named = base.where("n_shingles > 0").groupBy("a", "b").agg(least).select("a", "b", F.when(F.col("m.nameless"), surrogate).otherwise(F.col("m.doc_id")).alias("rep"), F.col("m.h").alias("own"), F.col("m.n_shingles").alias("n"), F.col("m.sig").alias("sig"), F.col("m.text").alias("text"))
    classes = cut(named)
    reps = classes.select("rep", "n", "sig")
    small, dense = leaves(reps)
    sketched = reps.select("rep", "n", F.expr(f"substring(sig, {2 * COORDINATES + 1}, {SKETCH})").alias("sketch"))
    own = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).unionByName(classes.where(F.col("rep") > top).select("rep", "text"))

    def texts_of(ids: DataFrame) -> DataFrame:
        return own.join(hinted(cut(ids.distinct()), 300_000), "rep", "left_semi")

    def confirm(pairs: DataFrame) -> DataFrame:
        return cut(confirmed(pairs, texts_of(pairs.select(F.explode(F.array("x", "y")).alias("rep"))), width).distinct())

    found = small.unionByName(cut(in_blocks(dense))) if dense is not None else small
    first = cut(proposals(found.join(sketched, "rep").withColumn("comp", F.col("rep"))).groupBy("x", "y").agg(F.max("agree").alias("agree")))
    tried = cut(_few_per_class(first))
    links = confirm(tried)
    alive = cut(first.select(F.explode(F.array("x", "y")).alias("rep")).distinct())

    def named_by(comps: DataFrame) -> DataFrame:
        named = alive.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("comp"))
        return hinted(cut(named), 300_000)

    def apart(groups: DataFrame, named: DataFrame) -> DataFrame:
        """The rows of groups that hold several components."""
        rows = groups.join(named, "rep")
        several = rows.groupBy("group").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("group")
        return rows.join(several, "group").join(sketched, "rep")

    # a round without pairs or groups changes nothing: what would follow it is not planned, since the driver holds every plan
    comps = cut(connected_components(links, "x", "y"))
    named = named_by(comps)
    more = proposals(apart(found, named)).groupBy("x", "y").agg(F.max("agree").alias("agree"))
    more = cut(_few_per_class(more).join(tried, ["x", "y"], "left_anti"))
    if more.limit(1).count():
        links = cut(links.unionByName(confirm(more)))
        comps = cut(connected_components(links, "x", "y"))
        named = named_by(comps)
    rest, every = undecided(apart(small, named)), named
    if dense is not None:
        held = cut(dense.join(named, "rep", "left").select("node", "rep", F.coalesce("comp", "rep").alias("comp")))
        every = hinted(cut(held.select("rep", "comp").unionByName(named).distinct()), 300_000)  # with classes of large nodes that have no candidate yet
        rest = rest.unionByName(undecided(apart(in_tiles(held), every)))
    rest = cut(rest.distinct())
    if rest.limit(1).count():
        full = rest.join(every, "rep").join(texts_of(rest.select("rep")), "rep")
        links = cut(links.unionByName(linked_in_groups(full, width)).distinct())
        comps = cut(connected_components(links, "x", "y"))
    named = classes.select("a", "b", "rep", "own").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    out = base.select("doc_id", "h", "n_shingles", "a", "b").join(named, ["a", "b"], "left")
    component = F.coalesce("component", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(False))
    nameless = F.col("doc_id").isNull() & ((F.col("n_shingles") == 0) | ((F.col("rep") > top) & (F.col("rep") == component) & (F.col("h") == F.col("own"))))
    return out.select("doc_id", "h", "n_shingles", F.when(component <= top, component).alias("component_id"), kept.alias("kept"), (kept | nameless).alias("stays"))


def near_duplicates(docs: DataFrame, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links, itself included) and kept.

    Null and empty texts have no shingles and are linked with nothing.  Equal sets are one class, so repeated rows and
    copies are linked; rows of one id count as one document.  A row with a null id links others but is not kept; its
    component_id is null if its component has no id.  An empty table gives no rows.
    """
    return _grouped(docs, width, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns; of rows that repeat id and text one stays.

    Of a component without ids one text stays; rows without ids whose component has an id do not.
    """
    gone = _grouped(docs, width, id_col, text_col).where("NOT stays").select(F.col("doc_id").alias("_gone"), F.col("h").alias("_gone_h")).distinct()
    gone = hinted(cut(gone), 300_000)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_h"))
    once = whole.dropDuplicates(["_id", "_h"])
    return once.join(gone, once["_id"].eqNullSafe(gone["_gone"]) & (once["_h"] == gone["_gone_h"]), "left_anti").select("_row.*")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS ss FROM d),
n AS (SELECT doc_id, len(ss)::BIGINT AS n FROM s),
e AS (SELECT doc_id, md5_number_lower(unnest(ss)) AS h FROM s),
c AS (SELECT x.doc_id AS x, y.doc_id AS y, count(*) AS c FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
b AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, b.v FROM r JOIN b ON b.u = r.v)
SELECT n.doc_id, n.n AS n_shingles, min(r.v) AS component_id, min(r.v) = n.doc_id AS kept FROM n JOIN r ON r.u = n.doc_id GROUP BY n.doc_id, n.n
"""
