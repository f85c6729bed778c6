"""Periodic runs of words by Karp-Miller-Rosenberg naming, within each text.

Level k names every block of 2**k words, so that two blocks have equal names if and only if their words are equal; the names
of level k + 1 are the ranks of pairs of level k.  Blocks that come only once in their text have no name, and no name above.
How far two places agree, forwards or backwards, follows from the levels in falling order.  A run of period q and at least
max(least, times * q) words has at least S = that - q places where the word equals the one q words on, so it holds a block of
2**k <= (S + 1) / 2 words at a multiple of S + 1 - 2**k whose name comes again q words on: these grid places are the
candidates, and each that fits is extended both ways.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, by_bytes, ragged, text_parts, word_spans

#: Grid places that are looked at together.
PLACES = 1 << 21
RUNS = "array<struct<start: long, length: long, period: long>>"


def word_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    held = data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    offsets = np.append(0, np.cumsum(end - start))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
    return np.asarray(words.dictionary_encode().indices).astype(np.int64)


def levels(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row k: the name of the block of 2**k words from each place on, -1 where it leaves its text or comes only once there.

    One more column of -1 follows, so that places one before the first and one after the last have no name.
    """
    n = len(word)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    out, at, width = [], np.arange(n), 1
    key = text * (int(word.max(initial=0)) + 1) + word
    while True:
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[name] > 1
        if not again.any():
            break
        row = np.full(n + 1, -1, np.int32)
        row[at[again]] = name[again]
        out.append(row)
        at = at[again]
        at = at[at + 2 * width <= end[at]]
        at = at[row[at + width] >= 0]
        key = row[at].astype(np.int64) * n + row[at + width]
        width *= 2
    return np.stack(out) if out else np.zeros((0, n + 1), np.int32)


def agree_after(names: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words from x on equal those from y on, for places x < y."""
    out = np.zeros(len(x), np.int64)
    for k in range(len(names) - 1, -1, -1):
        row = names[k]
        here = row[x + out]
        out += ((here >= 0) & (here == row[y + out])).astype(np.int64) << k
    return out


def agree_before(names: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words just before x equal those before y, for places x < y."""
    out = np.zeros(len(x), np.int64)
    for k in range(len(names) - 1, -1, -1):
        row = names[k]
        here = row[np.maximum(x - out - (1 << k), -1)]
        out += ((here >= 0) & (here == row[np.maximum(y - out - (1 << k), -1)])).astype(np.int64) << k
    return out


def find_runs(word: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (place among all words), length and period of every run, by start, then period."""
    names = levels(word, first)
    size, none = np.diff(first), np.zeros(0, np.int64)
    if not len(names):
        return none, none, none
    text = np.repeat(np.arange(len(size)), size)
    top = np.full(len(size), -1)  # the highest level with a name
    for k, row in enumerate(names):
        top[text[np.flatnonzero(row[:-1] >= 0)]] = k
    period = np.arange(1, max(int(size.max()) // times, 0) + 1)
    stretch = np.maximum(least, times * period) - period
    level = np.floor(np.log2((stretch + 1) / 2) + 1e-9).astype(np.int64)
    step = stretch + 1 - (1 << level)
    rising = np.minimum.accumulate(level[::-1])[::-1]
    most = np.minimum(size // times, np.searchsorted(rising, top, side="right"))  # periods that a text may have
    most[size < least] = 0
    owner, q = np.repeat(np.arange(len(size)), most), ragged(np.ones(len(size), np.int64), most)
    fits = level[q - 1] <= top[owner]
    owner, q = owner[fits], q[fits]
    s, k = step[q - 1], level[q - 1]
    count = np.maximum((size[owner] - q - (1 << k)) // s + 1, 0)
    done, found = np.cumsum(count), []
    flat, row = names.ravel(), names.shape[1]
    at = 0
    while at < len(q):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PLACES, side="right")))
        many = count[at:to]
        pair = np.repeat(np.arange(at, to), many)
        x = first[owner[pair]] + ragged(np.zeros(len(many), np.int64), many) * s[pair]
        here = flat[k[pair] * row + x]
        fits = np.flatnonzero(here >= 0)
        fits = fits[here[fits] == flat[k[pair[fits]] * row + x[fits] + q[pair[fits]]]]
        x, p = x[fits], q[pair[fits]]
        back = agree_before(names, x, x + p)
        length = back + agree_after(names, x, x + p) + p
        good = length >= np.maximum(least, times * p)
        found.append(np.stack([(x - back)[good], length[good], p[good]]))
        at = to
    start, length, p = np.concatenate(found, axis=1) if found else (none, none, none)
    order = np.lexsort((p, length, start))  # one stretch of words is found from many places, and with multiples of its period
    start, length, p = start[order], length[order], p[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[new], length[new], p[new]
    order = np.lexsort((p, start))
    return start[order], length[order], p[order]


def collapsed(data: np.ndarray, bounds: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    a, b = start[kept], end[kept]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[kept]
    follows = b[:-1][text[:-1] == text[1:]]  # ends of words that another one follows; white space is there
    mark = np.zeros(len(data) + 1, np.int8)
    mark[a] += 1
    mark[b] -= 1
    taken = np.cumsum(mark[:-1], dtype=np.int8) > 0
    taken[follows] = True
    held = data.copy()
    held[follows] = 32
    offsets = np.append(0, np.cumsum(taken))[bounds]
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(held[taken])])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """Per row: doc_id, runs (start and length in words, smallest period; by start, then period) and collapsed.

    A run is a stretch of words with smallest period q and at least max(least, times * q) words, times at least 2, that no
    neighbouring word extends.  collapsed has the words that no run covers after its first q, joined by one space.  Null and
    empty texts have no runs and collapse to an empty text; null ids and repeated rows stay; an empty table gives no rows.
    A text is looked at whole: 4 bytes a word for every level up to its longest repeated block.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods at least")

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text"):
                data, bounds = text_parts(part.column("text"))
                start, end, first = word_spans(data, bounds)
                at, length, period = find_runs(word_numbers(data, start, end), first, least, times)
                cover = np.zeros(len(start) + 1, np.int64)
                np.add.at(cover, at + period, 1)
                np.add.at(cover, at + length, -1)
                text = collapsed(data, bounds, start, end, first, np.cumsum(cover[:-1]) == 0)
                place = np.searchsorted(at, first)
                own = at - first[np.searchsorted(first, at, side="right") - 1]
                found = pa.StructArray.from_arrays([pa.array(own), pa.array(length), pa.array(period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(place, pa.int32()), found), text.cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where about a tenth of the texts, chosen by the CRC of their ids, become periodic from some word on; null ids are left alone."""
    word = re.compile(WORD_RE)

    def run(batches):
        for batch in batches:
            ids, hit = batch.column("doc_id").to_pylist(), {}
            for i, doc in enumerate(ids):
                h = 1 if doc is None else zlib.crc32(str(doc).encode())
                words = word.findall(batch.column("text")[i].as_py() or "") if h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    hit[i] = " ".join(words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a])
            text = batch.column("text")
            if hit:
                new = pa.array([hit.get(i) for i in range(len(ids))], text.type)
                text = pa.compute.if_else(pa.array([i in hit for i in range(len(ids))]), new, text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text], ["doc_id", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, text string")


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of periodic_runs: n_runs, the longest run (ties: smallest start, then period; else nulls) and SHA-256 digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), period.alias("period"), F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
