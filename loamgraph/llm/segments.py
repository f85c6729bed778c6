"""Byte-level BPE over distinct pre-tokens.

A text is cut by the byte-level pattern, whose pieces never merge with each other, so a piece's ids don't depend on
what stands around it.  The cut is done on whole Arrow batches in numpy; each distinct piece of a batch is looked up
once, and only pieces that a worker hasn't met go to an encoder.  Every hit is compared with the piece's bytes.  Long texts
go through in parts.  Memory is bounded by the batch and by CACHE pieces in two generations, so frequent pieces stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from .common import BATCH_BYTES, ragged, span_blocks

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: Pieces that a worker remembers, about: half of them in a young generation; when that is full, it replaces the old one.
CACHE = 400_000


# fixed values: white space of the pattern's \s
WHITE = (9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point."""
    if not _classes:
        names = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
        out = np.zeros(0x110000, np.uint8)
        out[names == "L"] = LETTER
        out[names == "N"] = NUMBER
        out[list(WHITE)] = SPACE
        _classes.append(out)
    return _classes[0]


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the pieces of texts that lie one after the other (n_pieces + 1), and each text's first piece (n + 1)."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(bounds), np.int64)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)  # byte offset of each character
    cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    kind = classes()[cp]
    first = np.searchsorted(at, bounds[:-1][bounds[:-1] < bounds[1:]])
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    run = head[:n].copy()  # where a run of one class begins
    run[1:] |= kind[1:] != kind[:-1]
    blank = kind == SPACE
    plain = cp == 32
    start = run.copy()
    glued = np.zeros(n, bool)  # begins right after a space of the same text
    glued[1:] = plain[:-1] & ~head[1:n]
    start &= blank | ~glued
    last = np.zeros(n, bool)  # the last of a white-space run that something follows
    last[:-1] = blank[:-1] & ~blank[1:] & ~head[1:n]
    start |= last
    quote = np.flatnonzero((cp == 0x27) & run & ~glued)
    if len(quote):
        def sees(k: int, letters: str) -> np.ndarray:
            i = np.minimum(quote + k, n - 1)
            inside = quote + k < n
            for j in range(1, k + 1):
                inside &= ~head[np.minimum(quote + j, n)]
            return inside & np.isin(cp[i], [ord(x) for x in letters])

        one = sees(1, "stmd")
        two = (sees(1, "rv") & sees(2, "e")) | (sees(1, "l") & sees(2, "l"))
        for hits, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[hits + 1] = False
            start[(hits + size)[hits + size < n]] = True
    begin = np.flatnonzero(start)
    offsets = np.append(at[begin], len(data))
    return offsets, np.searchsorted(offsets[:-1], bounds)


class Table:
    """Open-addressing map from 64-bit keys to 64-bit values in numpy, for many keys at once."""

    def __init__(self, bits: int = 16):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)
        self.size = 0

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for unknown keys."""
        slot = (keys & self.mask).astype(np.int64)
        out = self.values[slot]
        rest = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))  # few stand elsewhere than in their first slot
        out[rest] = -1
        slot = (slot[rest].astype(np.uint64) + np.uint64(1)) & self.mask
        while len(rest):
            value = self.values[slot]
            hit = (self.keys[slot] == keys[rest]) & (value >= 0)
            out[rest[hit]] = value[hit]
            go = ~hit & (value >= 0)
            rest, slot = rest[go], (slot[go] + np.uint64(1)) & self.mask
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that aren't there yet."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            old = self.values >= 0
            k, v, bits = self.keys[old], self.values[old], int(self.mask).bit_length()
            while 2 * (self.size + len(keys)) > 1 << bits:
                bits += 1
            self.__init__(bits)
            self.put(k, v)
        self.size += len(keys)
        slot = keys & self.mask
        while len(keys):
            free = np.flatnonzero(self.values[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + np.uint64(1)) & self.mask


class Stack:
    """A numpy array that grows at its end."""

    def __init__(self, kind: type):
        self.all, self.used = np.zeros(1 << 12, kind), 0

    def push(self, values: np.ndarray) -> int:
        """Where the values begin."""
        at, self.used = self.used, self.used + len(values)
        if self.used > len(self.all):
            grown = np.zeros(max(self.used, 2 * len(self.all)), self.all.dtype)
            grown[:at] = self.all[:at]
            self.all = grown
        self.all[at : self.used] = values
        return at


class Generation:
    """Pieces by number: their bytes (blocks of eight, if there are more than seven) and their ids."""

    def __init__(self):
        self.table = Table()
        self.ids, self.blocks = Stack(np.int32), Stack(np.uint64)
        self.at, self.size, self.block_at, self.length = Stack(np.int64), Stack(np.int32), Stack(np.int64), Stack(np.int32)

    def push(self, length: np.ndarray, held: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new pieces: byte lengths, blocks of the long ones, ids one after the other, and how many each has."""
        count = np.where(length > 7, (length + 7) >> 3, 0)
        self.block_at.push(self.blocks.push(held) + np.cumsum(count) - count)
        self.at.push(self.ids.push(flat) + np.cumsum(sizes) - sizes)
        self.size.push(sizes)
        return self.length.push(length) + np.arange(len(length))

    def copied(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces as push takes them."""
        length, size = self.length.all[number].astype(np.int64), self.size.all[number].astype(np.int64)
        count = np.where(length > 7, (length + 7) >> 3, 0)
        return length, self.blocks.all[ragged(self.block_at.all[number], count)], self.ids.all[ragged(self.at.all[number], size)], size

    def differ(self, number: np.ndarray, length: np.ndarray, long: np.ndarray, held: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Which spans aren't the pieces of these numbers.  Up to seven bytes equal hashes and lengths mean equal bytes."""
        wrong = self.length.all[number] != length
        same = ~wrong[long]
        some, n = long[same], count[same]
        other = self.blocks.all[ragged(self.block_at.all[number[some]], n)] != held[np.repeat(same, count)]
        wrong[some[np.repeat(np.arange(len(some)), n)[other]]] = True
        return np.flatnonzero(wrong)


class Encoder:
    """encode: ids of each of a list of byte pieces; direct: None, or for distinct pieces at once (data, start, end) the id or -1."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], direct: Callable | None = None, cache: int = CACHE):
        self.encode, self.direct, self.cache = encode, direct, cache
        self.young, self.old = Generation(), Generation()

    @property
    def pool(self) -> np.ndarray:
        return self.young.ids.all

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of pieces that aren't known yet."""
        ids = np.full(len(start), -1, np.int64) if self.direct is None else self.direct(data, start, end)
        rest = np.flatnonzero(ids < 0)
        raw = data.tobytes() if len(rest) > 64 else data
        lists = self.encode([bytes(raw[a:b]) for a, b in zip(start[rest].tolist(), end[rest].tolist())])
        sizes = np.ones(len(start), np.int64)
        sizes[rest] = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.empty(int(sizes.sum()), np.int32)
        at = np.cumsum(sizes) - sizes
        flat[at[ids >= 0]] = ids[ids >= 0]
        flat[ragged(at[rest], sizes[rest])] = np.fromiter((i for x in lists for i in x), np.int32, int(sizes[rest].sum()))
        _, _, held, _ = span_blocks(data, start, end)
        return self.young.push(end - start, held, flat, sizes)

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each span's ids begin in the pool, and how many they are."""
        if 2 * self.young.table.size > self.cache:
            self.old, self.young = self.young, Generation()
        hashes, long, held, count = span_blocks(data, start, end)
        number = self.young.table.get(hashes)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            distinct, index, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            index = miss[index]
            own = self.old.table.get(distinct)
            known, new = np.flatnonzero(own >= 0), np.flatnonzero(own < 0)
            own[known] = self.young.push(*self.old.copied(own[known]))
            own[new] = self._learn(data, start[index[new]], end[index[new]])
            self.young.table.put(distinct, own)
            number[miss] = own[back]
        apart = self.young.differ(number, end - start, long, held, count)
        if len(apart):  # other bytes with the same hash
            number[apart] = self._learn(data, start[apart], end[apart])
        return self.young.at.all[number], self.young.size.all[number].astype(np.int64)

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Ids of each text."""
        if len(parts := in_parts(data, bounds)) > 1:
            return np.array([sum(int(self.counts(x, np.array([0, len(x)]))[0]) for x in parts)])
        offsets, first = pieces(data, bounds)
        _, size = self.lookup(data, offsets[:-1], offsets[1:])
        return np.diff(np.concatenate([[0], np.cumsum(size)])[first])

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, one text after the other, and each text's place in them (n + 1)."""
        if len(parts := in_parts(data, bounds)) > 1:
            flat = np.concatenate([self.ids(x, np.array([0, len(x)]))[0] for x in parts])
            return flat, np.array([0, len(flat)])
        offsets, first = pieces(data, bounds)
        start, size = self.lookup(data, offsets[:-1], offsets[1:])
        return self.pool[ragged(start, size)], np.concatenate([[0], np.cumsum(size)])[first]


def in_parts(data: np.ndarray, bounds: np.ndarray, limit: int = BATCH_BYTES) -> list[np.ndarray]:
    """A long text that stands alone in parts of about limit bytes, else all data.

    The text is cut before a space or line feed that follows an ASCII letter, digit or mark: a piece always begins there,
    and what stands after it has no bearing on the pieces before.  Where a text has no such place it goes on to the next.
    """
    if len(bounds) != 2 or len(data) <= 2 * limit:
        return [data]
    out, at = [], 0
    while len(data) - at > 2 * limit:
        to, step = at + limit, at + limit
        while True:
            some = data[step - 1 : step + limit]
            safe = np.flatnonzero(((some[1:] == 32) | (some[1:] == 10)) & (some[:-1] > 32) & (some[:-1] < 127))
            if len(safe) or step + limit >= len(data):
                break
            step += limit
        if not len(safe):
            break
        to = step + int(safe[0])
        out.append(data[at:to])
        at = to
    return [*out, data[at:]]
