"""Shared helpers: reading tables, word scanning, hashes of byte spans and ragged numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.core import checkpoint_dir, cut, hinted, small

__all__ = ["BATCH_BYTES", "WORD_RE", "by_bytes", "checkpoint_dir", "cut", "hinted", "mix", "ragged", "small", "span_blocks", "span_hashes", "table", "text_parts", "word_spans"]

#: Words are runs of anything but these six ASCII white-space characters.
WORD_RE = r"[^\x20\x09-\x0D]+"

#: Bytes of text that Python looks at together.
BATCH_BYTES = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)
#: The lowest k bytes of a block.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every piece, one piece after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", held.data, strides=(1,))


def span_blocks(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of the bytes of each span; which spans are longer than seven bytes, their blocks of eight bytes one after the other, and how many each has.

    Up to seven bytes map one to one.  Of longer spans every block is mixed with a key of its place before the blocks are
    summed, so no pattern of the bytes carries over into the sum, as it does with powers modulo 2**64.  Other seeds give
    independent hashes.
    """
    view, size = blocks(data), end - start
    key = mix(np.array([seed], np.uint64) * _P)[0]
    out = mix(((view[start] & _MASKS[np.minimum(size, 7)]) | (size.astype(np.uint64) << np.uint64(56))) ^ key)
    long = np.flatnonzero(size > 7)
    if not len(long):
        return out, long, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = (size[long] + 7) >> 3
    first = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(first, count)
    held = view[np.repeat(start[long], count) + 8 * place]
    last = first + count - 1
    held[last] &= _MASKS[size[long] - 8 * (count - 1)]
    mixed = mix(held ^ mix((place.astype(np.uint64) + key) * _P + np.uint64(1)))
    out[long] = mix(np.add.reduceat(mixed, first) ^ mix(size[long].astype(np.uint64) + key))
    return out, long, held, count


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they stand."""
    return span_blocks(data, start, end, seed)[0]


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word in texts that lie one after the other (bounds: n + 1 offsets), and the first word of each text (n + 1)."""
    word = np.ones(len(data) + 2, bool)
    word[0] = word[-1] = False
    word[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    change = word[1:] != word[:-1]
    begins = change & word[1:]
    ends = change & word[:-1]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    joined = inner[word[inner] & word[inner + 1]]  # a word that runs over a text's end is two
    begins[joined] = True
    ends[joined] = True
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends), np.searchsorted(start, bounds)


def text_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets (from 0) of an Arrow string or binary array; null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.large_binary()), np.int64
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def by_bytes(batch, column: str, limit: int = BATCH_BYTES):
    """Slices of an Arrow batch whose texts hold about limit bytes; a longer text stands alone."""
    _, bounds = text_parts(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to
