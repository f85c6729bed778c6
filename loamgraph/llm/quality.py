"""Quality rules: base counts of a text, and how public tokenisers fare on it.

Fertility measures: characters per token of a byte-level vocabulary, characters per piece and byte-fallback share of a
vocabulary with byte fallback, and the entropy of the token ids.  Each language, or script where the language has no
entry, has bands; a text outside them is rejected.  Lower bounds follow the number of tokens: they widen with the sampling
error of few tokens, and entropy also grows with the length of clean texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import vocabulary
from .common import by_bytes, mix, span_hashes, text_parts, word_spans
from .segments import Encoder

#: Token numbers between which the bounds follow a text's length.
LENGTHS = (8, 16_384)
#: Share of the clean texts of a fit that may lie below each bound.
SHARE = 0.005
WINDOW = 5
SYMBOLS = b"#*$%&|<>"


class Curve(NamedTuple):
    """A lower bound for texts of n tokens: a + b L + c L^2 - z sqrt(spread^2 + error^2 / n), L being log2 of n within LENGTHS."""

    a: float
    b: float
    c: float
    spread: float
    error: float
    z: float

    def at(self, n: np.ndarray) -> np.ndarray:
        n = np.clip(n, *LENGTHS).astype(float)
        deep = np.log2(n)
        return self.a + self.b * deep + self.c * deep**2 - self.z * np.sqrt(self.spread**2 + self.error**2 / n)


class Band(NamedTuple):
    """Bounds of characters per token, characters per piece, bits of entropy, and byte-fallback share."""

    token_least: Curve
    piece_least: Curve
    entropy_least: Curve
    token_most: float = 8.0
    piece_most: float = 8.0
    byte_most: float = 0.2


def fit_curve(n_tokens: np.ndarray, values: np.ndarray, share: float = SHARE) -> Curve:
    """The curve that about this share of the given clean texts lies below: their mean by length, less z standard deviations."""
    n = np.clip(n_tokens, *LENGTHS).astype(float)
    deep = np.log2(n)
    powers = np.stack([np.ones(len(n)), deep, deep**2], axis=1)
    noise = np.stack([np.ones(len(n)), 1 / n], axis=1)
    sd = 1 / np.sqrt(n)
    for _ in range(5):
        mean = np.linalg.lstsq(powers / sd[:, None], values / sd, rcond=None)[0]
        off = values - powers @ mean
        parts = np.maximum(np.linalg.lstsq(noise / (sd**2)[:, None], off**2 / sd**2, rcond=None)[0], 1e-6)
        sd = np.sqrt(noise @ parts)
    z = -float(np.quantile(off / sd, share))
    return Curve(*(round(float(x), 4) for x in (*mean, *np.sqrt(parts), z)))


def fit_band(n_tokens: np.ndarray, measures: dict[str, np.ndarray], byte_most: float = 0.2) -> Band:
    """A language's band from its clean texts; the measures as measure() gives them."""
    return Band(*(fit_curve(n_tokens, measures[k]) for k in ("chars_per_token", "chars_per_piece", "entropy")), byte_most=byte_most)


def _flat(token: float, piece: float, entropy: float, byte_most: float) -> Band:
    """A wide band for a script without labelled texts: the bounds of long ones, less an assumed sampling error."""
    return Band(*(Curve(x, 0.0, 0.0, 0.0, x / 4, 4.0) for x in (token, piece, entropy)), byte_most=byte_most)


#: By fit_band from labelled clean texts of the 0.1 tables that pass the base rules and whose MD5 starts with a byte under
#: 128: 1,008 en, 254 fr, 243 de, 161 es.  The other half was held out.  Scripts without labelled texts have wide bands.
BANDS = {
    "en": Band(Curve(2.5898, 0.0077, -0.0002, 0.001, 1.1082, 2.5044), Curve(2.2226, -0.0023, 0.0002, 0.001, 0.9668, 3.1259), Curve(1.2837, 0.9239, -0.0368, 0.0349, 1.634, 2.4582)),
    "fr": Band(Curve(2.1595, 0.0436, -0.0018, 0.001, 1.2831, 2.688), Curve(1.8197, 0.0285, -0.0012, 0.001, 1.2083, 3.1136), Curve(1.9094, 0.7957, -0.0323, 0.001, 2.2854, 1.7233)),
    "de": Band(Curve(2.4803, 0.0392, -0.0017, 0.001, 1.2619, 2.7618), Curve(2.1435, 0.0186, -0.0009, 0.001, 1.1359, 2.7941), Curve(1.9066, 0.802, -0.0322, 0.0493, 1.571, 2.3179)),
    "es": Band(Curve(2.1178, 0.0609, -0.0028, 0.014, 1.0255, 2.5959), Curve(1.7231, 0.043, -0.0021, 0.0099, 0.9462, 2.9235), Curve(2.363, 0.6993, -0.0272, 0.0196, 2.374, 2.3283)),
    "latin": _flat(1.60, 1.40, 3.0, 0.3),
    "cyrillic": _flat(0.80, 1.00, 3.0, 0.3),
    "other": _flat(0.20, 0.20, 2.0, 0.9),
}


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Encoder:
    """For each distinct word: its pieces, and how many of them are bytes; one for each Python worker."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = {i for i in range(own.get_piece_size()) if own.is_byte(i)}

    def encode(words: list[bytes]) -> list[list[int]]:
        out = []
        for at in range(0, len(words), 4096):
            for ids in own.encode([w.decode("utf-8") for w in words[at : at + 4096]], num_threads=1):
                out.append([len(ids), sum(i in is_byte for i in ids)])
        return out

    return Encoder(encode)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values from first[i] to first[i + 1]."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[first])


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in windows which the text has twice or more."""
    n = len(hashes)
    if n < width:
        return np.zeros(len(first) - 1, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    window = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        window = window * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k]
    inside = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    own = mix(window[inside] + text[inside].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(own)
    same = own[order[1:]] == own[order[:-1]]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int32)
    at = inside[twice]
    step[at] += 1
    step[at + width] -= 1  # a window's start and end are met once each
    return per_text(np.cumsum(step[:n]) > 0, first)


def duplicate_lines(data: np.ndarray, bounds: np.ndarray, word_start: np.ndarray) -> np.ndarray:
    """Lines of each text that hold a word and equal an earlier line."""
    cut = np.flatnonzero(data == 10)
    start = np.union1d(bounds[:-1], cut + 1)
    start = start[start < len(data)]
    text = np.searchsorted(bounds, start, side="right") - 1
    end = np.append(start[1:], len(data))
    end = np.where((end > start) & (data[np.maximum(end - 1, 0)] == 10), end - 1, end)
    full = np.searchsorted(word_start, end) > np.searchsorted(word_start, start)
    start, end, text = start[full], end[full], text[full]
    own = mix(span_hashes(data, start, end) + text.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    _, one = np.unique(own, return_index=True)
    n = len(bounds) - 1
    return np.bincount(text, minlength=n) - np.bincount(text[one], minlength=n)


def entropy(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits of entropy of each text's token ids; 0 without tokens."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    _, one, count = np.unique(text.astype(np.int64) << 32 | ids, return_index=True, return_counts=True)
    share = count / n[text[one]]
    return -np.bincount(text[one], weights=share * np.log2(share), minlength=len(n)) + 0.0


def script(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text: 0 mostly Latin letters, 1 Cyrillic, 2 others, by the lead bytes of its characters."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    latin = ascii_letter | ((data >= 0xC3) & (data <= 0xCB))
    cyrillic = (data >= 0xD0) & (data <= 0xD4)
    other = ((data >= 0xCC) & (data < 0xD0)) | (data >= 0xD5)
    return np.argmax(np.stack([per_text(x, bounds) for x in (latin, cyrillic, other)]), axis=0)


def measure(data: np.ndarray, bounds: np.ndarray, langs: list[str | None], ranks_path: str, piece_path: str, bands: dict[str, Band] = BANDS) -> dict[str, np.ndarray]:
    """All counts and the verdicts for texts that lie one after the other."""
    start, end, first = word_spans(data, bounds)
    hashes = span_hashes(data, start, end)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    lead = (data & 0xC0) != 0x80
    table = np.zeros(256, np.uint8)
    table[list(SYMBOLS)] = 1
    n_words = np.diff(first)
    chars = per_text(lead, bounds)
    word_chars = chars - per_text(white, bounds)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": per_text(table[data], bounds), "n_dup_lines": duplicate_lines(data, bounds, start), "n_repeat_words": repeated_words(hashes, first)}
    out["base_failed"] = (n_words < 10) | (100 * out["n_repeat_words"] > 20 * n_words)
    ids, place = vocabulary(ranks_path)[1].ids(data, bounds)
    at, _ = (pieces := pieces_of(piece_path)).lookup(data, start, end)
    n_pieces, n_bytes = per_text(pieces.pool[at], first), per_text(pieces.pool[at + 1], first)
    n_tokens = np.diff(place)
    out["chars_per_token"] = chars / np.maximum(n_tokens, 1)
    out["chars_per_piece"] = word_chars / np.maximum(n_pieces, 1)
    out["byte_share"] = n_bytes / np.maximum(n_pieces, 1)
    out["entropy"] = entropy(ids, place)
    scripts = script(data, bounds)
    of = np.array([x if x in bands else ("latin", "cyrillic", "other")[s] for x, s in zip(langs, scripts)], object)
    fits = np.zeros(len(of), bool)
    for name in set(of):
        at, band = np.flatnonzero(of == name), bands[name]
        token, piece, n = out["chars_per_token"][at], out["chars_per_piece"][at], n_tokens[at]
        ok = (token >= band.token_least.at(n)) & (token <= band.token_most) & (piece >= band.piece_least.at(n)) & (piece <= band.piece_most)
        fits[at] = ok & (out["entropy"][at] >= band.entropy_least.at(n)) & (out["byte_share"][at] <= band.byte_most)
    out["kept"] = ~out["base_failed"] & fits
    return out


def _measured(batches: Iterator[pa.RecordBatch], ranks_path: str, piece_path: str, text_col: str, lang_col: str) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
    for batch in batches:
        for part in by_bytes(batch, text_col):
            data, bounds = text_parts(part.column(text_col))
            langs = part.column(lang_col).to_pylist() if lang_col in part.schema.names else [None] * part.num_rows
            yield part, measure(data, bounds, langs, ranks_path, piece_path)


_TYPES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "chars_per_token": "double", "chars_per_piece": "double", "byte_share": "double", "entropy": "double", "kept": "boolean"}
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def rate(docs: DataFrame, ranks_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: the counts, base_failed, the fertility measures and kept.

    Null texts are empty: no words, so they fail the base rules.  A null or unknown language is judged by script.  Rows
    are independent, so repeated rows give repeated results; no shuffle; about 1 MB of text, or one longer text, at a time.
    """

    def run(batches):
        for part, out in _measured(batches, ranks_path, piece_path, text_col, lang_col):
            yield pa.RecordBatch.from_arrays([part.column(id_col), *[pa.array(out[k], _ARROW[t]) for k, t in _TYPES.items()]], [id_col, *_TYPES])

    kind = docs.schema[id_col].dataType.simpleString()
    names = list(dict.fromkeys([id_col, text_col, *([lang_col] if lang_col in docs.columns else [])]))
    return docs.select(*names).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{k} {t}" for k, t in _TYPES.items()))


def keep(docs: DataFrame, ranks_path: str, piece_path: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose texts are kept, with all their columns."""

    def run(batches):
        for part, out in _measured(batches, ranks_path, piece_path, text_col, lang_col):
            yield part.filter(pa.array(out["kept"]))

    return docs.mapInArrow(run, docs.schema)
