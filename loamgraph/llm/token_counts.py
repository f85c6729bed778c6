"""Token counts: batch encoding in Arrow functions that return lengths only.

Arrow batches are re-cut to about equal bytes, and longer texts to parts of about that size, at white space where the
byte-level pattern always begins a piece.  Within a part nothing merges across pieces, and the library's model encodes each
distinct piece once.  Parts that hold an added special token, or characters whose class the Unicode versions of the
libraries may not agree on, go to the library as they are.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes, text_parts
from .segments import CACHE, Encoder, in_parts

# fixed values: code point ranges that every Unicode version from 7 on classes alike
STABLE = ((0x0, 0x36F), (0x370, 0x377), (0x37A, 0x37F), (0x384, 0x38A), (0x38C, 0x38C), (0x38E, 0x3A1), (0x3A3, 0x52F), (0x2000, 0x2064), (0x20A0, 0x20BD), (0x2100, 0x2189), (0x2190, 0x23FA), (0x2500, 0x27FF), (0x3000, 0x303F), (0x3041, 0x3096), (0x3099, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFF01, 0xFFBE))

def alphabet() -> np.ndarray:
    """The character for each byte in a byte-level vocabulary: printable ones stand for themselves, the others for those from 256 on."""
    out = np.arange(256, dtype="<u4")
    other = np.flatnonzero((out < 0x21) | ((out > 0x7E) & (out < 0xA1)) | (out == 0xAD))
    out[other] = 256 + np.arange(len(other))
    return out


class Library:
    """The tokenizers library for one file, for texts by way of their distinct pieces."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.own.get_added_tokens_decoder().values()]
        self.model, self.alphabet = self.own.model, alphabet()
        self.encoder = Encoder(self._encode, cache=cache)
        self.stable = np.zeros(0x110000, bool)
        for a, b in STABLE:
            self.stable[a : b + 1] = True

    def _encode(self, found: list[bytes]) -> list[list[int]]:
        """Ids of pieces by the library's model, in the alphabet that its byte-level pre-tokeniser gives it."""
        text = self.alphabet[np.frombuffer(b"".join(found), np.uint8)].tobytes().decode("utf-32-le")
        ends = np.cumsum([len(x) for x in found], dtype=np.int64).tolist()
        return [[x.id for x in self.model.tokenize(text[a:b])] for a, b in zip([0, *ends], ends)]

    def odd(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows that the library takes as they are."""
        raw, out = data.tobytes(), set()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                out.add(int(np.searchsorted(bounds, at, side="right")) - 1)
                at = raw.find(token, at + 1)
        if (data >= 0xCE).any():
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
            out.update((np.searchsorted(bounds, lead[~self.stable[cp]], side="right") - 1).tolist())
        return np.array(sorted(out), np.int64)

    def whole(self, raw: bytes) -> list[int]:
        return self.own.encode(raw.decode("utf-8"), add_special_tokens=False).ids

    def counts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(parts := in_parts(data, bounds)) > 1:
            return np.array([sum(int(self.counts(x, np.array([0, len(x)]))[0]) for x in parts)])
        out = self.encoder.counts(data, bounds)
        for i in self.odd(data, bounds):
            out[i] = len(self.whole(data[bounds[i] : bounds[i + 1]].tobytes()))
        return out

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one text after the other, and each text's place (n + 1)."""
        if len(parts := in_parts(data, bounds)) > 1:
            flat = np.concatenate([self.ids(x, np.array([0, len(x)]))[0] for x in parts])
            return flat, np.array([0, len(flat)])
        ids, first = self.encoder.ids(data, bounds)
        odd = self.odd(data, bounds)
        if not len(odd):
            return ids, first
        out, size, at = [], np.diff(first), 0
        for i in odd.tolist():
            own = np.array(self.whole(data[bounds[i] : bounds[i + 1]].tobytes()), np.int32)
            out += [ids[at : first[i]], own]
            at, size[i] = first[i + 1], len(own)
        return np.concatenate([*out, ids[at:]]), np.concatenate([[0], np.cumsum(size)])


@lru_cache(maxsize=2)
def library(path: str, cache: int = CACHE) -> Library:
    """One for each Python worker."""
    return Library(path, cache)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit); null and empty texts have no tokens.

    Repeated rows give repeated results.  No shuffle; only lengths leave the workers, which look at about 1 MB of text at a
    time, beside the Arrow batch itself.
    """

    def run(batches):
        own = library(path)
        for batch in batches:
            for part in by_bytes(batch, text_col):
                data, bounds = text_parts(part.column(text_col))
                n = own.counts(data, bounds)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(np.diff(bounds), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
