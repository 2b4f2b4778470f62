"""Counts of character classes for whole Arrow batches of text, without a loop over rows."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

FEATURES = ("n_bytes", "n_chars", "n_words", "n_digits", "n_punct", "n_latin", "n_latin_ext", "n_arabic", "n_other")
SPACE, DIGIT, PUNCT, LATIN, LATIN_EXT, ARABIC, OTHER = 1, 2, 3, 4, 5, 6, 7


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of each code point of the basic plane; all beyond it count as other."""
    out = np.full(0x10000 + 1, OTHER, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if ch.isspace():
            out[cp] = SPACE
        elif cat == "Nd":
            out[cp] = DIGIT
        elif cat[0] in "PS":
            out[cp] = PUNCT
        elif cat[0] == "L":
            out[cp] = LATIN if cp < 128 else LATIN_EXT if cp < 0x250 or 0x1E00 <= cp < 0x1F00 else ARABIC if 0x600 <= cp < 0x780 else OTHER
    return out


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in one array, the first of each text, and the bytes of each; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, starts[offsets], np.diff(offsets)


def counts(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    points, at, n_bytes = flat(texts)
    kind = class_table()[np.minimum(points, 0x10000)]
    out = np.zeros((len(n_bytes), len(FEATURES)), np.int64)
    out[:, 0], out[:, 1] = n_bytes, np.diff(at)

    def add(column: int, hits: np.ndarray) -> None:
        total = np.concatenate([[0], np.cumsum(hits)])
        out[:, column] = total[at[1:]] - total[at[:-1]]

    first = np.ones(len(kind), bool)
    if len(kind):
        first[1:] = kind[:-1] == SPACE
        first[at[:-1][at[:-1] < len(kind)]] = True
    add(2, first & (kind != SPACE))
    for column, c in enumerate((DIGIT, PUNCT, LATIN, LATIN_EXT, ARABIC, OTHER), 3):
        add(column, kind == c)
    return out
