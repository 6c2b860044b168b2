"""Helpers on word level, shared by the operators.

A word is a run of characters other than space, tab, newline, vertical tab, form feed and carriage
return, as UTF-8 bytes with A-Z lower-cased. Inside tasks a column of texts is handled as one byte
array; a word is represented by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]"  # the separators, as a Java, Python and RE2 pattern
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
CHUNK_BYTES = 1 << 20  # texts are handled in groups of about this size, so arrays stay small
WINDOW = 5  # words of a shingle

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RANDOM.integers(1, 2**63, dtype=np.uint64)) | 1
_SLOT = _RANDOM.integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and everything else left as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string column into runs of rows of about ``CHUNK_BYTES``, a longer text being one run.

    Yields (first row, last row + 1, bytes with A-Z lower-cased, row bounds in those bytes).
    A null counts as an empty text.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, _LOWER[data[bounds[first] : bounds[last]]], bounds[first : last + 1] - bounds[first]
        first = last


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``data[bounds[i]:bounds[i + 1]]``, and the bounds of each text in them."""
    inside = ~_IS_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    opens[edges] = inside[edges]
    letters = data[inside]
    starts = np.flatnonzero(opens[inside])
    word_bounds = np.searchsorted(np.flatnonzero(opens), bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), word_bounds
    lengths = np.diff(np.append(starts, len(letters)))
    place = np.arange(len(letters)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64), dtype=np.uint64)
    sums = np.add.reduceat(_BYTE[letters] * powers[place], starts)
    return mix(sums + lengths.astype(np.uint64)), word_bounds


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: 5-word windows, or the whole of fewer words."""
    for _, _, data, bounds in chunks(texts):
        words, at = word_hashes(data, bounds)
        windows = np.zeros(max(len(words) - WINDOW + 1, 0), np.uint64)
        for k in range(WINDOW):
            windows += words[k : len(words) - WINDOW + 1 + k] * _SLOT[k]
        windows = mix(windows)
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b - a >= WINDOW:
                yield np.unique(windows[a : b - WINDOW + 1])
            elif b > a:
                whole = (words[a:b] * _SLOT[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
