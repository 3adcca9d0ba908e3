"""Word hashes of whole Arrow batches of texts, without a Python object for each word."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_slices(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of about `limit` bytes of text, whole texts each, so that the
    arrays made of a slice stay small whatever the batch size."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        number = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = np.flatnonzero(np.diff(number)) + 1
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(sizes)).tolist()):
            if b > a:
                yield batch.slice(a, b - a)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of text that a task turns into arrays at a time.
SLICE_BYTES = 1 << 20


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, of all texts, and the words
    before each text (one number more than texts). A null text has none."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, ends, raw = texts.buffers()
    at = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or at[-1] == at[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = ~_WHITE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][at[1:] > at[:-1]]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    before = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    # A polynomial in the place of the byte in its word; blanks count nothing.
    heads = np.append(0, starts)
    place = np.arange(len(data)) - np.repeat(heads, np.diff(np.append(heads, len(data))))
    powers = np.ones(int(place.max()) + 1, np.uint64)
    powers[1:] = np.uint64(_BASE)
    powers = np.multiply.accumulate(powers)
    value = (_LOWER[data].astype(np.uint64) + np.uint64(1)) * powers[place]
    value[~inside] = 0
    return mixed(np.add.reduceat(value, starts)), before


def shingles(hashes: np.ndarray, before: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    out = []
    factors = [np.uint64((2 * k + 1) * 0xD6E8FEB86659FD93 % (1 << 64)) for k in range(width)]
    if len(hashes) >= width:
        n = len(hashes) - width + 1
        rolled = np.zeros(n, np.uint64)
        for k, f in enumerate(factors):
            rolled += mixed(hashes[k : n + k] * f)
        rolled = mixed(rolled)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            own = np.array([b - a], np.uint64)
            for k, f in enumerate(factors[: b - a]):
                own += mixed(hashes[a + k : a + k + 1] * f)
            out.append(mixed(own))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
