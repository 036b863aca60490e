"""Words of whole texts as numpy arrays, straight from Arrow's UTF-8 buffers.

All word rules here part bytes below 0x80 only, so they hold on UTF-8 bytes as
they do on code points. A word is known by a 64-bit fingerprint of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything below 0x80 but digits and lower-case letters (A-Z are lowered first).
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 256), _ODD)])
    return _powers


@dataclass
class Words:
    """Words of several texts one after another; text i has words first[i]:first[i + 1]."""

    first: np.ndarray
    start: np.ndarray  # byte positions in data
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from it on."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.hash))


def words(texts: pa.Array, parts: np.ndarray = SPACE, lower: bool = True) -> Words:
    """Null has no words."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = int(offsets[0]) if len(offsets) else 0
    high = int(offsets[-1]) if len(offsets) else 0
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[low:high] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - low if len(offsets) else np.zeros(1, np.int64)
    if lower:
        data = _LOWER[data]
    inside = ~parts[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends with its text
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    if not len(start):
        return Words(first, start, end, np.zeros(0, np.uint64), data)
    at = np.flatnonzero(inside)
    size = end - start
    power = _power(int(size.max()))
    begin = np.cumsum(size) - size
    rank = np.arange(len(at)) - np.repeat(begin, size)
    with np.errstate(over="ignore"):
        summed = np.add.reduceat(_BYTE[data[at]] * power[rank], begin)
        return Words(first, start, end, mix(summed + size.astype(np.uint64) * _ODD), data)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of each n words in a row, over text ends too; n - 1 fewer than the words."""
    total = max(0, len(hashes) - n + 1)
    out = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * _ODD + hashes[k : k + total])
    return out


def chunks(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Batches of about `size` bytes of text; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text).cast(pa.large_string())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
