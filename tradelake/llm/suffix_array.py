"""Word-level suffix arrays of one shard of training text, in numpy.

A suffix runs from a word to the end of its text. Suffixes are ordered by the
fingerprints of their words; a suffix that ends sorts first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BITS = 21


@dataclass
class SuffixArray:
    order: np.ndarray  # positions of words, suffixes ascending
    ids: np.ndarray  # word numbers from 1, in the order of their fingerprints
    left: np.ndarray  # words of the suffix
    vocabulary: np.ndarray  # sorted fingerprints

    def tokens(self, rows: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """The word at a depth of the suffixes in these rows, 0 past their end."""
        at = self.order[rows]
        inside = self.left[at] > depth
        return np.where(inside, self.ids[np.minimum(at + depth, len(self.ids) - 1)], 0)


def build(hashes: np.ndarray, left: np.ndarray) -> SuffixArray:
    """left: how many words the text has from each word on.

    The first sort is on three words packed in one number. After that, only
    rows that still tie are sorted again, on twice the words each time.
    """
    vocabulary, ids = np.unique(hashes, return_inverse=True)
    if len(vocabulary) >= 1 << _BITS:
        raise ValueError("a shard has too many different words; make shards smaller")
    ids = ids.astype(np.int64) + 1
    n = len(ids)

    def ahead(values: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
        return np.where(left[at] > steps, values[np.minimum(at + steps, n - 1)], 0)

    every = np.arange(n)
    key = ids << (2 * _BITS) | ahead(ids, every, 1) << _BITS | ahead(ids, every, 2)
    order = np.argsort(key)
    slots, keys = every, key[order]
    rank = np.zeros(n, np.int64)
    steps = 3
    while len(slots):
        new = np.ones(len(slots), bool)
        new[1:] = keys[1:] != keys[:-1]
        runs = np.flatnonzero(new)
        sizes = np.diff(np.append(runs, len(slots)))
        rank[order[slots]] = np.repeat(slots[runs], sizes) + 1
        # rows of one run that all end here are equal and need no order; one that ends sorts before those that go on
        again = np.repeat((sizes > 1) & (np.maximum.reduceat(left[order[slots]], runs) > steps), sizes)
        slots = slots[again]
        at = order[slots]
        keys = rank[at] << 32 | ahead(rank, at, steps)
        by = np.argsort(keys)
        order[slots], keys = at[by], keys[by]
        steps *= 2
    return SuffixArray(order, ids, left, vocabulary)


def _bisect(sa: SuffixArray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray, right: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        got = sa.tokens(mid, depth)
        below = got <= want[open_] if right else got < want[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    return lo


def search(sa: SuffixArray, test: np.ndarray, left: np.ndarray, window: np.ndarray):
    """Binary search of every suffix of the test texts, word by word.

    Returns, for each test suffix, the length of its longest verbatim match in
    the shard, one place of it (-1: none), and the rows [lo, hi) of all
    suffixes that begin with its first `window` words (empty: none).
    """
    at = np.searchsorted(sa.vocabulary, test)
    found = at < len(sa.vocabulary)
    found[found] = sa.vocabulary[at[found]] == test[found]
    ids = np.where(found, at + 1, -1)
    n = len(test)
    longest, place = np.zeros(n, np.int64), np.full(n, -1)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(found)
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(sa.order))
    depth = 0
    while len(live):
        want = ids[live + depth]
        lo, hi = _bisect(sa, lo, hi, depth, want, False), _bisect(sa, lo, hi, depth, want, True)
        some = lo < hi
        live, lo, hi = live[some], lo[some], hi[some]
        depth += 1
        longest[live], place[live] = depth, sa.order[lo]
        full = window[live] == depth
        low[live[full]], high[live[full]] = lo[full], hi[full]
        more = left[live] > depth
        live, lo, hi = live[more], lo[more], hi[more]
    return longest, place, low, high
