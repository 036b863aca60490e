"""Benchmark decontamination by suffix arrays over the training text.

Each task builds word-level suffix arrays over shards of its documents and
binary-searches every suffix of the test texts in them. No document is
shuffled. Test texts travel to the tasks in blocks of bounded size, one block
after another; a block is a broadcast with a proven bound.

Null or word-free documents and test texts match nothing. A test text without
an id hits words like any other and is left out of the items. A text longer than
a shard, or than a block, is one of its own. Repeated rows, repeated ids and further columns
(of any name) stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tradelake.llm import suffix_array
from tradelake.llm.tokens import NOT_ALNUM, chunks, words

WINDOW = 10
#: Bytes of test text in a block, and of training text in a shard.
BLOCK_BYTES = 16_000_000
SHARD_BYTES = 6_000_000

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    # word ranges [start, end) inside an occurrence of a window, apart and ascending
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    # longest verbatim matches of a window or more, as word positions
    T.StructField("matches", T.ArrayType(T.StructType([
        T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))),
])
_SPANS, _ITEMS, _MATCHES = (pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()),
                            pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int64()),
                                                ("start", pa.int64()), ("length", pa.int64())])))


class _Tests:
    """A block of test texts: words of all items in a row, and what surrounds each word."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int):
        w = words(pa.array(texts, pa.string()), NOT_ALNUM)
        self.ids, self.hash, self.left = ids, w.hash, w.left()
        self.item = w.text_of_word()
        self.place = np.arange(len(w.hash)) - w.first[self.item]
        size = np.diff(w.first)[self.item]
        length = np.minimum(size, window)
        self.window = np.where(self.left >= length, length, 0)


def _hits(tests: _Tests, w) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places where windows occur: word of the shard, test suffix, window length, and the match's length (0: not its first window)."""
    left = w.left()
    sa = suffix_array.build(w.hash, left)
    _, _, lo, hi = suffix_array.search(sa, tests.hash, tests.left, tests.window)
    some = np.flatnonzero(hi > lo)
    count = (hi - lo)[some]
    suffix = np.repeat(some, count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[some], count)
    at = sa.order[rows]
    # a match is told once, at its first window
    head = w.first[w.text_of_word()[at]] == at
    fresh = head | (tests.place[suffix] == 0)
    back = np.flatnonzero(~fresh)
    fresh[back] = w.hash[at[back] - 1] != tests.hash[suffix[back] - 1]
    length = np.where(fresh, tests.window[suffix], 0)
    live = np.flatnonzero(fresh)
    while len(live):
        n = length[live]
        inside = (left[at[live]] > n) & (tests.left[suffix[live]] > n)
        live, n = live[inside], n[inside]
        live = live[w.hash[at[live] + n] == tests.hash[suffix[live] + n]]
        length[live] += 1
    return at, suffix, tests.window[suffix], length


def _found(tests: _Tests, texts: pa.Array) -> list[dict]:
    w = words(texts, NOT_ALNUM)
    out = [{"n_words": int(n), "spans": [], "items": [], "matches": []} for n in np.diff(w.first)]
    if not len(w.hash) or not len(tests.hash):
        return out
    at, suffix, size, length = _hits(tests, w)
    if not len(at):
        return out
    doc = np.searchsorted(w.first, at, "right") - 1
    by = np.lexsort((at, doc))
    at, suffix, size, length, doc = at[by], suffix[by], size[by], length[by], doc[by]
    for rows in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1):
        d = int(doc[rows[0]])
        base = int(w.first[d])
        start, end = at[rows] - base, np.maximum.accumulate(at[rows] - base + size[rows])
        cut = np.flatnonzero(start[1:] > end[:-1]) + 1
        out[d]["spans"] = [{"start": int(a), "end": int(b)} for a, b in
                           zip(start[np.r_[0, cut]], end[np.r_[cut - 1, len(rows) - 1]])]
        out[d]["items"] = sorted({tests.ids[i] for i in np.unique(tests.item[suffix[rows]])} - {None})
        out[d]["matches"] = [
            {"item_id": tests.ids[tests.item[s]], "item_start": int(tests.place[s]), "start": int(p), "length": int(n)}
            for s, p, n in zip(suffix[rows], start, length[rows]) if n]
    return out


def _union(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*a, *b], key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(s)
    return out


def _searching(ids: list[str], texts: list[str | None], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _Tests(ids, texts, window)
        for batch in chunks(batches, "text", SHARD_BYTES):
            found = _found(tests, batch.column("text"))
            if "found" in batch.schema.names:
                for now, old in zip(found, batch.column("found").to_pylist()):
                    now["spans"] = _union(now["spans"], old["spans"])
                    now["items"] = sorted({*now["items"], *old["items"]})
                    now["matches"] = old["matches"] + now["matches"]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in
                       (("n_words", pa.int64()), ("spans", _SPANS), ("items", _ITEMS), ("matches", _MATCHES))]
            found = pa.StructArray.from_arrays(columns, ["n_words", "spans", "items", "matches"])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), found], ["row", "text", "found"])

    return run


def find_matches(docs: DataFrame, tests: DataFrame, *, text: str = "text", item: str = "item_id",
                 test_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                 keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """(row: the kept columns of docs, found: see FOUND) for every row of docs."""
    tests = tests.select(F.col(item).cast("string").alias("id"), F.col(test_text).alias("text"))
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + 2 * total // block_bytes  # filled by half on average
    out = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    for k in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k) if blocks > 1 else tests
        rows = part.collect()
        schema = T.StructType([*out.schema.fields[:2], T.StructField("found", FOUND)])
        out = out.mapInArrow(_searching([r.id for r in rows], [r.text for r in rows], window), schema)
    return out.select("row", "found")


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """Documents that hold no window of a test text, columns as they were."""
    clean = find_matches(docs, tests, **options).where(F.size("found.spans") == 0)
    return clean.select([F.col("row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """One row per document: words, words hit, items that occur in it."""
    return find_matches(docs, tests, keep=("doc_id",), **options).select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        n_hit(F.col("found")).alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.spans") > 0).alias("contaminated"),
        F.col("found.matches").alias("matches"),
    )
