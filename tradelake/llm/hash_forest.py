"""Nearest vectors by cosine through a forest of sorted hash strings.

A tree gives each vector a string of 64 bits, the sides of 64 random planes it
lies on. Every shard of vectors keeps one sorted array of strings per tree. A
query descends each array to its longest matching prefix by binary search; then
all trees of all shards ascend together, one bit at a time, until the ranges of
that prefix length hold `candidates` rows. Vectors stay where they are: what
meets across shards is a count per query and prefix length, and each task's
nearest. Queries travel in blocks of bounded bytes.

How many candidates are needed is measured, not set: a bounded sample of
queries is answered by brute force, and the forest has to reach `recall` of
those answers. For vectors that lie anyhow this is a good part of all rows, for
clustered ones a small one. The sample fits that one number; all rows are
indexed.

Vectors that are null, all zero, or hold null or non-finite components take no
part, nor do rows without an id, nor vectors of another length than most have.
Rows that repeat an id are vectors of their own: each is asked, and is a
candidate of every row of another id. Of copies of one vector in a shard only
those can be among the k nearest that have the smallest ids; the others are set
aside, which changes no answer. An empty table gives an empty result. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

TREES, BITS, SEED = 32, 64, 11
#: Share of the true neighbours of the sample that candidates must hold, and the sample's size.
RECALL, SAMPLE = 0.96, 64
SHARD_BYTES, BLOCK_BYTES = 32_000_000, 8_000_000

FOUND = "query int, vec_id bigint, score double, depth int"


def planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, trees * BITS))


def strings(x: np.ndarray, trees: int) -> np.ndarray:
    """(tree, row): hash strings, the first plane in the highest bit."""
    out = np.empty((trees, len(x)), np.uint64)
    p = planes(x.shape[1], trees)
    for at in range(0, len(x), 8192):
        side = (x[at : at + 8192] @ p > 0).reshape(-1, trees, BITS)
        out[:, at : at + 8192] = np.packbits(side, axis=2).view(">u8")[:, :, 0].T
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, and squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])


@dataclass
class Vectors:
    """Vectors that take part, with their ids; rows ascend by id."""

    ids: np.ndarray
    x: np.ndarray

    @cached_property
    def norm(self) -> np.ndarray:
        return np.sqrt((self.x * self.x).sum(1))

    def cosines(self, rows: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        """Sums run along each row, so that equal vectors get equal scores."""
        return (self.x[rows] * query).sum(1) / (self.norm[rows] * norm)


def vectors(ids: pa.Array, lists: pa.Array, dim: int, k: int | None = None) -> Vectors:
    """Of copies, only what can be among the k nearest if k is given."""
    fits = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid()) & (np.asarray(lists.value_lengths().fill_null(0)) == dim)
    rows = np.flatnonzero(fits)
    flat = lists.take(pa.array(rows)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dim)  # null reads as nan
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    rows, x = rows[fine], x[fine]
    ids = ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)
    by = np.argsort(ids, kind="stable")
    ids, x = ids[by], np.ascontiguousarray(x[by]) + 0.0  # no negative zeros
    if k is not None and len(ids):
        kind = np.unique(x.view(np.dtype((np.void, 8 * dim))).ravel(), return_inverse=True)[1].ravel()
        by = np.lexsort((ids, kind))
        kind_, ids_ = kind[by], ids[by]
        new_kind = np.r_[True, kind_[1:] != kind_[:-1]]
        new_id = new_kind | np.r_[True, ids_[1:] != ids_[:-1]]
        place = np.arange(len(ids))
        nth_id = np.cumsum(new_id)
        nth_id -= np.maximum.accumulate(np.where(new_kind, nth_id, 0))
        again = place - np.maximum.accumulate(np.where(new_id, place, 0))
        stay = np.sort(by[(nth_id <= k) & (again < k)])  # k + 1 ids, one of which may be the query's own
        ids, x = ids[stay], x[stay]
    return Vectors(ids, _scaled(x))


def _shards(batches: Iterator[pa.RecordBatch], dim: int, k: int) -> Iterator[Vectors]:
    """Vectors of a task in shards of bounded bytes."""
    limit, waiting, rows = max(1, SHARD_BYTES // (8 * dim)), [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            part = batch.slice(at, limit)
            if rows and rows + part.num_rows > limit:
                yield _joined(waiting, dim, k)
                waiting, rows = [], 0
            waiting.append(part)
            rows += part.num_rows
    if rows:
        yield _joined(waiting, dim, k)


def _joined(batches: list[pa.RecordBatch], dim: int, k: int) -> Vectors:
    t = pa.Table.from_batches(batches).combine_chunks()
    ids, lists = (c.chunk(0) if c.num_chunks else c.combine_chunks() for c in (t["id"], t["vector"]))
    return vectors(ids, lists, dim, k)


class Forest:
    """Sorted hash strings of a shard, one array per tree."""

    def __init__(self, x: np.ndarray, trees: int):
        h = strings(x, trees)
        self.order = np.argsort(h, axis=1)
        self.sorted = np.take_along_axis(h, self.order, axis=1)

    def ranges(self, tree: int, h: np.ndarray, depth: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """Where strings stand that agree with h on the first `depth` bits."""
        with np.errstate(over="ignore"):  # no bits to agree on: all ones
            rest = np.left_shift(np.uint64(1), np.uint64(BITS) - np.asarray(depth, np.uint64)) - np.uint64(1)
        a = self.sorted[tree]
        return np.searchsorted(a, h & ~rest, "left"), np.searchsorted(a, h | rest, "right")

    def counts(self, h: np.ndarray) -> np.ndarray:
        """(query, prefix length): rows of all trees that agree so far; each tree is descended to its longest match."""
        out = np.zeros((h.shape[1], BITS + 1), np.int64)
        for tree in range(len(h)):
            live = np.arange(h.shape[1])
            for depth in range(BITS + 1):
                low, high = self.ranges(tree, h[tree, live], depth)
                out[live, depth] += high - low
                live = live[high > low]
                if not len(live):
                    break
        return out


@dataclass
class Queries:
    """A block of queries."""

    v: Vectors
    trees: int

    @cached_property
    def strings(self) -> np.ndarray:
        return strings(self.v.x, self.trees)


def _nearest(shard: Vectors, rows: np.ndarray, q: Queries, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of the given rows (which ascend) to query n, ties to the smaller id."""
    rows = rows[shard.ids[rows] != q.v.ids[n]]
    if len(rows) > k:
        rough = shard.x[rows] @ q.v.x[n] / shard.norm[rows]
        least = np.partition(rough, len(rows) - k)[len(rows) - k]
        rows = rows[rough >= least - 1e-9 * q.v.norm[n]]
    score = shard.cosines(rows, q.v.x[n], q.v.norm[n])
    best = np.lexsort((shard.ids[rows], -score))[:k]
    return rows[best], score[best]


class _Best:
    """The nearest of each query over the shards of a task."""

    def __init__(self, n: int, k: int):
        self.k, self.found = k, [[] for _ in range(n)]

    def add(self, n: int, ids, scores, depths) -> None:
        own = self.found[n] + list(zip((-scores).tolist(), ids.tolist(), depths.tolist()))
        self.found[n] = sorted(own)[: self.k]

    def batch(self) -> pa.RecordBatch:
        rows = [(n, i, -s, d) for n, own in enumerate(self.found) for s, i, d in own]
        cells = list(zip(*rows)) if rows else [[]] * 4
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], ["query", "vec_id", "score", "depth"])


def _counting(q: Queries, dim: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(q.v.ids), BITS + 1), np.int64)
    for shard in _shards(batches, dim, k):
        total += Forest(shard.x, q.trees).counts(q.strings)
    n, depth = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(depth.astype(np.int32)), pa.array(total[n, depth])],
                                     ["query", "depth", "n"])


def _searching(q: Queries, depth: np.ndarray, dim: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    best = _Best(len(q.v.ids), k)
    for shard in _shards(batches, dim, k):
        forest = Forest(shard.x, q.trees)
        ends = [forest.ranges(t, q.strings[t], depth) for t in range(q.trees)]
        low, high = (np.array([e[side] for e in ends]).T.tolist() for side in (0, 1))
        for n in range(len(q.v.ids)):
            here = np.zeros(len(shard.ids), bool)
            for tree, (a, b) in enumerate(zip(low[n], high[n])):
                here[forest.order[tree, a:b]] = True
            rows, score = _nearest(shard, np.flatnonzero(here), q, n, k)
            best.add(n, shard.ids[rows], score, np.full(len(rows), depth[n]))
    yield best.batch()


def _brute_force(q: Queries, dim: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The true nearest, with the longest prefix that any tree shares with the query."""
    best = _Best(len(q.v.ids), k)
    for shard in _shards(batches, dim, k):
        for n in range(len(q.v.ids)):
            rows, score = _nearest(shard, np.arange(len(shard.ids)), q, n, k)
            apart = (strings(shard.x[rows], q.trees) ^ q.strings[:, n : n + 1]).min(0) if len(rows) else np.zeros(0, np.uint64)
            bits = [BITS - int(a).bit_length() for a in apart]
            best.add(n, shard.ids[rows], score, np.array(bits, np.int64))
    yield best.batch()


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """A forest over the vectors of a table, for searches of one k."""

    def __init__(self, table: DataFrame, *, id: str = "vec_id", vector: str = "embedding", k: int = 5, trees: int = TREES):
        self.rows = table.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("vector"))
        size = F.size("vector")
        common = self.rows.where(size > 0).groupBy(size.alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        self.dim, self.k, self.trees = (common.dim if common else 0), k, trees

    def _block(self, queries: DataFrame) -> Queries:
        """Queries on the driver; the caller bounds them."""
        t = queries.toArrow().combine_chunks()
        if not t.num_rows:
            return Queries(Vectors(np.zeros(0, np.int64), np.zeros((0, self.dim))), self.trees)
        return Queries(vectors(t["id"].combine_chunks(), t["vector"].combine_chunks(), self.dim), self.trees)

    def _totals(self, q: Queries) -> DataFrame:
        """(query, depth, n): rows of all trees and shards whose strings agree with the query's so far."""
        counts = self.rows.mapInArrow(partial(_counting, q, self.dim, self.k), "query int, depth int, n bigint")
        return counts.groupBy("query", "depth").agg(F.sum("n").alias("n"))

    def needed(self, queries: DataFrame, recall: float = RECALL, sample: int = SAMPLE) -> int:
        """How many candidates hold that share of the true neighbours of a sample of the queries."""
        drawn = queries.where(F.size("vector") == self.dim).orderBy(F.xxhash64("id"), "id").limit(sample)
        q = self._block(drawn)
        if not len(q.v.ids):
            return 0
        found = _top(self.rows.mapInArrow(partial(_brute_force, q, self.dim, self.k), FOUND), self.k)
        cost = found.join(self._totals(q), ["query", "depth"]).select("n").toArrow()["n"].to_numpy()  # at most sample * k
        return int(np.quantile(cost, recall, method="higher")) if len(cost) else 0

    def search(self, queries: DataFrame, candidates: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest found of each query row (id, vector)."""
        spark = queries.sparkSession
        out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        if not self.dim:
            return out
        if candidates is None:
            candidates = self.needed(queries)
        candidates = max(candidates, (self.k + 1) * self.trees)  # then one tree gives k rows
        blocks = 1 + 2 * queries.count() * 8 * self.dim // block_bytes  # filled by half on average
        for block in range(blocks):
            part = queries.where(F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)) == block) if blocks > 1 else queries
            q = self._block(part)
            if not len(q.v.ids):
                continue
            enough = self._totals(q).where((F.col("n") >= candidates) | (F.col("depth") == 0))
            depth = np.zeros(len(q.v.ids), np.int64)
            for n, deepest in enough.groupBy("query").agg(F.max("depth")).collect():  # one row per query of the block
                depth[n] = deepest
            top = _top(self.rows.mapInArrow(partial(_searching, q, depth, self.dim, self.k), FOUND), self.k)
            out = out.unionAll(_named(top, q))
        return out


def _named(top: DataFrame, q: Queries) -> DataFrame:
    """Numbers of the block to query ids."""
    ids = top.sparkSession.createDataFrame(pa.table({"query": pa.array(np.arange(len(q.v.ids), dtype=np.int32)), "query_id": pa.array(q.v.ids)}))
    return top.join(F.broadcast(ids), "query").select("query_id", "rank", "vec_id", "score")


def report(table: DataFrame, *, every: int = 50, k: int = 5, **options) -> DataFrame:
    """The k nearest of every row whose id is divisible by `every`, the row itself left out."""
    index = Index(table, k=k)
    return index.search(index.rows.where(F.col("id") % every == 0), **options)
