"""Exact n-gram Jaccard join by set relations: near-duplicate components.

A text's set holds fingerprints of its different 3-word shingles. Documents of
equal sets are one class, and classes meet in lists: a list holds the classes
that have a shingle in their prefix, the rarest tenth of the set, where every
pair at the threshold shares one.

* Block skipping. Short lists are read by position: a pair is looked at only if
  sizes and places of the shingle allow the threshold. Cells (below) are cut
  into bands of equal distance, and pairs of bands too far apart are skipped.
* Set relations. A long list is not paired. Its smallest classes become
  leaders, and each other class is compared with the leaders only. Jaccard
  distance keeps the triangle inequality, so for a class within 0.2 of a leader
  all its partners are within 0.3 of it: they are in the leader's cell. There a
  class is kept as its difference to the leader, and the overlap of two classes
  follows from their overlaps with the leader and from those differences, with
  no look at the sets themselves. The class then leaves the list; the rest goes
  into the next round, with twice the leaders, until no list is long.

Cells tell no pairs, only a tree of each component. Shingle frequencies, which
order the shingles, are estimated by a table of `slots` counters over all
documents: a fixed size, to be broadcast. Any order gives the same result.

Null or word-free texts have an empty set and link with nothing. Texts of one
or two words have one shingle. Rows that repeat an id or a text are classed by
text. Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradelake.llm.components import components
from tradelake.llm.sieve import sifted
from tradelake.llm.staging import discard, staged
from tradelake.llm.tokens import chunks, mix, windows, words

SHINGLE, PERCENT = 3, 90
SLOTS = 1 << 20
#: Lists up to SHORT are paired; a longer one has LEADERS leaders, twice as many each round; rows of a block of a cell.
SHORT, LEADERS, BLOCK = 48, 4, 1500
CHUNK_BYTES = 2_000_000
_PAGE = 1 << 14


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted different shingles of each text."""
    w = words(texts)
    size = np.diff(w.first)
    grams = windows(w.hash, n)
    out = []
    for a, k in zip(w.first[:-1], size):
        out.append(np.unique(grams[a : a + k - n + 1]) if k >= n else windows(w.hash[a : a + k], k) if k else grams[:0])
    return out


def _count(slots: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(slots, np.int64)
    for batch in chunks(batches, "text", CHUNK_BYTES):
        every = np.concatenate(shingle_sets(batch.column("text")))
        counts += np.bincount((every % np.uint64(slots)).astype(np.int64), minlength=slots)
    pages = np.split(counts.astype(np.uint32), slots // _PAGE)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(pages)), pa.int32()), pa.array([p.tobytes() for p in pages])], ["page", "counts"])


def _total(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), np.uint32).astype(np.uint64) for c in table["counts"])
    return pa.table({"page": pa.array([key[0].as_py()], pa.int32()), "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def frequencies(docs: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """How many sets have a shingle, for each slot of shingles; summed in two steps, page by page."""
    parts = docs.select("text").mapInArrow(partial(_count, slots), "page int, counts binary")
    parts = parts.withColumn("part", F.spark_partition_id() % 16)
    parts = parts.groupBy("page", "part").applyInArrow(_total, "page int, counts binary")
    pages = parts.groupBy("page").applyInArrow(_total, "page int, counts binary").collect()
    out = np.zeros(slots, np.uint32)
    for p in pages:
        out[p.page * _PAGE : (p.page + 1) * _PAGE] = np.frombuffer(p.counts, np.uint32)
    return out


def _fingerprint(tokens: np.ndarray) -> int:
    if not len(tokens):
        return 0
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(tokens).sum() + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def _signing(counts, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = counts.value
    for batch in chunks(batches, "text", CHUNK_BYTES):
        prints, sizes, prefixes = [], [], []
        for s in shingle_sets(batch.column("text")):
            keep = len(s) - -(-PERCENT * len(s) // 100) + 1 if len(s) else 0
            seen = table[(s % np.uint64(len(table))).astype(np.int64)]
            prints.append(_fingerprint(s))
            sizes.append(len(s))
            prefixes.append(s[np.lexsort((s, seen))[:keep]].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()),
             pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "set", "n", "prefix"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of their set, without other texts under the same id."""
    for batch in chunks(batches, "text", CHUNK_BYTES):
        prints = np.array([_fingerprint(s) for s in shingle_sets(batch.column("text"))])
        yield batch.filter(pa.array(prints == batch.column("set").to_numpy()))


def _comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps of pairs (a, b); with `wide`, also what a has more and what b has more, for Jaccard 0.7 and up."""
    for batch in batches:
        for at in range(0, batch.num_rows, 400):
            part = batch.slice(at, 400)
            known: dict[int, np.ndarray] = {}
            for side in "ab":
                ids = part.column(side).to_pylist()
                first = {i: k for k, i in reversed(list(enumerate(ids))) if i not in known}
                known |= zip(first, shingle_sets(part.column(f"text_{side}").take(pa.array(list(first.values()), pa.int64()))))
            rows: dict[str, list] = {k: [] for k in ("a", "b", "n_a", "n_b", "common", "less", "more")}
            for a, b, wide in zip(*(part.column(c).to_pylist() for c in ("a", "b", "wide"))):
                x, y = known[a], known[b]
                where = np.searchsorted(x, y)
                same = where < len(x)
                same[same] = x[where[same]] == y[same]
                n = int(same.sum())
                near = wide and 10 * n >= 7 * (len(x) + len(y) - n)
                lost = np.ones(len(x), bool)
                lost[where[same]] = False
                for k, v in zip(rows, (a, b, len(x), len(y), n, np.flatnonzero(lost) if near else None, y[~same].view(np.int64) if near else None)):
                    rows[k].append(v)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, lists if k in ("less", "more") else pa.int64()) for k, v in rows.items()], list(rows))


def _forest(key: tuple, table: pa.Table) -> pa.Table:
    """A tree for each component of a cell: overlaps from differences to the leader, by matrix products."""
    size = table["n_b"].to_numpy()
    less, more = (table[c].combine_chunks() for c in ("less", "more"))
    ids, n = table["b"].to_numpy(), len(size)
    away = less.value_lengths().to_numpy()
    common = (table["n_a"].to_numpy()[0] - away[:, None] - away[None, :]).astype(np.float32)
    for lists in (less, more):
        row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
        values, column, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        new = np.cumsum(times > 1) - 1
        row, column = row[times[column] > 1], new[column[times[column] > 1]]
        for k in range(0, int(new[-1]) + 1 if len(new) else 0, 2048):
            here = (column >= k) & (column < k + 2048)
            x = np.zeros((n, 2048), np.float32)
            x[row[here], column[here] - k] = 1
            common += x @ x.T
    link = 100 * common >= PERCENT * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(link, True)
    label = np.arange(n)
    while True:
        least = np.where(link, label, n).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    far = np.flatnonzero(label != np.arange(n))
    return pa.table({"a": ids[label[far]], "b": ids[far]})


def _cells(near: DataFrame) -> DataFrame:
    """Edges of the cells of all leaders.

    A cell is cut into bands of distance and these into blocks of about BLOCK
    rows; blocks meet in pairs unless the bands are over 0.1 apart or all of
    both are linked with the leader anyway.
    """
    near = near.withColumn("band", F.floor(100 * (1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")))).cast("int"))
    bands = near.groupBy("a", "band").agg(F.count("*").alias("c")).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    total = near.groupBy("a").agg(F.count("*").alias("all"))
    near = near.join(bands.drop("c"), ["a", "band"]).join(total, "a")
    whole = near.where(F.col("all") <= BLOCK).withColumn("cell", F.lit("whole"))
    large = near.where(F.col("all") > BLOCK).withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")))
    here = bands.select(F.col("a").alias("a2"), F.col("band").alias("band2"), F.col("blocks").alias("blocks2"))
    met = (F.col("a") == F.col("a2")) & (F.abs(F.col("band") - F.col("band2")) <= 11) & (F.greatest("band", "band2") >= 9)
    large = large.join(here, met).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
    mine, theirs = (F.struct(F.col(x).cast("bigint").alias("band"), F.col(y).cast("bigint").alias("block"))
                    for x, y in (("band", "own"), ("band2", "other")))
    large = large.withColumn("cell", F.concat_ws("_", F.least(mine, theirs).cast("string"), F.greatest(mine, theirs).cast("string")))
    columns = ["a", "cell", "b", "n_a", "n_b", "less", "more"]
    return whole.select(columns).unionAll(large.select(columns)).groupBy("a", "cell").applyInArrow(_forest, "a bigint, b bigint")


def _linked(pairs: DataFrame) -> DataFrame:
    c = F.col("common")
    return pairs.where(100 * c >= PERCENT * (F.col("n_a") + F.col("n_b") - c)).select("a", "b")


def _short_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of lists of at most SHORT classes that sizes and places allow; every pair at its first shared shingle or later."""
    a = entries.select("token", F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("p_a"))
    b = entries.select("token", F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("p_b"))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    # places of earlier shared shingles are part of what may be common, at most min(p_a, p_b) of them
    most = F.least("p_a", "p_b") + 1 + F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) - 1
    fits = (F.col("n_a") * 100 >= F.col("n_b") * PERCENT) & (most * (100 + PERCENT) >= PERCENT * (F.col("n_a") + F.col("n_b")))
    return a.join(b, "token").where(ordered & fits).select("a", "b", "n_a", "n_b")


def _sharing_enough(pairs: DataFrame) -> DataFrame:
    """Different pairs that share as many prefix shingles as the threshold asks for.

    Of the two, take the set whose prefix ends first: all shingles that it
    shares out of its prefix are in the other's prefix, so the overlap is at
    most their number and the rest of the set. Only for lists that hold all
    prefixes; a pair that also meets in a long list may be undercounted here
    and is judged there.
    """
    rest = F.greatest(*(F.floor((PERCENT * F.col(n) + 99) / 100) for n in ("n_a", "n_b"))) - 1
    counted = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("c"))
    return counted.where((F.col("c") + rest) * (100 + PERCENT) >= PERCENT * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _compared(pairs: DataFrame, docs: DataFrame, ids: DataFrame, made: list[str]) -> DataFrame:
    """pairs (a, b, wide) with overlaps; ids: (set, doc_id), a document for each set."""
    shown = pairs.select(F.col("a").alias("set")).unionAll(pairs.select("b")).distinct()
    needed = staged(ids.join(shown, "set"), "jaccard-needed", made)
    some = sifted(docs, needed.select("doc_id"), "doc_id")
    # rows of one id meet here, so repeated rows go without another shuffle
    texts = some.join(needed, "doc_id").dropDuplicates(["doc_id", "set", "text"]).select("set", "text")
    texts = staged(texts.mapInArrow(_own, texts.schema), "jaccard-texts", made)
    a, b = (texts.select(F.col("set").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
    return staged(pairs.join(b, "b").join(a, "a").select("a", "b", "wide", "text_a", "text_b").mapInArrow(
        _comparing, "a bigint, b bigint, n_a bigint, n_b bigint, common bigint, less array<bigint>, more array<bigint>"), "jaccard-pairs", made)


def classes(docs: DataFrame, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set, n) of every row, and (set, label) of every set that links with another.

    The label is the smallest doc_id of the set's component.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counts = spark.sparkContext.broadcast(frequencies(docs, slots))  # 4 bytes a slot, whatever the input
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = staged(docs.mapInArrow(partial(_signing, counts), f"doc_id {kind}, set bigint, n bigint, prefix array<bigint>"), "jaccard-sets")
    sets = signed.where("n > 0").groupBy("set").agg(F.max("n").alias("n"), F.first("prefix").alias("prefix"))
    entries = sets.select("set", "n", F.posexplode("prefix").alias("pos", "token"))
    counted = entries.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    made: list[str] = []
    entries = staged(entries.join(counted, "token"), "jaccard-lists", made)
    ids = signed.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc_id"))

    edges, round_ = [], 0  # what is staged from here on goes once the components are known
    while True:
        pairs = _short_pairs(entries.where(F.col("c") <= SHORT))
        pairs = (pairs.select("a", "b") if round_ else _sharing_enough(pairs)).withColumn("wide", F.lit(False))
        long = entries.where(F.col("c") > SHORT)
        if not long.take(1):
            edges.append(staged(_linked(_compared(staged(pairs.distinct(), "jaccard-candidates", made), docs, ids, made)), "jaccard-edges", made))
            break
        seat = F.pmod(F.xxhash64("set", F.lit(round_)), F.lit(LEADERS << round_))
        leaders = long.groupBy("token", seat.alias("seat")).agg(F.min(F.struct("n", "set")).alias("lead"))
        leaders = leaders.select("token", F.col("lead.set").alias("a"), F.col("lead.n").alias("n_a"))
        met = staged(long.join(leaders, "token").where("set <> a").select("token", F.col("set").alias("b"), "a", "n_a", "n"), "jaccard-met", made)
        fits = F.least("n_a", "n") * 10 >= F.greatest("n_a", "n") * 7
        star = met.where(fits).select("a", "b", F.lit(True).alias("wide"))
        told = _compared(staged(pairs.unionAll(star).distinct(), "jaccard-candidates", made), docs, ids, made)
        near = told.where(F.col("less").isNotNull())
        edges.append(staged(_linked(told).unionAll(_cells(near)), "jaccard-edges", made))
        distance = 1 - F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))
        done = met.join(told.where(distance <= 0.2).select("a", "b"), ["a", "b"]).select("token", F.col("b").alias("set"))
        done = done.unionAll(leaders.select("token", F.col("a").alias("set"))).distinct()
        rest = long.join(done, ["token", "set"], "left_anti").drop("c")
        counted = rest.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
        entries, round_ = staged(rest.join(counted, "token"), "jaccard-lists", made), round_ + 1

    every = edges[0]
    for e in edges[1:]:
        every = every.unionAll(e)
    found = components(every)
    discard(spark, made)
    found = found.join(ids, F.col("node") == F.col("set")).select("set", "label", "doc_id")
    least = found.groupBy("label").agg(F.min("doc_id").alias("least"))
    return signed.drop("prefix"), found.join(least, "label").select("set", F.col("least").alias("label"))


def report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: size of its set and the smallest id of its component."""
    signed, labels = classes(docs, **options)
    alone = signed.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("own"))
    named = alone.join(labels, "set", "left").select("set", F.coalesce("label", "own").alias("component_id"))
    out = signed.join(named, "set", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, that of the smallest doc_id; columns as they were.

    Rows that repeat an id and a text are one document. Empty sets link with
    nothing and stay, as do rows without an id, which cannot be told apart.
    """
    r = report(docs, **options)
    stay = r.where("n_shingles = 0 OR doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_stay")), "left_semi").dropDuplicates(["doc_id", "text"])
