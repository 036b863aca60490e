"""Ranked lexical search over inverted lists cut into geometric blocks.

One pass over the texts writes each document's postings: its number of terms
and how often it holds each term that some query asks for. Document counts and
lengths of the whole collection, and of each term, are summed from them. Shards
of postings are then searched on their own, each task giving its best rows:

Every term's list is clustered by how alike its documents are, and every block
keeps the largest impact per term of any of its documents. A query goes through
its terms from the largest possible part of a score to the smallest. A block
whose summary cannot reach the k-th best score known so far is skipped, and so
is a list when it and all lists after it cannot; everything else is scored in
full. A skipped document cannot be among the k best, so answers are exact.
Lists are clustered when a query first opens them.

Queries travel in blocks of bounded bytes. Null and term-free texts match
nothing and do not count as documents. Every query row is an item of its own,
also if ids repeat or are null. Rows that repeat a document's id are documents
of their own; at equal scores a null id comes last. Texts are read whole at any
length. Empty tables give an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tradelake.llm.staging import staged
from tradelake.llm.tokens import NOT_ALNUM, chunks, words

TOP = 10
#: Fixed values of the score: weight scale, impact scale, and the part of a length that counts, in percent.
WEIGHT, IMPACT, SATURATION, LENGTH_PERCENT = 1000, 1_000_000_000, 8, 90
BLOCK_DOCS, SKETCH = 32, 16
CHUNK_BYTES, SHARD_POSTINGS, QUERY_BYTES = 4_000_000, 1_000_000, 4_000_000


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and fingerprint of every term of some texts."""
    w = words(texts, NOT_ALNUM)
    return w.text_of_word(), w.hash


def _posted(vocabulary: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and their terms of the vocabulary."""
    for batch in chunks(batches, "text", CHUNK_BYTES):
        text, term = _terms(batch.column("text"))
        n = np.bincount(text, minlength=batch.num_rows)
        at = np.minimum(np.searchsorted(vocabulary, term), max(len(vocabulary) - 1, 0))
        here = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
        pair, tf = np.unique(text[here] * np.int64(len(vocabulary)) + at[here], return_counts=True)
        owner, pair = np.divmod(pair, max(len(vocabulary), 1))
        rows = np.flatnonzero(n)
        first = pa.array(np.r_[np.searchsorted(owner, rows), len(owner)].astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc").take(pa.array(rows)), pa.array(n[rows]), pa.ListArray.from_arrays(first, pa.array(pair.astype(np.int32))),
             pa.ListArray.from_arrays(first, pa.array(tf.astype(np.int32)))], ["doc", "n", "terms", "tf"])


class Block:
    """Queries with the weights of their terms."""

    def __init__(self, queries: list[np.ndarray], df: np.ndarray, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        self.queries = queries

    def impact(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * self.n_docs) // self.n_terms
        return (IMPACT * tf) // (1000 * tf + SATURATION * m)

    def company(self) -> list[np.ndarray]:
        """For each term, the terms that stand beside it in some query: its summaries need no others."""
        own = np.concatenate(self.queries) if self.queries else np.zeros(0, np.int64)
        query = np.repeat(np.arange(len(self.queries)), [len(q) for q in self.queries])
        by = np.argsort(own, kind="stable")
        asking = np.split(query[by], np.searchsorted(own[by], np.arange(1, len(self.weight))))
        return [np.unique(np.concatenate([self.queries[q] for q in qs])) if len(qs) else qs for qs in asking]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... size[0] of them, and so on."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + size, size)


class Shard:
    """Postings by document and by term; geometric blocks of the lists that were opened."""

    def __init__(self, block: Block, company: list[np.ndarray], n: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.block, self.company = block, company
        self.first, self.size, self.term = np.cumsum(size) - size, size, term
        doc = np.repeat(np.arange(len(size)), size)
        self.impact = block.impact(tf, n[doc])
        by = np.argsort(term, kind="stable")
        self.docs, ends = doc[by], np.searchsorted(term[by], np.arange(len(block.weight) + 1))
        self.begin, self.end = ends[:-1], ends[1:]
        self.largest = np.zeros(len(block.weight), np.int64)
        np.maximum.at(self.largest, term, self.impact)
        self.lists: dict[int, tuple] = {}
        # a few coordinates that keep angles between documents
        signs = np.random.default_rng(13).choice(np.array([-1, 1], np.float32), (len(block.weight), SKETCH))
        self.sketch = np.zeros((len(size), SKETCH), np.float32)
        some = np.flatnonzero(size)
        if len(some):
            part = (block.weight[term] * self.impact).astype(np.float32)[:, None] * signs[term]
            self.sketch[some] = np.add.reduceat(part, self.first[some], axis=0)
            self.sketch /= np.maximum(np.linalg.norm(self.sketch, axis=1, keepdims=True), 1e-9)

    def _labels(self, docs: np.ndarray) -> np.ndarray:
        """The nearest of some documents spread over the list, for each document."""
        count = math.ceil(len(docs) / max(BLOCK_DOCS, math.isqrt(len(docs))))
        middles = self.sketch[docs[np.arange(count) * len(docs) // count]].T
        return np.concatenate([np.argmax(self.sketch[docs[a : a + 4096]] @ middles, axis=1) for a in range(0, len(docs), 4096)])

    def blocks(self, t: int) -> tuple:
        """A list's documents by block, where blocks begin, and their summaries: block, term, largest impact."""
        if t not in self.lists:
            docs = self.docs[self.begin[t] : self.end[t]]
            label = self._labels(docs)
            by = np.argsort(label, kind="stable")
            docs, label = docs[by], np.unique(label[by], return_inverse=True)[1]
            begin = np.r_[np.flatnonzero(np.r_[True, label[1:] != label[:-1]]), len(docs)]
            at = _ranges(self.first[docs], self.size[docs])
            term, owner = self.term[at], np.repeat(label, self.size[docs])
            wanted = np.zeros(len(self.block.weight), bool)
            wanted[self.company[t]] = True
            keep = wanted[term]
            key = owner[keep] * len(wanted) + term[keep]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            most = np.maximum.reduceat(self.impact[at[keep][order]], new)
            self.lists[t] = (docs, begin, *np.divmod(key[new], len(wanted)), most)
        return self.lists[t]

    def scores(self, docs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        at = _ranges(self.first[docs], self.size[docs])
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], np.cumsum(self.size[docs]) - self.size[docs])

    def search(self, query: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents that may be among the best, their scores, and the best scores so far (`best` are those before)."""
        weight = np.zeros(len(self.block.weight), np.int64)
        weight[query] = self.block.weight[query]
        part = weight[query] * self.largest[query]
        order = np.argsort(-part, kind="stable")
        query, part = query[order], part[order]
        rest = np.cumsum(part[::-1])[::-1]  # what the lists from here on can give at most
        seen = np.zeros(len(self.size), bool)
        docs, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for t, bound in zip(query.tolist(), rest.tolist()):
            if bound < max(best[0], 1):
                break
            listed, begin, owner, term, most = self.blocks(t)
            reach = np.bincount(owner, weight[term] * most, len(begin) - 1)  # whole numbers below 2^53
            by = np.argsort(-reach, kind="stable")
            at = 0
            while at < len(by) and reach[by[at]] >= max(best[0], 1):
                some = by[at : at + 8]
                some = some[reach[some] >= max(best[0], 1)]
                at += len(some)
                found = listed[_ranges(begin[some], begin[some + 1] - begin[some])]
                found = found[~seen[found]]
                if not len(found):
                    continue
                seen[found] = True
                score = self.scores(found, weight)
                docs.append(found)
                scores.append(score)
                best = np.sort(np.r_[best, score])[-len(best) :]
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        good = scores >= max(best[0], 1)
        return docs[good], scores[good], best


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    waiting, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + SHARD_POSTINGS - size, "right")))
            waiting.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - before)
            at = to
            if size >= SHARD_POSTINGS or at < batch.num_rows:
                yield pa.Table.from_batches(waiting)
                waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)


def _searched(block: Block, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    company = block.company()
    best = np.zeros((len(block.queries), k), np.int64)
    for t in _shards(batches):
        t = t.combine_chunks()
        terms, tf = (t[c].chunk(0) for c in ("terms", "tf"))
        shard = Shard(block, company, t["n"].to_numpy(), np.asarray(terms.value_lengths()).astype(np.int64),
                      terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64))
        place = np.empty(t.num_rows, np.int64)
        place[pc.sort_indices(t["doc"], null_placement="at_end").to_numpy()] = np.arange(t.num_rows)
        query, docs, scores = [], [], []
        for q, own in enumerate(block.queries):
            found, score, best[q] = shard.search(own, best[q])
            first = np.lexsort((place[found], -score))[:k]
            query.append(np.full(len(first), q, np.int32))
            docs.append(found[first])
            scores.append(score[first])
        rows = t["doc"].chunk(0).take(pa.array(np.concatenate(docs)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), rows, pa.array(np.concatenate(scores))], ["query", "doc", "score"])


def _block_search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame | None:
    spark, rows = docs.sparkSession, items.toArrow()
    text, term = _terms(pa.concat_arrays(rows["text"].chunks) if rows.num_rows else pa.array([], pa.string()))
    vocabulary, at = np.unique(term, return_inverse=True)
    if not len(vocabulary):
        return None
    queries = [np.unique(q) for q in np.split(at.astype(np.int64), np.searchsorted(text, np.arange(1, rows.num_rows)))]
    kind = docs.schema["doc"].dataType.simpleString()
    postings = staged(docs.mapInArrow(partial(_posted, vocabulary), f"doc {kind}, n bigint, terms array<int>, tf array<int>"), "postings")
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    counts = postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow()  # one row per asked term
    df = np.zeros(len(vocabulary), np.int64)
    df[counts["t"].to_numpy()] = counts["n"].to_numpy()
    found = postings.mapInArrow(partial(_searched, Block(queries, df, n_docs, n_terms), k), f"query int, doc {kind}, score bigint")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(rows.num_rows, dtype=np.int32)), "item": rows["item"]}))
    return top.join(F.broadcast(names), "query").select("item", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, *, id: str = "doc_id", text: str = "text", item: str = "item_id",
           query: str = "text", k: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item, rank, doc, score): the k best documents of every item, scores above 0."""
    docs = docs.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    items = items.select(F.col(item).alias("item"), F.col(query).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + 2 * total // query_bytes  # filled by half on average
    types = f"item {items.schema['item'].dataType.simpleString()}, rank int, doc {docs.schema['doc'].dataType.simpleString()}, score bigint"
    out = docs.sparkSession.createDataFrame([], types)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        found = _block_search(docs, part, k)
        out = out if found is None else found if b == 0 else out.unionAll(found)
    return out


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The best documents of every item under the names of the tables."""
    return search(docs, items, **options).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


REPORT_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, terms, len(terms) AS n FROM lowered WHERE len(terms) > 0
), whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM docs),
asked AS (
  SELECT DISTINCT row, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS row, * FROM benchmark)
), postings AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * (SELECT docs FROM whole) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings GROUP BY term
), impacts AS (
  SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)) AS impact FROM postings, whole
), scored AS (
  SELECT a.row AS query, a.item_id, i.row, i.doc_id, sum(w * impact)::BIGINT AS score
  FROM asked a JOIN impacts i USING (term) JOIN weights USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
