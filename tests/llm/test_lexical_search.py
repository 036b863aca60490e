import math
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from tradelake.llm import lexical_search
from tradelake.llm.tokens import NOT_ALNUM, words


def ranked(docs, items, k=10):
    """{item row: [(doc_id, score)]} by scoring every document."""
    bags = [(i, Counter(brute.alnum_words(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = {}
    for row, (_, text) in enumerate(items):
        scores = []
        for i, b, n in bags:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                        for t in set(brute.alnum_words(text)) if b[t])
            if score > 0:
                scores.append((i, score))
        out[row] = sorted(scores, key=lambda s: (-s[1], s[0] is None, s[0]))[:k]
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(13)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "naïve", "x1"]
    text = lambda n: " ".join(rng.choice(vocabulary[: rng.choice([5, 30, 63])]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 3, 20, 80]))) for k in range(400)]
    docs += [(1000 + k, "W3 w4, w5 rare") for k in range(40)]  # copies tie by id
    docs += [(7, "w1 twice"), (None, "w3 w4 w5 rare"), (2000, None), (2001, "?!"), (2002, "w2 " * 200_000 + "odd")]
    items = [(k, text(rng.choice([1, 4, 30]))) for k in range(12)] + [(3, "again w9"), (None, "w1 RARE"), (50, None), (51, "..."), (52, "nowhere"), (53, "odd rare")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id long, text string, score double, item string"),
            spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("query_bytes", [4_000_000, 300])
def test_equals_brute_force(spark, case, query_bytes):
    docs, items = case
    d, i = frames(spark, docs, items)
    got = [tuple(r) for r in lexical_search.report(d.repartition(3), i, query_bytes=query_bytes).collect()]
    want = [(items[row][0], rank, doc, score) for row, best in ranked(docs, items).items() for rank, (doc, score) in enumerate(best, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fewer_asked_for(spark, case):
    docs, items = case
    got = lexical_search.report(*frames(spark, docs, items), k=1).collect()
    want = [(items[row][0], *best[0]) for row, best in ranked(docs, items).items() if best]
    assert sorted(((r.item_id, r.doc_id, r.score) for r in got), key=str) == sorted(want, key=str)


def test_empty_tables(spark, case):
    d, i = frames(spark, *case)
    assert lexical_search.report(d.limit(0), i).collect() == []
    assert lexical_search.report(d, i.limit(0)).collect() == []
    assert lexical_search.report(d.where("doc_id > 1999 AND doc_id < 2002"), i).collect() == []


def _block(docs, items):
    """Postings and queries as the search makes them, in one process."""
    vocabulary, at = np.unique(np.concatenate([words(pa.array([t], pa.string()), NOT_ALNUM).hash for _, t in items]), return_inverse=True)
    ends = np.cumsum([len(words(pa.array([t], pa.string()), NOT_ALNUM).hash) for _, t in items])
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], ["doc", "text"])
    posted = list(lexical_search._posted(vocabulary, iter([batch])))
    n = np.concatenate([b.column("n").to_numpy() for b in posted])
    df = np.bincount(np.concatenate([b.column("terms").flatten().to_numpy() for b in posted]), minlength=len(vocabulary))
    return lexical_search.Block([np.unique(q) for q in np.split(at, ends[:-1])], df, len(n), int(n.sum())), posted


def test_shards_and_skipped_blocks(monkeypatch, case):
    docs, items = case
    block, posted = _block(docs, items)
    scored = []
    real = lexical_search.Shard.scores
    monkeypatch.setattr(lexical_search.Shard, "scores", lambda self, d, w: (scored.append(len(d)), real(self, d, w))[1])
    best = {}
    for size in (10**6, 500):  # one shard, then many
        monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", size)
        found = [r for b in lexical_search._searched(block, 10, iter(posted)) for r in zip(*(c.to_pylist() for c in b.columns))]
        best[size] = {q: sorted(((d, s) for p, d, s in found if p == q), key=lambda r: (-r[1], r[0] is None, r[0]))[:10] for q in range(len(items))}
        assert best[size] == ranked(docs, items)
    matching = sum(bool(set(brute.alnum_words(t)) & set(brute.alnum_words(q))) for _, t in docs for _, q in items)
    assert sum(scored) < 2 * matching  # some documents of the lists were never scored


def test_summaries_bound_every_score(case):
    docs, items = case
    block, posted = _block(docs, items)
    t = pa.Table.from_batches(posted).combine_chunks()
    terms, tf = t["terms"].chunk(0), t["tf"].chunk(0)
    shard = lexical_search.Shard(block, block.company(), t["n"].to_numpy(), np.asarray(terms.value_lengths()).astype(np.int64),
                                 terms.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64))
    for query in block.queries:
        weight = np.zeros(len(block.weight), np.int64)
        weight[query] = block.weight[query]
        for term in query:
            if shard.begin[term] == shard.end[term]:
                continue
            listed, begin, owner, coordinate, most = shard.blocks(term)
            assert sorted(listed) == sorted(shard.docs[shard.begin[term] : shard.end[term]])
            reach = np.bincount(owner, weight[coordinate] * most, len(begin) - 1)
            scores = shard.scores(listed, weight)
            assert (reach >= np.maximum.reduceat(scores, begin[:-1])).all()
