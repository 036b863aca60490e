import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradelake.llm import rule_ensemble, toxicity_chain


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    calm, rude, docs, labels = [f"word{k}" for k in range(300)], ["idiot", "moron", "scum"], [], []
    for k in range(900):
        words = [rng.choice(calm) for _ in range(rng.randrange(5, 80))]
        toxic, junk = rng.random() < 0.15, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(rude))
        text = " ".join(words) + "." if not junk else " ".join(w.upper() + "!!" for w in words)
        docs.append((k, text, "x"))
        labels.append((k, int(not junk), int(toxic)))
    docs += [(2000, None, "x"), (2001, "", "x"), (5, docs[5][1], "x"), (None, "word1 idiot", "x"), (2002, "word2 " * 30_000, "x")]
    labels += [(None, 1, 0), (3, None, None), (7, 1, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, y string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def accuracy(scored, labels, label):
    known = labels.where(f"{label} IS NOT NULL AND doc_id <> 7")
    return scored.where("held_out").join(known, "doc_id").agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]


def test_rules(tables):
    docs, labels = tables
    scored = rule_ensemble.report(docs, labels)
    assert scored.count() == docs.count() and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert accuracy(scored, labels, "quality") > 0.97
    model = rule_ensemble.train(docs, labels)
    assert 0 < len(model.rules) and all(" if " in line for line in model.describe())


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random((300, len(rule_ensemble.INPUTS)))
    y = ((x[:, 2] > 0.4) & (x[:, 5] < 0.7)).astype(float)
    rules = rule_ensemble.grow(x, y, trees=8)
    z = np.column_stack([rule_ensemble.holds(r, x) for r in rules]).astype(np.float32)
    w, b = rule_ensemble.lasso(z, y, 1e-3)
    model = rule_ensemble.RuleModel(list(zip(rules, map(float, w))), b)
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "k int, x array<double>")
    got = [r.s for r in df.select("k", model.column(F.col("x")).alias("s")).orderBy("k").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-(z @ w + b))), atol=1e-6) and ((np.array(got) > 0.5) == y).mean() > 0.97


def test_chain(tables):
    docs, labels = tables
    scored = toxicity_chain.report(docs, labels)
    assert scored.count() == docs.count() and scored.where("score IS NULL").count() == 0
    assert accuracy(scored, labels, "toxic") > 0.97
    assert scored.where("doc_id IS NULL AND predicted = 1").count() == 1
    assert scored.where("doc_id IN (2000, 2001) AND predicted = 1").count() == 0


def test_the_chain_changes_scores(tables):
    docs, labels = tables
    chain = toxicity_chain.train(docs, labels)
    n = len(chain.inputs.features)
    assert [len(w) for w in chain.weights] == [n + 1, n + 2, n + 3]
    alone = [np.r_[w[:n], np.zeros(len(w) - n - 1), w[-1]] for w in chain.weights]  # blind to earlier categories
    on = {r.doc_id: r.p_toxic for r in toxicity_chain.score(docs, chain).where("doc_id < 900").collect()}
    off = {r.doc_id: r.p_toxic for r in toxicity_chain.score(docs, toxicity_chain.Chain(chain.inputs, alone)).where("doc_id < 900").collect()}
    assert max(abs(on[k] - off[k]) for k in on) > 0.005  # the inputs alone part these classes almost


def test_chain_equals_plain_numpy():
    """Against the same chain over dense matrices, one row and one fold at a time."""
    rng = np.random.default_rng(2)
    n, d = 120, 6
    there = rng.random((n, d)) < 0.4
    y = (there[:, 0] | (there[:, 1] & there[:, 2])).astype(float)
    size, fold = rng.integers(1, 400, n), rng.integers(0, 3, n)
    views = [toxicity_chain.Inputs(np.sort(rng.choice(d, m, replace=False)).astype(np.uint64), rng.normal(size=m), rng.random(m) < 0.5) for m in (5, 4, 6, 3)]
    row, feature = np.nonzero(there)
    chain = toxicity_chain.fit_chain(row, feature.astype(np.uint64), y, size, fold, views[0], views[1:])

    def dense(view, extra):
        return np.c_[there[:, view.features.astype(int)] * view.scale, extra, np.ones(n)]

    def target(view, category):
        marks = there[:, view.features.astype(int)][:, view.marked].sum(1)
        return y * {"dense": marks * 50 >= size, "repeated": marks >= 8, "toxic": y == y}[category]

    def fit(x, t, steps=150, l2=1e-4):
        w = np.zeros(x.shape[1])
        if t.min() == t.max():
            w[-1] = np.log((t.sum() + 0.5) / (len(t) - t.sum() + 0.5))
            return w
        k = x.shape[1] - 1
        rate = 4 * len(t) / (len(t) * (k - scaled + 1) + (x[:, :scaled] ** 2).sum())
        v, s = w, 1.0
        for _ in range(steps):
            new, u = v - rate * (x.T @ (toxicity_chain.sigmoid(x @ v) - t) / len(t) + l2 * v), (1 + np.sqrt(1 + 4 * s * s)) / 2
            v, w, s = new + (s - 1) / u * (new - w), new, u
        return w

    extra, weights = np.zeros((n, 0)), []
    for category in toxicity_chain.CATEGORIES:
        scaled = len(views[0].features)
        weights.append(fit(dense(views[0], extra), target(views[0], category)))
        apart = np.zeros(n)
        for k, view in enumerate(views[1:]):
            scaled = len(view.features)
            x, rest = dense(view, extra), fold != k
            apart[~rest] = toxicity_chain.sigmoid(x[~rest] @ fit(x[rest], target(view, category)[rest]))
        extra = np.c_[extra, apart]
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(chain.weights, weights))
    p = np.zeros((n, 0))
    for w in weights:
        p = np.c_[p, toxicity_chain.sigmoid(dense(views[0], p) @ w)]
    assert np.allclose(chain.probabilities(row, feature.astype(np.uint64), n), p, atol=1e-6)


@pytest.mark.parametrize("module, label", [(rule_ensemble, "quality"), (toxicity_chain, "toxic")])
def test_without_labels_or_documents(tables, module, label):
    docs, labels = tables
    assert module.report(docs.limit(0), labels).count() == 0
    one_class = module.report(docs.limit(9), labels.limit(0))
    assert one_class.select("score").distinct().count() == 1
