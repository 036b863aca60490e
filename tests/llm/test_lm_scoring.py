import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from tradelake.llm import gru, lm_scoring


def test_gradients():
    rng = np.random.default_rng(0)
    model = gru.Gru.start(rng.random(gru.HEAD + gru.TAIL) * 9 + 1)
    model.p = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in model.p.items()}
    before = rng.integers(0, 60, (7, 5))
    after = np.r_[before[1:], rng.integers(0, gru.HEAD + gru.TAIL, (1, 5))]
    before[3, 2] = 0
    h = rng.standard_normal((5, gru.HIDDEN))
    _, grads, _ = model.slope(h, before, after)
    for name, g in grads.items():
        for at in np.argsort(-np.abs(g).ravel())[[0, 3, 30]]:
            old, e = model.p[name].ravel()[at], 1e-5
            losses = []
            for v in (old + e, old - e):
                model.p[name].ravel()[at] = v
                losses.append(model.slope(h, before, after)[0])
            model.p[name].ravel()[at] = old
            assert (losses[0] - losses[1]) / (2 * e) == pytest.approx(g.ravel()[at], rel=1e-3, abs=1e-7)


def test_score_does_not_depend_on_windows_or_neighbours():
    rng = np.random.default_rng(1)
    model = gru.Gru.start(rng.random(gru.HEAD + gru.TAIL) + 1)
    model.p["c"] += rng.standard_normal(model.p["c"].shape).astype(np.float32)
    texts = [np.append(rng.integers(1, gru.HEAD + gru.TAIL, n), 0) for n in (0, 1, 31, 32, 33, 200, 5)]
    together = model.score(texts)
    for t, want in zip(texts, together):
        h, total, last = np.zeros((1, gru.HIDDEN), np.float32), 0.0, 0
        for token in t:
            h, _ = model.step(h, np.array([last]))
            total += model.outputs(h, np.array([token]))[0][0]
            last = token
        assert total == pytest.approx(want, rel=1e-4)


def test_base_and_score(spark):
    rng = random.Random(2)
    lists = ["der die das und ist".split(), "the of and to was".split()]
    rows = []
    for k in range(300):
        words = rng.choice(lists)
        rows.append((k, " ".join(rng.choice(words) if rng.random() < 0.9 else f"w{rng.randrange(3000)}" for _ in range(rng.randrange(1, 80)))))
    rows += [(400, None), (401, ""), (402, " A a\tÄ"), (None, "the of"), (5, rows[5][1])]
    got = lm_scoring.report(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int"), sample_docs=150, listed=40).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not out(i):
            counts.update([*brute.space_words(t), None])
    total, size = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*brute.space_words(t), None]
        base = sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in tokens)
        want.append((i, out(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6)))
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=str) == sorted(want, key=str)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_table(spark):
    assert lm_scoring.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_all_training_documents_teach_the_model(spark):
    """Word order that no document of the sample shows."""
    rng = random.Random(4)
    words, rows = [f"w{k}" for k in range(12)], []
    for k in range(1500):
        at = rng.randrange(12)
        rows.append((k, " ".join(words[(at + j) % 12] for j in range(rng.randrange(40, 80)))))
    got = lm_scoring.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id"), sample_docs=1).where("held_out")
    n, base, score = got.selectExpr("sum(n_tokens)", "sum(base_score)", "sum(score)").first()
    assert score / n > base / n + 0.3
