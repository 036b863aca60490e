import math
import random

import numpy as np
import pytest

from tradelake.llm import hash_forest

COLUMNS = "vec_id long, embedding array<double>, query_id string, score int"  # two clashing names


def usable(rows, dim):
    return [(i, v) for i, v in rows if i is not None and v is not None and len(v) == dim
            and all(c is not None and math.isfinite(c) for c in v) and any(v)]


def cosine(a, b):
    a, b = (np.ldexp(np.array(x, float), -np.frexp(np.abs(x).max())[1]) for x in (a, b))
    return (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))


def nearest(rows, k=5, every=50):
    """[(query id, [(vec_id, score)])] by all cosines."""
    return [(i, sorted(((j, cosine(w, v)) for j, w in rows if j != i), key=lambda r: (-round(r[1], 12), r[0]))[:k])
            for i, v in rows if i % every == 0]


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    middles = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    out = [(k, [c + rng.gauss(0, 0.4) for c in rng.choice(middles)]) for k in range(1500)]
    hot = [rng.gauss(0, 1) for _ in range(16)]
    out += [(2000 + k, hot) for k in range(700)]  # copies: ties go to the smaller id
    out += [(3000, [2 * c for c in hot]), (3001, [1e300 * c for c in middles[0]]), (3050, [-c for c in hot])]
    out += [(4000, None), (4050, [0.0] * 16), (4100, [None] + hot[1:]), (4150, [math.nan] + hot[1:]), (4200, [math.inf] + hot[1:]),
            (4250, hot[:15]), (4300, []), (None, hot)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], COLUMNS)


def test_recall_and_scores(spark, rows):
    good = usable(rows, 16)
    by_id = dict(good)
    got = answers(hash_forest.report(frame(spark, rows).repartition(3)))
    want = nearest(good)
    assert set(got) == {i for i, _ in want}
    hits = 0
    for i, best in want:
        assert [r for r, _, _ in got[i]] == [1, 2, 3, 4, 5]
        assert [(-s, j) for _, j, s in got[i]] == sorted((-s, j) for _, j, s in got[i])
        assert all(s == pytest.approx(cosine(by_id[j], by_id[i]), abs=1e-14) for _, j, s in got[i])
        hits += len({j for _, j, _ in got[i]} & {j for j, _ in best})
    assert hits >= 0.9 * 5 * len(want)


def test_copies_tie_to_the_smaller_id(spark, rows):
    got = answers(hash_forest.report(frame(spark, rows).repartition(4)))
    assert [j for _, j, _ in got[2000]] == [2001, 2002, 2003, 2004, 2005]
    assert [j for _, j, _ in got[2650]] == [2000, 2001, 2002, 2003, 2004]
    assert len({s for _, _, s in got[2650]}) == 1


def test_blocks_and_all_candidates_give_the_exact_answer(spark, rows):
    index = hash_forest.Index(frame(spark, rows))
    good = usable(rows, 16)
    got = answers(index.search(index.rows.where("id % 50 = 0"), candidates=10**9, block_bytes=2000))
    assert {i: [j for _, j, _ in a] for i, a in got.items()} == {i: [j for j, _ in best] for i, best in nearest(good)}


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (3, [0.0, 1.0]), (0, [0.9, 0.1])]
    got = hash_forest.report(frame(spark, rows)).collect()
    assert {r.vec_id for r in got if r.query_id == 50} == {0, 3} and max(r.rank for r in got if r.query_id == 50) == 3
    assert {r.vec_id for r in got if r.query_id == 0} == {50, 3}  # rows of its own id are no candidates
    assert hash_forest.report(frame(spark, [(0, [1.0, 2.0])])).collect() == []


def test_empty_tables(spark):
    assert hash_forest.report(frame(spark, [])).collect() == []
    assert hash_forest.report(frame(spark, [(0, None), (50, [])])).collect() == []
    assert hash_forest.report(frame(spark, [(1, [1.0]), (2, [2.0])])).collect() == []


def test_ranges_hold_what_agrees():
    rng = np.random.default_rng(1)
    forest = hash_forest.Forest(rng.standard_normal((200, 8)), 3)
    q = hash_forest.strings(rng.standard_normal((20, 8)), 3)
    counts = forest.counts(q)
    for n in range(20):
        for depth in (0, 1, 5, 9, 64):
            same = sum(int(np.sum((forest.sorted[t] ^ q[t, n]) >> np.uint64(64 - depth) == 0)) if depth else 200 for t in range(3))
            assert counts[n, depth] == same
