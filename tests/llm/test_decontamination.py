import hashlib
import random

import brute
import numpy as np
import pytest

from tradelake.llm import decontamination, suffix_array

COLUMNS = "doc_id long, text string, n_words string"  # n_words: a clashing name


def words_of(rng, n):
    return " ".join(rng.choice("a b c d, E f'g é-h".split()) for _ in range(n))


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(4)
    items = [(k, words_of(rng, rng.choice([0, 3, 10, 14, 40]))) for k in range(30)] + [(90, None), (91, "..."), (3, "zz yy"), (None, "only here qq ww"), (92, words_of(rng, 400))]
    docs = [(k, words_of(rng, rng.choice([0, 2, 9, 60, 200])), "x") for k in range(60)]
    docs += [(100 + k, f"{words_of(rng, 7)} {t} {words_of(rng, 5)}", None) for k, (_, t) in enumerate(items[:20])]
    docs += [(300, f"x {items[-1][1]}", "x"), (301, "a Only HERE, qq ww", "x")]
    docs += [docs[-1]] * 3 + [(None, items[3][1], "x"), (200, None, "x"), (201, "Zz. YY", "x"), (202, "q " * 3000 + (items[4][1] or ""), "x")]
    return spark.createDataFrame(docs, COLUMNS), spark.createDataFrame(items, "item_id long, text string"), docs, items


@pytest.mark.parametrize("block_bytes", [16_000_000, 600])
def test_hits_equal_brute_force(case, block_bytes):
    docs, tests, rows, items = case
    got = sorted((r[:6] for r in decontamination.report(docs, tests, block_bytes=block_bytes).collect()), key=str)
    want = []
    for doc, text, _ in rows:
        n, hit, found = brute.window_hits(text, items)
        found = [f for f in found if f != "None"]
        want.append((doc, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0))
    assert [tuple(r) for r in got] == sorted(want, key=str)


def test_matches_are_verbatim_and_longest(case):
    docs, tests, rows, items = case
    texts = {doc: brute.alnum_words(text) for doc, text, _ in rows}
    bodies = [brute.alnum_words(t) for _, t in items]
    for r in decontamination.report(docs, tests).where("doc_id < 110").collect():
        w = texts[r.doc_id]
        for m in r.matches:
            assert any(b[m.item_start : m.item_start + m.length] == w[m.start : m.start + m.length]
                       and b[m.item_start + m.length : m.item_start + m.length + 1] != w[m.start + m.length : m.start + m.length + 1] or
                       b[m.item_start : m.item_start + m.length] == w[m.start : m.start + m.length] and (len(b) == m.item_start + m.length or len(w) == m.start + m.length)
                       for b in bodies)


def test_affected_documents_go(case):
    docs, tests, rows, items = case
    kept = decontamination.decontaminate(docs, tests)
    assert kept.columns == docs.columns
    assert kept.count() == sum(brute.window_hits(t, items)[1] == 0 for _, t, _ in rows)


def test_empty_tables(spark, case):
    docs, tests, *_ = case
    assert decontamination.decontaminate(docs.limit(0), tests).count() == 0
    assert decontamination.decontaminate(docs, tests.limit(0)).count() == docs.count()


def test_suffixes_that_end_sort_first():
    rng = np.random.default_rng(4)
    for _ in range(50):
        texts = [rng.integers(0, 3, rng.integers(0, 30)).astype(np.uint64) for _ in range(12)]
        words, left = np.concatenate(texts), np.concatenate([np.arange(len(t), 0, -1) for t in texts])
        order = suffix_array.build(words, left).order
        suffixes = [words[p : p + left[p]].tolist() for p in order]
        assert suffixes == sorted(suffixes)
