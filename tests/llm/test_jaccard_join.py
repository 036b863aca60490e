import random

import brute
import pytest

from tradelake.llm import jaccard_join


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    line = "a very common line that many texts share in full"
    out = [None, "", "  \n ", "One", "one", "two words", "TWO words", "three words here", "three words there"]
    for size in (40, 120, 150):
        base = [rng.choice(vocabulary) for _ in range(size)]
        copies = [edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 4, 6])) for _ in range(60)]
        out += copies + [edited(rng, rng.choice(copies).split(), 1) for _ in range(40)]  # copies of copies
    out += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))) + " " + line for _ in range(60)]
    rng.shuffle(out)
    return [(k * 3 % 1009, t) for k, t in enumerate(out)] + [(5, out[20]), (5, out[20]), (6, out[21])]


@pytest.mark.parametrize("short, block", [(48, 1500), (4, 25)])
def test_components_equal_brute_force(spark, rows, monkeypatch, short, block):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, set string")
    got = sorted(tuple(r) for r in jaccard_join.report(docs, slots=1 << 14).collect())
    want = brute.jaccard_components(rows)
    assert got == sorted((rows[k][0], *want[k]) for k in want)


def test_one_of_each_component_stays(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard_join.deduplicate(docs, slots=1 << 14)
    want = {(i, t) for k, (i, t) in enumerate(rows) if brute.jaccard_components(rows)[k][1] == i or not brute.shingles(t)}
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.report(docs, slots=1 << 14).count() == 0 and jaccard_join.deduplicate(docs, slots=1 << 14).count() == 0
