import brute
import pytest

from tradelake.llm import line_quality


def text(n):
    sentence = lambda k, i: " ".join(f"w{k}x{i}y{j}" for j in range(12)).capitalize() + "."
    return "\n".join(" ".join(sentence(k, i) for i in range(3)) for k in range(n))


ROWS = [
    (1, text(4)), (2, None), (3, ""), (4, " \n\t\n "), (5, "too short."), (6, "Again Again Again " * 60),
    (7, text(3) + "\nHome\nSkip to content\nAll rights reserved.\n"), (8, "LOUD!! WORDS!! HERE!! " * 40),
    (9, "a### b$$$ c&&& d%%% " * 40), (10, text(2) + "\n" + text(2)), (11, text(1) + "\n" + "cell | cell2 | x | y | z | " * 20),
    (12, "x" * 200_000 + " end."), (None, text(4)), (1, text(4)),
]


def base(t):
    w = brute.space_words(t, lowered=False)
    seen, twice = {}, set()
    for k in range(len(w) - 2):
        seen.setdefault(tuple(w[k : k + 3]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            twice |= {k + i for k in at for i in range(3)}
    lines = [x for x in (t or "").split("\n") if brute.space_words(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in line_quality.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(twice),
            n < 50 or 100 * len(twice) > 50 * n)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in ROWS], "doc_id long, text string, kept string, n_chars long")


def test_base_signals(docs):
    got = sorted((tuple(r)[:7] for r in line_quality.report(docs).collect()), key=str)
    assert got == sorted(((i, *base(t)) for i, t in ROWS), key=str)


def test_verdicts_and_cleaned_text(docs):
    kept = {r.doc_id: r for r in line_quality.clean(docs).collect()}
    assert set(kept) == {1, 7, None} and list(kept[1].asDict()) == docs.columns
    assert kept[7].text == text(3) + "\n" and kept[7].n_chars == len(kept[7].text)
    assert kept[1].text == text(4)
    assert line_quality.clean(docs.limit(0)).count() == 0


def test_plan_is_native(docs):
    plan = line_quality.report(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
