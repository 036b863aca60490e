import hashlib
import random
import re

import pyarrow as pa
import pytest

from tradelake.llm import fill_in_middle as fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def formed(doc, text):
    """(n, form, prefix_chars, middle_chars, output) in plain Python."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = [int(sha(f"1:{'' if doc is None else doc}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    alphabet = ["a", "Zq", "@", "[", "`", "{", "é", "ß", "漢", "😀", " ", "\n", "\x00", "\x7f", "<", ">", "<S", "P>", "7", "_", "ſ"]
    out = [(k, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 7, 8, 9, 30, 200])))) for k in range(300)]
    out += [(k, "x" * (k - 300)) for k in range(300, 334)] + [(400, "abc<M>def"), (401, None), (402, ""), (None, "no id"), (5, "twice")]
    return out + [(403, "ab é" * 200_000), (404, "漢" * 300_000), (405, "q" * 1_000_000)]


def test_equals_plain_python(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    got = fim.transform(docs).collect()
    assert got and set(got[0].row.asDict()) == {"doc_id", "text", "output", "n"}
    assert [(r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got] == [formed(i, t) for i, t in rows]
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_text_comes_back(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fim.report(docs).collect()
    assert [r.restored_sha256 for r in got] == [sha(t or "") for _, t in rows]
    assert [r.output_sha256 for r in got] == [sha(formed(i, t)[-1]) for i, t in rows]


def test_empty_table(spark):
    assert fim.report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("text", ["", "a", "é", "aé", "abcdefgh", "abcdefg漢", "😀😀", "ab cd"])
def test_every_cut(text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    got = fim.Units(pa.array([text] * (len(units) + 1)))
    assert got.n.tolist() == [len(units)] * (len(units) + 1)
    cuts = ["".join(units[:k]) for k in range(len(units) + 1)]
    sizes = got.cut(pa.array(range(len(units) + 1)).to_numpy())
    assert sizes.tolist() == [len(c.encode()) for c in cuts]
    assert got.points(sizes).tolist() == [len(c) for c in cuts]
