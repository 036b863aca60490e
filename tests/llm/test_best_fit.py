import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tradelake.llm import best_fit


def best_fit_decreasing(lengths, capacity):
    gaps, count = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        count += gap == capacity
        if gap > n:
            bisect.insort(gaps, gap - n)
    return count


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    odd = ["don't I'LL\tsay 1234", "É ñ  Ünïcodé ΣΑΣ Σ", "<|endoftext|> x<|startoftext|>", "a" * 3000, "x<|endoftext|>y <|startoftext|><|endoftext|> z", "\n\n", "!!...?? ''s", "中文 텍스트 🙂🙂"]
    texts = odd + [" ".join(rng.choice("the of and Thtion, eronou. 12 é'l".split()) for _ in range(rng.choice([1, 20, 90, 300]))) for _ in range(120)]
    return [(k, t) for k, t in enumerate(texts)] + [(500, None), (501, ""), (7, texts[8]), (7, texts[8])]


@pytest.mark.parametrize("special_as_text", [False, True])
def test_ids_pieces_and_places(spark, rows, special_as_text):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = special_as_text
    got = best_fit.report(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, length string"), capacity=256, special_as_text=special_as_text).collect()
    want = []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want += [(doc, n, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for n, a in enumerate(range(0, len(ids), 256))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 256
    assert len(sequences) <= 1.01 * best_fit_decreasing([r.length for r in got], 256) + 1


def test_all_of_one_length(spark):
    cut = spark.range(0, 90).select("id", "id").toDF("pid", "x").selectExpr("pid", "300L AS length")
    assert best_fit.pack(cut, 1000).select("sequence_id").distinct().count() == 30


def test_empty(spark):
    assert best_fit.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
