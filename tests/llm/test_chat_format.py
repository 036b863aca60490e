import hashlib
import json

import pytest

from tradelake.llm import chat_format as C

RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, "messages", [("user", "hi"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}, "dialogue",
     [("user", "a"), ("assistant", "b"), ("tool", "c")]),
    ({"prompt": "p", "completion": "q"}, "prompt", [("user", "p"), ("assistant", "q")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("system", "do"), ("user", ""), ("assistant", "done")]),
    ({"data": {"turns": [{"speaker": "user", "utterance": {"text": "deep"}}]}}, "chat", [("user", "deep")]),
    ({"messages": []}, "messages", []), ({"data": {"turns": []}}, "chat", []), ({"other": 1}, None, None), ([1], None, None),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": 5}, {"role": "x", "content": True}]}, "messages",
     [("user", "a"), ("assistant", "5"), ("x", "true")]),
    ({"messages": [None]}, None, None), ({"messages": ["a"]}, None, None),
]
HARD = ["", "<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<", "<\\|", "a\nb", "\\n", "<|im_end|>\n", "é🙂", "x" * 100_000]


def test_layouts(spark):
    rows = [(k, json.dumps(r), "x") for k, (r, *_) in enumerate(RECORDS)] + [(98, None, "x"), (99, "{broken", "x")]
    got = {r.id: r for r in C.canonical(spark.createDataFrame(rows, "id int, record string, turns_ string")).collect()}
    for k, (_, layout, turns) in enumerate(RECORDS):
        assert got[k].layout == layout
        assert (got[k].turns and [tuple(t) for t in got[k].turns]) == turns
    assert got[98].turns is None and got[99].turns is None
    assert len({r.fingerprint for r in got.values()} - {None}) == 10  # mixed scalars look like any, [None] like none


def test_all_can_be_read_back(spark):
    rows = [(n, k, role, t) for n in range(len(HARD)) for k, (role, t) in enumerate(
        [("user", HARD[n]), ("assistant", HARD[-n - 1]), ("odd\nrole\\n<|", HARD[n]), ("assistant", HARD[(n + 3) % len(HARD)])])]
    rows += [(50, 0, None, None), (51, 1, "assistant", None), (51, 0, "user", "q"), (51, 0, "user", "q"), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in C.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        turns = sorted((k, role or "", t or "") for c, k, role, t in rows if c == conv)
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))


@pytest.mark.parametrize("native", ["Python", "Arrow"])
def test_plan_is_native(spark, native):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert native not in C.report(rows)._jdf.queryExecution().toString()


def test_empty(spark):
    assert C.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
