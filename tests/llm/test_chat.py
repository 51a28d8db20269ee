"""Snapshot collapse against a direct comparison of turn lists."""

from webstrata.llm import chat

LOG = [
    (1, [("user", "hi")]), (2, [("user", "hi"), ("assistant", "yo")]), (3, [("user", "hi"), ("assistant", "no")]),
    (4, [("user", "hi"), ("assistant", "yo")]), (5, [("user", None)]), (6, [(None, "")]), (7, [("user", "")]),
    (8, [("user", "hi"), ("assistant", "yo"), ("user", "more " * 5000)]), (9, [("user", "hi"), ("user", "hi")]),
    (None, [("user", None), ("user", "x")]),
]


def test_collapse(spark):
    rows = [(c, i, r, t, "x") for c, turns in LOG for i, (r, t) in enumerate(turns)]
    rows += [rows[0], rows[3]]  # logged twice
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns string")
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat.collapse(frame.repartition(3)).collect()}
    want = {}
    for c, turns in LOG:
        longer = any(o[: len(turns)] == turns and len(o) > len(turns) for _, o in LOG)
        first = min((k for k, o in LOG if o == turns), key=lambda k: (k is None, k))
        if not longer and first == c:
            text = "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)
            want[c] = (len(turns), text)
    assert got == want


def test_empty(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.collapse(frame).collect() == []
