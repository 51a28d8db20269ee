"""Counts against plain Python, and host verdicts."""

import re
from collections import Counter

from webstrata.llm import quality


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered),
    )


def test_counts(documents, prose):
    texts = [
        None, "", " \n\t", "a", "a b c a b c", "a a a a", "x\ny\nx\n\n x\nx", "#*$%&|<>\u00a0\u2003é ü", "a b a b a b",
        prose(1, 300), prose(1, 60) + " " + prose(1, 60), "w " * 3000, "\n".join(["same line"] * 50), "\x0b\x0cq\x1cr",
        prose(3, 20000),
    ]
    rows = documents(list(enumerate(texts)), clashing=True)
    got = quality.with_counts(rows).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        want = counts(text)
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == want


def test_hosts(documents, prose):
    good = [(i, prose(i, 80), f"good{i % 5}") for i in range(200)]
    bad = [(1000 + i, prose(i, 80) if i % 10 == 0 else "too short", "bad") for i in range(100)]
    lone = [(2000, prose(1, 90), "lone"), (2001, None, None), (2002, prose(2, 90), None), (2003, "", "")]
    got = {r["doc_id"]: r for r in quality.judge(documents(good + bad + lone)).collect()}
    assert all(got[i]["kept"] for i in range(200)) and got[2000]["kept"]
    assert not any(got[1000 + i]["kept"] for i in range(100))  # clean documents of a bad host too
    assert not got[1000]["base_failed"] and got[1001]["base_failed"] and got[2001]["base_failed"]
    assert quality.judge(documents([])).collect() == []
