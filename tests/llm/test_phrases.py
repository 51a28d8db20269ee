"""Phrases against counting every window, over many small shards; defined results."""

import re
from collections import Counter, defaultdict

import numpy as np

from webstrata.llm import phrases


def brute(rows, least, depth, top):
    """(lang, rank, phrase, a, l, r, n, score) by counting every window of every piece."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, found in counts.items():
        kept = {p: c for p, c in found.items() if c >= least}
        inside = set()
        for p, c in kept.items():
            for k in range(1, len(p)):
                for i in range(len(p) - k + 1):
                    if c >= found[p[i : i + k]]:
                        inside.add(p[i : i + k])
        scored = []
        for p, a in kept.items():
            if len(p) > 1 and p not in inside:
                cuts = [(1000 * a * total[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def texts(prose):
    rows = []
    for i in range(60):
        words = prose(i % 45, 80).split()
        for j in range(0, len(words), 9):
            words[j] += ".,;:!?\n\r\x0b"[j % 9]
        if i % 3 == 0:
            words[20:20] = ["New", "York", "City", "hall"]
            words[50:50] = ["na", "na", "na", "na", "na", "na", "na"]
        rows.append((" ".join(words).replace(" the", "\tTHE  "), ["en", "de", None][i % 3 if i % 5 else 0]))
    return rows + [(None, "en"), ("", "en"), (" .. ,", "xx"), ("ÄÖ  x y " * 9, "de"), ("a b", None)]


def test_equals_counting_every_window(spark, prose):
    rows = texts(prose)
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "text string, lang string, phrase string, block int, n int").repartition(3)
    for least, depth, top, limit in ((4, 5, 2000, 3000), (3, 3, 7, 1), (2, 5, 2000, 1 << 20)):
        got = phrases.collocations(frame, least, depth, top, limit).collect()
        assert sorted(map(tuple, got)) == brute(rows, least, depth, top)


def test_intervals_are_the_occurrences(prose):
    rows = texts(prose)
    made = phrases.Sequence.of([r[0] for r in rows], [r[1] for r in rows])
    again = phrases.Sequence.unpacked(made.packed())
    assert again.words == made.words and again.names == made.names and np.array_equal(again.ids, made.ids)
    index = phrases.Bidirectional(made.ids, len(made.words) + 1, 4)
    ids = made.ids.tolist()
    for words in range(1, 5):
        places = defaultdict(list)
        for i in range(len(ids) - words + 1):
            if 0 not in ids[i : i + words]:
                places[tuple(ids[i : i + words])].append(i)
        found = [tuple(ids[s : s + words]) for s in index.starts().tolist()]
        assert sorted(found) == sorted(places)
        low, size, twin = index.level
        before, after = index.neighbours()
        for at, p in enumerate(found):
            assert sorted(index.ahead.order[low[at] : low[at] + size[at]].tolist()) == places[p]
            ends = len(ids) - 1 - index.behind.order[twin[at] : twin[at] + size[at]]
            assert sorted((ends - words + 1).tolist()) == places[p]
            left, right = {ids[i - 1] for i in places[p]}, {ids[i + words] for i in places[p]}
            assert before[at] == (left.pop() if len(left) == 1 else 0)
            assert after[at] == (right.pop() if len(right) == 1 else 0)
        if words < 4:
            index.extend()


def test_large_products_are_exact(spark, rows):
    score = rows("a long, n long, l long, r long", (10**9, 10**13, 10**10, 3 * 10**9)).selectExpr(
        "(cast(1000 as decimal(38, 0)) * a * n) div (cast(l as decimal(38, 0)) * r) as s"
    )
    assert score.first()[0] == 1000 * 10**9 * 10**13 // (10**10 * 3 * 10**9)


def test_empty_and_blank(spark):
    frame = spark.createDataFrame([(None, "en"), ("", None), (" . ", "en")], "text string, lang string")
    assert phrases.collocations(frame, 1).collect() == []
    assert phrases.collocations(frame.limit(0), 1).collect() == []
