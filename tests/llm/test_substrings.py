"""Removed words against a direct search for repeated windows."""

import random
import re

import numpy as np
import pytest

from webstrata.llm import substrings


def expected(docs, window=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    least = {}
    for (key, _), own in zip(docs, words, strict=True):
        for i in range(len(own) - window + 1):
            if key is not None:
                w = tuple(own[i : i + window])
                least[w] = min(key, least.get(w, key))
    out = []
    for (key, _), own in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(own) - window + 1):
            if key is not None and least[tuple(own[i : i + window])] < key:
                gone |= set(range(i, i + window))
        out.append((str(key), len(own), len(gone), " ".join(w for i, w in enumerate(own) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 4000, 1 << 23])
def test_repeats(documents, prose, limit):
    rng = random.Random(2)
    passages = [prose(i, n) for i, n in enumerate([49, 50, 51, 80, 200])]
    docs = []
    for i in range(60):
        parts = [prose(1000 + i, rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), prose(2000 + 7 * i, rng.randrange(0, 30))]
        docs.append((i * 3 % 61, rng.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(100, docs[4][1]), (101, docs[4][1] + " tail"), (102, None), (103, ""), (104, " \n"), (105, "a " * 500)]
    docs += [(106, "a " * 120), (107, "a b " * 60), (None, docs[5][1]), (5, prose(3, 80)), (5, prose(3, 80))]
    got = substrings.dedup(documents(docs, clashing=True).repartition(4), limit=limit).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == expected(docs)


def test_hashes():
    words = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    twice = np.concatenate([words, words])
    runs = substrings.run_hashes(twice, 50)
    assert (runs[:150] == runs[199 : 199 + 150]).all() and len(set(runs.tolist())) == 199
    least = substrings.rolling_min(words, 41)
    assert least.tolist() == [words[i : i + 41].min() for i in range(len(words) - 40)]


def test_empty(documents):
    assert substrings.dedup(documents([])).collect() == []
