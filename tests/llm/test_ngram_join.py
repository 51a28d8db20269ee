"""The join's components against all pairs, and components against union-find."""

import random
import re

import pytest

from webstrata.llm import ngram_join
from webstrata.llm.components import components


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def expected(docs):
    sets = [shingles(t) for _, t in docs]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                links.append((i, j))
    root = roots(range(len(docs)), links)
    out = []
    for i, (key, _) in enumerate(docs):
        ids = [docs[j][0] for j in root if root[j] == root[i] and docs[j][0] is not None]
        out.append((str(key), len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def edited(words, rng, share):
    return [w + "x" if rng.random() < share else w for w in words]


@pytest.mark.parametrize("limit", [1, 1 << 23])
def test_components(documents, prose, limit):
    rng = random.Random(4)
    docs = []
    for base in range(6):
        words = prose(base, 60 + 50 * base).split()
        for _ in range(14):
            docs.append((len(docs), " ".join(edited(words, rng, rng.choice([0, 0.01, 0.02, 0.04])))))
    words = prose(77, 400).split()  # a chain: each a little further from the first
    for i in range(12):
        words = edited(words, rng, 0.012)
        docs.append((len(docs), " ".join(words)))
    passage = prose(5, 60)
    docs += [(200 + i, f"{prose(900 + i, 30)} {passage} {prose(800 + i, 30)}") for i in range(30)]
    docs += [(300, None), (301, ""), (302, " \n"), (303, "a b"), (304, "A  b"), (305, "a b c"), (306, "a b c d e")]
    docs += [(307, "a b c d e"), (None, prose(0, 60)), (None, "only me " * 9), (308, "x " * 3000), (309, "X " * 2500)]
    docs += [docs[0], docs[3]]
    got = ngram_join.join(documents(docs, clashing=True).repartition(3), limit=limit).collect()
    assert sorted([(str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got], key=str) == expected(docs)


def test_near_misses_and_edges(documents):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    docs = [(0, " ".join(base)), (1, " ".join(base[:-11])), (2, " ".join(base[:84])), (3, " ".join(base[:85])), (4, " ".join(base[20:]))]
    got = ngram_join.join(documents(docs)).collect()
    assert sorted([(str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got], key=str) == expected(docs)
    assert ngram_join.join(documents([])).collect() == []


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(170)]
    links += [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"h{i}") for i in range(50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    nodes = {x for pair in links if pair[0] != pair[1] for x in pair}
    assert got == roots(sorted(nodes), [p for p in links if p[0] != p[1]])
