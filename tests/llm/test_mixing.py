"""Mixing against direct apportionment and the promises of its result."""

import heapq
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webstrata.llm import mixing


def highest_quotients(votes, seats):
    heap = [(-v, k, 0) for k, v in sorted(votes.items()) if v > 0]
    heapq.heapify(heap)
    won = Counter()
    for _ in range(seats if heap else 0):
        _, k, n = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-votes[k] / (2 * n + 3), k, n + 1))
    return won


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1003])
def test_apportion(spark, seats):
    votes = {1: 5, 2: 90, 3: 1, 4: 33, 5: 33, 6: 0, 7: 700, 8: 2}
    frame = spark.createDataFrame([(0, k, v, seats) for k, v in votes.items()], "p int, k int, v long, n long")
    got = mixing.apportion(frame, ["p"], "k", "v", "n", "won").collect()
    assert {r["k"]: r["won"] for r in got} == {k: highest_quotients(votes, seats)[k] for k in votes}


def filled(sizes, weights, wanted):
    """Targets by repeated resharing."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = wanted - sum(target[i] for i in range(len(sizes)) if i not in open_)
        level = rest / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > 2 * sizes[i]}
        for i in over or open_:
            target[i] = 2.0 * sizes[i] if over else level * weights[i]
        open_ -= over or open_
    return target


def test_targets_and_taken(documents, prose):
    docs, sources = [], ["b", "a", None, "é", "z"]
    for i in range(60):
        docs.append((i, prose(i, (i % 7) * 40 + 3), sources[i % 5 if i % 3 else 1]))
    docs += [(100, None, "a"), (101, "", "b"), (102, " \t\n", None), (103, prose(9, 4000), "z"), (None, "lone words", "z")]
    docs += [(5, prose(5, 10), "b"), (5, prose(5, 10), "b")]
    got = mixing.mix(documents(docs)).collect()
    assert len(got) == len(docs)
    order = sorted({d[2] for d in docs}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((d[1] or "").split()) for d in docs if d[2] == s) for s in order]
    weights = [(3, 1, 2)[i % 3] for i in range(len(order))]
    targets = filled(sizes, weights, 1.5 * sum(sizes))
    taken = Counter()
    for r in got:
        at = order.index(r["source"])
        assert r["size"] == len((r["text"] or "").split()) and r["source_size"] == sizes[at]
        assert r["target"] == pytest.approx(targets[at])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[at] += r["taken"]
    for at, target in enumerate(targets):
        assert abs(taken[at] - target) <= 2 * mixing.BLOCK_WORDS
    again = mixing.mix(documents(docs[::-1])).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    assert key(got) == key(again)


def test_taken_text_has_the_taken_words(documents, prose):
    docs = [(i, prose(i, 20 + 37 * i).replace(" ", "\n", 3), f"s{i % 4}") for i in range(25)]
    mixed = mixing.mix(documents(docs))
    want = {r["doc_id"]: (r["taken"], r["text"]) for r in mixed.collect()}
    got = Counter()
    for r in mixing.taken_text(mixed).collect():
        words, whole = r["text"].split(), iter(want[r["doc_id"]][1].split())
        assert all(w in whole for w in words)  # in order
        got[r["doc_id"]] += len(words)
    assert {k: v for k, v in got.items()} == {k: t for k, (t, _) in want.items() if t}


def test_empty_and_extra_columns(documents, prose):
    assert mixing.mix(documents([])).collect() == []
    rows = mixing.mix(documents([(1, prose(1, 9), "s")]).withColumn("won", F.lit(1))).collect()
    assert rows[0]["won"] == 1
