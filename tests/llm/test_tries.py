"""The trie against grouping every prefix, over shards of every size; defined results."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from webstrata.llm import common, tries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, digest[:32], role, text))
    lists = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    full = {}
    for c, turns in lists.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        full[c] = tuple(lists.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in full.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own_part = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += own_part
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if full[c] == p)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def log(prose):
    rows = []
    for c in range(120):
        for turn in range((c * 7) % 11):
            same = c % 3 == 0 or turn < 2
            text = prose(turn if same else c, 1 + turn % 4) + ("é" if turn == 3 else "")
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", text))
    rows += [(1000 + i, t, "user", f"copy {t}") for i in range(300) for t in range(3)]
    rows += [(-7, 0, "user", "minus"), (-5, 1, "a", "b"), (-5, 0, "c", None), (None, 0, "user", "nobody")]
    rows += [(2000, None, None, None), (2000, 1, "", ""), (2000, 1, "x", "tie"), (2000, 1, "x", "tie"), (2000, 1, "a", "tie")]
    rows += [(3001 + 5 * i, t, "u", f"{i} {t} " * 40) for i in range(4) for t in range(60)]
    return rows


@pytest.mark.parametrize("limit", [1, 200, 1500, 1 << 22])
def test_equals_grouping_every_prefix(spark, prose, limit):
    rows = log(prose)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, key string").repartition(5)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in tries.trie(frame, limit).collect()), key=str)
    assert got == brute(rows)


def test_parents_beyond_the_broadcast(spark, prose, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    rows = log(prose)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in tries.trie(frame, 900).collect()), key=str)
    assert got == brute(rows)


def test_empty_tables(spark):
    frame = spark.createDataFrame([(None, 0, "u", "t")], "conv_id long, turn long, role string, text string")
    assert tries.trie(frame).collect() == []
    assert tries.trie(frame.limit(0)).collect() == []


def test_double_array_is_packed_and_walked():
    state = np.random.default_rng(3)
    found = sorted({tuple(state.integers(1, 40, state.integers(0, 6)).tolist()) for _ in range(3000)})
    lengths = np.array([len(p) for p in found])
    trie = tries.DoubleArray(np.array([c for p in found for c in p], np.int64), lengths)
    slots = {(): 0}
    for depth, rows, at in trie.walk():
        for row, slot in zip(rows.tolist(), at.tolist(), strict=True):
            assert slots.setdefault(found[row][:depth], slot) == slot
    assert len(set(slots.values())) == len(slots)
    for path, slot in slots.items():
        if path:
            assert trie.check[slot] == slots[path[:-1]] and trie.base[slots[path[:-1]]] + path[-1] == slot
    assert trie.size < 2 * len(slots) and (trie.check[: trie.size] >= 0).sum() == len(slots)


def test_members_in_many_batches(spark):
    rows = [(i, 0, "u", "same") for i in range(0, 200_000, 5)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    # Every base holds one turn; those that keep none of it have lost it from their own as well.
    got = {r["depth"]: r for r in tries.trie(frame).collect()}
    want = ",".join(str(r[0]) for r in rows)
    assert got[1]["n_convs"] == len(rows) and got[1]["ends_sha256"] == hashlib.sha256(want.encode()).hexdigest()
