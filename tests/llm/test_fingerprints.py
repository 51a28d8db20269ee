"""Signatures against a plain implementation, and their agreement with generalised Jaccard."""

import hashlib
import re
from collections import Counter

import numpy as np

from webstrata.llm import fingerprints


def words(text):
    return Counter(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def jaccard(a, b):
    a, b = words(a), words(b)
    total = sum((a | b).values())
    return sum((a & b).values()) / total if total else 1.0


def edits(docs):
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for i, (key, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[key] = (text[: len(text) - half] + following[:half], following)
    return out


def test_quantiles():
    q = fingerprints.gamma_quantiles()
    assert abs(q.mean() - 2) < 0.01 and (np.diff(q) > 0).all()
    assert abs(1 - (1 + q[511]) * np.exp(-q[511]) - 511.5 / 1024) < 1e-9


def test_compare(documents, prose):
    docs = [(i, prose(i // 2 if i % 5 else 7, 30 + 20 * (i % 9))) for i in range(80)]
    docs += [(90, None), (91, ""), (92, "é" * 7 + " 🙂🙂 x"), (93, "w " * 3000), (94, prose(3, 5000)), (95, docs[0][1])]
    got = {r["doc_id"]: r for r in fingerprints.compare(documents(docs, clashing=True).repartition(5)).collect()}
    want, by_text, errors = edits(docs), {}, []
    assert len(got) == len(docs)
    for key, text in docs:
        row, (edited, following) = got[key], want[key]
        assert row["n_chars"] == len(text or "")
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text or "", row["fingerprint"]) == row["fingerprint"]
        errors += [row["near_edited"] - jaccard(text, edited), row["near_next"] - jaccard(text, following)]
    for key, text in docs:  # an edited text that is another document's text has its fingerprint
        assert by_text.get(want[key][0], got[key]["edited_fingerprint"]) == got[key]["edited_fingerprint"]
    assert np.abs(errors).max() < 0.3 and abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.075


def test_edges(documents, prose):
    assert fingerprints.compare(documents([])).collect() == []
    one = fingerprints.compare(documents([(3, prose(1, 40))])).first()
    assert one["near_next"] == 1.0 and one["near_edited"] < 1
    rows = fingerprints.compare(documents([(None, "a b c"), (None, "a b c"), (1, None), (1, "")])).collect()
    assert len(rows) == 4 and all(0 <= r["near_next"] <= 1 for r in rows)


def test_a_rank_computes_its_hash_once(spark):
    """No condition stands around a rank; texts without a term still have no sample."""
    rows = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, " \t")], "doc_id int, text string")
    sampled = fingerprints.sample(rows, ["doc_id"], "text")
    plan = sampled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min(") >= fingerprints.IN_GROUP and "min(CASE" not in plan
    found = {r["doc_id"]: r["fingerprint"] for r in sampled.collect()}
    empty = fingerprints.NEVER * fingerprints.SAMPLES
    assert found[2] == found[3] == found[4] == empty != found[1]
