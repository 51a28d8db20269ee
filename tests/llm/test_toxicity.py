"""Held-out accuracy, bounds and defined results."""

import zlib

import numpy as np
import pytest

from webstrata.llm import toxicity


def test_held_out_accuracy(spark, prose):
    marks = ["vexor", "grimbal", "snarfle"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = prose(i, 60).split()
        if toxic:
            words[10:10] = [marks[i % 3], marks[(i // 3) % 3]]
        docs.append((i, " ".join(words)))
        if i * 7919 % 11 < 6:
            labels.append((i, 0, int(toxic)))
    docs += [(None, "vexor"), (5000, None), (5001, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marked = spark.createDataFrame(labels + [(None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    models = toxicity.fit(frame, marked)
    assert len(models) == toxicity.MODELS
    got = toxicity.score(frame, models).withColumn("held", toxicity.held_out(frame["doc_id"])).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    right = sum((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 6 == 0) for r in held)
    assert right >= 0.97 * len(held)
    again = toxicity.score(frame, toxicity.fit(frame.repartition(7), marked)).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["score"]) for r in rows)
    assert key(again) == [(k, s) for k, s in key(got)]


def test_no_positives_and_empty(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()] == [0.0, 0.0]
    assert toxicity.fit(docs, labels.limit(0)) == []
    assert toxicity.score(docs.limit(0), []).collect() == []


def test_long_texts_take_part_in_the_fit(spark, prose):
    """All positives are long; the words of the sample have the features of the texts."""
    filler = " stone light" * 5_000
    texts = [prose(i, 60) + (" vexor grimbal" if i % 6 == 0 else "") + (filler if i % 3 == 0 else "") for i in range(600)]
    assert all(len(t) > 50_000 for t in texts[::6])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = spark.createDataFrame([(i, 0, int(i % 6 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    models = toxicity.fit(frame, marked)
    assert len(models) == toxicity.MODELS
    got = toxicity.score(frame.filter(toxicity.held_out(frame["doc_id"])), models).collect()
    right = sum((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 6 == 0) for r in got)
    assert got and right >= 0.97 * len(got)
    one = "The \u0130stanbul \u03a3\u0391\u03a3 the_x VEXOR vexor " + texts[0]
    assert toxicity.words_of(" ".join(sorted(toxicity.words_of(one)))) == toxicity.words_of(one)


def test_bounds_hold_in_rows(spark, prose, monkeypatch):
    """One id repeated 500 times is as many rows as it has texts, and no more than the bound."""
    rows = [(i, prose(i, 30) + (" vexor" if i % 6 == 0 else "")) for i in range(200)] + [(12, "same vexor words")] * 500
    rows += [(18, f"vexor number {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, 0, int(i % 6 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    seen = spark.sparkContext.accumulator(0)
    learn = toxicity._learn_group

    def counted(prior):
        run = learn(prior)

        def wrapped(group):
            seen.add(len(group))
            return run(group)

        return wrapped

    monkeypatch.setattr(toxicity, "_learn_group", counted)
    toxicity.fit(frame, labels, max_positive=5, max_unlabelled=60)
    assert 0 < seen.value <= 5 * toxicity.MODELS + 60


def test_only_toxic_labels(spark, prose):
    rows = [(i, prose(i, 60) + (" vexor grimbal" if i % 6 == 0 else "")) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([(i, 0, 1) for i in range(0, 900, 12)], "doc_id long, quality int, toxic int")
    models = toxicity.fit(frame, marked, prior=1 / 6)
    assert len(models) == toxicity.MODELS and len(toxicity.fit(frame, marked)) == toxicity.MODELS
    got = toxicity.score(frame.filter(toxicity.held_out(frame["doc_id"])), models).collect()
    assert sum((r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 6 == 0) for r in got) >= 0.97 * len(got)


def test_slopes_are_derivatives_of_the_risk():
    state = np.random.default_rng(5)
    for shift in (-3.0, 0.0, 3.0):
        score, positive = state.normal(shift, 2, 40), np.arange(40) % 4 == 0
        for prior in (0.1, 0.7):
            as_positive, rest = toxicity.risk(score, positive, prior)
            got = toxicity.slopes(score, positive, prior)
            for i in range(40):
                sums = []
                for step in (1e-5, -1e-5):
                    moved = score.copy()
                    moved[i] += step
                    a, b = toxicity.risk(moved, positive, prior)
                    sums.append(a + b if rest >= 0 else -b)
                assert got[i] == pytest.approx((sums[0] - sums[1]) / 2e-5, abs=1e-6)
