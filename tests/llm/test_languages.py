"""Held-out accuracy, families, margins by hand, bounds and defined results."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webstrata.llm import languages

SOUNDS = {
    "n1": "skar fjor drag bjor stra ulv".split(), "n2": "skar fjor drag byen strå ulf".split(),
    "n3": "skar fyor drahk bjor stra olv".split(), "s1": "amo luce vino terra bella".split(),
    "s2": "amo luz vino tierra bella".split(), "k": "кот дом река лес море".split(),
}


def text(lang, seed, words):
    state, out = seed * 7919 + zlib.crc32(lang.encode()), []
    for _ in range(words):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        a, b = (state >> 33) % len(SOUNDS[lang]), (state >> 43) % len(SOUNDS[lang])
        out.append(SOUNDS[lang][a] + SOUNDS[lang][b] if state >> 60 else SOUNDS[lang][a])
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(spark):
    names = sorted(SOUNDS)
    rows = [(i, text(names[i % 6], i, 3 + i % 40), names[i % 6] if i % 7 else None, "x") for i in range(900)]
    rows += [(2000, None, "n1", "x"), (2001, "", "n1", "x"), (2002, " 12 .,!", "s1", "x"), (None, text("k", 1, 9), "k", "x")]
    rows += [(3000, text("n1", 1, 400_000), "n1", "x")] + [(4000, text("s2", 4, 20), "s2", "x")] * 50
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)


@pytest.fixture(scope="module")
def model(corpus):
    return languages.fit(corpus)


def test_held_out_accuracy(corpus, model):
    assert [sorted(x) for x in model.families] == model.families and len(model.families) == 3
    assert ["s1", "s2"] in model.families and ["n1", "n2", "n3"] in model.families
    got = languages.identify(corpus, model).withColumn("held", languages.held_out(F.col("doc_id"))).collect()
    assert len(got) == corpus.count() and all(0 <= r["score"] <= 1 for r in got)
    names = sorted(SOUNDS)
    held = [r for r in got if r["held"] and r["doc_id"] < 900]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == names[r["doc_id"] % 6] for r in held) >= 0.95 * len(held) > 100
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2000, 2001, 2002))
    assert by[3000]["lang_pred"] == "n1" and by[None]["lang_pred"] == "k"
    assert not isinstance(by[1]["score"], str)


def test_fit_does_not_depend_on_the_split(corpus, model):
    again = languages.fit(corpus.repartition(7))
    assert again.families == model.families and np.allclose(again.weights, model.weights) and np.allclose(again.biases, model.biases)


def bucket(gram):
    value = len(gram)
    for i, c in enumerate(gram):
        value += ord(c) * pow(0x9E3779B97F4A7C15, i, 2**64)
    value %= 2**64
    for shift, factor in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        value = (value ^ (value >> shift)) * factor % 2**64
    return (value ^ (value >> 32)) >> 50


def test_margins_are_weights_times_shares(model):
    texts = [text("n2", 5, 30), "Vino, VINO 7 vino", None, "", "ü", "x" * 300]
    got = model.margins(languages.word_lists(pa.array(texts)))
    for row, value in zip(got, texts, strict=True):
        words = "".join(c if c.isalpha() else " " for c in (value or "").lower()).split()
        counts = np.zeros(languages.BUCKETS)
        for w in words:
            marked = f"^{w}$"
            for n in languages.GRAMS:
                for i in range(len(marked) - n + 1):
                    counts[bucket(marked[i : i + n])] += 1
        want = counts @ model.weights / max(counts.sum(), 1) + model.biases
        assert np.allclose(row, want)


def test_predictions_by_rounds_of_pairs(model):
    texts = [text(n, 7000 + i, 12) for i in range(40) for n in SOUNDS]
    found = model.margins(languages.word_lists(pa.array(texts)))
    names, scores = model.predict(pa.array(texts))
    for row, name, score in zip(found, names, scores, strict=True):
        at = int(np.argmax(row[: len(model.families)]))
        wins, least = dict.fromkeys(model.families[at], 0), {n: row[at] for n in model.families[at]}
        for (a, b), m in zip(model.pairs, row[len(model.families) :], strict=True):
            if a in wins:
                wins[a if m > 0 else b] += 1
                least[a], least[b] = min(least[a], m), min(least[b], -m)
        assert wins[name] == max(wins.values())
        assert score == pytest.approx(1 / (1 + np.exp(-2 * np.clip(least[name], -20, 20))))


def test_slices_hold_every_text():
    texts = pa.array(["a" * n for n in (5, 0, 900, 3, 3, 70)] + [None])
    parts = list(languages.slices(texts, 200))
    assert sum((p.to_pylist() for p in parts), []) == texts.to_pylist() and len(parts) > 2
    assert list(languages.slices(texts.slice(0, 0))) == []


def test_sample_is_bounded(corpus):
    counts = languages.sample(corpus, 5).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in counts} == dict.fromkeys(SOUNDS, 10)


def test_one_language_none_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "xx"), (2, "5", "xx"), (3, "c", None)], "doc_id long, text string, lang string")
    one = [(r["lang_pred"], r["score"]) for r in languages.identify(docs, languages.fit(docs)).orderBy("doc_id").collect()]
    assert [p for p, _ in one] == ["xx", "und", "xx"] and one[0][1] == pytest.approx(1) and one[1][1] == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert languages.fit(none) is None
    assert {(r["lang_pred"], r["score"]) for r in languages.identify(none, None).collect()} == {("und", 0.0)}
    assert languages.fit(docs.limit(0)) is None and languages.identify(docs.limit(0), None).collect() == []
