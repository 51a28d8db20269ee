"""Operators that look up hosts or sources give the same rows on either side of the broadcast limit,
and columns named like their own do no harm."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from webstrata.llm import bpe, common, extraction, languages, mixing, quality, substrings, toxicity

NAMES = "size source_size target taken n_words word_chars kept base_failed n_removed kept_text ids decoded host path score lang_pred _no _shard _salt _key _s _hash _text _n _id _h _row _w".split()


def key(rows):
    return sorted(str(sorted(r.asDict().items(), key=str)) for r in rows)


@pytest.fixture
def docs(documents, prose):
    rows = [(i, prose(i % 50, 60 + i), f"s{i % 4}" if i % 9 else None) for i in range(70)]
    return documents(rows + [(None, prose(3, 70), "s1"), (None, "short", None), (7, None, "s2"), (7, "", "s2"), (3, prose(400, 80), "s3")])


@pytest.fixture
def pages(spark):
    body = "<p>" + "Words of a long text stand here. " * 9 + "</p>"
    rows = [(i, f"http://h{i % 5}.org/{i}", f"<body><ul><li>menu</ul><div class=c{i % 2}>{body}{i}</div></body>") for i in range(40)]
    return spark.createDataFrame(rows + [(99, None, None), (100, "x", "")], "page_id long, url string, html string")


CALLS = {
    "mix": lambda d, p: mixing.mix(d),
    "judge": lambda d, p: quality.judge(d),
    "judge_narrow": lambda d, p: quality.judge(d, keep_text=False),
    "extract": lambda d, p: extraction.extract(p),
    "quality stage": lambda d, p: corpus_pipeline.quality_rules(None, d, ""),
    "mix stage": lambda d, p: corpus_pipeline.target_mix(None, d, ""),
}


@pytest.mark.parametrize("name", CALLS)
def test_same_rows_beyond_the_broadcast(docs, pages, monkeypatch, name):
    want = key(CALLS[name](docs, pages).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    shuffled = CALLS[name](docs, pages)
    assert key(shuffled.collect()) == want


def test_measured_bytes(spark):
    frame = spark.createDataFrame([("a" * 1000, 1), (None, 2)], "k string, v long")
    assert 1000 < common.lookup_bytes(frame) < 1300 and common.lookup_bytes(frame.limit(0)) == 0


@pytest.mark.parametrize("name", CALLS)
def test_clashing_names(docs, pages, name):
    plain = CALLS[name](docs, pages)
    extra = {n: F.lit("mine") for n in NAMES}
    got = CALLS[name](docs.withColumns(extra), pages.withColumns(extra))
    assert key(got.select(*plain.columns).collect()) == key(plain.collect())
    if "stage" in name:
        assert got.columns == [*docs.columns, *NAMES] and {r["n_words"] for r in got.collect()} == {"mine"}
    if name == "extract":
        assert {r["path"] for r in got.collect()} == {"mine"}


def test_clashing_names_of_block_operators(docs):
    extra = docs.withColumns({n: F.lit("mine") for n in NAMES})
    for call in (substrings.dedup, lambda d: bpe.encode(d, decoded=True), lambda d: languages.identify(d, None), lambda d: toxicity.score(d, [])):
        plain = call(docs)
        got = call(extra)
        assert len(set(got.columns)) == len(got.columns)
        assert key(got.select(*plain.columns).collect()) == key(plain.collect())
    stages = dict(corpus_pipeline.STAGES)
    for name in ("n-gram Jaccard join", "substring dedup"):
        plain, got = stages[name](None, docs, ""), stages[name](None, extra, "")
        assert key(got.select(*plain.columns).collect()) == key(plain.collect())


def test_one_row_of_each_component_stays(documents, prose):
    near = prose(1, 90) + " " + "more words"
    rows = [(5, prose(1, 90)), (5, prose(2, 90)), (5, prose(2, 90)), (6, near), (None, prose(1, 90)), (None, prose(3, 90))]
    rows += [(None, prose(3, 90))] * 3 + [(4, prose(7, 60)), (4, prose(8, 60)), (3, prose(8, 60)), (9, None), (9, ""), (9, "")]
    got = corpus_pipeline.near_copies(None, documents([(*r, "s") for r in rows]), "").collect()
    want = [(5, prose(1, 90)), (5, prose(2, 90)), (None, prose(3, 90)), (4, prose(7, 60)), (3, prose(8, 60)), (9, None), (9, ""), (9, "")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, want))


def test_rows_of_one_id_are_dealt_over_shards(documents, prose, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 200)
    rows = [(None, prose(i, 40), "s") for i in range(100)]
    mixed = mixing.mix(documents(rows)).collect()
    assert len({r["_offset"] for r in mixed}) > 5
