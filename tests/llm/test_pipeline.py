"""Every stage of the pipeline on what the one before kept."""

import hashlib
from collections import Counter

import corpus_pipeline
from tokenizers import Tokenizer

from tests.llm.test_ngram_join import expected as joined
from tests.llm.test_quality import counts
from tests.llm.test_substrings import expected as cut
from webstrata.llm import bpe


def test_stages(spark, documents, prose):
    docs = [(i, prose(i, 90 + i), f"s{i % 3}") for i in range(30)]
    docs += [(40, docs[3][1], "s1"), (41, docs[4][1] + " more words", "s2"), (42, "short", "s1"), (43, "", "s0"), (44, None, None)]
    docs += [(50, prose(3, 70) + " " + prose(500, 60), "s0"), (51, docs[3][1], "s1"), (None, prose(60, 70), "s0")]
    frame = documents(docs, clashing=True)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, frame, "")
    assert kept.columns == frame.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(map(str, rows)) == sorted(str(d[:2]) for d in docs if counts(d[1])[0] >= 50)

    apart = stages["n-gram Jaccard join"](spark, kept, "")
    left = [(r["doc_id"], r["text"]) for r in apart.collect()]
    groups = [(k, c) for k, _, c in joined(rows)]
    assert sorted(str(k) for k, _ in left) == sorted(str(k) for k, c in groups if k == str(c) or k == "None")

    whole = stages["substring dedup"](spark, apart, "")
    after = [(str(r["doc_id"]), " ".join((r["text"] or "").split())) for r in whole.collect()]
    assert sorted(after) == sorted((k, t) for k, n, gone, t in cut(left) if gone < n or not n)

    mixed = stages["mixing sources to target weights"](spark, whole, "")
    assert mixed.columns == frame.columns
    texts = Counter((str(r["doc_id"]), r["text"]) for r in mixed.collect())
    ends = Counter((str(r["doc_id"]), r["decoded_sha256"]) for r in stages["BPE encoding and decoding"](spark, mixed, "").collect())
    assert ends == Counter({(k, hashlib.sha256(t.encode()).hexdigest()): n for (k, t), n in texts.items()})
    assert Tokenizer.from_file(bpe.default_path())


def test_empty(spark, documents):
    frame = documents([])
    for _, stage in corpus_pipeline.STAGES:
        last = frame
        frame = stage(spark, last, "")
        assert frame.collect() == []
