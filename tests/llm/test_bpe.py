"""Encoding against the tokenizers library, and the round trip."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webstrata.llm import bpe

TEXTS = [
    "", " ", "a", "Hello, world! it's I'LL 12345", "x<|endoftext|>y<|endoftext|>", "<|endoftext|>", "tab\t\tnl\n\n  end  ",
    "naïve façade ŝ 日本語 🙂🙂", "\u0378 new \U0001fae9 ᠎ \x85 \x1c", "word " * 4000, "a" * 5000, "é" * 300, "\x00\x01", None,
    "word " * 4000,
]


@pytest.mark.parametrize("limit", [1, 200, 1 << 20])
def test_round_trip(spark, limit):
    library = Tokenizer.from_file(bpe.default_path())
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, data string")
    for frame in (
        bpe.decode(bpe.encode(docs.repartition(3), limit=limit)),
        bpe.encode(docs, limit=limit, decoded=True),
    ):
        got = frame.orderBy("doc_id").collect()
        assert len(got) == len(TEXTS)
        for row, text in zip(got, TEXTS, strict=True):
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(row["ids"], "<u4").tolist() == ids
            assert row["decoded"] == library.decode(ids, skip_special_tokens=False)
            assert row["data"] == "x"


def test_words_of_every_character():
    """Each code point between letters, digits, marks and blanks is split as the library does."""
    path = bpe.default_path()
    split, letters = bpe.split_words(path), bpe._letters()
    library = Tokenizer.from_file(path).pre_tokenizer
    points = [c for c in range(0, 0x30000, 1) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 3000):
        text = "".join(f"a{c}1{c}!{c}  {c}{c}" for c in map(chr, points[at : at + 3000]))
        own = ["".join(letters[b] for b in w.encode()) for w in split(text)]
        assert own == [w for w, _ in library.pre_tokenize_str(text)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs).collect() == []
    nothing = spark.createDataFrame([(1, None)], "doc_id long, text string")
    row = bpe.digests(nothing).first()
    assert row["n_tokens"] == 0 and row["ids_sha256"] == row["decoded_sha256"]
    assert spark.range(1).select(F.sha2(F.lit(b""), 256)).first()[0] == row["ids_sha256"]
