import math
import re
from collections import Counter

from pyspark.sql import functions as F

from webstrata.functions import keys, labels, text
from webstrata.operators import vocabulary

CONTENT = [
    ("I told me: My i-me", 5, 0, 0),
    ("We, our COMPANY's B2B platform_x services", 0, 3, 2),
    ("éme mé", 0, 0, 0),
    (None, 0, 0, 0),
]


def test_content_features(rows):
    df = rows("t string", *[(c[0],) for c in CONTENT])
    got = df.withColumns(text.content_features(F.col("t"))).collect()
    assert [tuple(r) for r in got] == CONTENT


def test_whitespace_is_unicode(rows):
    samples = [" a \n b\x1c", "  x\ty  ", "", "​z "]
    df = rows("t string", *[(s,) for s in samples])
    got = df.select("t", text.collapse_space(F.col("t")), text.strip(F.col("t"))).collect()
    for value, collapsed, stripped in got:
        assert collapsed == re.sub(r"\s+", " ", value).strip()
        assert stripped == value.strip()


def test_block_text(rows):
    df = rows("b array<struct<tag:string,text:string>>", ([("p", "a"), ("li", "b c")],), (None,))
    assert [r[0] for r in df.select(text.block_text(F.col("b"))).collect()] == ["a b c", ""]


def test_tokens_and_word_ngrams(rows):
    df = rows("t string", ("The cat, the HAT x y2",), ("the",), (None,))
    df = df.withColumn("w", text.tokens(F.col("t"), ["the"])).withColumn("g", text.word_ngrams("w", 1, 3))
    got = [r.g for r in df.collect()]
    assert got == [["cat", "hat", "y2", "cat hat", "hat y2", "cat hat y2"], [], []]


def test_char_ngrams(rows):
    df = rows("t string", ("Aba  b",), ("a",), ("",), (None,))
    got = [r.o for r in text.with_char_ngrams(df, "t", "o", 3, 5).collect()]
    assert got == [["aba", "ba ", "a b", "aba ", "ba b", "aba b"], [], [], []]


DOCS = {"d1": "a b a c".split(), "d2": "b b d".split(), "d3": [], "d4": "e".split()}


def test_term_counts_and_stats(rows):
    df = rows("k string, terms array<string>", *DOCS.items(), ("d5", None))
    for row in text.with_term_counts(df, "terms", "c").collect():
        assert dict((c.term, c.tf) for c in row.c) == Counter(DOCS.get(row.k, []))
    got = {r.term: (r.tf, r.df) for r in vocabulary.term_stats(df, "terms").collect()}
    assert got == {"a": (2, 1), "b": (3, 2), "c": (1, 1), "d": (1, 1), "e": (1, 1)}
    top = vocabulary.vocabulary(vocabulary.term_stats(df, "terms"), 3).collect()
    assert [r.term for r in top] == ["b", "a", "c"]


def test_tfidf_against_brute_force(rows):
    df = rows("k string, terms array<string>", *DOCS.items())
    got = {(r.k, r.term): r.weight for r in vocabulary.tfidf(df, "k", "terms", 3).collect()}
    idf = {"b": math.log(5 / 3) + 1, "a": math.log(5 / 2) + 1, "c": math.log(5 / 2) + 1}
    expected = {}
    for key, terms in DOCS.items():
        raw = {t: n * idf[t] for t, n in Counter(terms).items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        expected.update({(key, t): w / norm for t, w in raw.items()})
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[k], expected[k]) for k in got)


def test_decision_rule_and_names(rows):
    df = rows("p double", (0.5,), (0.51,))
    p = F.col("p")
    got = df.select(
        labels.decide(p), labels.confidence(p), keys.percent(labels.confidence(p)),
        labels.display_name(labels.label_name(labels.decide(p))),
    ).collect()
    assert [tuple(r) for r in got] == [(0, 0.5, "50.00%", "Corporate Seo"), (1, 0.51, "51.00%", "Personal Blog")]


def test_keys(rows):
    assert keys.config_key({"b": 1, "a": 2}) == keys.config_key({"a": 2, "b": 1})
    assert len(keys.config_key({})) == 12
    row = rows("a int", (1,)).select(keys.fingerprint("a"), keys.run_id("abcdefghi")).first()
    assert len(row[0]) == 12 and re.fullmatch(r"\d{8}_\d{6}_abcdefg", row[1])


def test_term_stats_need_no_sort_inside_a_row(rows):
    found = vocabulary.term_stats(
        rows("id int, t array<string>", (1, ["b", "a", "b", "é"]), (2, ["b"]), (3, []), (4, None), (5, ["b", "b"])), "t"
    )
    assert "sort_array" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("a", 1, 1), ("b", 5, 3), ("é", 1, 1)}
    assert dict(found.dtypes) == {"term": "string", "tf": "bigint", "df": "bigint"}
