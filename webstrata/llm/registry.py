"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from webstrata.llm import (
    bpe,
    chat,
    extraction,
    fingerprints,
    languages,
    mixing,
    ngram_join,
    phrases,
    quality,
    substrings,
    toxicity,
    tries,
    url_filter,
)

QUERIES = {
    "op1_source_mixing": mixing.query,
    "op2_url_filter": url_filter.query,
    "op3_chat_formatting": chat.query,
    "op4_html_extraction": extraction.query,
    "op5_toxicity": toxicity.query,
    "op6_quality_rules": quality.query,
    "op7_bpe_round_trip": bpe.query,
    "op8_document_fingerprints": fingerprints.query,
    "op9_ngram_jaccard_join": ngram_join.query,
    "op10_substring_dedup": substrings.query,
    "op11_language_id": languages.query,
    "op12_phrase_collocations": phrases.query,
    "op13_prefix_trie": tries.query,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mixing": mixing.oracle(),
        "op3_chat_formatting": chat.ORACLE,
        "op6_quality_rules": quality.oracle(),
        "op9_ngram_jaccard_join": ngram_join.ORACLE,
        "op10_substring_dedup": substrings.ORACLE,
        "op12_phrase_collocations": phrases.oracle(),
        "op13_prefix_trie": tries.ORACLE,
    }
