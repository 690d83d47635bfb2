"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from tidemark.llm import bpe, chat, fmindex, jaccard, language, quality, secrets, toxicity, urls, warc

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_toxicity": toxicity.query,
    "op3_warc": warc.query,
    "op4_decontamination": fmindex.query,
    "op5_url_filters": urls.query,
    "op6_language_id": language.query,
    "op7_chat_formatting": chat.query,
    "op8_ngram_jaccard": jaccard.query,
    "op9_bpe": bpe.query,
    "op10_secret_scans": secrets.query,
}
ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op3_warc": warc.ORACLE,
    "op4_decontamination": fmindex.ORACLE,
    "op5_url_filters": urls.ORACLE,
    "op8_ngram_jaccard": jaccard.ORACLE,
}
