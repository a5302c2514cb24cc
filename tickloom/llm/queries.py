"""Queries of the training-data operators on the test tables, and their SQL where it can express them."""

from __future__ import annotations

from tickloom.llm import chat_format, exact_dedup, fingerprints, hard_negatives, importance_resampling, minhash_dedup, packing, quality_rules, sentencepiece_bpe, suffix_dedup, token_counts, toxicity, url_filters


def queries() -> dict:
    return {
        "op1_minhash_dedup": minhash_dedup.query,
        "op10_suffix_dedup": suffix_dedup.query,
        "op11_hard_negatives": hard_negatives.query,
        "op12_importance_resampling": importance_resampling.query,
        "op13_exact_dedup": exact_dedup.query,
        "op2_sentencepiece": sentencepiece_bpe.query,
        "op3_url_filters": url_filters.query,
        "op4_token_counts": token_counts.query,
        "op5_packing": packing.query,
        "op6_chat_format": chat_format.query,
        "op7_toxicity": toxicity.query,
        "op8_fingerprints": fingerprints.query,
        "op9_quality_rules": quality_rules.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_dedup": minhash_dedup.SQL,
        "op11_hard_negatives": hard_negatives.SQL,
        "op12_importance_resampling": importance_resampling.SQL,
        "op13_exact_dedup": exact_dedup.SQL,
        "op3_url_filters": url_filters.SQL,
        "op6_chat_format": chat_format.SQL,
    }
