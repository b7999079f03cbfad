"""Registered queries of this package: opN_<name> -> (query, SQL or None)."""

from __future__ import annotations

from lodestar.llm import chat, clustering, decontam, html, merkle, mixing, neardup, quality, sketches, substrings, tokens, toxicity, urls

ENTRIES = {
    "op1_html_extraction": (html.op1_html_extraction, None),
    "op2_mix_sources": (mixing.op2_mix_sources, mixing.SQL),
    "op3_jaccard_join": (neardup.op3_jaccard_join, None),
    "op4_decontamination": (decontam.op4_decontamination, None),
    "op5_token_ids": (tokens.op5_token_ids, None),
    "op6_chat_formatting": (chat.op6_chat_formatting, chat.SQL),
    "op7_substring_dedup": (substrings.op7_substring_dedup, None),
    "op8_quality_rules": (quality.op8_quality_rules, quality.SQL),
    "op9_toxicity": (toxicity.op9_toxicity, None),
    "op10_url_filters": (urls.op10_url_filters, urls.SQL),
    "op11_centroid_clustering": (clustering.op11_centroid_clustering, clustering.SQL),
    "op12_minhash_near_dedup": (sketches.op12_minhash_near_dedup, sketches.SQL),
    "op13_merkle_manifest": (merkle.op13_merkle_manifest, merkle.SQL),
}


def queries() -> dict:
    return {k: v[0] for k, v in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in ENTRIES.items() if v[1]}
