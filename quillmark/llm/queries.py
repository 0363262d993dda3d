"""The package's queries and the SQL that tells the same, where SQL can."""

from __future__ import annotations

from quillmark.llm import bpe_roundtrip, license_scan, line_dedup, ngram_join, packing, quality_rules, token_codes, toxicity, url_filter, vector_neardup

QUERIES = {
    "op1_token_codes": token_codes.op1_token_codes,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_vector_neardup": vector_neardup.op5_vector_neardup,
    "op6_bpe_roundtrip": bpe_roundtrip.op6_bpe_roundtrip,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_url_filter": url_filter.op10_url_filter,
}

ORACLE_SQL = {"op10_url_filter": url_filter.oracle_sql()}
