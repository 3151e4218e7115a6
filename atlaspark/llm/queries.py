"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from atlaspark.llm import chat, decontam, fingerprint, lines, near_dup, packing, pii, quality, shards, url_filter

QUERIES = {
    "op1_benchmark_decontamination": decontam.op1_benchmark_decontamination,
    "op2_pii": pii.op2_pii,
    "op3_packing": packing.op3_packing,
    "op4_minhash_near_dedup": near_dup.op4_minhash_near_dedup,
    "op5_training_order": shards.op5_training_order,
    "op6_document_fingerprints": fingerprint.op6_document_fingerprints,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_url_filters": url_filter.op10_url_filters,
}

ORACLE = {
    "op1_benchmark_decontamination": decontam.ORACLE,
    "op4_minhash_near_dedup": near_dup.ORACLE,
    "op7_chat_formatting": chat.ORACLE,
    "op10_url_filters": url_filter.ORACLE,
}
