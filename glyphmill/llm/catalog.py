"""The ten queries of this subpackage, by name, and SQL where SQL can express one."""

from __future__ import annotations

from glyphmill.llm import bpe_text, decontamination, jaccard_join, quality, sharding, substring_dedup, token_counts, token_files, toxicity, warc

QUERIES = {
    "op1_sharding": sharding.op1,
    "op2_quality_rules": quality.op2,
    "op3_bpe_encoding_and_decoding": bpe_text.op3,
    "op4_benchmark_decontamination": decontamination.op4,
    "op5_ngram_jaccard_join": jaccard_join.op5,
    "op6_toxicity": toxicity.op6,
    "op7_substring_dedup": substring_dedup.op7,
    "op8_token_id_files": token_files.op8,
    "op9_warc": warc.op9,
    "op10_token_counts": token_counts.op10,
}
ORACLES: dict[str, str] = {
    "op5_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op7_substring_dedup": substring_dedup.ORACLE_SQL,
}
