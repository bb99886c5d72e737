"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from basewright.llm import bpe, exact_dedup, kd_shards, language_id, pii, quality_model, repetition, similarity_join, source_mix, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_language": language_id.op2_language,
    "op3_source_mix": source_mix.op3_source_mix,
    "op4_quality": quality_model.op4_quality,
    "op5_repetition": repetition.op5_repetition,
    "op6_kd_shards": kd_shards.op6_kd_shards,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_ngram_join": similarity_join.op8_ngram_join,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_bpe": bpe.op10_bpe,
}

ORACLE_SQL = {
    "op5_repetition": repetition.OP5_SQL,
    "op8_ngram_join": similarity_join.OP8_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}
