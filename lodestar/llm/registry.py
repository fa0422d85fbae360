"""Queries and oracles of the training-data operators, for the driver entry."""

from __future__ import annotations

import corpus_pipeline
from lodestar.llm import op1_jaccard, op10_toxicity, op11_sharding, op12_phrases, op13_spelling, op2_quality, op3_mixing, op4_bpe, op5_urls, op6_ann, op7_repeats, op8_language, op9_lines


def queries() -> dict:
    return {
        "op1_jaccard_join": op1_jaccard.op1_jaccard_join,
        "op2_quality_rules": op2_quality.op2_quality_rules,
        "op3_mix_sources": op3_mixing.op3_mix_sources,
        "op4_bpe_roundtrip": op4_bpe.op4_bpe_roundtrip,
        "op5_url_filter": op5_urls.op5_url_filter,
        "op6_nearest": op6_ann.op6_nearest,
        "op7_repeated_strings": op7_repeats.op7_repeated_strings,
        "op8_language_id": op8_language.op8_language_id,
        "op9_line_dedup": op9_lines.op9_line_dedup,
        "op10_toxicity": op10_toxicity.op10_toxicity,
        "op11_sharding": op11_sharding.op11_sharding,
        "op12_phrases": op12_phrases.op12_phrases,
        "op13_spelling": op13_spelling.op13_spelling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op3_mix_sources": op3_mixing.mix_sql(),
        "op9_line_dedup": op9_lines.line_sql(),
        "op11_sharding": op11_sharding.shard_sql(),
        "op12_phrases": op12_phrases.phrase_sql(),
        "op13_spelling": op13_spelling.spelling_sql(),
    }
