"""Schemas of stored tables."""

from __future__ import annotations

SCORE = "struct<faithfulness:double,answer_relevance:double,context_precision:double,context_recall:double>"

GOLDEN = "question string, ideal_answer string, expected_sources array<string>"
RATING = "question string, answer string, rating int, comment string, provider string, model string, prompt_version string, id string, created_at string"
RUN = (
    f"dataset string, provider string, model string, prompt_version string, n int, aggregate {SCORE}, "
    f"per_example array<struct<question:string,answer:string,ideal_answer:string,score:{SCORE}>>, created_at string"
)
