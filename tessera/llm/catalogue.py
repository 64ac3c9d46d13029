"""Registered corpus queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, fingerprints, line_dedup, lm_scoring, near_dedup, neighbours, packing, quality, sampling, substring

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_lm_scoring": lm_scoring.query,
    "op3_chat_formatting": chat.query,
    "op4_quality_classifier": quality.query,
    "op5_substring_dedup": substring.query,
    "op6_line_dedup": line_dedup.query,
    "op7_fingerprints": fingerprints.query,
    "op8_near_dedup": near_dedup.query,
    "op9_sampled_segmentation": sampling.query,
    "op10_nearest_neighbours": neighbours.query,
}
ORACLES = {"op3_chat_formatting": chat.SQL, "op5_substring_dedup": substring.SQL, "op8_near_dedup": near_dedup.SQL}
