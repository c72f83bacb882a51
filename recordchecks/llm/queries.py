"""Registered queries of the training-data operators: each applies one
operator, with production parameters, to its whole table."""

from __future__ import annotations

from recordchecks.llm import (class_lm, line_rules, mixing, nearest, packing, periodic_runs, pii, quality_net, simhash,
                              spelling_variants, token_counts, toxicity, web_archive)

LLM_QUERIES = {
    "op1_mixing": mixing.query,
    "op2_token_counts": token_counts.query,
    "op3_simhash": simhash.query,
    "op4_pii": pii.query,
    "op5_class_lm": class_lm.query,
    "op6_web_archive": web_archive.query,
    "op7_quality_net": quality_net.query,
    "op8_packing": packing.query,
    "op9_nearest": nearest.query,
    "op10_line_rules": line_rules.query,
    "op11_spelling_variants": spelling_variants.query,
    "op12_toxicity": toxicity.query,
    "op13_periodic_runs": periodic_runs.query,
}
LLM_ORACLES = {"op6_web_archive": web_archive.ORACLE}
