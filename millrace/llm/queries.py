"""Queries of this subpackage, for the entry module."""

from __future__ import annotations

from millrace.llm import chat, cotraining, decontam, kd_search, licenses, line_dedup, lm_scoring, mixing, simhash, toxicity

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_lm_scoring": lm_scoring.query,
    "op3_simhash": simhash.query,
    "op4_license_scan": licenses.query,
    "op5_line_dedup": line_dedup.query,
    "op6_toxicity": toxicity.query,
    "op7_chat_formatting": chat.query,
    "op8_decontamination": decontam.query,
    "op9_cotraining": cotraining.query,
    "op10_top_k": kd_search.query,
}

SQL = {
    "op1_mixing": mixing.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op7_chat_formatting": chat.SQL,
    "op8_decontamination": decontam.SQL,
    "op10_top_k": kd_search.SQL,
}
