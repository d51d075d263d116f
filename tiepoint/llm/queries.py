"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, extract, fingerprints, lines, neardup, packing, quality, resample, secrets, substrings, token_files, turns

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": packing.op1,
    "op2_fingerprints": fingerprints.op2,
    "op3_token_files": token_files.op3,
    "op4_minhash_near_dedup": neardup.op4,
    "op5_secret_scan": secrets.op5,
    "op6_chat_format": chat.op6,
    "op7_quality": quality.op7,
    "op8_decontamination": decontaminate.op8,
    "op9_line_dedup": lines.op9,
    "op10_substring_dedup": substrings.op10,
    "op11_importance_resampling": resample.op11,
    "op12_main_text": extract.op12,
    "op13_conversation_repair": turns.op13,
}

ORACLES: dict[str, str] = {
    "op9_line_dedup": lines.ORACLE,
    "op11_importance_resampling": resample.ORACLE,
    "op13_conversation_repair": turns.ORACLE,
}
