"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quarry.llm import chat, chat_repair, decontamination, language, mixing, near_duplicates, neighbours, phrases, privacy, quality_classifier, quality_rules, repeated_lines, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_pii": privacy.op1_pii,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_near_duplicates": near_duplicates.op3_near_duplicates,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language": language.op7_language,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_repeated_lines": repeated_lines.op9_repeated_lines,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op11_phrases": phrases.op11_phrases,
    "op12_neighbours": neighbours.op12_neighbours,
    "op13_conversation_repair": chat_repair.op13_conversation_repair,
}
SQL = {
    "op2_quality_rules": quality_rules.OP2_SQL,
    "op3_near_duplicates": near_duplicates.OP3_SQL,
    "op5_decontamination": decontamination.OP5_SQL,
    "op9_repeated_lines": repeated_lines.OP9_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
    "op11_phrases": phrases.OP11_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
