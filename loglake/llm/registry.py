"""Queries over the synthetic tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loglake.llm import chat, decontaminate, language, mixing, neighbours, ppm, quality, simhash, suffix, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_mix": mixing.op2_mix,
        "op3_quality": quality.op3_quality,
        "op4_simhash": simhash.op4_simhash,
        "op5_chat": chat.op5_chat,
        "op6_suffix": suffix.op6_suffix,
        "op7_ppm": ppm.op7_ppm,
        "op8_tokens": tokens.op8_tokens,
        "op9_neighbours": neighbours.op9_neighbours,
        "op10_language": language.op10_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.OP1_SQL, "op2_mix": mixing.OP2_SQL, "op5_chat": chat.OP5_SQL, "op6_suffix": suffix.OP6_SQL}
