"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from ragloom.llm import chat, decontam, linededup, lm, minhash, neardup, packing, rans, secrets, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_line_dedup": linededup.op1_line_dedup,
        "op2_benchmark_decontamination": decontam.op2_benchmark_decontamination,
        "op3_embedding_near_dedup": neardup.op3_embedding_near_dedup,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_lm_scoring": lm.op9_lm_scoring,
        "op7_toxicity": toxicity.op7_toxicity,
        "op10_token_blocks": rans.op10_token_blocks,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": linededup.SQL,
        "op2_benchmark_decontamination": decontam.SQL,
        "op3_embedding_near_dedup": neardup.SQL,
        "op4_chat_formatting": chat.SQL,
        "op8_secret_scan": secrets.SQL,
    }
