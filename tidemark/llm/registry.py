"""Queries of this subpackage and their SQL; the entry module adds them when the subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import ann, bpe, chat, media, mixing, pitman_yor, sharding, simhash, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_sharding": sharding.op3_sharding,
    "op4_nearest": ann.op4_nearest,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_mixing": mixing.op6_mixing,
    "op7_chat_rotation": chat.op7_chat_rotation,
    "op8_media": media.op8_media,
    "op9_simhash": simhash.op9_simhash,
    "op10_language_model": pitman_yor.op10_language_model,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op7_chat_rotation": chat.OP7_SQL,
}
