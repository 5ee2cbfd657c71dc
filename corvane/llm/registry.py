"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, divergence, fim, langid, lm, neardup, packing, quality, toxicity, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_toxicity": toxicity.op2_toxicity,
    "op9_language": langid.op9_language,
    "op3_topk": vectors.op3_topk,
    "op7_lm_score": lm.op7_lm_score,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op10_vector_links": vectors.op10_vector_links,
    "op4_retrieval_packing": packing.op4_retrieval_packing,
    "op5_bpe_codec": bpe.op5_bpe_codec,
    "op6_chat_format": chat.op6_chat_format,
    "op11_decontamination": decontaminate.op11_decontamination,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk": vectors.ORACLE_TOPK,
    "op6_chat_format": chat.ORACLE,
    "op10_vector_links": vectors.ORACLE_LINKS,
    "op11_decontamination": decontaminate.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
