"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import alignment, bpe, chaining, chat, decontaminate, langid, lines, minhash, packing, pipeline, quality, repair, surrogates, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_chaining": chaining.op2_chaining,
    "op3_packing": packing.op3_packing,
    "op4_line_windows": lines.op4_line_windows,
    "op5_minhash": minhash.op5_minhash,
    "op6_bpe": bpe.op6_bpe,
    "op7_chat": chat.op7_chat,
    "op8_surrogates": surrogates.op8_surrogates,
    "op9_quality": quality.op9_quality,
    "op10_templates": decontaminate.op10_templates,
    "op11_repair": repair.op11_repair,
    "op12_langid": langid.op12_langid,
    "op13_alignment": alignment.op13_alignment,
    "pipeline": pipeline.run,
}
ORACLES: dict[str, str] = {
    "op4_line_windows": lines.ORACLE,
    "op7_chat": chat.ORACLE,
    "op11_repair": repair.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
