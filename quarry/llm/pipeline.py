"""The corpus pipeline: quality, line dedup, near dedup, decontamination, tokens. Each stage's rows are the next one's documents.

Defined results, for every stage: a null or empty text goes with the first stage, so later ones meet none from it (alone
they keep such rows: line dedup unchanged, near dedup as documents without a group, decontamination as clean, tokens
with none); ties go to the least doc_id, in line dedup then to the first place; repeated rows are judged alike and stay
or go together; rows without doc_id are judged by their text, and near dedup keeps them; texts are read whole; an empty
table gives an empty table; extra columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, decontaminate, lines, minhash, quality
from quarry.llm.common import read, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the posterior quality reject go; null and empty texts are among them."""
    return quality.filter_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go from the texts; a document goes only if it had words and none is left."""
    return lines.clean_documents(docs, drop_emptied=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the least doc_id stays; texts without words are in no group; of texts that share a
    doc_id each is judged by itself."""
    return minhash.drop_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document: its token count and the digests of its ids and decoded text; null texts have none."""
    return bpe.encode(docs, digest=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: Expectation-maximisation, signatures and the tokenizer have no SQL form; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
