"""The corpus pipeline: from raw documents to token ids, stage by stage.

Each stage is a function of (spark, docs, folder of tables); its result is written as Parquet
and read again as the next stage's documents. All stages take null ids, texts, languages and sources, empty and very long texts, repeated rows,
further columns of any name, and empty tables, which give empty tables. All but the last return their rows with all columns, unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import common, exact, mixing, near, toxicity
from loomline.llm.queries import token_digests


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. A null or empty text is scored like any other; repeated rows share their fate."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts, the one with the largest id; null counts as empty. Of rows that share id and text one stays."""
    return exact.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Texts without words and rows without an id stand alone. Of rows that share id and text one stays."""
    return near.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is a source. Texts without words have no weight in the mix."""
    return mixing.draw(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the token ids of each row, and digests of the ids and of the text decoded from them; no other column. A null text is empty."""
    return token_digests(docs, keep_ids=True)


STAGES = [("toxicity", toxicity_filter), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("byte_bpe", tokenize)]

#: The first and the third stage have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.stash(docs, compression="zstd")
    return docs
