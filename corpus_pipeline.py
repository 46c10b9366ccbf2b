"""A training corpus from documents: quality, line and near-duplicate filters, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet in the shared folder and reads them again as the next one's docs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparquill.llm import bpe, line_dedup, minhash_dedup, mixing, quality
from sparquill.llm.common import written
from sparquill.sources import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.passing(docs)


def line_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those that lose all their lines go."""
    return line_dedup.dedup_lines(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id."""
    return minhash_dedup.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """mixing.SHARE of all tokens, shared among sources by the mixing.TEMPERATURE-th power of their tokens; small sources give all they have."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as token ids, with the text decoded from them."""
    return bpe.encode(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_repeats),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources", source_mix),
    ("BPE encoding", token_ids),
]
#: Near-duplicate groups and byte-pair merges are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
