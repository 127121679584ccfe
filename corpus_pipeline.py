"""From raw documents to packed training bins, in five stages.

Each stage takes (spark, docs, sf_dir), where docs is the written result of the stage before, and
returns a DataFrame: the kept documents with all their columns, or, in the last stage, one row per
packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import best_fit, entropy_mix, lsh_forest, pii, rule_ensemble
from ledgerline.session import durable

CAPACITY = 4096


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the rule ensemble scores below its threshold; labels of four folds of five teach it."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return rule_ensemble.keep_good(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that shares 80 % of its five-word shingles."""
    return lsh_forest.keep_first(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    return pii.redact(docs, pii.fit(docs.select("doc_id", "text")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and leave out documents so that sources have their target shares of words."""
    return entropy_mix.mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all pieces into bins; copies of a text never share one."""
    return best_fit.pack(best_fit.items_of(docs), capacity=CAPACITY)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: learned scores, signatures and packing order are beyond SQL; tests/llm holds brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
