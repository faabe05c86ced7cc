"""The training-data pipeline: each stage works on what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents.

Defined cases of every stage: columns of any further names are kept, null doc_ids and repeated rows are rows of their
own, texts are handled whole however long, an empty table gives no rows; what null and empty texts come to is said
at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import shared_folder, table
from sparkloom.llm.op1_quality import drop_rejected
from sparkloom.llm.op6_minhash import drop_near_duplicates
from sparkloom.llm.op7_packing import pack
from sparkloom.llm.op8_pii import mask_pii
from sparkloom.llm.op10_decontaminate import drop_contaminated


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores under its threshold go; null and empty texts are scored as the empty text."""
    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays; null, empty and blank texts are no copies of anything and stay."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item go; null and empty texts contain none."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets in texts become marks; null and empty texts stay as they are."""
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows become pieces of token sequences; null and empty texts are the end id alone."""
    return pack(docs, cache_words=200_000, text_bytes=2 << 20)  # executors still hold what earlier stages took


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The classifier, the field and the tokenizer can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet in the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
