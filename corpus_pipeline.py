"""A corpus pipeline: every stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turfline.functions.lineage import scratch
from turfline.llm import chosen_path, language, mixing, pieces, private

STAGES = [
    ("language", language.keep_identified),
    ("near_duplicates", chosen_path.keep_one),
    ("private", private.redact_documents),
    ("mix", mixing.mix_documents),
    ("encode", pieces.encode_documents),
]

#: Trained models and a tokenizer cannot be put in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the application's shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{scratch(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
