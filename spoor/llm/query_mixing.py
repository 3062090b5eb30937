"""op1: rates of all documents for a mix of mostly good text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix

NAME = "op1_mixing"
SQL = None
#: Shares of the corpus's tokens.
TARGETS = {"good": 0.9, "rough": 0.08, "toxic": 0.02}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS).rows.drop("text")
