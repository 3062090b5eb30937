"""op2: benchmark items that leak into the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import find_leaks

NAME = "op2_decontamination"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
