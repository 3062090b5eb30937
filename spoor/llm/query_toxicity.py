"""op6: toxicity of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .toxicity import predict, train

NAME = "op6_toxicity"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return predict(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
