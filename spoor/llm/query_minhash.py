"""op10: near-duplicate classes of all documents over 2-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .minhash import near_duplicates

NAME = "op10_minhash_near_dedup"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, size=2, percent=80).rows.select("doc_id", "n_shingles", "component_id", "kept")
