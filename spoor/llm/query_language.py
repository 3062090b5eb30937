"""op9: languages of all documents, learnt from those outside the held-out quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language
from .common import bucket_of

NAME = "op9_language_id"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = bucket_of("doc_id", 4) == 2
    model = language.fit(docs.where(~held).select("lang", "text"))
    out = language.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
