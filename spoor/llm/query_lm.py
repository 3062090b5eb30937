"""op8: log probabilities of all documents under a model learnt from six sevenths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngram_lm
from .common import bucket_of

NAME = "op8_lm_scoring"
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = ngram_lm.train(docs.where(bucket_of("doc_id", 7) != 2))
    out = ngram_lm.score(docs, model)
    return out.select("doc_id", F.coalesce(bucket_of("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
