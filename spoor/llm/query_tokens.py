"""op3: token counts of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .token_counts import count_tokens

NAME = "op3_token_counts"
SQL = None
MODEL = "piece_bpe_32k.model"
LIMIT = 4096


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a cache that begins empty, so every distinct text is encoded once."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = count_tokens(docs, public_tokenizers.path(MODEL))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
