"""Token counts through a digest cache.

A text's count depends on its content and on the tokenizer's version alone, so counts are stored once by
(content digest, tokenizer digest). A run joins its texts' digests to the stored counts, encodes one text of each
digest that has none, appends those counts to the cache, and joins the counts back to all rows.

Defined results: a null text is the empty text; it has 0 bytes and 0 tokens. Repeated texts are encoded once and each
row gets the count. Extra columns are passed over. An empty table gives an empty result and leaves the cache as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clean_text, new_path, slices, written

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"

def tokenizer_digest(model_path: str) -> str:
    """sha256 over the model's bytes and the library's version."""
    import sentencepiece
    import tokenizers

    version = tokenizers.__version__ if model_path.endswith(".json") else sentencepiece.__version__
    with open(model_path, "rb") as f:
        return hashlib.sha256(f.read() + version.encode()).hexdigest()


class SentencePieceCounter:
    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class JsonTokenizerCounter:
    def __init__(self, model_path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(model_path)
        self.model.no_truncation()
        self.model.no_padding()

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]


def counter(model_path: str):
    return (JsonTokenizerCounter if model_path.endswith(".json") else SentencePieceCounter)(model_path)


def _encode(model_path: str, digest: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for part in slices(batches, "text"):
            count = count or counter(model_path)
            n = count(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("content_digest"), pa.array([digest] * len(n), pa.string()), pa.array(n, pa.int64())], names=["content_digest", "tokenizer_digest", "n_tokens"])

    return run


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def count_tokens(docs: DataFrame, model_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, content_digest, n_bytes, n_tokens`` of every row; the cache at ``cache_path`` grows by what it lacked."""
    spark = docs.sparkSession
    version = tokenizer_digest(model_path)
    cache_path = cache_path or new_path(spark, "token-cache")
    text = clean_text(text_col)
    keyed = docs.select(F.col(id_col), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content_digest"), text.alias("text"))

    def stored() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)

    lacking = keyed.select("content_digest", "text")
    if exists(spark, cache_path):
        lacking = lacking.join(stored().select("content_digest"), "content_digest", "left_anti")
    lacking.dropDuplicates(["content_digest"]).mapInArrow(_encode(model_path, version), CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # two runs that append at one time may both have encoded a text; their counts are equal
    # (written, so that a text with very many copies is dealt to several tasks when it is joined)
    counts = written(stored().groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    rows = keyed.select(id_col, "content_digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(counts, "content_digest", "inner").select(id_col, "content_digest", "n_bytes", "n_tokens")
