"""op11: variants of the spelling among the words of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .spelling import group_variants, runs, vocabulary

NAME = "op11_spelling_variants"
#: A search by edit distance among all words would compare all pairs in SQL; a test holds the query against plain Python.
SQL = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return group_variants(vocabulary(runs(docs))).select("word", "form", "root", "n", "n_near", "form_n")
