"""The documents table from raw text to a weighted training mix.

Each stage works on what its predecessor kept, which is written as Parquet to the shared folder and read again:

1. quality rules: documents that fail them go, with all documents of hosts that nearly always fail;
2. MinHash near-dedup: one row of each class of near copies (5-word shingles, similarity 0.8 or more) stays;
3. substring dedup: words in 35-word windows that repeat anywhere go; a document that loses all its words goes;
4. benchmark decontamination: documents with a verified leak go;
5. mixing: each document gets a rate, so that expected tokens match the domains' target shares; those of rate 0 go.

Stages 1 to 4 return the columns of documents; stage 5 adds n_tokens, a posterior for each domain, the rate,
and targets_met: whether the rates reach every domain's target (else they are the nearest that can be reached).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.llm import decontaminate as clean
from spoor.llm import minhash, mixing, quality, substring
from spoor.llm.common import new_path
from spoor.llm.query_mixing import TARGETS

#: Shingle size and percentage of similarity of near copies.
SHINGLE, SIMILAR = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, SHINGLE, SIMILAR)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the row travels as one column, so that its columns can have any name
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    out = substring.strip_repeats(rows).where("n_removed = 0 OR n_removed < n_words")
    cut = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    kept = lambda c: F.col("_doc").getField(c)
    return out.select(*[(F.when(F.col("n_removed") > 0, cut[f.name].cast(f.dataType)).otherwise(kept(f.name)) if f.name in cut else kept(f.name)).alias(f.name) for f in docs.schema])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS)
    return mixed.rows.where("rate > 0").withColumn("targets_met", F.lit(mixed.fit.converged))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Near copies, substring search and the fitted rates have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
