"""op12: periodic runs of all documents, those with every tenth hash made periodic first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .periodic import collapse_runs

NAME = "op12_periodic_runs"
#: All stretches of all periods in SQL compare every word with all that follow; a test holds the query against plain Python.
SQL = None


def _planted(n: Column) -> Column:
    """From which word on, and with which period, a document of n words is made to repeat itself."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = g % n
    period = 1 + F.floor((n - a) / (3 + g % 8))
    return F.when((h % 10 == 0) & (n > 0), F.struct(a.cast("long").alias("from"), period.cast("long").alias("period")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    out = collapse_runs(docs, _planted(n))
    best = F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))[0]
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))).alias("listed"), "collapsed")
    return out.select(
        "doc_id",
        "n_runs",
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.floor(1000 * -F.col("best.l") / F.col("best.p")).cast("long").alias("exponent_milli"),
        sha(F.col("listed")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
