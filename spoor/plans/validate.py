"""Validation of a topology document: its shape first, then the graph that it holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import written
from ..operators.validation import document_findings, document_graph, findings
from .topology import Topology, to_json


@dataclass
class Report:
    """``findings``: phase, severity, rule, n; warnings never fail."""

    findings: DataFrame

    @property
    def ok(self) -> bool:
        return self.findings.where("severity = 'FAIL'").isEmpty()

    @property
    def status(self) -> int:
        return 0 if self.ok else 2


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The whole file as one row ``document``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("document"))


def write_document(graph: Topology, path: str) -> None:
    to_json(graph).select(F.col("document").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def validate(documents: DataFrame, **limits) -> Report:
    """Broken shapes of nodes and edges are findings and leave the items out; a broken document is a finding alone."""
    shape = written(document_findings(documents).select(F.lit(0).alias("phase"), F.lit("FAIL").alias("severity"), F.concat_ws(": ", "subject", "rule").alias("rule"), F.col("n").cast("long").alias("n")), "shape")
    if not shape.where("startswith(rule, 'document')").isEmpty():
        return Report(shape)
    nodes, edges = (written(x, "graph") for x in document_graph(documents))
    return Report(written(shape.unionByName(findings(nodes, edges, **limits)), "findings"))
