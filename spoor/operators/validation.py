"""Quality rules of a topology: each finding is a row (severity, rule, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import is_finite, ratio
from .graph import components, degrees
from .storage import written


def at_places(df: DataFrame, column: str, places: dict[str, int]) -> DataFrame:
    """The sorted values at the given indices, in one row; null where there are fewer. No list of values is gathered.

    Values are dealt by ranges once, into a written table, so that both uses of a range see the same rows.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    split = written(values.repartitionByRange(column).withColumn("_p", F.spark_partition_id()), "ranges")
    # running counts by ranges of values: a sum a partition, then within it
    before = split.groupBy("_p").agg(F.sum("c").alias("s")).withColumn("_start", F.coalesce(F.sum("s").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    run = split.join(before.select("_p", "_start"), "_p").withColumn("upto", F.col("_start") + F.sum("c").over(W.partitionBy("_p").orderBy(column)))
    return run.agg(*[F.min(F.when(F.col("upto") > at, F.col(column))).alias(k) for k, at in places.items()])


def ranked(df: DataFrame, column: str, fractions: dict[str, float]) -> DataFrame:
    """Percentiles by the sorted value at index trunc(p (n - 1)); 0 of nothing."""
    total = df.agg(F.count(column)).first()[0]
    found = at_places(df, column, {k: int(p * (total - 1)) for k, p in fractions.items()})
    return found.select(*[F.coalesce(k, F.lit(0.0)).alias(k) for k in fractions])


def interpolated(df: DataFrame, column: str, fraction: float, name: str = "value") -> DataFrame:
    """The percentile between the two sorted values around index p (n - 1), in one row; null of nothing."""
    total = df.agg(F.count(column)).first()[0]
    at = fraction * max(total - 1, 0)
    low = int(at)
    found = at_places(df, column, {"low": low, "high": min(low + 1, max(total - 1, 0))})
    return found.select((F.col("low") * (low + 1 - at) + F.col("high") * (at - low)).alias(name))


def edge_faults(nodes: DataFrame, edges: DataFrame, allow_self_loops: bool = False) -> DataFrame:
    """``edges`` with ``fault``: unknown endpoint, weight not finite, negative weight, self-loop, or null.

    A self-loop is counted and still used; the other faults take the edge out.
    """
    known = nodes.select("id").distinct()
    e = edges.join(known.select(F.col("id").alias("_s")), F.col("source") == F.col("_s"), "left").join(known.select(F.col("id").alias("_t")), F.col("target") == F.col("_t"), "left")
    fault = (
        F.when(F.col("_s").isNull() | F.col("_t").isNull(), "unknown_endpoint")
        .when(~is_finite(F.col("weight")), "weight_not_finite")
        .when(F.col("weight") < 0, "negative_weight")
        .when((F.col("source") == F.col("target")) & F.lit(not allow_self_loops), "self_loop")
    )
    return e.withColumn("fault", fault).drop("_s", "_t")


def findings(nodes: DataFrame, edges: DataFrame, allow_self_loops: bool = False, allow_noncontiguous_ids: bool = False, max_isolated_nodes: int = 0, min_largest_component_ratio: float = 1.0, max_avg_degree: float | None = None, max_max_degree: float | None = None, max_p95_weight: float | None = None) -> DataFrame:
    """``severity, rule, n`` of every rule that is broken, in the order of the checks (``phase``)."""
    spark = nodes.sparkSession
    ids = nodes.agg(F.count("id").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    bad_nodes = nodes.agg(*[F.count_if(F.col(c).isNotNull() & ~is_finite(F.col(c))) for c in ("x", "y", "z", "clearance_radius")]).first()
    checked = edge_faults(nodes, edges, allow_self_loops)
    faults = {r["fault"]: r["n"] for r in checked.groupBy("fault").agg(F.count(F.lit(1)).alias("n")).collect()}
    used = checked.where("fault IS NULL OR fault = 'self_loop'")
    degree = degrees(nodes, used).agg(F.count_if(F.col("degree") == 0).alias("isolated"), F.avg("degree").alias("mean"), F.max("degree").alias("most")).first()
    sizes = components(nodes, used).groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    p95 = ranked(used, "weight", {"p": 0.95}).first()["p"] if max_p95_weight is not None else 0.0
    share = sizes / ids["d"] if ids["d"] else 0.0
    told = [
        (1, "FAIL", "node_not_finite", sum(bad_nodes)),
        (2, "FAIL", "ids_not_unique", ids["n"] - ids["d"]),
        (3, "FAIL", "ids_not_contiguous", 0 if allow_noncontiguous_ids or not ids["d"] else ids["hi"] - ids["lo"] + 1 - ids["d"]),
        *[(4 + i, "FAIL", k, faults.get(k, 0)) for i, k in enumerate(("unknown_endpoint", "weight_not_finite", "negative_weight", "self_loop"))],
        (8, "FAIL", "isolated_nodes", degree["isolated"] if degree["isolated"] > max_isolated_nodes else 0),
        (9, "FAIL", "largest_component", int(share < min_largest_component_ratio)),
        (10, "WARN", "mean_degree", int(max_avg_degree is not None and (degree["mean"] or 0) > max_avg_degree)),
        (11, "WARN", "max_degree", int(max_max_degree is not None and (degree["most"] or 0) > max_max_degree)),
        (12, "WARN", "p95_weight", int(max_p95_weight is not None and p95 > max_p95_weight)),
    ]
    return spark.createDataFrame([x for x in told if x[3]], "phase int, severity string, rule string, n long")


NODE_KEYS, EDGE_KEYS = ("id", "x", "y", "z", "clearance_radius"), ("source", "target", "weight")


def document_messages(documents: DataFrame) -> DataFrame:
    """``subject, item, place, rule`` of each structural fault of raw documents (column ``document``).

    ``item`` is the number of the node or edge (null for the document), ``place`` the check's; together they give the
    order in which the faults are met: document, nodes, edges.
    """
    parsed = documents.select(F.try_parse_json("document").alias("v"))
    is_list = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")).startswith("ARRAY"), F.lit(False))
    there = lambda k: F.try_variant_get("v", f"$.{k}", "variant").isNotNull()
    root = F.when(F.col("v").isNull(), "unparsable").when(F.schema_of_variant("v").startswith("OBJECT") == F.lit(False), "root_not_object").when(~there("nodes"), "nodes_missing").when(~there("edges"), "edges_missing")
    none = F.lit(None).cast("int")
    out = parsed.select(F.lit("document").alias("subject"), none.alias("item"), F.lit(0).alias("place"), root.alias("rule"))
    lists = [F.when(root.isNull() & ~is_list(k), F.lit(f"{k}_not_a_list")) for k in ("nodes", "edges")]
    out = out.unionByName(parsed.select(F.lit("lists").alias("subject"), none.alias("item"), F.posexplode(F.array(*lists)).alias("place", "rule")))
    for kind, keys, whole in (("nodes", NODE_KEYS, ("id",)), ("edges", EDGE_KEYS, ("source", "target"))):
        items = parsed.where(root.isNull()).select(F.posexplode(F.try_variant_get("v", f"$.{kind}", "array<variant>")).alias("item", "i"))
        shape = F.schema_of_variant("i")
        rules = [F.when(~shape.startswith("OBJECT"), F.lit("not_an_object"))]
        for k in keys:
            value = F.try_variant_get("i", f"$.{k}", "variant")
            rules.append(F.when(shape.startswith("OBJECT") & value.isNull(), F.lit(f"{k}_missing")))
            if k in whole:
                rules.append(F.when(value.isNotNull() & ~F.schema_of_variant(value).isin("BIGINT", "BOOLEAN"), F.lit(f"{k}_not_integer")))
            else:
                rules.append(F.when(value.isNotNull() & ~is_finite(F.try_variant_get("i", f"$.{k}", "string")), F.lit(f"{k}_not_finite")))
        out = out.unionByName(items.select(F.lit(kind).alias("subject"), "item", F.posexplode(F.array(*rules)).alias("place", "rule")))
    return out.where("rule IS NOT NULL")


def document_findings(documents: DataFrame) -> DataFrame:
    """``subject, rule, n``: structural faults of raw documents by kind."""
    return document_messages(documents).groupBy("subject", "rule").agg(F.count(F.lit(1)).alias("n"))


def document_graph(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of raw documents as far as their ids are whole numbers; true and false are 1 and 0, as ids go."""
    parsed = documents.select(F.try_parse_json("document").alias("v"))

    def items(kind: str, keys: tuple[str, ...], whole: tuple[str, ...]) -> DataFrame:
        rows = parsed.select(F.explode(F.try_variant_get("v", f"$.{kind}", "array<variant>")).alias("i"))
        get = lambda k, t: F.try_variant_get("i", f"$.{k}", t)
        ids = lambda k: F.when(F.schema_of_variant(get(k, "variant")).isin("BIGINT", "BOOLEAN"), F.coalesce(get(k, "bigint"), get(k, "boolean").cast("long")))
        out = rows.select(*[ids(k).alias(k) if k in whole else get(k, "string").try_cast("double").alias(k) for k in keys])
        return out.dropna(subset=list(whole))

    return items("nodes", NODE_KEYS, ("id",)), items("edges", EDGE_KEYS, ("source", "target"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: distinct nodes, listed edges, degree statistics."""
    d = degrees(nodes, edges).agg(F.count(F.lit(1)).alias("n_nodes"), F.coalesce(F.avg("degree"), F.lit(0.0)).alias("mean_degree"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))
    e = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return d.join(e, F.lit(True)).withColumn("edges_per_node", ratio(F.col("n_edges").cast("double"), F.col("n_nodes").cast("double")))
