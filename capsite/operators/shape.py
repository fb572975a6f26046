"""Promoter shape: entropy of the tags between the 10 % and 90 % positions."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from capsite.operators.intervals import points_in_intervals


def shape_scores(signal: DataFrame, clusters: DataFrame, method: str = "PSS") -> DataFrame:
    """Adds shape_score: PSS = -sum(p log2 p) * log2(width), SI = 2 + sum(p log2 p)."""
    if method not in ("PSS", "SI"):
        raise ValueError(f"unknown shape method {method!r}")
    keys = ["sample", "chr", "strand"]
    cores = clusters.select(*keys, "cluster", F.col("q_0_1").alias("_q1"), F.col("q_0_9").alias("_q9"))
    inside = points_in_intervals(signal, cores, keys, "pos", "_q1", "_q9")
    # sum(p log2 p) with p = t / T is (sum t log2 t) / T - log2 T, so one aggregation does.
    plogp = inside.groupBy("sample", "cluster").agg((F.sum(F.col("tags") * F.log2("tags")) / F.sum("tags") - F.log2(F.sum("tags"))).alias("_h"))
    score = -F.col("_h") * F.log2("interquantile_width") if method == "PSS" else 2 + F.col("_h")
    return clusters.join(plogp, ["sample", "cluster"]).withColumn("shape_score", score).withColumn("method", F.lit(method)).drop("_h")
