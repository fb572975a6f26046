"""Enhancer candidates: divergent pairs of clusters away from genes."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from capsite.operators.intervals import points_in_intervals


def call_enhancers(annotated: DataFrame, flanking: int = 400, dis2gene: int = 2000) -> DataFrame:
    """Minus then plus neighbours within ``flanking`` among clusters without a gene.

    Pairs are numbered per sample and chromosome before the balance filter (-0.8 < D < 0.8) and before
    pairs near the strongest cluster of any gene, on either strand, go.
    """
    axis = W.partitionBy("sample", "chr").orderBy("dominant_tss", "cluster")
    free = annotated.filter(F.col("gene").isNull()).select("sample", "chr", "strand", "cluster", "dominant_tss", "tags")
    ahead = free.select("*", *[F.lead(c).over(axis).alias(f"{c}_p") for c in ("strand", "cluster", "dominant_tss", "tags")])
    pairs = ahead.filter((F.col("strand") == "-") & (F.col("strand_p") == "+") & (F.col("dominant_tss_p") - F.col("dominant_tss") <= flanking))
    pairs = pairs.withColumn("enhancer", F.row_number().over(W.partitionBy("sample", "chr").orderBy("dominant_tss", "cluster")).cast("bigint"))
    pairs = pairs.withColumn("d", (F.col("tags_p") - F.col("tags")) / (F.col("tags_p") + F.col("tags"))).filter((F.col("d") > -0.8) & (F.col("d") < 0.8))
    tops = annotated.filter(F.col("gene").isNotNull()).groupBy("sample", "chr", "gene").agg(F.max_by("dominant_tss", F.struct(F.col("tags"), -F.col("cluster"))).alias("_top"))
    reach = tops.select("sample", "chr", (F.col("_top") - dis2gene).alias("_s"), (F.col("_top") + dis2gene).alias("_e"))
    ends = pairs.select("sample", "chr", "enhancer", F.explode(F.array("dominant_tss", "dominant_tss_p")).alias("pos"))
    near = points_in_intervals(ends, reach, ["sample", "chr"], "pos", "_s", "_e").select("sample", "chr", "enhancer").distinct()
    kept = pairs.join(near, ["sample", "chr", "enhancer"], "left_anti")
    return kept.select("sample", "enhancer", F.col("cluster").alias("cluster_m"), F.col("cluster_p"), "chr", F.col("dominant_tss").alias("dominant_tss_m"), F.col("dominant_tss_p"), F.col("tags").alias("tags_m"), F.col("tags_p"), "d")
