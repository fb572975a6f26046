"""Cross-sample cluster identity: an ordered fold over samples, then per-sample statistics."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from capsite.operators.cluster import CLUSTER, spread, summarize
from capsite.operators.intervals import merge_intervals, overlaps, points_in_intervals

KEYS = ["chr", "strand"]


def _seeds(clusters: DataFrame, sample: str, dis: int) -> DataFrame:
    half = F.bround(F.lit(dis / 2)).cast("bigint")
    return clusters.filter(F.col("sample") == sample).select(*KEYS, (F.col("dominant_tss") - half).alias("start"), (F.col("dominant_tss") + half).alias("end"))


def _fold(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ranges of both sides that meet are united; the others stay as they are, side by side."""
    r = right.select(*KEYS, F.col("start").alias("start_r"), F.col("end").alias("end_r"))
    pairs = overlaps(left, r, KEYS)
    met_l = pairs.select(*KEYS, "start", "end").distinct()
    met_r = pairs.select(*KEYS, F.col("start_r").alias("start"), F.col("end_r").alias("end")).distinct()
    union = merge_intervals(met_l.unionByName(met_r), KEYS)
    on = [*KEYS, "start", "end"]
    return union.unionByName(left.join(met_l, on, "left_anti").select(*on)).unionByName(right.join(met_r, on, "left_anti").select(*on))


def consensus_ranges(clusters: DataFrame, samples: list[str], dis: int = 50) -> DataFrame:
    """Numbered ranges around dominant sites, folded in the order of ``samples``.

    The fold has one step per merged sample, a handful; each is two shuffles on (chr, strand, bin).
    """
    if not samples:
        raise ValueError("no samples given")
    seeds = [_seeds(clusters, s, dis) for s in samples]
    folded = reduce(_fold, seeds[1:], merge_intervals(seeds[0], KEYS))
    w = W.orderBy("strand", "chr", "start", "end")
    # One row per promoter of the genome: thousands, whatever the number of reads.
    return folded.withColumn("cluster", F.row_number().over(w).cast("bigint")).select("cluster", *KEYS, "start", "end")


def consensus_clusters(signal: DataFrame, clusters: DataFrame, samples: list[str], dis: int = 50) -> DataFrame:
    """Per sample and consensus range: the span of the tag clusters whose dominant site lies in it, re-measured."""
    ranges = consensus_ranges(clusters, samples, dis).select(F.col("cluster").alias("consensus"), *KEYS, F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    own = clusters.select("sample", *KEYS, "dominant_tss", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    spans = points_in_intervals(own, ranges, KEYS, "dominant_tss", "r_start", "r_end").groupBy("sample", *KEYS, "consensus").agg(F.min("c_start").alias("s_start"), F.max("c_end").alias("s_end"))
    inside = points_in_intervals(signal, spans, ["sample", *KEYS], "pos", "s_start", "s_end")
    keys = ["sample", *KEYS, "consensus"]
    return summarize(spread(inside.select(*keys, "pos", "tags"), keys), keys).withColumnRenamed("consensus", "cluster").select(*CLUSTER)
