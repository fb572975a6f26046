"""Peak clustering of a signal, as window functions that share one exchange on (sample, chr, strand, block).

A block is a stretch of sites without a gap that no rule of the clustering reaches over, so blocks are
independent and their number grows with the genome and the sites, not with samples and chromosomes only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

AXIS = ["sample", "chr", "strand"]
CLUSTER = ["sample", "cluster", "chr", "start", "end", "strand", "dominant_tss", "tags", "tags_dominant_tss", "q_0_1", "q_0_9", "interquantile_width"]


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Dealt to as many tasks as shuffles have: sites are few bytes but much work, so they are not to be coalesced by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def blocks(signal: DataFrame, reach: int) -> DataFrame:
    """Adds block, the number of the stretch of sites without a gap of ``reach`` bases or more, and last_block of its axis.

    One linear pass over each axis, which holds at most a site per base; all further windows run by block.
    """
    along = W.partitionBy(*AXIS).orderBy("pos")
    gap = spread(signal, AXIS).withColumn("_gap", (F.col("pos") - F.lag("pos").over(along) >= reach).cast("bigint"))
    whole = gap.withColumn("block", F.coalesce(F.sum("_gap").over(along.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))).withColumn("last_block", F.coalesce(F.sum("_gap").over(W.partitionBy(*AXIS)), F.lit(0)))
    return spread(whole.drop("_gap"), [*AXIS, "block"])


def _apart(df: DataFrame) -> list[str]:
    return [*AXIS, "block"] if "block" in df.columns else AXIS


def mark_peaks(signal: DataFrame, peak_distance: int = 100) -> DataFrame:
    """Adds is_peak: the site is the lowest-positioned maximum among sites nearer than peak_distance."""
    w = W.partitionBy(*_apart(signal)).orderBy("pos")
    before, after = F.max("tags").over(w.rangeBetween(-(peak_distance - 1), -1)), F.max("tags").over(w.rangeBetween(1, peak_distance - 1))
    higher = F.coalesce(before < F.col("tags"), F.lit(True)) & F.coalesce(after <= F.col("tags"), F.lit(True))
    return signal.withColumn("is_peak", higher if peak_distance > 1 else F.lit(True))


def mark_local_noise(marked: DataFrame, peak_distance: int = 100, local_threshold: float = 0.02) -> DataFrame:
    """Adds kept: false for sites weaker than local_threshold times a peak up to peak_distance upstream."""
    downstream = F.when(F.col("strand") == "+", F.col("pos")).otherwise(-F.col("pos"))
    w = W.partitionBy(*_apart(marked)).orderBy(downstream).rangeBetween(-peak_distance, 0)
    upstream = F.max(F.when(F.col("is_peak"), F.col("tags"))).over(w)
    return marked.withColumn("_up", upstream).withColumn("kept", F.col("_up").isNull() | (F.col("tags") >= F.col("_up") * local_threshold)).drop("_up")


def _members(signal: DataFrame, peak_distance: int, extension_distance: int, local_threshold: float) -> DataFrame:
    """Sites inside a cluster, with its number within the block as ``island``."""
    keys = [*AXIS, "block"]
    w = W.partitionBy(*keys).orderBy("pos")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    apart = blocks(signal, max(peak_distance + 1, extension_distance))
    df = mark_local_noise(mark_peaks(apart, peak_distance), peak_distance, local_threshold)
    # The last kept site of an axis joins no cluster unless it is a peak itself. A block's highest peak is
    # always kept (or, with a threshold over 1, no peak is), so that site lies in the last block.
    final = (F.col("block") == F.col("last_block")) & (F.col("pos") == F.max(F.when(F.col("kept"), F.col("pos"))).over(W.partitionBy(*keys)))
    df = df.withColumn("live", F.col("kept") & (F.col("is_peak") | ~final))
    df = df.withColumn("_pos", F.last(F.when(F.col("live"), F.col("pos")), True).over(past)).withColumn("_peak", F.last(F.when(F.col("live"), F.col("is_peak")), True).over(past))
    opens = F.col("live") & (F.col("_pos").isNull() | (F.col("pos") - F.col("_pos") >= extension_distance) | (F.col("is_peak") & F.col("_peak")))
    df = df.withColumn("island", F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    own = W.partitionBy(*keys, "island")
    live_pos = F.when(F.col("live"), F.col("pos"))
    df = df.withColumn("_s", F.min(live_pos).over(own)).withColumn("_e", F.max(live_pos).over(own)).withColumn("_p", F.max(F.when(F.col("live") & F.col("is_peak"), 1)).over(own))
    return df.filter((F.col("_p") == 1) & F.col("pos").between(F.col("_s"), F.col("_e"))).select(*keys, "island", "pos", "tags")


def summarize(members: DataFrame, keys: list[str]) -> DataFrame:
    """Extent, dominant site, tags and 10 % / 90 % positions of each group of sites."""
    up = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys).orderBy(F.col("pos").desc()).rowsBetween(W.unboundedPreceding, 0)
    df = members.withColumn("_up", F.sum("tags").over(up)).withColumn("_down", F.sum("tags").over(down)).withColumn("_all", F.sum("tags").over(W.partitionBy(*keys)))
    tail = F.col("_all") * F.lit(0.1)
    out = df.groupBy(*keys).agg(
        F.min("pos").alias("start"),
        F.max("pos").alias("end"),
        F.max_by("pos", F.struct(F.col("tags"), -F.col("pos"))).alias("dominant_tss"),
        F.sum("tags").alias("tags"),
        F.max("tags").alias("tags_dominant_tss"),
        F.min(F.when(F.col("_up") > tail, F.col("pos"))).alias("q_0_1"),
        F.max(F.when(F.col("_down") > tail, F.col("pos"))).alias("q_0_9"),
    )
    return out.withColumn("interquantile_width", F.col("q_0_9") - F.col("q_0_1") + 1)


def number(df: DataFrame) -> Column:
    """Running cluster number of a sample in (strand, chr, start) order."""
    return F.row_number().over(W.partitionBy("sample").orderBy("strand", "chr", "start")).cast("bigint")


def tag_clusters(signal: DataFrame, method: str = "peakclu", peak_distance: int = 100, extension_distance: int = 30, local_threshold: float = 0.02, cluster_threshold: float = 1.0) -> DataFrame:
    """Clusters around peaks: peaks grow over kept sites while gaps stay below extension_distance.

    Clusters that share sites become one; statistics are over all sites of the extent, kept or not.
    """
    if method != "peakclu":
        raise ValueError(f"unknown clustering method {method!r}")
    if min(peak_distance, extension_distance) < 1:
        raise ValueError("distances must be positive")
    stats = summarize(_members(signal, peak_distance, extension_distance, local_threshold), [*AXIS, "block", "island"])
    stats = stats.filter(F.col("tags") > cluster_threshold)
    return stats.withColumn("cluster", number(stats)).select(*CLUSTER)
