"""Incremental counting: 5'-end counts are additive, so they can be kept by a stream."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SITE = ("sample", "chr", "pos", "strand")


def stream_site_counts(ends: DataFrame) -> DataFrame:
    """Running count per site of a (streaming or batch) frame of 5' ends; use output mode ``update`` or ``complete``."""
    return ends.groupBy(*SITE).agg(F.count(F.lit(1)).cast("double").alias("tags"))
