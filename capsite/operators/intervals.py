"""Interval algebra on 1-based closed (chr, start, end, strand) columns: binned range joins and interval union."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BIN = 10_000


def _bin(c: Column, size: int) -> Column:
    return F.floor(c / F.lit(size)).cast("bigint")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str = "pos", start: str = "start", end: str = "end", bin_size: int = BIN) -> DataFrame:
    """Inner join of points to the intervals that hold them.

    An interval is listed under each bin it touches and a point under the only one it lies in, so the
    join is an equi-join on keys and bin and yields no pair twice. Columns other than keys must differ.
    """
    p = points.withColumn("_bin", _bin(F.col(pos), bin_size))
    i = intervals.withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), bin_size), _bin(F.col(end), bin_size))))
    return p.join(i, [*keys, "_bin"]).filter((F.col(pos) >= F.col(start)) & (F.col(pos) <= F.col(end))).drop("_bin")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], bin_size: int = BIN) -> DataFrame:
    """Pairs of left (start, end) and right (start_r, end_r) that share a base; each pair once."""
    a = left.withColumn("_bin", F.explode(F.sequence(_bin(F.col("start"), bin_size), _bin(F.col("end"), bin_size))))
    b = right.withColumn("_bin", F.explode(F.sequence(_bin(F.col("start_r"), bin_size), _bin(F.col("end_r"), bin_size))))
    met = (F.col("start") <= F.col("end_r")) & (F.col("start_r") <= F.col("end"))
    first = F.col("_bin") == F.greatest(_bin(F.col("start"), bin_size), _bin(F.col("start_r"), bin_size))
    return a.join(b, [*keys, "_bin"]).filter(met & first).drop("_bin")


def merge_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Union of intervals per key; overlapping and adjacent intervals become one."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("start") > before + 1), 1).otherwise(0)
    islands = df.select(*keys, "start", "end", opens.alias("_open")).withColumn("_island", F.sum("_open").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
