"""Statistics that Spark SQL lacks: Poisson cutoff, chi-square tail, Benjamini-Hochberg, histogram bins."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType


def poisson_cutoff(lam: float, p_value: float) -> int:
    """Smallest x with P(X > x) <= p_value for X ~ Poisson(lam)."""
    if not 0 < p_value < 1:
        raise ValueError("p_value must lie in (0, 1)")
    if lam < 0:
        raise ValueError("lambda must not be negative")
    x, log_term, cdf = 0, -lam, math.exp(-lam)
    while cdf < 1 - p_value:
        x += 1
        log_term += math.log(lam) - math.log(x)
        cdf += math.exp(log_term)
        if x > lam + 1000 * math.sqrt(lam + 1):
            break
    return x


def chi2_yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Yates-corrected chi-square statistic of the table [[a, b], [c, d]]; null when a margin is zero."""
    n = a + b + c + d
    cells = [(a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)]
    diffs = [F.abs(o - r * k / n) for o, r, k in cells]
    yates = F.least(F.lit(0.5), *diffs)
    total = sum((F.pow(x - yates, 2) / (r * k / n) for x, (_, r, k) in zip(diffs[1:], cells[1:])), F.pow(diffs[0] - yates, 2) / (cells[0][1] * cells[0][2] / n))
    proper = (a + b > 0) & (c + d > 0) & (a + c > 0) & (b + d > 0)
    return F.when(proper, total)


@F.pandas_udf(DoubleType())
def chi2_tail_1df(x: pd.Series) -> pd.Series:
    """P(chi-square with one degree of freedom > x)."""
    return x.map(lambda v: None if pd.isna(v) else math.erfc(math.sqrt(v / 2)))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """Two-sided tail of the standard normal."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


def bh_adjust(df: DataFrame, p: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Benjamini-Hochberg adjusted p within ``by``; null p stays null and is not counted.

    One row per gene and comparison reaches this window, so a partition holds a few tens of thousand rows.
    """
    has = F.col(p).isNotNull()
    keys = [F.col(k) for k in by] + [has]
    up = W.partitionBy(*keys).orderBy(p)
    n = F.count(F.lit(1)).over(W.partitionBy(*keys))
    last_rank = F.rank().over(up) + F.count(F.lit(1)).over(W.partitionBy(*keys, F.col(p))) - 1
    df = df.withColumn("_ratio", F.when(has, F.col(p) * n / last_rank))
    down = W.partitionBy(*keys).orderBy(F.col(p).desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(out, F.when(has, F.least(F.lit(1.0), F.min("_ratio").over(down)))).drop("_ratio")


def histogram(df: DataFrame, value: str, width: float, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Counts of ``value`` in bins [k * width, (k + 1) * width) per group."""
    bin_id = F.floor(F.col(value) / F.lit(float(width))).cast("bigint")
    return df.groupBy(*by, bin_id.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
