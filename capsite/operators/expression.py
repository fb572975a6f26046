"""Gene-level differential expression: raw tags per cluster and gene, size factors, negative-binomial Wald test.

The test is a compatible method (median-of-ratios, dispersion trend with shrinkage, Wald), not a bitwise
twin of any other implementation: no independent filtering and no outlier replacement.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from capsite.functions.stats import bh_adjust, normal_two_sided
from capsite.operators.intervals import points_in_intervals


def cluster_counts(raw: DataFrame, annotated: DataFrame, sample_map: DataFrame) -> DataFrame:
    """(merged, cluster, gene, sample, count): raw tags of each replicate of a cluster's own group inside its extent."""
    spans = annotated.filter(F.col("gene").isNotNull()).select(F.col("sample").alias("merged"), "chr", "strand", "cluster", "gene", F.col("start").alias("_s"), F.col("end").alias("_e"))
    sites = raw.join(sample_map.select("sample", "merged"), "sample")
    inside = points_in_intervals(sites, spans, ["merged", "chr", "strand"], "pos", "_s", "_e")
    return inside.groupBy("merged", "cluster", "gene", "sample").agg(F.sum("tags").alias("count"))


def gene_counts(counts: DataFrame) -> DataFrame:
    """(gene, sample, count)."""
    return counts.groupBy("gene", "sample").agg(F.sum("count").alias("count"))


def size_factors(genes: DataFrame, n_samples: int) -> DataFrame:
    """Median over genes seen in every sample of count over the gene's geometric mean."""
    w = W.partitionBy("gene")
    logs = genes.filter(F.col("count") > 0).withColumn("_l", F.log("count")).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_m", F.avg("_l").over(w))
    return logs.filter(F.col("_n") == n_samples).groupBy("sample").agg(F.exp(F.percentile(F.col("_l") - F.col("_m"), 0.5)).alias("size_factor"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling series after shifting the argument to at least 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift -= np.where(low, np.log(np.where(low, x, 1.0)), 0)
        x = np.where(low, x + 1, x)
    i = 1 / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + i * (1 / 12 - i**2 * (1 / 360 - i**2 / 1260))


def _fit(counts: np.ndarray, sizes: np.ndarray, treated: np.ndarray, alpha: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """IRLS of log mu = b0 + b1 * treated + log size for every gene at once; returns mu, b1 and its variance."""
    b0 = np.log(np.maximum(counts[:, ~treated] / sizes[~treated], 0.5).mean(1))
    b1 = np.log(np.maximum(counts[:, treated] / sizes[treated], 0.5).mean(1)) - b0
    t = treated.astype(float)
    ridge = 1e-6
    for _ in range(rounds):
        eta = b0[:, None] + b1[:, None] * t
        mu = np.maximum(np.exp(np.clip(eta, -30, 30)) * sizes, 0.5e-6)
        w = mu / (1 + alpha[:, None] * mu)
        z = eta + (counts - mu) / mu
        s0, s1 = w.sum(1) + ridge, (w * t).sum(1) + ridge
        v0, v1 = (w * z).sum(1), (w * z * t).sum(1)
        det = s0 * s1 - (w * t).sum(1) ** 2
        n0, n1 = (v0 * s1 - v1 * (w * t).sum(1)) / det, (s0 * v1 - (w * t).sum(1) * v0) / det
        done = max(np.abs(n0 - b0).max(initial=0), np.abs(n1 - b1).max(initial=0)) < 1e-8
        b0, b1 = n0, n1
        if done:
            break
    return mu, b1, s0 / det


def _profile(counts: np.ndarray, mu: np.ndarray, treated: np.ndarray, log_alpha: np.ndarray) -> np.ndarray:
    """Cox-Reid adjusted log likelihood per gene at its log_alpha."""
    r = np.exp(-log_alpha)[:, None]
    like = (_log_gamma(counts + r) - _log_gamma(r + np.zeros_like(counts)) + counts * np.log(mu / (mu + r)) + r * np.log(r / (mu + r))).sum(1)
    w = mu / (1 + mu / r)
    t = treated.astype(float)
    det = w.sum(1) * (w * t).sum(1) - (w * t).sum(1) ** 2
    return like - 0.5 * np.log(np.maximum(det, 1e-300))


def _best_alpha(counts: np.ndarray, mu: np.ndarray, treated: np.ndarray, prior: np.ndarray | None = None, width: float = 1.0) -> np.ndarray:
    """Log dispersion of highest (posterior) likelihood, by two nested grids."""
    lo, hi = np.full(len(counts), math.log(1e-8)), np.full(len(counts), math.log(max(10.0, counts.shape[1])))
    best = lo
    for _ in range(3):
        grid = np.linspace(0, 1, 21)
        values = []
        for g in grid:
            a = lo + (hi - lo) * g
            values.append(_profile(counts, mu, treated, a) - (0 if prior is None else (a - prior) ** 2 / (2 * width)))
        k = np.argmax(values, 0)
        step = (hi - lo) / 20
        best = lo + step * k
        lo, hi = best - step, best + step
    return best


def de_genes(genes: DataFrame, groups: dict[str, list[str]], control: str, treat: str) -> DataFrame:
    """Wald test of treat against control per gene: base_mean, log2_fold_change, lfc_se, stat, pvalue, padj.

    genes: (gene, sample, count) of raw counts, absent pairs meaning zero. Gene rows stay distributed; only
    size factors (one per sample) and the dispersion trend (two numbers and a width) go through the driver.
    """
    samples = [*groups[control], *groups[treat]]
    treated = np.array([s in groups[treat] for s in samples])
    if min(treated.sum(), (~treated).sum()) < 1 or len(samples) < 3:
        raise ValueError("both groups need samples, and one of them replicates")
    own = genes.filter(F.col("sample").isin(samples))
    found = {r["sample"]: r["size_factor"] for r in size_factors(own, len(samples)).collect()}
    sizes = np.array([found.get(s) or 1.0 for s in samples])
    rows = own.groupBy("gene").agg(F.map_from_entries(F.collect_list(F.struct("sample", "count"))).alias("_m"))
    rows = rows.select("gene", F.array(*[F.coalesce(F.col("_m")[s], F.lit(0.0)) for s in samples]).alias("k"))

    def gene_wise(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            k = np.stack(pdf["k"].to_numpy()).astype(float)
            q = k / sizes
            mean = np.maximum(q.mean(1), 1e-8)
            rough = np.clip((q.var(1, ddof=1) - mean * (1 / sizes).mean()) / mean**2, 1e-8, 10)
            mu, _, _ = _fit(k, sizes, treated, rough)
            yield pd.DataFrame({"gene": pdf["gene"], "k": pdf["k"], "base_mean": q.mean(1), "la": _best_alpha(k, mu, treated)})

    wise = rows.mapInPandas(gene_wise, "gene string, k array<double>, base_mean double, la double")
    usable = wise.filter((F.col("la") > math.log(1e-7)) & (F.col("base_mean") > 0)).select(F.exp("la").alias("a"), (1 / F.col("base_mean")).alias("x"), "la", "base_mean")
    fit = usable.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("a", "x").alias("s"), F.regr_intercept("a", "x").alias("i"), F.percentile("a", 0.5).alias("m")).first()
    a1, a0 = (max(fit["s"] or 0.0, 0.0), max(fit["i"] or 0.0, 0.01 * (fit["m"] or 0.1))) if fit["n"] else (0.0, 0.1)
    trend = F.log(F.lit(a0) + F.lit(a1) / F.col("base_mean"))
    spread = usable.select(F.abs(F.col("la") - trend).alias("r")).agg(F.percentile("r", 0.5).alias("r")).first()["r"] or 1.0
    df = len(samples) - 2
    width = max((1.4826 * spread) ** 2 - 2.0 / max(df, 1), 0.25)

    def wald(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            k = np.stack(pdf["k"].to_numpy()).astype(float)
            mean = np.maximum(pdf["base_mean"].to_numpy(), 1e-8)
            prior = np.log(a0 + a1 / mean)
            mu, _, _ = _fit(k, sizes, treated, np.exp(prior))
            la = _best_alpha(k, mu, treated, prior, width)
            outlier = pdf["la"].to_numpy() > prior + 2 * math.sqrt(width + 2.0 / max(df, 1))
            _, b1, var = _fit(k, sizes, treated, np.exp(np.where(outlier, pdf["la"], la)))
            se = np.sqrt(np.maximum(var, 1e-300))
            yield pd.DataFrame({"gene": pdf["gene"], "base_mean": pdf["base_mean"], "log2_fold_change": b1 / math.log(2), "lfc_se": se / math.log(2), "stat": b1 / se})

    out = wise.mapInPandas(wald, "gene string, base_mean double, log2_fold_change double, lfc_se double, stat double")
    return bh_adjust(out.withColumn("pvalue", normal_two_sided("stat")), "pvalue", "padj").withColumn("comparison", F.lit(f"{control}_VS_{treat}"))


def significant(de: DataFrame, p_value: float = 0.01) -> DataFrame:
    return de.filter(F.col("padj") < p_value)
