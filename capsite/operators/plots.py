"""The numbers behind the plots; drawing them is left to the caller."""
from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, functions as F

from capsite.functions.stats import histogram
from capsite.operators.signal import wide


def correlation(raw: DataFrame, samples: list[str]) -> DataFrame:
    """Pearson correlation of every pair of samples over the union of sites, zeros included, to two decimals.

    One row of sums per pair comes out of a single aggregation of the matrix.
    """
    pairs = list(itertools.combinations(range(len(samples)), 2))
    if not pairs:
        raise ValueError("two samples at least")
    m = wide(raw, samples)
    row = m.agg(*[F.corr(samples[i], samples[j]).alias(f"c{i}_{j}") for i, j in pairs])
    entries = F.array(*[F.struct(F.lit(samples[i]).alias("sample_a"), F.lit(samples[j]).alias("sample_b"), F.round(F.col(f"c{i}_{j}"), 2).alias("pearson")) for i, j in pairs])
    return row.select(F.inline(entries))


def pca(raw: DataFrame, samples: list[str], threshold: float = 10) -> DataFrame:
    """First two principal components of the samples over sites where any reaches the threshold.

    The sample-by-sample Gram matrix is summed in Spark; its eigenvectors, as small as the number of
    samples, are found on the driver. Signs are fixed so that each component's largest loading is positive.
    """
    m = wide(raw, samples).filter(F.greatest(*[F.col(s) for s in samples], F.lit(float("-inf"))) >= threshold)
    center = sum((F.col(s) for s in samples[1:]), F.col(samples[0])) / len(samples)
    c = m.select(*[(F.col(s) - center).alias(s) for s in samples])
    n = len(samples)
    sums = c.agg(*[F.sum(F.col(samples[i]) * F.col(samples[j])).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    values, vectors = np.linalg.eigh(gram)
    scores = vectors[:, ::-1][:, :2] * np.sqrt(np.maximum(values[::-1][:2], 0))
    scores *= np.where(scores[np.abs(scores).argmax(0), range(scores.shape[1])] < 0, -1, 1)
    return raw.sparkSession.createDataFrame([(s, float(a), float(b)) for s, (a, b) in zip(samples, scores)], "sample string, pc1 double, pc2 double")


def interquantile_histogram(clusters: DataFrame, tags_threshold: float = 1, most: int = 200, width: int = 5) -> DataFrame:
    return histogram(clusters.filter((F.col("tags") >= tags_threshold) & (F.col("interquantile_width") <= most)), "interquantile_width", width)


def shape_histogram(scored: DataFrame, width: float = 0.5) -> DataFrame:
    return histogram(scored, "shape_score", width)


def volcano(de: DataFrame) -> DataFrame:
    """(gene, log2_fold_change, neg_log10_p, class): both, significant, changed or none."""
    sig, big = F.coalesce(F.col("padj") < 0.05, F.lit(False)), F.abs("log2_fold_change") > 1
    kind = F.when(sig & big, "both").when(sig, "significant").when(big, "changed").otherwise("none")
    return de.select("comparison", "gene", "log2_fold_change", (-F.log10("pvalue")).alias("neg_log10_p"), kind.alias("class"))


def locus(signal: DataFrame, clusters: DataFrame, genes: DataFrame, names: list[str], up: int = 500, down: int = 500, both_strands: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, sites, clusters) around named genes; tags of the minus strand are negated."""
    plus = F.col("strand") == "+"
    win = genes.filter(F.col("gene_id").isin(names)).select("gene_id", "chr", F.col("strand").alias("gene_strand"), F.when(plus, F.col("start") - up).otherwise(F.col("start") - down).alias("w_start"), F.when(plus, F.col("end") + down).otherwise(F.col("end") + up).alias("w_end"))
    on = lambda df, a, b: df.join(F.broadcast(win) if len(names) <= 10_000 else win, "chr").filter((F.col(a) >= F.col("w_start")) & (F.col(b) <= F.col("w_end")) & (F.lit(both_strands) | (F.col("strand") == F.col("gene_strand"))))
    sites = on(signal, "pos", "pos").select("gene_id", "sample", "chr", "pos", "strand", F.when(F.col("strand") == "-", -F.col("tags")).otherwise(F.col("tags")).alias("tags"))
    shown = on(clusters, "q_0_1", "q_0_9").select("gene_id", *clusters.columns)
    return win, sites, shown
