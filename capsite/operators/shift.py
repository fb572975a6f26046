"""Core-promoter shift of genes between two samples that share consensus clusters."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from capsite.functions.stats import bh_adjust, chi2_tail_1df, chi2_yates


def shift_statistics(annotated: DataFrame, control: str, treat: str, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(gene, ds, chi2) of genes with two clusters or more and tags in both samples.

    The leading cluster of each sample is taken (the runner-up of control where they agree); the proximal
    one goes first: the highest dominant position on plus, the lowest on minus. scale multiplies the tags of
    control and treat in the chi-square test.
    """
    def side(sample: str, s: str) -> DataFrame:
        own = annotated.filter((F.col("sample") == sample) & F.col("gene").isNotNull())
        return own.select("cluster", "strand", F.col("dominant_tss").alias(f"dom_{s}"), F.col("tags").alias(f"tags_{s}"), F.col("gene").alias(f"gene_{s}"))

    both = side(control, "x").join(side(treat, "y"), ["cluster", "strand"], "full")
    rows = both.select("cluster", "strand", F.coalesce("gene_x", "gene_y").alias("gene"), F.greatest(F.coalesce("dom_x", F.lit(0)), F.coalesce("dom_y", F.lit(0))).alias("dom"), F.coalesce("tags_x", F.lit(0.0)).alias("x"), F.coalesce("tags_y", F.lit(0.0)).alias("y"))
    gene = W.partitionBy("gene")
    by_y = gene.orderBy(F.col("y").desc(), "cluster")
    by_x = gene.orderBy(F.col("x").desc(), F.col("y").desc(), "cluster")
    rows = rows.withColumn("_ry", F.row_number().over(by_y)).withColumn("_rx", F.row_number().over(by_x)).withColumn("_n", F.count(F.lit(1)).over(gene)).withColumn("_sx", F.sum("x").over(gene)).withColumn("_sy", F.sum("y").over(gene))
    same = F.max(F.when(F.col("_ry") == 1, F.col("_rx"))).over(gene) == 1
    rows = rows.withColumn("_same", same).filter((F.col("_n") >= 2) & (F.col("_sx") > 0) & (F.col("_sy") > 0))
    two = rows.filter((F.col("_ry") == 1) | (F.col("_rx") == F.when(F.col("_same"), 2).otherwise(1)))
    near = F.when(F.col("strand") == "+", -F.col("dom")).otherwise(F.col("dom"))
    order = F.struct(near, F.col("_rx"))
    one = two.groupBy("gene").agg(*[f(c, order).alias(f"{c}{k}") for k, f in ((1, F.min_by), (2, F.max_by)) for c in ("x", "y")])
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    ds = F.log2(((y1 + 0.1) / (y2 + 0.1)) / ((x1 + 0.1) / (x2 + 0.1)))
    return one.select("gene", ds.alias("ds"), chi2_yates(x1 * scale[0], y1 * scale[1], x2 * scale[0], y2 * scale[1]).alias("chi2"))


def promoter_shift(annotated: DataFrame, control: str, treat: str, p_value: float = 0.01, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Genes whose leading promoter moves: (comparison, gene, ds, pval, padj), padj <= p_value."""
    stats = shift_statistics(annotated, control, treat, scale).withColumn("pval", chi2_tail_1df("chi2"))
    out = bh_adjust(stats, "pval", "padj").filter(F.col("padj") <= p_value)
    return out.select(F.lit(f"{control}_VS_{treat}").alias("comparison"), "gene", "ds", "pval", "padj")
