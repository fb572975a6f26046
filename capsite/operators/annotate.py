"""Promoter windows of genes, assignment of clusters to them, and the gene-wise filter of weak downstream clusters."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from capsite.operators.intervals import points_in_intervals

KEYS = ["chr", "strand"]
EDGE = 1000  # stands for a missing neighbour


def promoter_windows(genes: DataFrame, upstream: int = 1000, upstream_overlap: int = 500, downstream: int = 0) -> DataFrame:
    """(gene_id, chr, strand, ordinal, w_start, w_end): the stretch in which a dominant site belongs to the gene.

    genes: (chr, start, end, strand, gene_id). Genes are walked in transcription-neutral order: by start on
    the plus strand, by end on the minus strand; the upstream reach yields to the neighbour.
    """
    plus = F.col("strand") == "+"
    genes = genes.select(*KEYS, F.col("start").cast("bigint"), F.col("end").cast("bigint"), "gene_id")
    w = W.partitionBy(*KEYS).orderBy(F.when(plus, F.col("start")).otherwise(F.col("end")), "start", "gene_id")
    width = F.col("end") - F.col("start") + 1
    df = genes.withColumn("ordinal", F.row_number().over(w).cast("bigint"))
    prev_end, prev_width = F.lag("end").over(w), F.lag(width).over(w)
    next_start, next_width = F.lead("start").over(w), F.lead(width).over(w)
    df = df.withColumn("_dis", F.when(plus, F.col("start") - F.coalesce(prev_end, F.lit(0))).otherwise(F.coalesce(next_start, F.col("end") + EDGE) - F.col("end")))
    df = df.withColumn("_w", F.coalesce(F.when(plus, prev_width).otherwise(next_width), F.lit(EDGE)))
    df = df.withColumn("_gap", F.when(plus, F.coalesce(next_start, F.lit(EDGE)) - F.col("start")).otherwise(F.col("end") - F.coalesce(prev_end, F.lit(EDGE))))
    reach = F.when(F.col("_dis") > upstream, F.lit(upstream)).when(F.col("_dis") + F.col("_w") <= upstream_overlap, F.col("_dis") + F.col("_w") - 1)
    df = df.withColumn("_up", reach.when(F.col("_dis") < upstream_overlap, F.lit(upstream_overlap)).otherwise(F.col("_dis")))
    df = df.withColumn("_theirs", F.coalesce(F.when(plus, F.lead("_up").over(w)).otherwise(F.lag("_up").over(w)), F.lit(EDGE)))
    room = F.lit(downstream) + F.col("_theirs")
    free = F.when(plus, F.col("_gap") > room).otherwise(F.col("_gap") >= room)
    df = df.withColumn("_down", F.when(free, F.lit(downstream)).when(F.col("_gap") < F.col("_theirs"), F.lit(0)).otherwise(F.col("_gap") - F.col("_theirs")))
    first = F.when(plus, F.col("start") - F.col("_up") + 1).otherwise(F.col("end") - F.col("_down"))
    last = F.when(plus, F.col("start") + F.col("_down")).otherwise(F.col("end") + F.col("_up") - 1)
    return df.select("gene_id", *KEYS, "ordinal", first.cast("bigint").alias("w_start"), last.cast("bigint").alias("w_end"))


def _first_hit(clusters: DataFrame, spans: DataFrame, out: str) -> DataFrame:
    hit = points_in_intervals(clusters.select("sample", "cluster", *KEYS, "dominant_tss"), spans.filter(F.col("w_start") <= F.col("w_end")), KEYS, "dominant_tss", "w_start", "w_end")
    return hit.groupBy("sample", "cluster").agg(F.min_by("gene_id", "ordinal").alias(out))


def annotate(clusters: DataFrame, genes: DataFrame, upstream: int = 1000, upstream_overlap: int = 500, downstream: int = 0, annotation_type: str = "genes", in_coding: bool = True) -> DataFrame:
    """Adds gene (first promoter window that holds the dominant site) and in_coding (first gene body that does).

    Clusters that nothing holds keep null; a sample or strand without any hit loses no rows.
    """
    if annotation_type not in ("genes", "transcripts"):
        raise ValueError(f"unknown annotation type {annotation_type!r}")
    gene = _first_hit(clusters, promoter_windows(genes, upstream, upstream_overlap, downstream), "gene")
    out = clusters.join(gene, ["sample", "cluster"], "left")
    if not in_coding:
        return out.withColumn("in_coding", F.lit(None).cast("string"))
    by_start = F.row_number().over(W.partitionBy(*KEYS).orderBy("start", "end", "gene_id"))
    bodies = genes.select("gene_id", *KEYS, by_start.alias("ordinal"), F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    return out.join(_first_hit(clusters, bodies, "in_coding"), ["sample", "cluster"], "left")


def assigned(annotated: DataFrame) -> DataFrame:
    return annotated.filter(F.col("gene").isNotNull())


def unassigned(annotated: DataFrame) -> DataFrame:
    return annotated.filter(F.col("gene").isNull())


def filter_downstream(annotated: DataFrame, threshold: float = 0.02) -> DataFrame:
    """Drops clusters downstream of their gene's strongest one that hold less than threshold of its tags.

    Clusters without gene and gene body pass; in_coding is cleared where a gene is known.
    """
    named = annotated.withColumn("in_coding", F.when(F.col("gene").isNull(), F.col("in_coding"))).withColumn("_r", F.coalesce("gene", "in_coding"))
    w = W.partitionBy("sample", "_r")
    top = F.max("tags").over(w)
    lead = F.max_by("dominant_tss", F.struct(F.col("tags"), -F.col("cluster"))).over(w)
    past = F.when(F.col("strand") == "+", F.col("dominant_tss") > lead).otherwise(F.col("dominant_tss") < lead)
    marked = named.withColumn("_weak", F.col("_r").isNotNull() & past & (F.col("tags") < top * threshold))
    return marked.filter(~F.col("_weak")).drop("_r", "_weak")
