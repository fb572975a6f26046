"""One query per operator over the TSS-shaped view of the driver's tables (lineitem as reads, part as genes)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from capsite.functions.stats import bh_adjust
from capsite.operators import annotate as an, cluster as cl, consensus as co, enhancer as en, expression as ex, plots as pl, shape as sh, shift as st, signal as sg
from capsite.sources import sinks
from capsite.sources.staging import staged

SAMPLES, MERGED = ["S0", "S1", "S2", "S3"], ["control", "treat"]
CHROMOSOMES = [f"chr{a}{b}" for a in "ANR" for b in "FO"]
CHROM_LENGTH = 200_000
ANNOTATION = {"upstream": 1500, "upstream_overlap": 500, "downstream": 0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, without a negative zero."""
    return df.select(*[(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


class View:
    """The frames that the branches of one query share, from one data directory.

    Clusters, consensus and annotation feed several branches each and are staged once per query; they hold a
    row per promoter and sample.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    def _once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = staged(build(), name)
        return self.made[name]

    def raw(self) -> DataFrame:
        k, p = F.col("l_suppkey"), F.col("l_partkey")
        line = F.col("l_linenumber").cast("bigint")
        leaning = (p % 2 == 1) & (k % 8 < 6)
        ends = _table(self.spark, self.dir, "lineitem").select(
            F.concat(F.lit("S"), F.when(leaning, k % 2).otherwise(k % 4).cast("string")).alias("sample"),
            F.concat(F.lit("chr"), "l_returnflag", "l_linestatus").alias("chr"),
            (1000 * (p % 200) + line * line + k % 13 + 1).cast("bigint").alias("pos"),
            F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        )
        return sg.count_ends(ends)

    def sample_map(self) -> DataFrame:
        return self.spark.createDataFrame([("S0", "control"), ("S1", "control"), ("S2", "treat"), ("S3", "treat")], "sample string, merged string")

    def merged(self) -> DataFrame:
        return self._once("merged", lambda: sg.merge_samples(self.raw(), self.sample_map()))

    def sizes(self) -> DataFrame:
        return sg.library_sizes(self.merged())

    def genes(self) -> DataFrame:
        b = F.col("p_partkey")
        wd = F.when(b % 2 == 0, 1000).otherwise(600)
        plus = F.col("strand") == "+"
        part = _table(self.spark, self.dir, "part").filter((b >= 1) & (b <= 199) & (b % 3 == 0)).select("p_partkey")
        crossed = part.withColumn("chr", F.explode(F.array(*map(F.lit, CHROMOSOMES)))).withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
        return crossed.select("chr", F.when(plus, 1000 * b + 300).otherwise(1000 * b - 300 - wd).cast("bigint").alias("start"), F.when(plus, 1000 * b + 300 + wd).otherwise(1000 * b - 300).cast("bigint").alias("end"), "strand", F.concat(F.lit("G"), b.cast("string"), F.lit("_"), "chr", "strand").alias("gene_id"))

    def clusters(self) -> DataFrame:
        return self._once("clusters", lambda: cl.tag_clusters(self.merged()))

    def consensus(self) -> DataFrame:
        return self._once("consensus", lambda: co.consensus_clusters(self.merged(), self.clusters(), MERGED))

    def annotated(self) -> DataFrame:
        return self._once("annotated", lambda: an.annotate(self.consensus(), self.genes(), **ANNOTATION))

    def cluster_counts(self) -> DataFrame:
        return ex.cluster_counts(self.raw(), self.annotated(), self.sample_map())

    def gene_counts(self) -> DataFrame:
        return ex.gene_counts(self.cluster_counts())

    def de(self) -> DataFrame:
        return ex.de_genes(self.gene_counts(), {"control": ["S0", "S1"], "treat": ["S2", "S3"]}, "control", "treat")

    def given_p(self) -> DataFrame:
        return _table(self.spark, self.dir, "customer").select("c_custkey", ((F.col("c_custkey") * 7919 % 10007 + 1) / F.lit(10008.0)).alias("p"))

    def given_de(self) -> DataFrame:
        """A table as de() gives it, made of customers by arithmetic alone, so that SQL can follow."""
        k = F.col("c_custkey")
        table = self.given_p().select(k.cast("string").alias("gene"), F.lit("control_VS_treat").alias("comparison"), ((k * 31 % 97 - 48) / F.lit(12.0)).alias("log2_fold_change"), (F.col("p") * F.col("p")).alias("pvalue"))
        return bh_adjust(table, "pvalue", "padj")


SITE_ORDER = ["sample", "chr", "pos", "strand", "tags"]
BUILD: dict[str, Callable[[View], DataFrame]] = {
    "tss_counts": lambda v: v.raw(),
    "tss_wide_pivot": lambda v: sg.wide(v.raw(), SAMPLES),
    "library_sizes": lambda v: v.sizes(),
    "merge_samples": lambda v: v.merged(),
    "normalize_tpm": lambda v: sg.tpm(v.merged(), v.sizes()),
    "filter_poisson": lambda v: sg.filter_poisson(v.merged(), v.sizes(), CHROM_LENGTH * len(CHROMOSOMES)),
    "filter_tpm": lambda v: sg.filter_tpm(sg.tpm(v.merged(), v.sizes()), 60.0),
    "peaks": lambda v: cl.mark_peaks(cl.blocks(v.merged(), 101)).filter("is_peak").select(*SITE_ORDER),
    "local_filter": lambda v: cl.mark_local_noise(cl.mark_peaks(cl.blocks(v.merged(), 101)), 100, 0.2).filter("kept").select(*SITE_ORDER),
    "tag_clusters": lambda v: cl.tag_clusters(v.merged()),
    "cluster_quantiles": lambda v: v.clusters().select("sample", "cluster", "q_0_1", "q_0_9", "interquantile_width"),
    "consensus_ranges": lambda v: co.consensus_ranges(v.clusters(), MERGED),
    "consensus_clusters": lambda v: v.consensus(),
    "shape_pss": lambda v: sh.shape_scores(v.merged(), v.consensus(), "PSS").select("sample", "cluster", "shape_score"),
    "shape_si": lambda v: sh.shape_scores(v.merged(), v.consensus(), "SI").select("sample", "cluster", "shape_score"),
    "promoter_windows": lambda v: an.promoter_windows(v.genes(), **ANNOTATION),
    "annotate_assigned": lambda v: an.assigned(v.annotated()),
    "annotate_unassigned": lambda v: an.unassigned(v.annotated()),
    "annotate_in_coding": lambda v: v.annotated().filter("in_coding IS NOT NULL").select("sample", "cluster", "in_coding"),
    "annotate_filtered": lambda v: an.filter_downstream(v.annotated(), 0.5),
    "enhancers": lambda v: en.call_enhancers(v.annotated(), 400, 400),
    "cluster_tag_counts": lambda v: v.cluster_counts(),
    "gene_tag_counts": lambda v: v.gene_counts(),
    "size_factors": lambda v: ex.size_factors(v.gene_counts(), len(SAMPLES)),
    "shift_ds": lambda v: st.shift_statistics(v.annotated(), *MERGED).select("gene", "ds"),
    "shift_chi2_stat": lambda v: st.shift_statistics(v.annotated(), *MERGED).select("gene", "chi2"),
    "shift_padj": lambda v: st.promoter_shift(v.annotated(), *MERGED),
    "bh_adjust": lambda v: bh_adjust(v.given_p(), "p", "padj"),
    "correlation": lambda v: pl.correlation(v.raw(), SAMPLES),
    "pca": lambda v: pl.pca(v.raw(), SAMPLES, 2),
    "interquantile_hist": lambda v: pl.interquantile_histogram(v.consensus()),
    "shape_hist": lambda v: pl.shape_histogram(sh.shape_scores(v.merged(), v.consensus(), "PSS")),
    "volcano_classes": lambda v: pl.volcano(v.given_de()),
    "bed12": lambda v: sinks.bed12(v.consensus()),
    "bedgraph": lambda v: sinks.bedgraph(v.merged()),
    "locus_sites": lambda v: pl.locus(v.merged(), v.clusters(), v.genes(), [f"G30_{c}+" for c in CHROMOSOMES])[1],
    "de_genes": lambda v: v.de(),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(cl.tag_clusters(View(spark, sf_dir).merged()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda s, d, f=f: tidy(f(View(s, d)))) for name, f in BUILD.items()}
