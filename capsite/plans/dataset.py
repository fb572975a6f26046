"""An immutable data set: each verb returns a new one.

Raw signal, clusters, consensus clusters and annotation are staged in the shared folder, as later verbs use
them several times; the rest is lazy.
"""
from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from capsite.operators import annotate as an, cluster as cl, consensus as co, enhancer as en, expression as ex, plots as pl, shape as sh, shift as st, signal as sg
from capsite.sources import readers, sinks
from capsite.sources.staging import staged

FILE_TYPES = ("bam", "bamPairedEnd", "bed", "tss", "TSStable", "BigWig")


@dataclass(frozen=True)
class TssDataset:
    """Inputs, sample labels and the frames built from them so far.

    merge_index[i] is the 1-based group of sample i and merged_labels[g - 1] that group's label. genes is a table of
    genes; without one, annotation reads them (or transcripts) from the GFF or GTF file ref_source.
    """

    spark: SparkSession
    files: tuple[str, ...] = ()
    files_type: str = "bed"
    samples: tuple[str, ...] = ()
    merged_labels: tuple[str, ...] = ()
    merge_index: tuple[int, ...] = ()
    genome: DataFrame | None = None
    genes: DataFrame | None = None
    ref_source: str | None = None
    units: str = "counts"
    raw: DataFrame | None = field(default=None, repr=False)
    signal: DataFrame | None = field(default=None, repr=False)
    sizes: DataFrame | None = field(default=None, repr=False)
    clusters: DataFrame | None = field(default=None, repr=False)
    consensus: DataFrame | None = field(default=None, repr=False)
    shape: DataFrame | None = field(default=None, repr=False)
    annotated: DataFrame | None = field(default=None, repr=False)
    filtered: DataFrame | None = field(default=None, repr=False)
    enhancers: DataFrame | None = field(default=None, repr=False)
    de_tables: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict, repr=False)
    tag_tables: DataFrame | None = field(default=None, repr=False)
    shifts: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if self.files_type not in FILE_TYPES:
            raise ValueError(f"files_type must be one of {', '.join(FILE_TYPES)}")
        if self.files and self.files_type != "TSStable" and len(self.files) != len(self.samples):
            raise ValueError("one sample label per input file")
        if self.merge_index and len(self.merge_index) != len(self.samples):
            raise ValueError("one merge index per sample")
        if len(set(self.merge_index)) != len(self.merged_labels):
            raise ValueError("one merged label per merge index")
        if self.merge_index and set(self.merge_index) != set(range(1, len(self.merged_labels) + 1)):
            raise ValueError("merge indexes must be 1 to the number of groups")

    def _need(self, *names: str) -> None:
        for n in names:
            if getattr(self, n) is None:
                raise ValueError(f"{n} is not there yet")

    @property
    def sample_map(self) -> DataFrame:
        rows = [(s, self.merged_labels[g - 1]) for s, g in zip(self.samples, self.merge_index)] or [(s, s) for s in self.samples]
        return self.spark.createDataFrame(rows, "sample string, merged string")

    @property
    def labels(self) -> list[str]:
        return list(self.merged_labels or self.samples)

    def read(self, **options) -> TssDataset:
        """Reads the files; ``options`` go to the alignment filter."""
        for f in self.files:
            if "://" not in f and not os.path.exists(f):
                raise FileNotFoundError(f"input file not found: {f}")
        raw = readers.read_signal(self.spark, list(self.files), self.files_type, list(self.samples), self.genome, **options)
        return self.with_signal(staged(raw, "raw"))

    def with_signal(self, raw: DataFrame) -> TssDataset:
        return replace(self, raw=raw, signal=raw, sizes=sg.library_sizes(raw), units="counts")

    def merge(self) -> TssDataset:
        self._need("raw")
        merged = sg.merge_samples(self.raw, self.sample_map)
        return replace(self, signal=merged, sizes=sg.library_sizes(merged))

    def normalize(self) -> TssDataset:
        self._need("signal")
        if self.units != "counts":
            raise ValueError("the signal is normalised already")
        return replace(self, signal=sg.tpm(self.signal, self.sizes), units="tpm")

    def filter(self, method: str = "poisson", normalization: bool = True, p_value: float = 0.01, tpm_low: float = 0.1) -> TssDataset:
        self._need("signal")
        if method == "poisson":
            if self.units != "counts":
                raise ValueError("the Poisson filter needs raw counts")
            self._need("genome")
            size = self.genome.agg(F.sum("length")).first()[0]
            return replace(self, signal=sg.filter_poisson(self.signal, self.sizes, size, p_value, normalization), units="tpm" if normalization else "counts")
        if method == "TPM":
            if self.units != "tpm":
                raise ValueError("the TPM filter needs a normalised signal")
            return replace(self, signal=sg.filter_tpm(self.signal, tpm_low))
        raise ValueError(f"unknown filter method {method!r}")

    def cluster(self, **options) -> TssDataset:
        self._need("signal")
        return replace(self, clusters=staged(cl.tag_clusters(self.signal, **options), "clusters"))

    def consensus_cluster(self, dis: int = 50) -> TssDataset:
        self._need("signal", "clusters")
        return replace(self, consensus=staged(co.consensus_clusters(self.signal, self.clusters, self.labels, dis), "consensus"))

    def _chosen(self, which: str) -> DataFrame:
        if which not in ("consensusClusters", "tagClusters"):
            raise ValueError(f"unknown clusters {which!r}")
        name = "consensus" if which == "consensusClusters" else "clusters"
        self._need(name)
        return getattr(self, name)

    def shape_cluster(self, clusters: str = "consensusClusters", method: str = "PSS") -> TssDataset:
        return replace(self, shape=sh.shape_scores(self.signal, self._chosen(clusters), method))

    def annotate(self, clusters: str = "consensusClusters", filter_cluster: bool = True, filter_threshold: float = 0.02, annotation_type: str = "genes", **options) -> TssDataset:
        if self.genes is None and self.ref_source is None:
            raise ValueError("a table of genes or a GFF file is needed")
        kept = self
        if self.genes is None:
            feature = {"genes": "gene", "transcripts": "transcript"}.get(annotation_type)
            if feature is None:
                raise ValueError(f"unknown annotation type {annotation_type!r}")
            kept = replace(self, genes=staged(readers.read_genes(self.spark, self.ref_source, feature), "genes"))
        done = staged(an.annotate(self._chosen(clusters), kept.genes, in_coding=filter_cluster, annotation_type=annotation_type, **options), "annotated")
        return replace(kept, annotated=done, filtered=an.filter_downstream(done, filter_threshold) if filter_cluster else None)

    def call_enhancers(self, flanking: int = 400, dis2gene: int = 2000) -> TssDataset:
        self._need("annotated")
        return replace(self, enhancers=en.call_enhancers(self.annotated, flanking, dis2gene))

    def de(self, compare_pairs: tuple[tuple[str, str], ...] = (("control", "treat"),), p_value: float = 0.01) -> TssDataset:
        """de_tables maps "one_VS_two" to all genes and to the significant ones; tag_tables holds raw tags by cluster and replicate."""
        self._need("annotated", "raw")
        tables, counts = {}, staged(ex.cluster_counts(self.raw, self.annotated, self.sample_map), "tags")
        for control, treat in compare_pairs:
            groups = {g: [s for s, i in zip(self.samples, self.merge_index) if self.merged_labels[i - 1] == g] for g in (control, treat)}
            table = staged(ex.de_genes(ex.gene_counts(counts.filter(F.col("merged").isin(control, treat))), groups, control, treat), "de")
            tables[f"{control}_VS_{treat}"] = (table, ex.significant(table, p_value))
        return replace(self, de_tables=tables, tag_tables=counts)

    def shift(self, compare_pairs: tuple[tuple[str, str], ...] = (("control", "treat"),), p_value: float = 0.01, use_raw_count: bool = False) -> TssDataset:
        """shifts maps "one_VS_two" to the genes whose leading promoter moves. With use_raw_count TPM are tested as tags."""
        self._need("annotated", "consensus")
        sizes = {r["sample"]: r["library_size"] for r in self.sizes.collect()} if use_raw_count else {}
        scale = lambda s: sizes[s] / 1e6 if use_raw_count else 1.0
        return replace(self, shifts={f"{c}_VS_{t}": st.promoter_shift(self.annotated, c, t, p_value, (scale(c), scale(t))) for c, t in compare_pairs})

    def export_tss_table(self, folder: str, data: str = "raw", merged: bool = True) -> str:
        self._need("raw", "signal")
        return sinks.export_tss_table(self.raw, self.signal, list(self.samples), self.labels, folder, data, merged)

    def export_clusters_table(self, folder: str, data: str = "assigned") -> list[str]:
        """data: tagClusters, consensusClusters, assigned, unassigned or filtered."""
        return sinks.export_clusters_table(self._clusters_of(data), self.labels, folder, data if data.endswith("Clusters") else f"{data}Clusters")

    def _clusters_of(self, data: str) -> DataFrame:
        if data in ("tagClusters", "consensusClusters"):
            return self._chosen(data)
        if data not in ("assigned", "unassigned", "filtered"):
            raise ValueError(f"unknown clusters {data!r}")
        self._need("filtered" if data == "filtered" else "annotated")
        return {"assigned": lambda: an.assigned(self.annotated), "unassigned": lambda: an.unassigned(self.annotated), "filtered": lambda: self.filtered}[data]()

    def export_clusters_bed(self, folder: str, data: str = "consensusClusters") -> list[str]:
        return sinks.export_bed(self._clusters_of(data), self.labels, folder, data)

    def export_bedgraph(self, folder: str, data: str = "processed", file_format: str = "bedGraph", one_file: bool = False) -> list[str]:
        """data: raw or processed; file_format: bedGraph or BigWig (which needs the genome)."""
        if data not in ("raw", "processed"):
            raise ValueError(f"unknown data {data!r}")
        frame, samples = (self.raw, list(self.samples)) if data == "raw" else (self.signal, self.labels)
        if file_format == "bedGraph":
            return sinks.export_bedgraph(frame, samples, folder, data, one_file)
        if file_format != "BigWig":
            raise ValueError(f"unknown format {file_format!r}")
        self._need("genome")
        return sinks.export_bigwig(frame, self.genome, samples, folder, data)

    def export_shape_table(self, folder: str) -> list[str]:
        self._need("shape")
        return sinks.export_shape_table(self.shape, self.labels, folder)

    def export_enhancer_table(self, folder: str) -> list[str]:
        self._need("enhancers")
        return sinks.export_enhancer_table(self.enhancers, self.labels, folder)

    def export_de_table(self, folder: str, data: str = "sig") -> list[str]:
        if data not in ("sig", "all"):
            raise ValueError(f"unknown data {data!r}")
        return [x for name, tables in self.de_tables.items() for x in sinks.export_de_table(tables[0 if data == "all" else 1], [name], folder, data, None)]

    def export_shift_table(self, folder: str) -> list[str]:
        return [x for name, table in self.shifts.items() for x in sinks.export_shift_table(table, [name], folder)]

    def plot_correlation(self) -> DataFrame:
        self._need("raw")
        return pl.correlation(self.raw, list(self.samples))

    def plot_pca(self, threshold: float = 10) -> DataFrame:
        """Adds merged, the group that colours a sample."""
        self._need("raw")
        return pl.pca(self.raw, list(self.samples), threshold).join(self.sample_map, "sample")

    def plot_interquantile(self, clusters: str = "consensusClusters", tags_threshold: float = 1) -> DataFrame:
        return pl.interquantile_histogram(self._chosen(clusters), tags_threshold)

    def plot_shape(self) -> DataFrame:
        self._need("shape")
        return pl.shape_histogram(self.shape)

    def plot_de(self) -> dict[str, DataFrame]:
        return {name: pl.volcano(tables[0]) for name, tables in self.de_tables.items()}

    def plot_tss(self, genes: list[str], up: int = 500, down: int = 500, clusters: str = "consensusClusters", both_strands: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
        self._need("genes")
        return pl.locus(self.signal, self._chosen(clusters), self.genes, genes, up, down, both_strands)
