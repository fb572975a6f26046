"""Tables, tracks and BED files under their published names, written by Spark and joined part by part."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from capsite.operators.signal import wide

DOTTED = {"tags_dominant_tss": "tags.dominant_tss", "q_0_1": "q_0.1", "q_0_9": "q_0.9", "shape_score": "shape.score", "in_coding": "inCoding", "cluster_m": "cluster.m", "cluster_p": "cluster.p", "dominant_tss_m": "dominant_tss.m", "dominant_tss_p": "dominant_tss.p", "tags_m": "tags.m", "tags_p": "tags.p", "d": "D", "base_mean": "baseMean", "log2_fold_change": "log2FoldChange", "lfc_se": "lfcSE", "ds": "Ds"}
CLUSTER_KINDS = ("tagClusters", "consensusClusters", "assignedClusters", "unassignedClusters", "filteredClusters")


def _joined(df: DataFrame, path: str, write) -> str:
    """Writes df by ``write(writer, folder)`` and joins the parts, in order, to one file; any store that Spark reaches."""
    spark = df.sparkSession
    parts = f"{path}.parts"
    write(df.write.mode("overwrite"), parts)
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    found = sorted((x.getPath() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")), key=lambda x: x.getName())
    if fs.exists(target):
        fs.delete(target, True)
    out = fs.create(target, True)
    try:
        for part in found:
            source = fs.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            finally:
                source.close()
    finally:
        out.close()
    fs.delete(folder, True)
    return path


def _tsv(df: DataFrame, path: str, order: list[str]) -> None:
    """One header line and tab-separated text; reports are small beside the reads they sum up."""
    rows = df.orderBy(*order).select(*[F.col(c).alias(DOTTED.get(c, c)) for c in df.columns]).coalesce(1)
    _joined(rows, path, lambda w, folder: w.option("header", True).option("sep", "\t").option("nullValue", "NA").option("quote", "").csv(folder))


def export_tss_table(raw: DataFrame, processed: DataFrame, samples: list[str], merged: list[str], folder: str, data: str = "raw", use_merged: bool = True) -> str:
    """The matrix; raw with use_merged writes the processed one, as merged raw counts are kept there."""
    if data not in ("raw", "processed"):
        raise ValueError(f"unknown data {data!r}")
    frame, names = (raw, samples) if data == "raw" and not use_merged else (processed, merged)
    path = f"{folder}/ALL.samples.TSS.{data}.txt"
    _tsv(wide(frame, names), path, ["strand", "chr", "pos"])
    return path


def export_clusters_table(clusters: DataFrame, samples: list[str], folder: str, kind: str) -> list[str]:
    if kind not in CLUSTER_KINDS:
        raise ValueError(f"unknown clusters {kind!r}")
    return _per_sample(clusters, samples, folder, f"{kind}.txt", ["cluster"])


def _per_sample(df: DataFrame, samples: list[str], folder: str, suffix: str, order: list[str], by: str = "sample") -> list[str]:
    paths = [f"{folder}/{s}.{suffix}" for s in samples]
    for s, p in zip(samples, paths):
        _tsv(df.filter(F.col(by) == s).drop(by), p, order)
    return paths


def export_shape_table(shape: DataFrame, samples: list[str], folder: str) -> list[str]:
    return _per_sample(shape.drop("method"), samples, folder, "promoter.shape.txt", ["cluster"])


def export_enhancer_table(enhancers: DataFrame, samples: list[str], folder: str) -> list[str]:
    return _per_sample(enhancers, samples, folder, "enhancers.txt", ["chr", "enhancer"])


def export_de_table(de: DataFrame, comparisons: list[str], folder: str, data: str = "sig", p_value: float | None = 0.01) -> list[str]:
    if data not in ("sig", "all"):
        raise ValueError(f"unknown data {data!r}")
    rows = de.filter(F.col("padj") < p_value) if data == "sig" and p_value is not None else de
    return _per_sample(rows, comparisons, folder, f"DE.table.{'sig' if data == 'sig' else 'aLL'}.txt", ["padj"], "comparison")


def export_shift_table(shift: DataFrame, comparisons: list[str], folder: str) -> list[str]:
    return _per_sample(shift, comparisons, folder, "promoter.shift.table.txt", ["padj"], "comparison")


def bedgraph(signal: DataFrame) -> DataFrame:
    """(sample, chr, start0, end, score), minus scores negated."""
    return signal.select("sample", "chr", (F.col("pos") - 1).alias("start0"), F.col("pos").alias("end"), F.when(F.col("strand") == "+", F.col("tags")).otherwise(-F.col("tags")).alias("score"))


def export_bedgraph(signal: DataFrame, samples: list[str], folder: str, data: str = "processed", one_file: bool = False) -> list[str]:
    """Tracks per sample, split by strand unless one_file; lines are sorted by all tasks."""
    paths = []
    for s in samples:
        rows = bedgraph(signal.filter(F.col("sample") == s)).drop("sample")
        for name, keep in ([("", F.lit(True))] if one_file else [("plus.", F.col("score") > 0), ("minus.", F.col("score") < 0)]):
            paths.append(f"{folder}/{s}.TSS.{data}.{name}bedGraph")
            _joined(rows.filter(keep).orderBy("chr", "start0"), paths[-1], lambda w, folder: w.option("sep", "\t").csv(folder))
    return paths


def export_bigwig(signal: DataFrame, genome: DataFrame, samples: list[str], folder: str, data: str = "processed") -> list[str]:
    """Plus and minus BigWig tracks per sample.

    Tasks sort a track and pack its sections; one writer, which the format needs, receives packed sections in
    order, a partition at a time, and keeps an index entry of each.
    """
    from capsite.sources.binary import packed_sections, write_bigwig

    lengths = [(r["chr"], r["length"]) for r in genome.collect()]
    paths = []
    for s in samples:
        for name, strand in (("plus", "+"), ("minus", "-")):
            rows = bedgraph(signal.filter((F.col("sample") == s) & (F.col("strand") == strand))).orderBy("chr", "start0")
            paths.append(f"{folder}/{s}.TSS.{data}.{name}.BigWig")
            write_bigwig(paths[-1], lengths, (tuple(r) for r in packed_sections(rows, lengths).toLocalIterator()))
    return paths


def bed12(clusters: DataFrame, single_block_plus_one: bool = True) -> DataFrame:
    """BED12 rows: whiskers to the extent, a block over the interquantile range."""
    lo, hi, q1, q9 = F.col("start"), F.col("end"), F.col("q_0_1"), F.col("q_0_9")
    width = (q9 - q1 + 1).cast("string")
    left, right = lo < q1, q9 < hi
    n = 1 + F.when(left, 1).otherwise(0) + F.when(right, 1).otherwise(0)
    alone = (hi - lo + (1 if single_block_plus_one else 0)).cast("string")
    sizes = F.when(left & right, F.concat(F.lit("1,"), width, F.lit(",1"))).when(left, F.concat(F.lit("1,"), width)).when(right, F.concat(width, F.lit(",1"))).otherwise(alone)
    q_at, end_at = (q1 - lo).cast("string"), (hi - lo).cast("string")
    starts = F.when(left & right, F.concat(F.lit("0,"), q_at, F.lit(","), end_at)).when(left, F.concat(F.lit("0,"), q_at)).when(right, F.concat(F.lit("0,"), end_at)).otherwise(F.lit("0"))
    return clusters.select("sample", "chr", (lo - 1).alias("chrom_start"), hi.alias("chrom_end"), F.lit(".").alias("name"), F.lit(0).alias("score"), "strand", (F.col("dominant_tss") - 1).alias("thick_start"), F.col("dominant_tss").alias("thick_end"), F.lit(0).alias("item_rgb"), n.cast("int").alias("block_count"), sizes.alias("block_sizes"), starts.alias("block_starts"))


def export_bed(clusters: DataFrame, samples: list[str], folder: str, kind: str) -> list[str]:
    """A track line, then BED12 lines by position."""
    paths = []
    for s in samples:
        rows = bed12(clusters.filter(F.col("sample") == s)).drop("sample")
        label = f"{s}({kind}(TC) q0.1-q0.9)"
        track = f'track name="{label}" description="{label}" visibility="pack" color=0,255,255'
        head = clusters.sparkSession.createDataFrame([("", -1, track)], "chr string, chrom_start bigint, value string")
        body = rows.select("chr", "chrom_start", F.concat_ws("\t", *rows.columns).alias("value"))
        paths.append(f"{folder}/{s}.{kind}.bed")
        _joined(head.unionByName(body).orderBy("chr", "chrom_start").select("value"), paths[-1], lambda w, folder: w.text(folder))
    return paths
