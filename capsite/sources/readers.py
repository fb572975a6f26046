"""Text and binary inputs as signal, gene and genome frames."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from capsite.operators import signal as sg
from capsite.sources.binary import BamSource, BigWigSource


def _bundle(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def read_tss(spark: SparkSession, files: list[str], samples: list[str]) -> DataFrame:
    """Tab-separated (chr, pos, strand, count) with a header, one file per sample."""
    read = spark.read.schema("chr string, pos bigint, strand string, tags double").option("header", True).option("sep", "\t")
    return _bundle([read.csv(f).filter(F.col("tags") > 0).select(F.lit(s).alias("sample"), "chr", "pos", "strand", "tags") for f, s in zip(files, samples)])


def read_tss_table(spark: SparkSession, file: str, samples: list[str]) -> DataFrame:
    """Whitespace-separated matrix (chr, pos, strand, a column per sample) with a header."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(file).filter(F.trim("value") != "").select(parts.alias("p"))
    body = lines.filter(F.try_element_at("p", F.lit(2)).try_cast("bigint").isNotNull())
    matrix = body.select(F.col("p")[0].alias("chr"), F.col("p")[1].cast("bigint").alias("pos"), F.col("p")[2].alias("strand"), *[F.col("p")[3 + i].cast("double").alias(s) for i, s in enumerate(samples)])
    return sg.long(matrix, samples)


def read_bed(spark: SparkSession, files: list[str], samples: list[str], genome: DataFrame | None) -> DataFrame:
    """5' ends of BED intervals inside the genome, counted; rows without a strand are dropped."""
    frames = []
    for f, s in zip(files, samples):
        p = F.split("value", r"\t")
        rows = spark.read.text(f).filter(~F.col("value").rlike(r"^(track|browser|#)") & (F.trim("value") != ""))
        frames.append(rows.select(F.lit(s).alias("sample"), p[0].alias("chr"), (p[1].cast("bigint") + 1).alias("read_start"), p[2].cast("bigint").alias("read_end"), F.try_element_at(p, F.lit(6)).alias("strand")))
    reads = _bundle(frames).filter(F.col("strand").isin("+", "-"))
    if genome is not None:
        reads = reads.join(genome.select("chr", "length"), "chr").filter(F.col("read_end") <= F.col("length"))
    return sg.count_ends(sg.five_prime_ends(reads))


def signed_runs(runs: DataFrame, expand: bool = True) -> DataFrame:
    """Signal of (sample, chr, start0, end, score) runs; the sign of the score is the strand.

    ``expand`` gives every base of a run its score; otherwise a run counts once, at its 5' end.
    """
    plus = F.col("score") > 0
    first, last = F.col("start0") + 1, F.col("end")
    pos = F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))) if expand else F.when(plus, first).otherwise(last).cast("bigint")
    return runs.filter((F.col("score") != 0) & (F.col("end") > F.col("start0"))).select("sample", "chr", pos.alias("pos"), F.when(plus, "+").otherwise("-").alias("strand"), F.abs("score").cast("double").alias("tags"))


def read_bedgraph(spark: SparkSession, files: list[str], samples: list[str], expand: bool = True) -> DataFrame:
    p = F.split("value", r"\s+")
    rows = [spark.read.text(f).filter(~F.col("value").rlike(r"^(track|browser|#)") & (F.trim("value") != "")).select(F.lit(s).alias("sample"), p[0].alias("chr"), p[1].cast("bigint").alias("start0"), p[2].cast("bigint").alias("end"), p[3].cast("double").alias("score")) for f, s in zip(files, samples)]
    return signed_runs(_bundle(rows), expand)


def read_bigwig(spark: SparkSession, files: list[str], samples: list[str], genome: DataFrame | None = None, expand: bool = True) -> DataFrame:
    spark.dataSource.register(BigWigSource)
    runs = spark.read.format("capsite_bigwig").option("paths", "\n".join(files)).option("samples", "\n".join(samples)).load()
    if genome is not None:
        runs = runs.join(genome.select("chr", "length"), "chr").filter(F.col("end") <= F.col("length")).drop("length")
    return signed_runs(runs, expand)


def read_bam(spark: SparkSession, files: list[str], samples: list[str], require_flags: int = 0, exclude_flags: int = 0, mapping_quality: int = 0) -> DataFrame:
    """Alignments as stored, with chr, strand and 1-based pos; flags and mapping quality are looked at before a record is decoded."""
    spark.dataSource.register(BamSource)
    options = {"paths": "\n".join(files), "samples": "\n".join(samples), "requireFlags": require_flags, "excludeFlags": exclude_flags, "minMapq": mapping_quality}
    return spark.read.format("capsite_bam").options(**options).load()


def read_signal(spark: SparkSession, files: list[str], kind: str, samples: list[str], genome: DataFrame | None = None, bases: DataFrame | None = None, **options) -> DataFrame:
    """Raw signal of any supported input type."""
    if kind == "tss":
        return read_tss(spark, files, samples)
    if kind == "TSStable":
        if len(files) != 1:
            raise ValueError("a TSS table is exactly one file")
        return read_tss_table(spark, files[0], samples)
    if kind == "bed":
        return read_bed(spark, files, samples, genome)
    if kind == "BigWig":
        return read_bigwig(spark, files, samples, genome)
    if kind in ("bam", "bamPairedEnd"):
        if genome is None:
            raise ValueError("alignments need a genome")
        paired = kind == "bamPairedEnd"
        stored = read_bam(spark, files, samples, 2 | 64 if paired else 0, 4 if paired else 4 | 512, options.get("mapping_quality", 20))
        reads = sg.filter_alignments(stored, genome, paired_end=paired, **options)
        return sg.count_ends(sg.five_prime_ends(reads if bases is None else sg.trim_uncoded_g(reads, bases)))
    raise ValueError(f"unknown input type {kind!r}")


def read_genome(spark: SparkSession, file: str) -> DataFrame:
    """(chr, length) of a .fai or chrom.sizes file."""
    p = F.split("value", r"\s+")
    return spark.read.text(file).filter(F.trim("value") != "").select(p[0].alias("chr"), p[1].cast("bigint").alias("length"))


def _fasta_lines(spark: SparkSession, file: str) -> DataFrame:
    """(chr, first, seq): sequence lines with the 0-based place of their first base.

    Lines are numbered within their split of the file; a table of one row per split carries names and lengths
    from one split to the next, so no chromosome is ever one row and splits stay parallel.
    """
    lines = spark.read.text(file).select(F.rtrim(F.regexp_replace("value", "\r", "")).alias("v"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = lines.filter(F.col("v") != "").withColumn("name", F.regexp_extract("v", r"^>(\S*)", 1)).withColumn("head", F.col("v").startswith(">"))
    inside = W.partitionBy("split").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    size = F.when(F.col("head"), 0).otherwise(F.length("v")).cast("bigint")
    lines = lines.withColumn("part", F.sum(F.col("head").cast("int")).over(inside)).withColumn("size", size)
    own = W.partitionBy("split", "part").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn("before", F.coalesce(F.sum("size").over(own), F.lit(0))).withColumn("chr", F.first(F.when(F.col("head"), F.col("name")), True).over(W.partitionBy("split", "part")))
    splits = lines.groupBy("split").agg(F.max("part").alias("parts"), F.max_by("chr", "part").alias("last"), F.sum(F.when(F.col("part") == 0, F.col("size"))).alias("lead"), F.max_by(F.col("before") + F.col("size"), "line").alias("tail"))
    along = W.partitionBy().orderBy("split")  # one row per split
    past = along.rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_k", F.sum(F.when(F.col("parts") > 0, 1).otherwise(0)).over(along.rowsBetween(W.unboundedPreceding, 0)))
    splits = splits.withColumn("from_", F.last("last", True).over(past)).withColumn("_k0", F.lag("_k").over(along))
    # Bases of the open chromosome so far: the tail of the split in which it begins and all splits since.
    splits = splits.withColumn("have", F.sum("tail").over(W.partitionBy("_k").orderBy("split").rowsBetween(W.unboundedPreceding, 0)))
    splits = splits.select("split", "from_", F.coalesce(F.lag("have").over(along), F.lit(0)).alias("have"))
    open_ = F.col("part") == 0
    body = lines.filter(~F.col("head")).join(F.broadcast(splits), "split")
    return body.select(F.when(open_, F.col("from_")).otherwise(F.col("chr")).alias("chr"), (F.col("before") + F.when(open_, F.col("have")).otherwise(F.lit(0))).alias("first"), F.upper("v").alias("seq"))


def read_chunks(spark: SparkSession, file: str, size: int = sg.CHUNK) -> DataFrame:
    """The genome of a FASTA file in stretches, as trim_uncoded_g takes them."""
    lines = _fasta_lines(spark, file)
    first, last = F.floor(F.col("first") / size), F.floor((F.col("first") + F.length("seq") - 1) / size)
    cut = lines.withColumn("chunk", F.explode(F.sequence(first, last)))
    a = F.greatest(F.col("chunk") * size, F.col("first"))
    piece = F.substring(F.col("seq"), (a - F.col("first") + 1).cast("int"), (F.least((F.col("chunk") + 1) * size, F.col("first") + F.length("seq")) - a).cast("int"))
    chunks = cut.groupBy("chr", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(a.alias("a"), piece.alias("p")))), lambda x: x["p"]), "").alias("seq"))
    return sg.linked_chunks(chunks, size)


def read_bases(spark: SparkSession, file: str) -> DataFrame:
    """(chr, pos, base) of a FASTA file, line by line."""
    lines = _fasta_lines(spark, file).select("chr", "first", F.posexplode(F.split("seq", "")).alias("i", "base")).filter(F.col("base") != "")
    return lines.select("chr", (F.col("first") + F.col("i") + 1).cast("bigint").alias("pos"), "base")


#: Feature types that stand for transcripts in GFF3 and GTF files; fixed values.
TRANSCRIPTS = ("transcript", "mRNA", "ncRNA", "lnc_RNA", "rRNA", "tRNA", "snRNA", "snoRNA", "miRNA", "pseudogenic_transcript")


def read_genes(spark: SparkSession, file: str, feature: str = "gene") -> DataFrame:
    """(chr, start, end, strand, gene_id) of the genes or transcripts of a GFF3 or GTF file; ids on several strands or chromosomes go."""
    if feature not in ("gene", "transcript"):
        raise ValueError(f"unknown feature {feature!r}")
    p = F.split("value", r"\t")
    rows = spark.read.text(file).filter(~F.col("value").startswith("#") & (F.size(p) >= 9)).filter(p[2] == "gene" if feature == "gene" else p[2].isin(*TRANSCRIPTS))
    keys = "gene_id|ID" if feature == "gene" else "transcript_id|ID"
    gene = F.regexp_extract(p[8], rf'(?:^|;)\s*(?:{keys})[= ]"?([^";]+)', 1)
    spans = rows.select(gene.alias("gene_id"), p[0].alias("chr"), p[6].alias("strand"), p[3].cast("bigint").alias("start"), p[4].cast("bigint").alias("end"))
    one = spans.groupBy("gene_id").agg(F.min("chr").alias("chr"), F.max("chr").alias("_c"), F.min("strand").alias("strand"), F.max("strand").alias("_s"), F.min("start").alias("start"), F.max("end").alias("end"))
    return one.filter((F.col("chr") == F.col("_c")) & (F.col("strand") == F.col("_s"))).select("chr", "start", "end", "strand", "gene_id")
