"""From 5' ends to a processed signal: counting, replicate merge, library size, TPM and noise filters.

A signal is a long frame (sample, chr, pos, strand, tags) that holds positive tags only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from capsite.functions.stats import poisson_cutoff

SITE = ["sample", "chr", "pos", "strand"]
#: More samples than this are labelled by a join.
MAP_LITERALS = 1_000
#: Bases of a stretch of the genome.
CHUNK = 10_000


def count_ends(ends: DataFrame) -> DataFrame:
    """One row per site with the number of 5' ends on it."""
    return ends.groupBy(*SITE).agg(F.count(F.lit(1)).cast("double").alias("tags"))


def mapped_length(cigar: Column, mode: str = "reference") -> Column:
    """Bases that an alignment spans. ``reference`` sums M, D, N, = and X; ``sum_all`` sums every operation."""
    pattern = {"reference": "([0-9]+)[MDN=X]", "sum_all": "([0-9]+)"}.get(mode)
    if pattern is None:
        raise ValueError(f"unknown cigar mode {mode!r}")
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(pattern), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


def filter_alignments(reads: DataFrame, genome: DataFrame, base_quality: int = 10, mapping_quality: int = 20, paired_end: bool = False, softclipping: bool = False, cigar_mode: str = "reference") -> DataFrame:
    """Quality-filtered alignments with their reference span.

    reads: (sample, chr, pos, strand, flag, mapq, cigar, seq, qual array). Single-end input drops unmapped
    and failed reads; paired-end input keeps properly paired first mates. A missing mapping quality (255 or
    null) passes. With ``softclipping`` the reference span already excludes clipped bases.
    """
    flag = F.col("flag")
    by_flag = (flag.bitwiseAND(4) == 0) & ((flag.bitwiseAND(2) != 0) & (flag.bitwiseAND(64) != 0) if paired_end else flag.bitwiseAND(512) == 0)
    mean = F.floor(F.aggregate("qual", F.lit(0).cast("bigint"), lambda a, q: a + q) / F.size("qual"))
    span = mapped_length(F.col("cigar"), cigar_mode)
    if softclipping and cigar_mode == "sum_all":
        span = span - F.coalesce(F.regexp_extract(F.col("cigar"), "^([0-9]+)S", 1).try_cast("bigint"), F.lit(0))
    kept = reads.filter(by_flag & (F.coalesce(F.col("mapq"), F.lit(255)) >= mapping_quality) & (mean >= base_quality))
    kept = kept.withColumn("read_start", F.col("pos").cast("bigint")).withColumn("read_end", F.col("pos") + span - 1)
    return kept.join(genome.select("chr", "length"), "chr").filter(F.col("read_end") <= F.col("length")).drop("length")


def five_prime_ends(reads: DataFrame) -> DataFrame:
    """The 5' end of each alignment: its start on the plus strand, its end on the minus strand."""
    end = F.when(F.col("strand") == "+", F.col("read_start")).otherwise(F.col("read_end"))
    return reads.select("sample", "chr", end.cast("bigint").alias("pos"), "strand")


def base_chunks(bases: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chr, chunk, seq, next_g, last_c) of (chr, pos, base) rows: upper-case stretches of the genome, gaps as N.

    next_g is the first G behind the chunk and last_c the last C before it, so a search that leaves the chunk ends there.
    """
    at = F.col("pos") - 1
    rows = bases.select("chr", F.floor(at / size).cast("bigint").alias("chunk"), (at % size).cast("int").alias("i"), F.upper("base").alias("base"))
    letters = rows.groupBy("chr", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("i", "base"))).alias("m"), F.max("i").alias("n"))
    return linked_chunks(letters.select("chr", "chunk", F.concat_ws("", F.transform(F.sequence(F.lit(0), F.col("n")), lambda i: F.coalesce(F.col("m")[i], F.lit("N")))).alias("seq")), size)


def linked_chunks(chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Adds next_g and last_c to (chr, chunk, seq); one row per chunk goes through the windows."""
    start = F.col("chunk") * size
    first_g, last_c = F.locate("G", F.col("seq")), F.length("seq") - F.locate("C", F.reverse("seq")) + 1
    own = chunks.withColumn("_g", F.when(first_g > 0, start + first_g)).withColumn("_c", F.when(F.locate("C", F.col("seq")) > 0, start + last_c))
    behind, before = W.partitionBy("chr").orderBy(F.col("chunk").desc()), W.partitionBy("chr").orderBy("chunk")
    past = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    return own.withColumn("next_g", F.last("_g", True).over(past(behind))).withColumn("last_c", F.last("_c", True).over(past(before))).drop("_g", "_c")


def trim_uncoded_g(reads: DataFrame, bases: DataFrame, size: int = CHUNK) -> DataFrame:
    """Moves the 5' end inwards over read Gs that the genome does not have (C on the minus strand's end).

    bases: (chr, pos, base) of the genome, or chunks of it as base_chunks() gives. Trimming stops at the first
    G that the genome shares or at the end of the read's run of Gs, however long: the end moves by the shorter
    of the run and the way to the next G of the genome. Only reads that begin with the base meet the genome,
    each one chunk of it.
    """
    plus = F.col("strand") == "+"
    chunks = bases if "seq" in bases.columns else base_chunks(bases, size)
    keyed = reads.withColumn("_lead", F.length(F.when(plus, F.regexp_extract("seq", "^(G*)", 1)).otherwise(F.regexp_extract("seq", "(C*)$", 1))))
    still = keyed.filter(F.coalesce(F.col("_lead"), F.lit(0)) == 0).drop("_lead")
    end = F.when(plus, F.col("read_start")).otherwise(F.col("read_end"))
    leading = keyed.filter(F.col("_lead") > 0).withColumn("_end", end).withColumn("_chunk", F.floor((end - 1) / size))
    genome = chunks.select("chr", F.col("chunk").alias("_chunk"), F.col("seq").alias("_seq"), "next_g", "last_c")
    met = leading.join(genome, ["chr", "_chunk"], "left")
    at = (F.col("_end") - F.col("_chunk") * size).cast("int")  # from 1, within the chunk
    ahead = F.call_function("locate", F.lit("G"), F.col("_seq"), at)
    near = F.reverse(F.substring("_seq", F.lit(1), at))
    back = F.call_function("locate", F.lit("C"), near)
    way = F.when(plus, F.when(ahead > 0, ahead - at).otherwise(F.col("next_g") - F.col("_end"))).otherwise(F.when(back > 0, back - 1).otherwise(F.col("_end") - F.col("last_c")))
    moved = met.withColumn("_trim", F.least(F.col("_lead"), F.coalesce(way, F.col("_lead"))))
    moved = moved.withColumn("read_start", F.when(plus, F.col("read_start") + F.col("_trim")).otherwise(F.col("read_start"))).withColumn("read_end", F.when(plus, F.col("read_end")).otherwise(F.col("read_end") - F.col("_trim")))
    return still.unionByName(moved.select(*still.columns))


def merge_samples(signal: DataFrame, sample_map: DataFrame) -> DataFrame:
    """Sums replicates into their group. sample_map: (sample, merged), one row per sample.

    Labels come in through a literal map while there are few of them, else through a join.
    """
    labels = sample_map.select("sample", "merged").limit(MAP_LITERALS + 1).collect()
    if len(labels) <= MAP_LITERALS:
        lookup = F.create_map(*[F.lit(x) for r in labels for x in r]) if labels else F.lit(None).cast("map<string,string>")
        named = signal.withColumn("merged", lookup[F.col("sample")]).filter(F.col("merged").isNotNull())
    else:
        named = signal.join(sample_map.select("sample", "merged"), "sample")
    return named.groupBy(F.col("merged").alias("sample"), "chr", "pos", "strand").agg(F.sum("tags").alias("tags"))


def library_sizes(signal: DataFrame) -> DataFrame:
    """(sample, library_size)."""
    return signal.groupBy("sample").agg(F.sum("tags").alias("library_size"))


def tpm(signal: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tags per million of the stored library size, to six decimals."""
    return signal.join(sizes, "sample").select(*SITE, F.round(F.col("tags") / (F.col("library_size") / 1e6), 6).alias("tags"))


def filter_poisson(signal: DataFrame, sizes: DataFrame, genome_size: int, p_value: float = 0.01, normalize: bool = True) -> DataFrame:
    """Keeps sites with at least the Poisson cutoff of their sample; then TPM by the size before the filter.

    A scalar per sample goes to the driver and comes back as a literal map.
    """
    if genome_size <= 0:
        raise ValueError("genome_size must be positive")
    cut = [(r["sample"], float(poisson_cutoff(r["library_size"] / (2 * genome_size), p_value))) for r in sizes.collect()]
    if not cut:
        return signal
    cutoffs = signal.sparkSession.createDataFrame(cut, "sample string, cutoff double")
    kept = signal.join(F.broadcast(cutoffs), "sample").filter(F.col("tags") >= F.col("cutoff")).select(*SITE, "tags")
    return tpm(kept, sizes) if normalize else kept


def filter_tpm(signal: DataFrame, tpm_low: float = 0.1) -> DataFrame:
    """Keeps sites of at least ``tpm_low``."""
    return signal.filter(F.col("tags") >= tpm_low)


def wide(signal: DataFrame, samples: list[str]) -> DataFrame:
    """The matrix form: a column per sample, zero where a sample has no tags."""
    return signal.groupBy("chr", "pos", "strand").pivot("sample", samples).agg(F.sum("tags")).na.fill(0.0, samples)


def long(matrix: DataFrame, samples: list[str]) -> DataFrame:
    """The signal of a matrix; zeros go."""
    return matrix.unpivot(["chr", "pos", "strand"], samples, "sample", "tags").filter(F.col("tags") > 0).select("sample", "chr", F.col("pos").cast("bigint").alias("pos"), "strand", F.col("tags").cast("double").alias("tags"))
