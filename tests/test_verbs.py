"""The data set's verbs from files to exported tables, and inputs and outputs that other tests leave out."""
import math
import random

import pytest
from pyspark.sql import functions as F

from capsite.operators import expression as ex, signal as sg
from capsite.plans.dataset import TssDataset
from capsite.sources import binary, readers, sinks
from capsite.streaming import stream_site_counts
from tests.test_core import SIGNAL, bam_bytes, signal


def lines(path):
    with open(path) as f:
        return f.read().splitlines()


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    """A data set of two groups in which some genes move their promoter and some change their level."""
    out = tmp_path_factory.mktemp("verbs")
    r = random.Random(6)
    rows = []
    for s in ("a1", "a2", "b1", "b2"):
        for g in range(1, 41):
            lead, other = (60, 12) if s[0] == "a" or g % 4 else (12, 60)
            level = 8 if s[0] == "b" and g % 5 == 0 else 1
            for at, n in ((0, lead), (400, other)):
                for k in range(5):
                    rows.append((s, "c", g * 5000 + at + 7 * k, "+", float(max(1, round(n * level * r.uniform(0.9, 1.1) / (1 + k))))))
        rows += [(s, "c", 300_000 + d, "-", 9.0 + d % 3) for d in range(0, 20, 5)] + [(s, "c", 300_200 + d, "+", 10.0) for d in range(0, 20, 5)]
    gff = out / "genes.gff"
    text = "".join(f"c\tx\tgene\t{g * 5000 + 450}\t{g * 5000 + 1500}\t.\t+\t.\tID=g{g}\nc\tx\tmRNA\t{g * 5000 + 450}\t{g * 5000 + 1400}\t.\t+\t.\tID=t{g};Parent=g{g}\n" for g in range(1, 41))
    gff.write_text("##gff-version 3\n" + text)
    genome = spark.createDataFrame([("c", 400_000)], "chr string, length bigint")
    data = TssDataset(spark, samples=("a1", "a2", "b1", "b2"), merged_labels=("a", "b"), merge_index=(1, 1, 2, 2), ref_source=str(gff), genome=genome)
    data = data.with_signal(spark.createDataFrame(rows, SIGNAL)).merge().normalize().cluster().consensus_cluster()
    data = data.annotate(upstream=1000).shape_cluster(method="PSS").call_enhancers().de((("a", "b"), ("b", "a"))).shift((("a", "b"),), 0.05)
    return data, out


def test_comparisons(done):
    data, _ = done
    assert set(data.de_tables) == {"a_VS_b", "b_VS_a"} and set(data.shifts) == {"a_VS_b"}
    table, sig = (x.collect() for x in data.de_tables["a_VS_b"])
    back = {r["gene"]: r for r in data.de_tables["b_VS_a"][0].collect()}
    assert len(table) == 40 and {r["gene"] for r in sig} == {r["gene"] for r in table if r["padj"] < 0.01}
    assert {f"g{g}" for g in range(5, 41, 5)} <= {r["gene"] for r in sig}
    assert all(r["log2_fold_change"] == pytest.approx(-back[r["gene"]]["log2_fold_change"], abs=1e-3) for r in table)
    moved = {r["gene"] for r in data.shifts["a_VS_b"].collect() if abs(r["ds"]) > 2}
    assert moved == {f"g{g}" for g in range(4, 41, 4)}
    raw = data.shift((("a", "b"),), 1.0, use_raw_count=True).shifts["a_VS_b"]
    plain = data.shift((("a", "b"),), 1.0).shifts["a_VS_b"]
    pair = raw.join(plain, "gene").filter(raw.pval != plain.pval).count()
    assert pair > 0 and raw.count() == plain.count() == 40
    assert data.tag_tables.select("sample").distinct().count() == 4


def test_transcripts_come_from_the_file(done):
    data, _ = done
    from dataclasses import replace

    again = replace(data, genes=None).annotate(annotation_type="transcripts")
    assert {r["gene"] for r in again.annotated.filter("gene IS NOT NULL").select("gene").distinct().collect()} == {f"t{g}" for g in range(1, 41)}
    with pytest.raises(ValueError):
        replace(data, genes=None).annotate(annotation_type="exons")
    with pytest.raises(ValueError):
        replace(data, genes=None, ref_source=None).annotate()


def test_exports_of_all_tables(done, spark):
    data, out = done
    folder = str(out)
    table = lines(data.export_tss_table(folder, "raw", False))
    assert table[0] == "chr\tpos\tstrand\ta1\ta2\tb1\tb2" and len(table) == 1 + data.raw.select("pos", "strand").distinct().count()
    assert lines(data.export_tss_table(folder, "processed"))[0] == "chr\tpos\tstrand\ta\tb"
    for kind in ("tagClusters", "consensusClusters", "assigned", "unassigned", "filtered"):
        paths = data.export_clusters_table(folder, kind)
        assert len(paths) == 2 and lines(paths[0])[0].startswith("cluster\tchr\tstart\tend\tstrand\tdominant_tss\ttags\ttags.dominant_tss\tq_0.1\tq_0.9\tinterquantile_width")
        assert [p.rsplit("/", 1)[1] for p in paths] == [f"{s}.{kind if kind.endswith('Clusters') else kind + 'Clusters'}.txt" for s in "ab"]
    shape = lines(data.export_shape_table(folder)[1])
    assert shape[0].endswith("\tshape.score") and len(shape) == 1 + data.shape.filter("sample = 'b'").count()
    enhancers = lines(data.export_enhancer_table(folder)[0])
    assert enhancers[0] == "enhancer\tcluster.m\tcluster.p\tchr\tdominant_tss.m\tdominant_tss.p\ttags.m\ttags.p\tD" and len(enhancers) == 2
    every, sig = data.export_de_table(folder, "all"), data.export_de_table(folder)
    assert every[0].endswith("a_VS_b.DE.table.aLL.txt") and sig[0].endswith("a_VS_b.DE.table.sig.txt")
    assert lines(every[0])[0] == "gene\tbaseMean\tlog2FoldChange\tlfcSE\tstat\tpvalue\tpadj" and len(lines(every[0])) == 41 > len(lines(sig[0])) > 8
    shift = lines(data.export_shift_table(folder)[0])
    assert shift[0] == "gene\tDs\tpval\tpadj" and len(shift) > 5
    bed = lines(data.export_clusters_bed(folder)[0])
    assert bed[0].startswith('track name="a(consensusClusters(TC)') and [int(x.split("\t")[1]) for x in bed[1:]] == sorted(int(x.split("\t")[1]) for x in bed[1:])
    tracks = data.export_bedgraph(folder)
    assert len(tracks) == 4 and all(float(x.split("\t")[3]) < 0 for x in lines(tracks[1]))
    wig = data.export_bedgraph(folder, "raw", "BigWig")
    got = readers.read_bigwig(spark, wig[:1], ["a1"]).agg(F.sum("tags")).first()[0]
    assert got == data.raw.filter("sample = 'a1' AND strand = '+'").agg(F.sum("tags")).first()[0]
    for bad in (lambda: data.export_tss_table(folder, "x"), lambda: data.export_clusters_table(folder, "x"), lambda: data.export_de_table(folder, "x"), lambda: data.export_bedgraph(folder, "x"), lambda: data.export_bedgraph(folder, "raw", "x")):
        with pytest.raises(ValueError):
            bad()


def test_plot_data(done):
    data, _ = done
    assert data.plot_correlation().count() == 6 and data.plot_interquantile().count() > 0 and data.plot_shape().count() > 0
    assert {(r["sample"], r["merged"]) for r in data.plot_pca(5).collect()} == {("a1", "a"), ("a2", "a"), ("b1", "b"), ("b2", "b")}
    kinds = {r["gene"]: r["class"] for r in data.plot_de()["a_VS_b"].collect()}
    assert all(kinds[f"g{g}"] == "both" for g in range(5, 41, 5))
    window, sites, shown = data.plot_tss(["g3"])
    assert window.first()["w_start"] == 3 * 5000 + 450 - 500 and sites.count() > 0 and shown.count() > 0


def test_bigwig_index_levels(tmp_path):
    r = random.Random(1)
    lengths = [("b", 10**6), ("a", 10**6)]
    runs = {c: sorted((p, p + 1, float(r.randint(1, 50))) for p in r.sample(range(10**6 - 1), 3000)) for c in "ab"}
    for fan in (2, 3, 256):
        sections = [binary.pack_section(c, {"a": 0, "b": 1}[c], runs[c][i : i + 7]) for c in "ab" for i in range(0, 3000, 7)]
        binary.write_bigwig(f"{tmp_path}/x.bw", lengths, iter(sections), fan)
        with open(f"{tmp_path}/x.bw", "rb") as f:
            assert [tuple(x) for x in binary.bigwig_runs(f)] == [(c, *x) for c in "ab" for x in runs[c]]
    binary.write_bigwig(f"{tmp_path}/e.bw", lengths, iter(()))
    with open(f"{tmp_path}/e.bw", "rb") as f:
        assert list(binary.bigwig_runs(f)) == []


def test_fasta_in_splits(spark, tmp_path):
    r = random.Random(5)
    genome = {f"s{k}": "".join(r.choice("ACGTN") for _ in range(r.choice([0, 1, 59, 60, 61, 700]))) for k in range(9)}
    with open(f"{tmp_path}/g.fa", "w") as f:
        for name, seq in genome.items():
            f.write(f">{name} text\n" + "".join(seq[i : i + 60] + "\n" for i in range(0, len(seq), 60)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("130", "1000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = {}
        for x in readers.read_bases(spark, f"{tmp_path}/g.fa").orderBy("chr", "pos").collect():
            got[x["chr"]] = got.get(x["chr"], "") + x["base"]
            assert len(got[x["chr"]]) == x["pos"]
        assert got == {k: v for k, v in genome.items() if v}
        chunks = {}
        for x in readers.read_chunks(spark, f"{tmp_path}/g.fa", 50).orderBy("chr", "chunk").collect():
            chunks[x["chr"]] = chunks.get(x["chr"], "") + x["seq"]
        assert chunks == got
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bam_modes(spark, tmp_path):
    reads = [(100, 2 | 64, 30, [(5, "S"), (30, "M")], "A" * 35, 40), (200, 2 | 128, 30, [(35, "M")], "A" * 35, 40), (300, 2 | 64 | 16, 10, [(35, "M")], "A" * 35, 40), (400, 2 | 64 | 16, 255, [(10, "M"), (100, "N"), (25, "M")], "A" * 35, 40)]
    path = f"{tmp_path}/p.bam"
    with open(path, "wb") as f:
        f.write(bam_bytes(reads))
    genome = spark.createDataFrame([("c", 100_000)], "chr string, length bigint")
    ends = lambda **k: {(x["pos"], x["strand"]) for x in readers.read_signal(spark, [path], "bamPairedEnd", ["s"], genome, **k).collect()}
    assert ends() == {(100, "+"), (400 + 134, "-")}
    assert ends(mapping_quality=5) == {(100, "+"), (300 + 34, "-"), (400 + 134, "-")}
    assert ends(cigar_mode="sum_all", softclipping=True, mapping_quality=5) == ends(mapping_quality=5)
    stored = readers.read_bam(spark, [path], ["s"], require_flags=64, exclude_flags=16, mapping_quality=20)
    assert [x["pos"] for x in stored.collect()] == [100]
    cigars = spark.createDataFrame([("5S30M2I10N",)], "cigar string")
    assert cigars.select(sg.mapped_length(F.col("cigar")), sg.mapped_length(F.col("cigar"), "sum_all")).first()[:] == (40, 47)
    lengths = tmp_path / "g.fai"
    lengths.write_text("c\t100000\t5\t60\t61\nd\t7\t9\t60\t61\n")
    assert sorted(map(tuple, readers.read_genome(spark, str(lengths)).collect())) == [("c", 100_000), ("d", 7)]


def test_runs_of_several_bases(spark, tmp_path):
    (tmp_path / "r.bedGraph").write_text("c\t4\t7\t2.5\nc\t10\t12\t-1\n")
    of = lambda **k: sorted((x["pos"], x["strand"], x["tags"]) for x in readers.read_bedgraph(spark, [f"{tmp_path}/r.bedGraph"], ["s"], **k).collect())
    assert of() == [(5, "+", 2.5), (6, "+", 2.5), (7, "+", 2.5), (11, "-", 1.0), (12, "-", 1.0)]
    assert of(expand=False) == [(5, "+", 2.5), (12, "-", 1.0)]


def test_counts_of_a_stream(spark, tmp_path):
    rows = [("s", "c", 5, "+"), ("s", "c", 5, "+"), ("s", "c", 9, "-")]
    kind = "sample string, chr string, pos bigint, strand string"
    for k in range(2):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stream_site_counts(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("site_counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r["pos"], r["tags"]) for r in spark.table("site_counts").collect()) == [(5, 4.0), (9, 2.0)]


def test_significant_and_de_sink(spark, tmp_path):
    de = spark.createDataFrame([("x_VS_y", "g", 0.001, 3.0), ("x_VS_y", "h", 0.5, 0.1)], "comparison string, gene string, padj double, d double")
    assert [r["gene"] for r in ex.significant(de).collect()] == ["g"]
    assert len(lines(sinks.export_de_table(de, ["x_VS_y"], str(tmp_path))[0])) == 2
    assert math.isclose(signal(spark, [(1, 2.0)]).first()["tags"], 2.0)
