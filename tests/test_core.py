"""Operators on hand-made rows, against plain Python, and through files."""
import math
import random
import struct
import zlib

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from capsite.functions import stats
from capsite.operators import annotate as an, cluster as cl, consensus as co, enhancer as en, expression as ex, plots as pl, shape as sh, shift as sf, signal as sg
from capsite.plans.dataset import TssDataset
from capsite.sources import binary, readers, sinks

SIGNAL = "sample string, chr string, pos bigint, strand string, tags double"


def signal(spark, sites, strand="+", sample="s"):
    return spark.createDataFrame([(sample, "c", p, strand, float(t)) for p, t in sites], SIGNAL)


def clusters_by_hand(sites, strand, d, ext, local):
    """Peaks, filter, growth and merging, step by step over sorted (pos, tags)."""
    sites = sorted(sites)
    peak = {}
    for p, t in sites:
        near = [(q, u) for q, u in sites if abs(q - p) < d]
        top = max(u for _, u in near)
        peak[p] = t == top and min(q for q, u in near if u == top) == p
    kept = []
    for p, t in sites:
        over = [u for q, u in sites if peak[q] and (p - d <= q <= p if strand == "+" else p <= q <= p + d)]
        if not over or t >= max(over) * local:
            kept.append(p)
    if kept and not peak[kept[-1]]:
        kept.pop()
    out, run = [], []
    for p in kept:
        if run and (p - run[-1] >= ext or (peak[p] and peak[run[-1]])):
            out.append(run)
            run = []
        run.append(p)
    out.append(run)
    return [(r[0], r[-1], sum(t for p, t in sites if r[0] <= p <= r[-1])) for r in out if any(peak[p] for p in r)]


@pytest.mark.parametrize("sites,want", [
    ([(10, 5)], [(10, 10)]), ([(10, 5), (20, 5), (25, 1)], [(10, 20)]), ([(10, 5), (40, 1), (45, 1)], [(10, 10)]), ([(10, 5), (39, 1), (45, 1)], [(10, 39)]),
    ([(10, 100), (20, 1), (25, 3), (30, 3)], [(10, 25)]), ([(10, 9), (30, 1), (50, 1), (70, 1), (90, 1), (110, 8)], [(10, 110)]),
])
def test_cluster_cases(spark, sites, want):
    got = cl.tag_clusters(signal(spark, sites)).collect()
    assert [(r["start"], r["end"]) for r in got] == want


def test_clusters_property(spark):
    r = random.Random(11)
    rows, want = [], {}
    d, ext = 50, 30
    for case in range(120):
        strand = r.choice("+-")
        sites = [(p, float(r.choice([1, 1, 1, 2, 3, 5, 100, 400]))) for p in r.sample(range(1, r.choice([60, 300, 1500])), r.randint(1, 40))]
        rows += [(f"s{case}", "c", p, strand, t) for p, t in sites]
        want[f"s{case}"] = [x for x in clusters_by_hand(sites, strand, d, ext, 0.02) if x[2] > 1]
    got = {}
    for x in cl.tag_clusters(spark.createDataFrame(rows, SIGNAL), peak_distance=d, extension_distance=ext).orderBy("sample", "cluster").collect():
        got.setdefault(x["sample"], []).append((x["start"], x["end"], x["tags"]))
    assert got == {k: v for k, v in want.items() if v}


def test_unknown_methods(spark):
    s = signal(spark, [(1, 2)])
    for f in (lambda: cl.tag_clusters(s, "x"), lambda: sh.shape_scores(s, s, "x"), lambda: an.annotate(s, s, annotation_type="x"), lambda: sg.mapped_length(s.tags, "x")):
        with pytest.raises(ValueError):
            f()


def test_tpm(spark):
    sizes = spark.createDataFrame([("a", 3221609.0), ("b", 5131202.0)], "sample string, library_size double")
    one = signal(spark, [(1, 1)], sample="a").unionByName(signal(spark, [(1, 1)], sample="b"))
    assert {r["sample"]: r["tags"] for r in sg.tpm(one, sizes).collect()} == {"a": 0.310404, "b": 0.194886}


def test_shape(spark):
    for sites, pss in (([(1, 1), (4, 1)], 2.0), ([(1, 0.974431), (4, 0.389772)], 1.726241), ([(1, 3), (20, 1), (30, 1), (45, 1)], 9.844044), ([(7, 9)], 0.0)):
        s = signal(spark, sites)
        c = spark.createDataFrame([("s", 1, "c", "+", sites[0][0], sites[-1][0], sites[-1][0] - sites[0][0] + 1)], "sample string, cluster bigint, chr string, strand string, q_0_1 bigint, q_0_9 bigint, interquantile_width bigint")
        assert sh.shape_scores(s, c, "PSS").first()["shape_score"] == pytest.approx(pss, abs=2e-6)
    assert sh.shape_scores(s, c, "SI").first()["shape_score"] == pytest.approx(2)


def test_promoter_windows(spark):
    spans = {"A": (5000, 6000), "B": (6300, 7000), "C": (9000, 9500)}
    genes = spark.createDataFrame([("c", s, e, strand, g) for g, (s, e) in spans.items() for strand in "+-"], "chr string, start bigint, end bigint, strand string, gene_id string")

    def windows(down):
        return {(r["gene_id"], r["strand"]): (r["w_start"], r["w_end"]) for r in an.promoter_windows(genes, downstream=down).collect()}

    none, some = windows(0), windows(500)
    assert [none[g, "+"] for g in "ABC"] == [(4001, 5000), (5801, 6300), (8001, 9000)]
    assert [none[g, "-"] for g in "ABC"] == [(6000, 6499), (7000, 7999), (9500, 10499)]
    assert [some[g, "+"] for g in "ABC"] == [(4001, 5500), (5801, 6800), (8001, 9000)]


def test_consensus_fold(spark):
    def fold(samples, half):
        def merge(x):
            out = []
            for s, e in sorted(x):
                if out and s <= out[-1][1] + 1:
                    out[-1] = (out[-1][0], max(out[-1][1], e))
                else:
                    out.append((s, e))
            return out

        acc = merge([(d - half, d + half) for d in samples[0]])
        for doms in samples[1:]:
            new = [(d - half, d + half) for d in doms]
            meet = lambda a, b: a[0] <= b[1] and b[0] <= a[1]
            la, lb = [a for a in acc if any(meet(a, b) for b in new)], [b for b in new if any(meet(a, b) for a in acc)]
            acc = merge(la + lb) + [a for a in acc if a not in la] + [b for b in new if b not in lb]
        return sorted(acc)

    r = random.Random(4)
    for _ in range(3):
        samples = [sorted(r.sample(range(100, 1500), 12)) for _ in range(3)]
        rows = [(f"s{i}", "c", "+", d) for i, doms in enumerate(samples) for d in doms]
        df = spark.createDataFrame(rows, "sample string, chr string, strand string, dominant_tss bigint")
        got = co.consensus_ranges(df, ["s0", "s1", "s2"], 50).collect()
        assert sorted((x["start"], x["end"]) for x in got) == fold(samples, 25)


def test_bh_and_tails(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.5), (5, None)], "k int, p double")
    got = {r["k"]: r["padj"] for r in stats.bh_adjust(df, "p", "padj").collect()}
    assert got[5] is None and [got[i] for i in (1, 2, 3, 4)] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])
    assert spark.createDataFrame([(3.841459,)], "x double").select(stats.chi2_tail_1df("x")).first()[0] == pytest.approx(0.05, abs=1e-6)


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.floats(1e-3, 60), st.floats(1e-4, 0.5))
def test_poisson_cutoff(lam, p):
    x = stats.poisson_cutoff(lam, p)
    tail = lambda k: 1 - sum(math.exp(-lam + i * math.log(lam) - math.lgamma(i + 1)) for i in range(k + 1))
    assert tail(x) <= p + 1e-9 and (x == 0 or tail(x - 1) > p - 1e-9)


def test_constructor_errors(spark, tmp_path):
    for bad in ({"files_type": "xlsx"}, {"files": ("a",), "samples": ()}, {"samples": ("a", "b"), "merge_index": (1, 2), "merged_labels": ("x",)}, {"samples": ("a",), "merge_index": (1, 1), "merged_labels": ("x",)}):
        with pytest.raises(ValueError):
            TssDataset(spark, **bad)
    with pytest.raises(FileNotFoundError, match="nowhere.bed"):
        TssDataset(spark, files=(f"{tmp_path}/nowhere.bed",), samples=("a",)).read()


def test_workflow(spark):
    r = random.Random(2)
    rows = [(s, "c", b * 1000 + r.randint(0, 30), "+", float(r.randint(1, 40))) for s in ("a1", "a2", "b1", "b2") for b in range(1, 9) for _ in range(4)]
    genes = spark.createDataFrame([("c", b * 1000 + 40, b * 1000 + 600, "+", f"g{b}") for b in range(2, 8)], "chr string, start bigint, end bigint, strand string, gene_id string")
    data = TssDataset(spark, samples=("a1", "a2", "b1", "b2"), merged_labels=("a", "b"), merge_index=(1, 1, 2, 2), genes=genes)
    data = data.with_signal(spark.createDataFrame(rows, SIGNAL).groupBy("sample", "chr", "pos", "strand").sum("tags").toDF("sample", "chr", "pos", "strand", "tags")).merge().normalize()
    with pytest.raises(ValueError):
        data.normalize()
    with pytest.raises(ValueError):
        data.annotate()
    data = data.filter("TPM", tpm_low=0.1).cluster().consensus_cluster().annotate()
    assert data.annotated.filter("gene IS NOT NULL").count() > 5


def test_exports(spark, tmp_path):
    mine = signal(spark, [(5, 2.5), (6, 1.0), (400, 7.25)], sample="a")
    kept = spark.createDataFrame([("a", 1, "c", 5, 6, "+", 5, 3.5, 2.5, 5, 6, 2)], "sample string, cluster bigint, chr string, start bigint, end bigint, strand string, dominant_tss bigint, tags double, tags_dominant_tss double, q_0_1 bigint, q_0_9 bigint, interquantile_width bigint")
    out = str(tmp_path)
    text = lambda p: [r["value"] for r in spark.read.text(p).collect()]
    assert text(sinks.export_tss_table(mine, mine, ["a"], ["a"], out))[0] == "chr\tpos\tstrand\ta"
    assert "q_0.1" in text(sinks.export_clusters_table(kept, ["a"], out, "tagClusters")[0])[0]
    assert text(sinks.export_bed(kept, ["a"], out, "tagClusters")[0])[1].split("\t") == ["c", "4", "6", ".", "0", "+", "4", "5", "0", "1", "2", "0"]
    plus = sinks.export_bedgraph(mine, ["a"], out)[0]
    want = {5: 2.5, 6: 1.0, 400: 7.25}
    assert {r["pos"]: r["tags"] for r in readers.read_bedgraph(spark, [plus], ["a"]).collect()} == want
    genome = spark.createDataFrame([("c", 1000)], "chr string, length bigint")
    wig = readers.read_bigwig(spark, sinks.export_bigwig(mine, genome, ["a"], out)[:1], ["a"], genome)
    assert {r["pos"]: r["tags"] for r in wig.collect()} == want


def test_de_finds_changes(spark):
    import numpy as np

    g = np.random.default_rng(5)
    rows = []
    for k in range(300):
        mean, fold = g.uniform(30, 500), 4.0 if k < 30 else 1.0
        for i, s in enumerate(("a1", "a2", "a3", "b1", "b2", "b3")):
            mu = mean * (fold if i > 2 else 1)
            rows.append((f"g{k}", s, float(g.poisson(g.gamma(10, mu / 10)))))
    de = ex.de_genes(spark.createDataFrame(rows, "gene string, sample string, count double"), {"a": ["a1", "a2", "a3"], "b": ["b1", "b2", "b3"]}, "a", "b").collect()
    hit = {r["gene"] for r in de if r["padj"] < 0.05}
    assert sum(f"g{k}" in hit for k in range(30)) >= 25 and sum(f"g{k}" in hit for k in range(30, 300)) <= 10


def test_enhancers(spark):
    rows = [("s", 1, "c", "-", 1000, 10.0, None), ("s", 2, "c", "+", 1200, 12.0, None), ("s", 3, "c", "-", 9000, 10.0, None), ("s", 4, "c", "+", 9100, 900.0, None), ("s", 5, "c", "+", 30_000, 50.0, "g")]
    df = spark.createDataFrame(rows, "sample string, cluster bigint, chr string, strand string, dominant_tss bigint, tags double, gene string")
    got = en.call_enhancers(df).collect()
    assert [(r["enhancer"], r["cluster_m"], r["cluster_p"]) for r in got] == [(1, 1, 2)]


def bam_bytes(reads):
    body = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 2) + b"c\0" + struct.pack("<i", 100_000)
    for i, (pos, flag, mapq, cigar, seq, qual) in enumerate(reads):
        name = f"r{i}".encode() + b"\0"
        ops = [(int(n), "MIDNSHP=X".index(o)) for n, o in cigar]
        codes = ["=ACMGRSVTWYHKDBN".index(b) for b in seq] + [0] * (len(seq) % 2)
        rec = struct.pack("<iiBBHHHiiii", 0, pos - 1, len(name), mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops)
        rec += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + bytes([qual] * len(seq))
        body += struct.pack("<i", len(rec)) + rec
    out = b""
    for k in range(0, len(body), 4000):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        z = c.compress(body[k : k + 4000]) + c.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(z) + 25) + z + struct.pack("<II", zlib.crc32(body[k : k + 4000]), len(body[k : k + 4000]))
    return out


def test_bam(spark, tmp_path):
    r = random.Random(3)
    reads = [(r.randint(1, 90_000), r.choice([0, 16, 4, 512]), r.choice([0, 30, 255]), [(5, "S"), (30, "M"), (2, "I")], "".join(r.choice("ACGT") for _ in range(37)), r.choice([5, 40])) for _ in range(2000)]
    path = f"{tmp_path}/x.bam"
    open(path, "wb").write(bam_bytes(reads))
    for size in (1 << 26, 9000):
        spark.dataSource.register(binary.BamSource)
        got = spark.read.format("capsite_bam").option("path", path).option("splitBytes", size).load().collect()
        assert sorted((x["pos"], x["flag"], x["seq"], x["cigar"]) for x in got) == sorted((p, f, s, "5S30M2I") for p, f, _, _, s, _ in reads)
    genome = spark.createDataFrame([("c", 100_000)], "chr string, length bigint")
    counts = readers.read_signal(spark, [path], "bam", ["s"], genome)
    want = {}
    for p, f, q, _, _, ql in reads:
        if f in (0, 16) and q >= 20 and ql >= 10:
            key = (p, "+") if f == 0 else (p + 29, "-")
            want[key] = want.get(key, 0) + 1
    assert {(x["pos"], x["strand"]): x["tags"] for x in counts.collect()} == want


def trimmed_by_hand(genome, strand, start, end, seq):
    """Step by step, base after base."""
    i = 0
    if strand == "+":
        while i < len(seq) and seq[i] == "G" and genome[start - 1 + i : start + i] != "G":
            i += 1
        return start + i
    while i < len(seq) and seq[-1 - i] == "C" and not (end - 1 - i >= 0 and genome[end - 1 - i] == "C"):
        i += 1
    return end - i


def test_uncoded_g(spark):
    r = random.Random(8)
    genome = "AGGTACCA" + "A" * 40 + "".join(r.choice("ACGTN") for _ in range(60)) + "T" * 30
    bases = spark.createDataFrame([("c", i + 1, b) for i, b in enumerate(genome)], "chr string, pos bigint, base string")
    rows = [("s", "c", "+", 1, 4, "GGGT"), ("s", "c", "+", 4, 6, "TAC"), ("s", "c", "-", 2, 8, "GGTACCC"), ("s", "c", "-", 2, 7, "GGTACC"), ("s", "c", "+", 9, 40, "G" * 15 + "A" * 17), ("s", "c", "+", 110, 130, "G" * 21)]
    for _ in range(200):
        a = r.randint(1, len(genome) - 25)
        rows.append(("s", "c", "+", a, a + 24, "G" * r.randint(0, 25)) if r.random() < 0.5 else ("s", "c", "-", a, a + 24, "C" * r.randint(0, 25)))
    rows = [(*x[:5], x[5] + "T" * (x[4] - x[3] + 1 - len(x[5])) if x[2] == "+" else "T" * (x[4] - x[3] + 1 - len(x[5])) + x[5]) for x in rows]
    reads = spark.createDataFrame(rows, "sample string, chr string, strand string, read_start bigint, read_end bigint, seq string")
    want = sorted((trimmed_by_hand(genome, *x[2:]), x[2]) for x in rows)
    for size in (7, 10_000):
        got = sg.five_prime_ends(sg.trim_uncoded_g(reads, bases, size)).collect()
        assert sorted((x["pos"], x["strand"]) for x in got) == want


def test_text_inputs(spark, tmp_path):
    (tmp_path / "t.tss").write_text("chr\tpos\tstrand\tcount\nc\t5\t+\t3\nc\t6\t-\t0\n")
    (tmp_path / "t.tab").write_text("chr pos strand a b\nc 5 + 1 0\nc 7 - 0 2\n")
    (tmp_path / "t.bed").write_text("track x\nc\t4\t9\tn\t0\t+\nc\t4\t9\tn\t0\t-\nc\t4\t9\tn\t0\t.\nc\t1\t200\tn\t0\t+\n")
    (tmp_path / "t.gff").write_text("##gff\nc\tx\tgene\t10\t20\t.\t+\t.\tID=g1;Name=n\nc\tx\tgene\t30\t40\t.\t-\t.\tgene_id \"g2\"; x \"y\"\n")
    (tmp_path / "t.fa").write_text(">c one\nAC\nGT\n>d\nTT\n")
    genome = spark.createDataFrame([("c", 100)], "chr string, length bigint")
    of = lambda df: sorted(tuple(r[c] for c in ("sample", "chr", "pos", "strand", "tags")) for r in df.collect())
    assert of(readers.read_signal(spark, [f"{tmp_path}/t.tss"], "tss", ["a"])) == [("a", "c", 5, "+", 3.0)]
    assert of(readers.read_signal(spark, [f"{tmp_path}/t.tab"], "TSStable", ["a", "b"])) == [("a", "c", 5, "+", 1.0), ("b", "c", 7, "-", 2.0)]
    assert of(readers.read_signal(spark, [f"{tmp_path}/t.bed"], "bed", ["a"], genome)) == [("a", "c", 5, "+", 1.0), ("a", "c", 9, "-", 1.0)]
    assert sorted(map(tuple, readers.read_genes(spark, f"{tmp_path}/t.gff").collect())) == [("c", 10, 20, "+", "g1"), ("c", 30, 40, "-", "g2")]
    assert [r["base"] for r in readers.read_bases(spark, f"{tmp_path}/t.fa").orderBy("chr", "pos").collect()] == list("ACGTTT")


def test_plots(spark):
    rows = [(s, "c", p, "+", float(p % 7 + i)) for i, s in enumerate("ab") for p in range(1, 50)]
    raw = spark.createDataFrame(rows, SIGNAL).filter("tags > 0")
    assert pl.correlation(raw, ["a", "b"]).first()["pearson"] == pytest.approx(1.0)
    assert pl.pca(raw, ["a", "b"], 1).count() == 2


def test_shift(spark):
    rows = [("x", 1, "+", 100, 50.0, "g"), ("x", 2, "+", 300, 10.0, "g"), ("y", 1, "+", 100, 10.0, "g"), ("y", 2, "+", 300, 60.0, "g"), ("x", 3, "+", 900, 5.0, "h")]
    df = spark.createDataFrame(rows, "sample string, cluster bigint, strand string, dominant_tss bigint, tags double, gene string")
    got = sf.shift_statistics(df, "x", "y").collect()
    assert len(got) == 1 and got[0]["ds"] == pytest.approx(math.log2((60.1 / 10.1) / (10.1 / 50.1)))
    assert sf.promoter_shift(df, "x", "y").count() == 1
