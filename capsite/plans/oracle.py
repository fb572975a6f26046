"""The same results as DuckDB SQL, written from the rules and not from the Spark code."""
from __future__ import annotations

import re

from capsite.plans.queries import CHROMOSOMES

AXIS = "sample, chr, strand"


def _islands(source: str) -> str:
    """SELECT of the union of (chr, strand, s, e) intervals; adjacent ones join."""
    return f"""SELECT chr, strand, min(s) AS s, max(e) AS e FROM (
      SELECT *, sum(o) OVER (PARTITION BY chr, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chr, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS o FROM {source}))
      GROUP BY chr, strand, g"""


def _stats(members: str, keys: str) -> str:
    """SELECT of the statistics of groups of sites."""
    return f"""SELECT {keys}, min(pos) AS "start", max(pos) AS "end", min(CASE WHEN tags = top THEN pos END) AS dominant_tss, sum(tags) AS tags, max(tags) AS tags_dominant_tss,
        min(CASE WHEN up > total * CAST(0.1 AS DOUBLE) THEN pos END) AS q_0_1, max(CASE WHEN down > total * CAST(0.1 AS DOUBLE) THEN pos END) AS q_0_9
      FROM (SELECT *, sum(tags) OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS up, sum(tags) OVER (PARTITION BY {keys} ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS down,
        sum(tags) OVER (PARTITION BY {keys}) AS total, max(tags) OVER (PARTITION BY {keys}) AS top FROM {members}) GROUP BY {keys}"""


GENES = ", ".join(f"('{c}')" for c in CHROMOSOMES)
CTE = {
    "reads": """SELECT 'S' || CAST(CASE WHEN l_partkey % 2 = 1 AND l_suppkey % 8 < 6 THEN l_suppkey % 2 ELSE l_suppkey % 4 END AS VARCHAR) AS sample, 'chr' || l_returnflag || l_linestatus AS chr,
      CAST(1000 * (l_partkey % 200) + l_linenumber * l_linenumber + l_suppkey % 13 + 1 AS BIGINT) AS pos, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem""",
    "tss": f"SELECT sample, chr, pos, strand, CAST(count(*) AS DOUBLE) AS tags FROM reads GROUP BY ALL",
    "merged": "SELECT CASE WHEN sample IN ('S0', 'S1') THEN 'control' ELSE 'treat' END AS sample, chr, pos, strand, sum(tags) AS tags FROM tss GROUP BY ALL",
    "lib": "SELECT sample, sum(tags) AS library_size FROM merged GROUP BY sample",
    "tpm": "SELECT m.sample, chr, pos, strand, round(tags / (library_size / 1e6), 6) AS tags, tags AS n, library_size FROM merged m JOIN lib USING (sample)",
    "pk": f"""SELECT *, tags = max(tags) OVER (PARTITION BY {AXIS} ORDER BY pos RANGE BETWEEN 99 PRECEDING AND 99 FOLLOWING)
      AND coalesce(max(tags) OVER (PARTITION BY {AXIS} ORDER BY pos RANGE BETWEEN 99 PRECEDING AND 1 PRECEDING) < tags, true) AS is_peak FROM merged""",
    "noise": f"""SELECT *, CASE WHEN strand = '+' THEN max(CASE WHEN is_peak THEN tags END) OVER (PARTITION BY {AXIS} ORDER BY pos RANGE BETWEEN 100 PRECEDING AND CURRENT ROW)
      ELSE max(CASE WHEN is_peak THEN tags END) OVER (PARTITION BY {AXIS} ORDER BY pos RANGE BETWEEN CURRENT ROW AND 100 FOLLOWING) END AS above FROM pk""",
    "live": f"SELECT * FROM (SELECT *, lead(pos) OVER (PARTITION BY {AXIS} ORDER BY pos) AS nx FROM noise WHERE above IS NULL OR tags >= above * CAST(0.02 AS DOUBLE)) WHERE nx IS NOT NULL OR is_peak",
    "runs": f"""SELECT *, sum(o) OVER (PARTITION BY {AXIS} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN pos - lag(pos) OVER w < 30 AND NOT (is_peak AND lag(is_peak) OVER w) THEN 0 ELSE 1 END AS o
      FROM live WINDOW w AS (PARTITION BY {AXIS} ORDER BY pos))""",
    "ext": f"SELECT {AXIS}, g, min(pos) AS s, max(pos) AS e FROM runs GROUP BY {AXIS}, g HAVING bool_or(is_peak)",
    "mem": "SELECT m.*, x.g FROM merged m JOIN ext x ON m.sample = x.sample AND m.chr = x.chr AND m.strand = x.strand AND m.pos BETWEEN x.s AND x.e",
    "tc": f"""SELECT row_number() OVER (PARTITION BY sample ORDER BY strand, chr, "start") AS cluster, *, q_0_9 - q_0_1 + 1 AS interquantile_width FROM ({_stats('mem', AXIS + ', g')}) WHERE tags > 1""",
    "sa": f"SELECT chr, strand, dominant_tss - 25 AS s, dominant_tss + 25 AS e FROM tc WHERE sample = 'control'",
    "ua": _islands("sa"),
    "sb": f"SELECT chr, strand, dominant_tss - 25 AS s, dominant_tss + 25 AS e FROM tc WHERE sample = 'treat'",
    "hit": "SELECT a.chr, a.strand, a.s AS sl, a.e AS el, b.s AS sr, b.e AS er FROM ua a JOIN sb b ON a.chr = b.chr AND a.strand = b.strand AND a.s <= b.e AND b.s <= a.e",
    "met": "SELECT DISTINCT chr, strand, sl AS s, el AS e FROM hit UNION ALL SELECT DISTINCT chr, strand, sr, er FROM hit",
    "fold": f"""{_islands('met')} UNION ALL SELECT chr, strand, s, e FROM ua a WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.chr = a.chr AND h.strand = a.strand AND h.sl = a.s AND h.el = a.e)
      UNION ALL SELECT chr, strand, s, e FROM sb b WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.chr = b.chr AND h.strand = b.strand AND h.sr = b.s AND h.er = b.e)""",
    "rng": "SELECT row_number() OVER (ORDER BY strand, chr, s, e) AS cluster, chr, strand, s, e FROM fold",
    "span": """SELECT t.sample, t.chr, t.strand, r.cluster, min(t."start") AS s, max(t."end") AS e FROM tc t JOIN rng r ON t.chr = r.chr AND t.strand = r.strand AND t.dominant_tss BETWEEN r.s AND r.e GROUP BY ALL""",
    "cmem": "SELECT m.*, x.cluster FROM merged m JOIN span x ON m.sample = x.sample AND m.chr = x.chr AND m.strand = x.strand AND m.pos BETWEEN x.s AND x.e",
    "cc": f"SELECT *, q_0_9 - q_0_1 + 1 AS interquantile_width FROM ({_stats('cmem', AXIS + ', cluster')})",
    "core": "SELECT c.sample, c.cluster, c.interquantile_width AS w, m.tags / sum(m.tags) OVER (PARTITION BY c.sample, c.cluster) AS p FROM cc c JOIN merged m ON m.sample = c.sample AND m.chr = c.chr AND m.strand = c.strand AND m.pos BETWEEN c.q_0_1 AND c.q_0_9",
    "pss": "SELECT sample, cluster, round(-sum(p * log2(p)) * log2(any_value(w)), 6) + 0.0 AS shape_score FROM core GROUP BY sample, cluster",
    "gene": f"""SELECT chr, strand, 'G' || p_partkey || '_' || chr || strand AS gene_id, CASE WHEN strand = '+' THEN 1000 * p_partkey + 300 ELSE 1000 * p_partkey - 300 - wd END AS s,
      CASE WHEN strand = '+' THEN 1000 * p_partkey + 300 + wd ELSE 1000 * p_partkey - 300 END AS e
      FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1000 ELSE 600 END AS wd FROM part WHERE p_partkey BETWEEN 1 AND 199 AND p_partkey % 3 = 0), (VALUES {GENES}) c(chr), (VALUES ('+'), ('-')) st(strand)""",
    "gp": """SELECT *, row_number() OVER w AS ordinal, s - coalesce(lag(e) OVER w, 0) AS dis, coalesce(lag(e - s + 1) OVER w, 1000) AS nw, coalesce(lead(s) OVER w, 1000) - s AS gap FROM gene WHERE strand = '+' WINDOW w AS (PARTITION BY chr ORDER BY s, gene_id)
      UNION ALL SELECT *, row_number() OVER w, coalesce(lead(s) OVER w, e + 1000) - e, coalesce(lead(e - s + 1) OVER w, 1000), e - coalesce(lag(e) OVER w, 1000) FROM gene WHERE strand = '-' WINDOW w AS (PARTITION BY chr ORDER BY e, s, gene_id)""",
    "gu": "SELECT *, CASE WHEN dis > 1500 THEN 1500 WHEN dis + nw <= 500 THEN dis + nw - 1 WHEN dis < 500 THEN 500 ELSE dis END AS up FROM gp",
    "gw": """SELECT gene_id, chr, strand, ordinal, CASE WHEN strand = '+' THEN s - up + 1 ELSE e - down END AS w_start, CASE WHEN strand = '+' THEN s + down ELSE e + up - 1 END AS w_end FROM (
      SELECT *, CASE WHEN (strand = '+' AND gap > their) OR (strand = '-' AND gap >= their) THEN 0 WHEN gap < their THEN 0 ELSE gap - their END AS down FROM (
      SELECT *, coalesce(CASE WHEN strand = '+' THEN lead(up) OVER w ELSE lag(up) OVER w END, 1000) AS their FROM gu WINDOW w AS (PARTITION BY chr, strand ORDER BY ordinal)))""",
    "ann": """SELECT c.*, g.gene, b.in_coding FROM cc c
      LEFT JOIN (SELECT c.sample, c.cluster, arg_min(w.gene_id, w.ordinal) AS gene FROM cc c JOIN gw w ON c.chr = w.chr AND c.strand = w.strand AND c.dominant_tss BETWEEN w.w_start AND w.w_end GROUP BY ALL) g USING (sample, cluster)
      LEFT JOIN (SELECT c.sample, c.cluster, arg_min(x.gene_id, x.s) AS in_coding FROM cc c JOIN gene x ON c.chr = x.chr AND c.strand = x.strand AND c.dominant_tss BETWEEN x.s AND x.e GROUP BY ALL) b USING (sample, cluster)""",
    "cnt": """SELECT a.sample AS merged, a.cluster, a.gene, t.sample, sum(t.tags) AS "count" FROM ann a JOIN tss t ON a.chr = t.chr AND a.strand = t.strand AND t.pos BETWEEN a."start" AND a."end"
      AND a.sample = CASE WHEN t.sample IN ('S0', 'S1') THEN 'control' ELSE 'treat' END WHERE a.gene IS NOT NULL GROUP BY ALL""",
    "gcnt": """SELECT gene, sample, sum("count") AS "count" FROM cnt GROUP BY ALL""",
    "joined": """SELECT cluster, strand, coalesce(x.gene, y.gene) AS gene, greatest(coalesce(x.dominant_tss, 0), coalesce(y.dominant_tss, 0)) AS dom, coalesce(x.tags, 0) AS tx, coalesce(y.tags, 0) AS ty
      FROM (SELECT * FROM ann WHERE sample = 'control' AND gene IS NOT NULL) x FULL JOIN (SELECT * FROM ann WHERE sample = 'treat' AND gene IS NOT NULL) y USING (cluster, strand)""",
    "rk": """SELECT *, row_number() OVER (PARTITION BY gene ORDER BY ty DESC, cluster) AS ry, row_number() OVER (PARTITION BY gene ORDER BY tx DESC, ty DESC, cluster) AS rx FROM joined
      WHERE gene IN (SELECT gene FROM joined GROUP BY gene HAVING count(*) >= 2 AND sum(tx) > 0 AND sum(ty) > 0)""",
    "two": """SELECT r.*, row_number() OVER (PARTITION BY r.gene ORDER BY CASE WHEN strand = '+' THEN -dom ELSE dom END, rx) AS k FROM rk r JOIN (SELECT gene, rx AS lead_rx FROM rk WHERE ry = 1) l USING (gene) WHERE ry = 1 OR rx = CASE WHEN lead_rx = 1 THEN 2 ELSE 1 END""",
    "sh": """SELECT gene, max(CASE WHEN k = 1 THEN tx END) AS a, max(CASE WHEN k = 1 THEN ty END) AS b, max(CASE WHEN k = 2 THEN tx END) AS c, max(CASE WHEN k = 2 THEN ty END) AS d FROM two GROUP BY gene""",
    "unas": "SELECT *, lead(strand) OVER w AS strand_p, lead(cluster) OVER w AS cluster_p, lead(dominant_tss) OVER w AS dominant_tss_p, lead(tags) OVER w AS tags_p FROM ann WHERE gene IS NULL WINDOW w AS (PARTITION BY sample, chr ORDER BY dominant_tss, cluster)",
    "pairs": "SELECT *, row_number() OVER (PARTITION BY sample, chr ORDER BY dominant_tss, cluster) AS enhancer, (tags_p - tags) / (tags_p + tags) AS d FROM unas WHERE strand = '-' AND strand_p = '+' AND dominant_tss_p - dominant_tss <= 400",
    "tops": "SELECT sample, chr, gene, min(dominant_tss) AS t FROM (SELECT *, row_number() OVER (PARTITION BY sample, chr, gene ORDER BY tags DESC, cluster) AS r FROM ann WHERE gene IS NOT NULL) WHERE r = 1 GROUP BY ALL",
    "nm": "SELECT * REPLACE (CASE WHEN gene IS NULL THEN in_coding END AS in_coding), coalesce(gene, in_coding) AS r FROM ann",
    "best": "SELECT sample, r, dominant_tss AS lead, tags AS top FROM (SELECT *, row_number() OVER (PARTITION BY sample, r ORDER BY tags DESC, cluster) AS k FROM nm WHERE r IS NOT NULL) WHERE k = 1",
}
COLS = 'sample, cluster, chr, "start", "end", strand, dominant_tss, round(tags, 6) + 0.0 AS tags, round(tags_dominant_tss, 6) + 0.0 AS tags_dominant_tss, q_0_1, q_0_9, interquantile_width'
SITE = "sample, chr, pos, strand, tags"


def _cutoff_case() -> str:
    """The Poisson cutoff is the smallest x with P(X > x) <= 0.01; lambda is a third of a tag per base at most here, so a short sum of terms does."""
    lam = "(library_size / 2400000.0)"
    terms, cases = "1.0", []
    fact = 1
    for x in range(60):
        if x:
            fact *= x
            terms += f" + pow({lam}, {x}) / {fact}.0"
        cases.append(f"WHEN exp(-{lam}) * ({terms}) >= 1 - 0.01 THEN {x}")
    return "CASE " + " ".join(cases) + " END"


CHI2 = """SELECT gene, a, b, c, d, pow(greatest(abs(a - ea) - y, 0), 2) / ea + pow(greatest(abs(b - eb) - y, 0), 2) / eb + pow(greatest(abs(c - ec) - y, 0), 2) / ec + pow(greatest(abs(d - ed) - y, 0), 2) / ed AS chi2
      FROM (SELECT *, least(0.5, abs(a - ea)) AS y FROM (SELECT *, (a + b) * (a + c) / nullif(a + b + c + d, 0) AS ea, (a + b) * (b + d) / nullif(a + b + c + d, 0) AS eb, (c + d) * (a + c) / nullif(a + b + c + d, 0) AS ec, (c + d) * (b + d) / nullif(a + b + c + d, 0) AS ed FROM sh))"""
# erf(x) = 2 / sqrt(pi) * sum of exp(-x^2) 2^n x^(2n+1) / (2n+1)!!, whose terms are all positive; (2n+1)!! = (2n+1)! / (2^n n!).
TAIL = """CASE WHEN chi2 IS NULL THEN NULL WHEN chi2 = 0 THEN 1.0 WHEN chi2 > 80 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200),
      lambda n: exp(-chi2 / 2 + 2 * n * ln(2.0) + (2 * n + 1) * ln(sqrt(chi2 / 2)) + lgamma(n + 1.0) - lgamma(2.0 * n + 2)))) END"""


def _adjusted(source: str, p: str) -> str:
    """SELECT of source with padj, by Benjamini and Hochberg; null p stay out."""
    return f"""SELECT * EXCLUDE (n, r), least(1.0, min({p} * n / r) OVER (ORDER BY {p} DESC RANGE UNBOUNDED PRECEDING)) AS padj
      FROM (SELECT *, count(*) OVER () AS n, count(*) OVER (ORDER BY {p} RANGE UNBOUNDED PRECEDING) AS r FROM ({source}) WHERE {p} IS NOT NULL)"""


FINAL = {
    "tss_counts": f"SELECT {SITE} FROM tss",
    "tss_wide_pivot": "SELECT chr, pos, strand, " + ", ".join(f"coalesce(sum(CASE WHEN sample = 'S{i}' THEN tags END), 0.0) AS S{i}" for i in range(4)) + " FROM tss GROUP BY chr, pos, strand",
    "library_sizes": "SELECT sample, library_size FROM lib",
    "merge_samples": f"SELECT {SITE} FROM merged",
    "normalize_tpm": f"SELECT {SITE} FROM tpm",
    "filter_poisson": f"SELECT {SITE} FROM tpm WHERE n >= {_cutoff_case()}",
    "filter_tpm": f"SELECT {SITE} FROM tpm WHERE tags >= 60",
    "peaks": f"SELECT {SITE} FROM pk WHERE is_peak",
    "local_filter": f"SELECT {SITE} FROM noise WHERE above IS NULL OR tags >= above * CAST(0.2 AS DOUBLE)",
    "tag_clusters": f"SELECT {COLS} FROM tc",
    "cluster_quantiles": "SELECT sample, cluster, q_0_1, q_0_9, interquantile_width FROM tc",
    "consensus_ranges": 'SELECT cluster, chr, strand, s AS "start", e AS "end" FROM rng',
    "consensus_clusters": f"SELECT {COLS} FROM cc",
    "shape_pss": "SELECT * FROM pss",
    "shape_si": "SELECT sample, cluster, round(2 + sum(p * log2(p)), 6) + 0.0 AS shape_score FROM core GROUP BY sample, cluster",
    "promoter_windows": "SELECT gene_id, chr, strand, ordinal, w_start, w_end FROM gw",
    "annotate_assigned": f"SELECT {COLS}, gene, in_coding FROM ann WHERE gene IS NOT NULL",
    "annotate_unassigned": f"SELECT {COLS}, gene, in_coding FROM ann WHERE gene IS NULL",
    "annotate_in_coding": "SELECT sample, cluster, in_coding FROM ann WHERE in_coding IS NOT NULL",
    "annotate_filtered": f"SELECT {COLS.replace('sample,', 'n.sample,', 1)}, gene, in_coding FROM nm n LEFT JOIN best b ON n.sample = b.sample AND n.r = b.r WHERE n.r IS NULL OR NOT (CASE WHEN strand = '+' THEN dominant_tss > lead ELSE dominant_tss < lead END AND tags < top * CAST(0.5 AS DOUBLE))",
    "enhancers": """SELECT sample, enhancer, cluster AS cluster_m, cluster_p, chr, dominant_tss AS dominant_tss_m, dominant_tss_p, tags AS tags_m, tags_p, round(d, 6) + 0.0 AS d FROM pairs p WHERE d > -0.8 AND d < 0.8
      AND NOT EXISTS (SELECT 1 FROM tops t WHERE t.sample = p.sample AND t.chr = p.chr AND (abs(p.dominant_tss - t.t) <= 400 OR abs(p.dominant_tss_p - t.t) <= 400))""",
    "cluster_tag_counts": 'SELECT merged, cluster, gene, sample, "count" FROM cnt',
    "gene_tag_counts": 'SELECT gene, sample, "count" FROM gcnt',
    "size_factors": """SELECT sample, round(exp(median(l - m)), 6) + 0.0 AS size_factor FROM (SELECT *, ln("count") AS l, avg(ln("count")) OVER (PARTITION BY gene) AS m, count(*) OVER (PARTITION BY gene) AS n FROM gcnt) WHERE n = 4 GROUP BY sample""",
    "shift_ds": "SELECT gene, round(log2(((b + 0.1) / (d + 0.1)) / ((a + 0.1) / (c + 0.1))), 6) + 0.0 AS ds FROM sh",
    "shift_chi2_stat": """SELECT gene, round(pow(greatest(abs(a - ea) - y, 0), 2) / ea + pow(greatest(abs(b - eb) - y, 0), 2) / eb + pow(greatest(abs(c - ec) - y, 0), 2) / ec + pow(greatest(abs(d - ed) - y, 0), 2) / ed, 6) + 0.0 AS chi2
      FROM (SELECT *, least(0.5, abs(a - ea)) AS y FROM (SELECT *, (a + b) * (a + c) / nullif(a + b + c + d, 0) AS ea, (a + b) * (b + d) / nullif(a + b + c + d, 0) AS eb, (c + d) * (a + c) / nullif(a + b + c + d, 0) AS ec, (c + d) * (b + d) / nullif(a + b + c + d, 0) AS ed FROM sh))""",
    "shift_padj": f"""SELECT 'control_VS_treat' AS comparison, gene, round(log2(((b + 0.1) / (d + 0.1)) / ((a + 0.1) / (c + 0.1))), 6) + 0.0 AS ds, round(pval, 6) + 0.0 AS pval, round(padj, 6) + 0.0 AS padj
      FROM ({_adjusted(f"SELECT *, {TAIL} AS pval FROM ({CHI2})", "pval")}) WHERE padj <= 0.01""",
    "volcano_classes": f"""SELECT comparison, gene, round(log2_fold_change, 6) + 0.0 AS log2_fold_change, round(-log10(pvalue), 6) + 0.0 AS neg_log10_p,
      CASE WHEN padj < 0.05 AND abs(log2_fold_change) > 1 THEN 'both' WHEN padj < 0.05 THEN 'significant' WHEN abs(log2_fold_change) > 1 THEN 'changed' ELSE 'none' END AS class
      FROM ({_adjusted("SELECT 'control_VS_treat' AS comparison, CAST(c_custkey AS VARCHAR) AS gene, (c_custkey * 31 % 97 - 48) / 12.0 AS log2_fold_change, pow((c_custkey * 7919 % 10007 + 1) / 10008.0, 2) AS pvalue FROM customer", "pvalue")})""",
    "bh_adjust": """SELECT c_custkey, round(p, 6) + 0.0 AS p, round(least(1.0, min(p * n / r) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) + 0.0 AS padj
      FROM (SELECT c_custkey, p, count(*) OVER () AS n, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS r FROM (SELECT c_custkey, (c_custkey * 7919 % 10007 + 1) / 10008.0 AS p FROM customer))""",
    "correlation": "SELECT v.a AS sample_a, v.b AS sample_b, round(v.r, 2) AS pearson FROM (SELECT " + ", ".join(f"corr(S{i}, S{j}) AS r{i}{j}" for i in range(4) for j in range(i + 1, 4)) + " FROM (SELECT chr, pos, strand, " + ", ".join(f"coalesce(sum(CASE WHEN sample = 'S{i}' THEN tags END), 0.0) AS S{i}" for i in range(4)) + " FROM tss GROUP BY ALL)) q, LATERAL (VALUES " + ", ".join(f"('S{i}', 'S{j}', r{i}{j})" for i in range(4) for j in range(i + 1, 4)) + ") v(a, b, r)",
    "interquantile_hist": "SELECT sample, CAST(floor(interquantile_width / 5.0) AS BIGINT) AS bin, count(*) AS n FROM cc WHERE tags >= 1 AND interquantile_width <= 200 GROUP BY ALL",
    "shape_hist": "SELECT sample, CAST(floor(shape_score / 0.5) AS BIGINT) AS bin, count(*) AS n FROM pss GROUP BY ALL",
    "bed12": """SELECT sample, chr, "start" - 1 AS chrom_start, "end" AS chrom_end, '.' AS name, 0 AS score, strand, dominant_tss - 1 AS thick_start, dominant_tss AS thick_end, 0 AS item_rgb, nb AS block_count,
      CASE WHEN l AND r THEN '1,' || w || ',1' WHEN l THEN '1,' || w WHEN r THEN w || ',1' ELSE CAST("end" - "start" + 1 AS VARCHAR) END AS block_sizes,
      CASE WHEN l AND r THEN '0,' || (q_0_1 - "start") || ',' || ("end" - "start") WHEN l THEN '0,' || (q_0_1 - "start") WHEN r THEN '0,' || ("end" - "start") ELSE '0' END AS block_starts
      FROM (SELECT *, q_0_1 > "start" AS l, q_0_9 < "end" AS r, CAST(q_0_9 - q_0_1 + 1 AS VARCHAR) AS w, CAST(1 + CAST(q_0_1 > "start" AS INT) + CAST(q_0_9 < "end" AS INT) AS INT) AS nb FROM cc)""",
    "bedgraph": "SELECT sample, chr, pos - 1 AS start0, pos AS \"end\", CASE WHEN strand = '+' THEN tags ELSE -tags END AS score FROM merged",
    "locus_sites": "SELECT g.gene_id, m.sample, m.chr, m.pos, m.strand, CASE WHEN m.strand = '-' THEN -m.tags ELSE m.tags END AS tags FROM merged m JOIN gene g ON m.chr = g.chr AND m.pos BETWEEN g.s - 500 AND g.e + 500 WHERE g.gene_id LIKE 'G30!_%+' ESCAPE '!'",
}


def oracle_sql() -> dict[str, str]:
    """Each final SELECT under the CTEs that it needs."""
    order = list(CTE)
    words = {n: set(re.findall(r"\b\w+\b", s)) for n, s in CTE.items()}
    out = {}
    for name, final in FINAL.items():
        need, todo = set(), re.findall(r"\b\w+\b", final)
        while todo:
            w = todo.pop()
            if w in CTE and w not in need:
                need.add(w)
                todo += words[w]
        ctes = ", ".join(f"{n} AS ({CTE[n]})" for n in order if n in need)
        out[name] = f"WITH {ctes} {final}" if ctes else final
    return out
