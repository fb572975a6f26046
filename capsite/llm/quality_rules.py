"""Quality rules of documents and of their hosts.

Each document is measured once. Base rules (too few words, too many repeated five-word windows) decide
alone. Milder rules (symbols, repeated lines, odd word length) only count as failures of the document's
host: failures are summed by host, the rates shrunk towards an empirical beta prior fitted to all hosts by
moments, and a host whose shrunk rate has ``host_limit`` times the odds of the mean rate is joined back: its documents
that break a milder rule go as well. A clean document is kept wherever it stands.

Defined cases: null text has no words and fails; a null host is a host of its own; empty tables give empty
results; repeated rows count as often as they stand there; texts may be of any length.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from capsite.llm.common import staged, text_bytes

SYMBOLS = b"#*$%&|<>"  # fixed values
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: Odds of failing, relative to the mean over all documents.
HOST_LIMIT = 3.0
#: Bad hosts up to this number are broadcast; more are joined by a shuffle.
FEW_HOSTS = 100_000
#: Milder rules, as percentages.
SYMBOL_PERCENT, LINE_PERCENT, SHORT_WORD, LONG_WORD = 10, 30, 2, 20
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*FIELDS, "n_lines"]
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(islice(words, i, None) for i in range(size))))
    if len(set(windows)) == n:
        return 0
    count = Counter(windows)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + size - max(i, end)
            end = i + size
    return total


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The five counts of a document, and its lines with a word."""
    words = text.split()
    seen: set[bytes] = set()
    repeats = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            if line in seen:
                repeats += 1
            else:
                seen.add(line)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return len(words), len(b"".join(words).translate(None, _CONTINUATION)), symbols, repeats, repeated_words(words), repeats + len(seen)


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, host, the counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [measure(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(len(MEASURES))]], ["doc_id", "host", *MEASURES])

    cols = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(host).cast("string").alias("host"), text_bytes(text).alias("text"))
    return cols.mapInArrow(run, "doc_id bigint, host string, " + ", ".join(f"{f} bigint" for f in MEASURES))


def host_verdicts(rated: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_docs, host_rate, host_bad): failure rates shrunk by the prior that all hosts give.

    rated: (host, failed). The prior's mean m and strength s come from one row: the mean and variance of the
    hosts' rates weighted by documents; s = m (1 - m) / variance - 1, within [1, 1000].
    """
    hosts = rated.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("failed").cast("bigint")).alias("_k"))
    rate = F.col("_k") / F.col("host_docs")
    sums = hosts.agg(F.sum("host_docs").alias("n"), F.sum("_k").alias("k"), F.sum(F.col("_k") * rate).alias("q")).first()
    n = sums["n"] or 0
    mean = (sums["k"] / n) if n else 0.0
    var = max(sums["q"] / n - mean * mean, 0.0) if n else 0.0
    strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1000.0) if var > 0 else 1000.0
    shrunk = (F.col("_k") + F.lit(mean * strength)) / (F.col("host_docs") + F.lit(strength))
    worse = shrunk * (1 - F.lit(mean)) > F.lit(host_limit * mean) * (1 - shrunk)
    return hosts.select("host", "host_docs", shrunk.alias("host_rate"), worse.alias("host_bad"))


def _rules(c: dict[str, Column]) -> tuple[Column, Column]:
    """Whether the base rules and the milder ones fail."""
    base = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
    mild = (100 * c["n_symbols"] > SYMBOL_PERCENT * c["word_chars"]) | (100 * c["n_dup_lines"] > LINE_PERCENT * c["n_lines"]) | (c["word_chars"] < SHORT_WORD * c["n_words"]) | (c["word_chars"] > LONG_WORD * c["n_words"])
    return base, mild


def _judged(counts: DataFrame) -> DataFrame:
    base, mild = _rules({f: F.col(f) for f in MEASURES})
    return counts.withColumn("base_failed", base).withColumn("mild_failed", mild).withColumn("failed", base | mild)


@F.pandas_udf(StructType([StructField(f, LongType()) for f in MEASURES]))
def _measure_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=MEASURES, dtype="int64")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """(doc_id, the five counts, base_failed, kept, host, mild_failed, host_rate, host_bad) of every row."""
    counts = staged(measured(docs, doc_id, text, host), "quality")
    rated = _judged(counts)
    verdicts = host_verdicts(rated, host_limit)
    joined = rated.join(verdicts, rated["host"].eqNullSafe(verdicts["host"]), "left").drop(verdicts["host"])
    return joined.select("doc_id", *FIELDS, "base_failed", (~F.col("base_failed") & ~(F.col("host_bad") & F.col("mild_failed"))).alias("kept"), "host", "mild_failed", "host_rate", "host_bad")


def keep_good(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows that the rules keep, with all columns of docs.

    Rows are judged where they stand, so ids may repeat or be null: each is measured once and staged with its
    counts; hosts are summed up from these, and the few bad ones looked up.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _measure_udf(text_bytes(text)).alias("counts"), F.col(host).cast("string").alias("own"))
    rows = staged(rows, "measured")
    bad = staged(host_verdicts(_judged(rows.select(F.col("own").alias("host"), "counts.*")), host_limit).filter("host_bad").select("host"), "hosts")
    verdicts = bad.select(F.col("host").alias("_host"), F.lit(True).alias("_bad"))
    if bad.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS:
        verdicts = F.broadcast(verdicts)
    base, mild = _rules({f: F.col(f"counts.{f}") for f in MEASURES})
    rows = rows.filter(~base).join(verdicts, F.col("own").eqNullSafe(F.col("_host")), "left")
    return rows.filter(~(F.coalesce("_bad", F.lit(False)) & mild)).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines, text FROM d),
wn AS (SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wn) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(0, 5) r(j) GROUP BY doc_id),
ln AS (SELECT doc_id, sum(c - 1) AS n, sum(c) AS lines FROM (SELECT doc_id, line, count(*) AS c FROM (SELECT doc_id, unnest(lines) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, coalesce(ln.lines, 0) AS n_lines FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rw USING (doc_id)),
r AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS mild_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(CASE WHEN base_failed OR mild_failed THEN 1 ELSE 0 END) AS k FROM r GROUP BY host),
p AS (SELECT CAST(sum(k) AS DOUBLE) / sum(n) AS mean, greatest(sum(k * (CAST(k AS DOUBLE) / n)) / sum(n) - (CAST(sum(k) AS DOUBLE) / sum(n)) * (CAST(sum(k) AS DOUBLE) / sum(n)), 0) AS var FROM h),
s AS (SELECT mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 1), 1000) ELSE 1000 END AS strength FROM p),
v AS (SELECT host, mean, (k + mean * strength) / (n + strength) AS host_rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (host_rate * (1 - mean) > 3 * mean * (1 - host_rate) AND mild_failed) AS kept
FROM r JOIN v ON r.host IS NOT DISTINCT FROM v.host
"""
