"""Approximate nearest neighbours by inner product, with cross-polytope hashing.

The direction of a vector is turned by pseudo-random rotations (sign flips and fast Hadamard transforms, three
times) and assigned to the nearest signed axis, of which there are twice the padded dimension. Each of TABLES
tables has rotations of its own. A query looks into the axes nearest to it in every table, PROBES for each 64
of padded dimension (so that the share of axes does not fall as the dimension grows); what it finds is ranked
exactly in double precision. Lengths are kept out of the hash: vectors above the LONG quantile of lengths form
a band of their own, which every query meets whole, as the longest win over many directions. A query for which
fewer than ENOUGH candidates turn up meets all vectors of its dimension.

Equal vectors form a class that is hashed and ranked once and stands for its least ids. Buckets are cut into
blocks of bounded size by a hash of the class; a query meets every block of a bucket it probes.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; vectors meet only others of their length; equal scores go to the smaller id; repeated (id, vector)
rows count once; other columns are not read; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import FloatType

from capsite.llm.common import staged

TABLES, PROBES = 16, 9
#: Vectors longer than this share of the others are met whole; lengths this near to it count as equal.
LONG, SAME = 0.9, 1e-4
#: Candidates, in multiples of k + 1, below which a query meets everything.
ENOUGH = 5
#: Numbers that stand for a table: the band of long vectors, and all vectors.
LONGEST, ALL = -1, -2
#: Candidates, and queries, of one block of a bucket.
BLOCK = 4096
SALTS = 16


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    rng = np.random.default_rng(1000 + table)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return x


def axes(x: np.ndarray, table: int, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of each row after the table's rotation, nearest first; axis i is 2 i, its opposite 2 i + 1."""
    y = rotate(x, table)
    both = np.stack([y, -y], 2).reshape(len(y), -1)
    if count == 1:
        return both.argmax(1)[:, None]
    top = np.argpartition(-both, count - 1, 1)[:, :count]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), 1, kind="stable"), 1)


def classes(vectors: DataFrame, vec_id: str, embedding: str, keep: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, v) of vectors that take part, and (key, v, ids) of their classes with the ``keep`` least ids."""
    v = F.col(embedding).cast("array<double>")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v")).filter(F.coalesce(fine, F.lit(False)) & F.col("id").isNotNull())
    # 0.0 and -0.0 are one value
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("key", F.xxhash64("v"))
    salted = W.partitionBy("key", "salt").orderBy("id")
    part = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("n", F.dense_rank().over(salted)).filter(F.col("n") <= keep)
    whole = part.dropDuplicates(["key", "id"]).withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("id"))).filter(F.col("n") <= keep)
    return rows, whole.groupBy("key").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))


def nearest(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, k: int = 20, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by ``every``."""
    kind = "array<float>" if isinstance(vectors.schema[embedding].dataType.elementType, FloatType) else "array<double>"
    rows, grouped = classes(vectors, vec_id, embedding, k + 1)
    asked = rows.filter(F.col("id") % every == 0).select("id", "key").distinct()
    grouped = grouped.join(asked.select("key").distinct().withColumn("asks", F.lit(True)), "key", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    grouped = staged(grouped.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).withColumn("v", F.col("v").cast(kind)), "vectors")
    span = grouped.groupBy(F.size("v").alias("d")).agg(F.percentile_approx("norm2", LONG, 10_000).alias("most"), F.max("norm2").alias("hi")).collect()
    most = {r["d"]: r["most"] * (1 + SAME) for r in span}
    banded = {r["d"] for r in span if r["hi"] > r["most"] * (1 + SAME)}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pc.list_value_length(batch.column(1)))
            for d in map(int, np.unique(size)):
                part = batch.take(pa.array(np.flatnonzero(size == d)))
                asks = np.asarray(part.column(3).to_numpy(zero_copy_only=False))
                far = np.asarray(part.column(4)) > most[d]
                wanted, near = part.filter(pa.array(asks)), part.filter(pa.array(~far))
                if d in banded:
                    for some, wants in ((part.filter(pa.array(far)), False), (wanted, True)):
                        yield _rows(some, d, LONGEST, np.zeros(some.num_rows), wants)
                x = _directions(np.asarray(part.column(1).flatten()).reshape(part.num_rows, d))
                count = min(max(probes, -(-probes * x.shape[1] // 64)), 2 * x.shape[1])
                for t in range(tables):
                    yield _rows(near, d, t, axes(x[~far], t, 1)[:, 0], False)
                    if wanted.num_rows:
                        for code in axes(x[asks], t, count).T:
                            yield _rows(wanted, d, t, code, True)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"q": [], "c": [], "least": [], "score": []}).astype({"q": "int64", "c": "int64", "least": "int64", "score": "float64"})
        q, c = pdf[asks], pdf[~asks].sort_values("least")
        x, y = (np.stack(side["v"].to_numpy()).astype(np.float64) for side in (c, q))
        m = min(k + 1, len(x))
        rough = y @ x.T
        least = np.partition(rough, len(x) - m, 1)[:, len(x) - m]
        # more than what rounding may move
        slack = 1e-12 * x.shape[1] * np.sqrt((y * y).sum(1) * (x * x).sum(1).max())
        i, j = np.nonzero(~(rough < (least - slack)[:, None]))
        score = np.zeros(len(i))
        for a in range(x.shape[1]):  # one component after another: equal pairs get equal sums in every bucket
            score += y[i, a] * x[j, a]
        order = np.lexsort((j, -score, i))
        order = order[np.arange(len(i)) - np.searchsorted(i, i) < m]
        i, j = i[order], j[order]
        return pd.DataFrame({"q": q["key"].to_numpy()[i], "c": c["key"].to_numpy()[j], "least": c["least"].to_numpy()[j], "score": score[order]})

    def ranked(placed: DataFrame, keep: int) -> DataFrame:
        """(q, c, least, score, n): the ``keep`` best that each query meets in its buckets."""
        bucket = ["d", "tab", "code"]
        # A row per bucket: twice the padded dimension for each table.
        counts = placed.groupBy(*bucket).agg((F.count_if("asks") / block).alias("q"), (F.count_if(~F.col("asks")) / block).alias("c"))
        counts = staged(counts.select(*bucket, F.greatest(F.ceil("q"), F.lit(1)).cast("bigint").alias("qb"), F.greatest(F.ceil("c"), F.lit(1)).cast("bigint").alias("cb")), "buckets")
        sized = placed.join(F.broadcast(counts), bucket) if counts.count() <= 100_000 else placed.join(counts, bucket)
        own = F.pmod(F.xxhash64("key"), F.when(F.col("asks"), F.col("qb")).otherwise(F.col("cb")))
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("asks"), F.col("cb")).otherwise(F.col("qb")) - 1))
        dealt = sized.withColumn("own", own).withColumn("other", other)
        dealt = dealt.withColumn("qi", F.when(F.col("asks"), F.col("own")).otherwise(F.col("other"))).withColumn("ci", F.when(F.col("asks"), F.col("other")).otherwise(F.col("own")))
        pairs = dealt.groupBy(*bucket, "qi", "ci").applyInPandas(search, "q bigint, c bigint, least bigint, score double").dropDuplicates(["q", "c"])
        return pairs.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "least"))).filter(F.col("n") <= keep)

    fields = f"d bigint, tab bigint, code bigint, asks boolean, key bigint, v {kind}, least bigint"
    best = ranked(grouped.select("key", "v", F.col("ids")[0].alias("least"), "asks", "norm2").mapInArrow(hashed, fields), ENOUGH * (k + 1))
    best = staged(best, "best")
    enough = best.filter(F.col("n") == ENOUGH * (k + 1)).select(F.col("q").alias("key"))
    short = staged(grouped.filter("asks").join(enough, "key", "left_anti").select("key", "v", "ids"), "short")
    best = best.filter(F.col("n") <= k + 1)
    sizes = [r["d"] for r in short.select(F.size("v").alias("d")).distinct().collect()]
    if sizes:
        every_one = grouped.filter(F.size("v").isin(sizes)).withColumn("asks", F.lit(False)).select("key", "v", "ids", "asks").unionByName(short.withColumn("asks", F.lit(True)))
        every_one = every_one.select(F.size("v").cast("bigint").alias("d"), F.lit(ALL).cast("bigint").alias("tab"), F.lit(0).cast("bigint").alias("code"), "asks", "key", "v", F.col("ids")[0].alias("least"))
        best = best.join(short.select(F.col("key").alias("q")), "q", "left_anti").unionByName(ranked(every_one, k + 1))
    answers = best.join(grouped.select(F.col("key").alias("c"), "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
    answers = answers.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("n") <= k + 1)
    listed = answers.groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("found"))
    out = asked.join(listed, asked["key"] == listed["q"])
    out = out.withColumn("found", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k))
    out = out.select(F.col("id").alias("query_id"), F.posexplode("found").alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def _directions(x: np.ndarray) -> np.ndarray:
    """Rows brought to length one, padded to a power of two."""
    n, d = x.shape
    out = np.zeros((n, 1 << (d - 1).bit_length()))
    # the largest component first: squares may overflow
    out[:, :d] = x / np.abs(x).max(1, keepdims=True).astype(np.float64)
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def _rows(part: pa.RecordBatch, d: int, table: int, code: np.ndarray, asks: bool) -> pa.RecordBatch:
    n = part.num_rows
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int64)), pa.array(np.full(n, table, np.int64)), pa.array(code.astype(np.int64)), pa.array(np.full(n, asks)), part.column(0), part.column(1), part.column(2)], ["d", "tab", "code", "asks", "key", "v", "least"])
