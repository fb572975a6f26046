"""Connected components of an edge table by alternating large-star and small-star steps, staged each round."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from capsite.llm.common import staged


#: Edges that one task may solve (16 bytes each); more are solved by rounds over all tasks.
FEW_EDGES = 500_000


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches if x.num_rows]
    if not held:
        return
    v, u = (np.concatenate(c) for c in zip(*held))
    nodes, index = np.unique(np.concatenate([v, u]), return_inverse=True)
    i, j = index[: len(v)], index[len(v) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """(node, root) of bigint edges: root is the least node of the component; nodes without edges don't appear.

    Both steps are a grouped minimum (combined before the shuffle) joined back to the edges; a join that a hub
    makes uneven is split by AQE. Rounds grow with the logarithm of the longest path and end when nothing moves.
    """
    u, v = F.col(a), F.col(b)
    edges = staged(edges.filter(u != v).select(F.greatest(u, v).alias("v"), F.least(u, v).alias("u")).distinct(), "edges")
    if edges.limit(few + 1).count() <= few:
        return staged(edges.coalesce(1).mapInArrow(_in_one_task, "node bigint, root bigint"), "roots")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(F.col("v").alias("hub")).agg(F.least(F.min("u"), F.first("v")).alias("m"))
        # Large star: a hub's larger neighbours move to its least one; small star then does so for the smaller ones.
        large = edges.join(least, edges["u"] == least["hub"]).select("v", F.col("m").alias("u")).distinct()
        own = large.groupBy(F.col("v").alias("hub")).agg(F.min("u").alias("m"))
        small = large.join(own, large["v"] == own["hub"]).select(F.col("u").alias("x"), "v", "m")
        moved = small.filter(F.col("x") != F.col("m")).select(F.col("x").alias("v"), F.col("m").alias("u"))
        edges = staged(moved.unionByName(small.select("v", F.col("m").alias("u"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (now["n"], now["x"]) == mark:
            break
        mark = (now["n"], now["x"])
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
