"""Self join of documents by the Jaccard similarity of their five-word shingles, through a MinHash LSH forest.

Copies (equal texts) form one node. A node has DEPTH MinHashes in each of TREES trees; nodes of a tree that share a
prefix of them are one subtree of its sorted trie, and counts of nodes by prefix tell how large subtrees are.
Every node begins with its full prefixes and shortens them one at a time, where that brings the fewest further
nodes for the recall it gains, until a pair at the threshold would be met with the target recall:
1 - product over trees of (1 - s ** length). So dense subtrees are searched deep, sparse ones from near the root.

The searched subtrees are buckets; buckets with the same members are one. Pairs are verified bucket by bucket, in
blocks of bounded size, and a pair that shares several buckets in the least of them only. Verification is exact:
words of a block are numbered, shingles are compared as tuples of these numbers, and counts of common shingles
come from a matrix over the shingles that several texts have. Blocks give numbers of links and one tie per node, not pairs.

Defined cases: words are runs of other than ASCII white space; a text of one to four words is one shingle; a
text without words (null included) has no links; rows keep their null ids; repeated rows are copies; texts may be of
any length (a block of long texts is large only by the texts' own size).
"""
from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from capsite.llm.anchors import _GRAM, mix, numbered
from capsite.llm.common import PIECE, staged, text_bytes
from capsite.llm.components import components

SHINGLE = 5
SIMILARITY = (4, 5)  # as a fraction
TREES, DEPTH = 20, 7
#: Prefixes are not shortened further, as this length reaches the target in any case.
SHORTEST = 3
RECALL = 0.999
#: Nodes of a block; larger buckets are verified by pairs of blocks.
BLOCK = 512
#: Candidate nodes up to this number are broadcast (some hundred bytes each); more are joined by a shuffle.
FEW = 100_000
U = np.uint64


def prefix_length(similarity: float, trees: int = TREES, depth: int = DEPTH - 1, recall: float = RECALL) -> int:
    """Longest prefix at which ``trees`` trees searched alike reach the target recall, at least 1."""
    for k in range(depth, 1, -1):
        if 1 - (1 - similarity**k) ** trees >= recall:
            return k
    return 1


def shortened(sizes: np.ndarray, similarity: float, recall: float = RECALL) -> np.ndarray:
    """Prefix lengths for each node and tree. sizes[i, t, j]: nodes that share the prefix of length least + j with node i in tree t.

    The last length is the full one; sizes fall along it. The next step is the one with the most gain in the logarithm of the chance
    to miss a pair for each node more to compare, the first tree of equals.
    """
    n, trees, depths = sizes.shape
    least = DEPTH - depths + 1
    miss = np.log1p(-(similarity ** np.arange(least, DEPTH + 1)))
    at = np.full((n, trees), depths - 1)
    row, tree = np.arange(n)[:, None], np.arange(trees)[None, :]
    while True:
        short = np.flatnonzero((miss[at].sum(1) > math.log(1 - recall)) & (at.max(1) > 0))
        if not len(short):
            return at + least
        here = at[short]
        next_ = np.maximum(here - 1, 0)
        more = sizes[row[short], tree, next_] - sizes[row[short], tree, here]
        worth = np.where(here > 0, (miss[here] - miss[next_]) / (more + 1e-3), -1.0)
        at[short, worth.argmax(1)] -= 1


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of each text, for signatures only, and where each text begins."""
    words = [t.split() for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    bounds = np.concatenate([[0], np.cumsum(n)])
    _, word = numbered([x for w in words for x in w])
    full = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), full)
    place = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + bounds[row]
    h = np.zeros(len(place), np.uint64)
    padded = np.append(word, np.zeros(SHINGLE, np.uint64))
    for j in range(SHINGLE):
        h += np.where(place + j < bounds[row + 1], padded[place + j], U(0)) * _GRAM[j]
    return mix(h), np.concatenate([[0], np.cumsum(full)])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingles of each text as numbers that are equal exactly where shingles are."""
    known: defaultdict[bytes, int] = defaultdict(count(1).__next__)  # 0 fills up shingles of short texts
    rows = []
    for t in texts:
        ids = np.fromiter(map(known.__getitem__, t.split()), np.int64)
        rows.append(np.pad(ids, (0, SHINGLE - len(ids))) if 0 < len(ids) < SHINGLE else ids)
    n = np.array([len(r) for r in rows], np.int64)
    ids = np.concatenate([*rows, np.zeros(SHINGLE, np.int64)])
    code = ids
    for j in range(1, SHINGLE):  # numbers of ever longer tuples
        tail = ids[j : j + len(code) - 1]
        code = np.unique(code[: len(tail)] * (len(known) + 1) + tail, return_inverse=True)[1].reshape(-1)
    bounds = np.concatenate([[0], np.cumsum(n)])
    return [np.unique(code[a : max(b - SHINGLE + 1, a)]) for a, b in zip(bounds[:-1], bounds[1:])]


def batches_of(texts: list[bytes], most: int = PIECE) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``most`` bytes together; a longer text stands alone."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """DEPTH MinHashes of each tree for each row; rows without shingles give zeros."""
    a, b = _functions()
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.zeros((len(at) - 1, TREES * DEPTH), np.uint32)
    for k in range(TREES * DEPTH if len(full) else 0):
        out[full, k] = (np.minimum.reduceat(h * a[k] + b[k], at[full]) >> U(32)).astype(np.uint32)
    return out


def verify(sets: list[np.ndarray], left: np.ndarray, similarity: tuple[int, int] = SIMILARITY, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set and the least place in its tied group; left marks the first block where only cross pairs count.

    Where all are of one block (left all true) every pair counts. skip: pairs that count elsewhere.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    both = np.zeros((n, n), np.float32)
    row = np.repeat(np.arange(n), size)
    values, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[inverse] > 1
    row, column = row[shared], inverse[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, total, 2048):
        i, j = np.searchsorted(column, (c, c + 2048))
        m = np.zeros((n, min(2048, total - c)), np.float32)
        m[row[i:j], column[i:j] - c] = 1
        both += m @ m.T
    both = both.astype(np.int64)
    num, den = similarity
    linked = den * both >= num * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, False)
    if not left.all():
        linked &= left[:, None] != left[None, :]
    if skip is not None:
        linked &= ~skip
    root = np.arange(n)
    while True:  # least place over links and over the ties found so far
        near = np.where(linked, root[None, :], n).min(1) if n else root
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return linked.sum(1), root
        root = new


def node_of(text: str):
    """128 bits of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, node, sig): node names the text, sig holds its MinHashes, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs: list = []
            for texts in batches_of(batch.column(2).to_pylist()):
                h, rows = shingle_hashes(texts)
                sigs += [s.tobytes() if n else None for s, n in zip(signatures(h, rows), np.diff(rows))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, pa.binary())], ["doc_id", "node", "sig"])

    body = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_bytes(text).alias("text"))
    return body.select("doc_id", node_of("text").alias("node"), "text").mapInArrow(run, "doc_id bigint, node binary, sig binary")


def _prefixes(nodes: DataFrame, least: int) -> DataFrame:
    """(nid, tree, codes): for each tree a number for each prefix, from the shortest to the full one."""
    depths = DEPTH - least + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, TREES, DEPTH)
            code = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (n, TREES)).copy()
            codes = []
            for k in range(DEPTH):
                code = mix(code * U(0x9E3779B97F4A7C15) + sig[:, :, k])
                if k + 1 >= least:
                    codes.append(code.copy())
            flat = np.stack(codes, 2).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * TREES * depths + 1, depths, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), TREES)), pa.array(np.tile(np.arange(TREES), n)), lists], ["nid", "tree", "codes"])

    return nodes.select("nid", "sig").mapInArrow(run, "nid bigint, tree bigint, codes array<bigint>")


def _searched(sized: DataFrame, similarity: float, recall: float, least: int) -> DataFrame:
    """(code): the subtrees that some node searches. sized: (nid, tree, k, code, n) of subtrees of two nodes or more."""
    depths = DEPTH - least + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
            tree, k, code, n = (held.flatten().field(c).to_numpy() for c in ("tree", "k", "code", "n"))
            sizes = np.ones((batch.num_rows, TREES, depths), np.int64)
            sizes[row, tree, k] = n
            length = shortened(sizes, similarity, recall)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(code[length[row, tree] == k + least]))], ["code"])

    per_node = sized.groupBy("nid").agg(F.collect_list(F.struct("tree", "k", "code", "n")).alias("held"))
    return per_node.mapInArrow(run, "code bigint").distinct()


def buckets(nodes: DataFrame, similarity: float = SIMILARITY[0] / SIMILARITY[1], recall: float = RECALL) -> DataFrame:
    """(nid, held): the buckets (code, n) of each node (nid, sig) that meets others.

    Counts by prefix are summed up before the shuffle; joins on a prefix that many nodes share are split by AQE.
    """
    least = min(SHORTEST, prefix_length(similarity, recall=recall))
    rows = _prefixes(nodes.filter(F.col("sig").isNotNull()), least).withColumn("top", F.col("codes")[0])
    company = rows.groupBy("top").count().filter("count > 1").select("top")
    rows = staged(rows.join(company, "top").drop("top"), "prefixes")
    level = rows.select("nid", "tree", F.posexplode("codes").alias("k", "code"))
    sized = staged(level.join(level.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "code"), "subtrees")
    own = sized.join(_searched(sized, similarity, recall, least), "code")
    # Below a searched subtree, deeper ones have no pairs of their own.
    own = staged(own.groupBy("nid", "tree").agg(F.min(F.struct("k", "code", "n")).alias("b")).select("nid", "b.code", "b.n"), "buckets")
    same = own.groupBy("code").agg(F.first("n").alias("n"), F.bit_xor(F.xxhash64("nid")).alias("x"), F.bit_xor(F.xxhash64("nid", F.lit(7))).alias("y"), F.min("nid").alias("m"))
    kept = same.groupBy("n", "x", "y", "m").agg(F.min("code").alias("code")).select("code")
    return own.join(kept, "code").groupBy("nid").agg(F.collect_list(F.struct("code", "n")).alias("held"))


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(doc_id, node, copy_id, n_copies, class_id, n_links, root) of every row.

    copy_id is the least id of equal texts and n_copies their number; n_links counts the different texts at
    least as similar as the threshold; class_id is the least id of all rows that links tie together.
    """
    signed = staged(_signed(docs, doc_id, text), "signed")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"), F.first("sig", True).alias("sig"))
    nodes = staged(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")  # written, so the numbers stay
    members = staged(nodes.select("node", "nid").join(buckets(nodes, similarity[0] / similarity[1], recall), "nid"), "members")
    found = staged(_verified(docs, text, F.broadcast(members) if members.limit(few + 1).count() <= few else members, similarity, block), "links")
    links = found.groupBy("nid").agg(F.sum("links").alias("n_links"))
    final = components(found.filter(F.col("nid") != F.col("tie")).select(F.col("nid").alias("a"), F.col("tie").alias("b"))).select(F.col("node").alias("nid"), "root")
    named = nodes.drop("sig").join(links, "nid", "left").join(final, "nid", "left")
    named = staged(named.withColumn("root", F.coalesce("root", "nid")).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("bigint")), "named")
    ids = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    classes = named.join(ids, "root").select("node", "copy_id", "n_copies", "class_id", "n_links", "root")
    return signed.select("doc_id", "node").join(classes, "node").select("doc_id", "node", "copy_id", "n_copies", "class_id", "n_links", "root")


def _verified(docs: DataFrame, text: str, members: DataFrame, similarity: tuple[int, int], block: int) -> DataFrame:
    """(nid, links, tie): a row for each node and pair of blocks in which it was verified."""
    body = docs.select(text_bytes(text).alias("text"))
    held = body.select(node_of("text").alias("node"), "text").join(members, "node")
    fields = "code bigint, b1 bigint, b2 bigint, own bigint, nid bigint, codes array<bigint>, text binary"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.unique(np.asarray(batch.column(0)), return_index=True)[1]))  # one of the copies does
            held = batch.column(1)
            code, n = (held.flatten().field(c).to_numpy() for c in ("code", "n"))
            which = np.repeat(np.arange(batch.num_rows), np.diff(held.offsets.to_numpy()))
            blocks = -(-n // block)
            mine = mix(np.asarray(batch.column(0))[which].astype(np.uint64) + U(1)).astype(np.int64) & ((1 << 62) - 1)
            mine %= blocks
            entry = np.repeat(np.arange(len(which)), blocks)
            other = np.arange(len(entry)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            row = pa.array(which[entry])
            codes = pa.ListArray.from_arrays(held.offsets, pa.array(code)) if held.offset == 0 else pa.array([[r["code"] for r in x] for x in held.to_pylist()], pa.list_(pa.int64()))
            columns = [pa.array(code[entry]), pa.array(np.minimum(mine[entry], other)), pa.array(np.maximum(mine[entry], other)), pa.array(mine[entry]), batch.column(0).take(row), codes.take(row), batch.column(2).take(row)]
            yield pa.RecordBatch.from_arrays(columns, ["code", "b1", "b2", "own", "nid", "codes", "text"])

    def solve(key: tuple[int, int, int], group: list[tuple[int, int, list[int], bytes]]) -> tuple[np.ndarray, ...]:
        nodes = np.array([g[1] for g in group])
        earlier = defaultdict(list)  # pairs that meet in a lesser bucket count there
        for i, g in enumerate(group):
            for c in g[2]:
                if c < key[0]:
                    earlier[c].append(i)
        skip = np.zeros((len(group), len(group)), bool)
        for i in earlier.values():
            skip[np.ix_(i, i)] = True
        links, root = verify(shingle_sets([g[3] for g in group]), np.array([g[0] for g in group]) == key[1], similarity, skip)
        return nodes, links.astype(np.int64), nodes[root]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, list[int], bytes]] = []
        key, done, size = None, [], 0

        def batch_of(parts):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["nid", "links", "tie"])

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for c, b1, b2, own, nid, codes, text in zip(*[batch.slice(i, 256).column(k).to_pylist() for k in range(7)]):
                    if (c, b1, b2) != key:
                        if len(group) > 1:
                            done.append(solve(key, group))
                            size += len(group)
                        if size > 20_000:
                            yield batch_of(done)
                            done, size = [], 0
                        key, group = (c, b1, b2), []
                    if not group or group[-1][1] != nid:  # copies of a text come one after another
                        group.append((own, nid, codes, text))
        if len(group) > 1:
            done.append(solve(key, group))
        if done:
            yield batch_of(done)

    dealt = held.select("nid", "held", "text").mapInArrow(deal, fields).repartition("code", "b1", "b2").sortWithinPartitions("code", "b1", "b2", "nid")
    return dealt.mapInArrow(check, "nid bigint, links bigint, tie bigint")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the least id of each class, all columns kept; of repeated rows one stays.

    A class whose ids are all null keeps the text that its name puts first.
    """
    rows = jaccard_join(docs, doc_id, text)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    winners = rows.groupBy("root").agg(F.min(order).alias("_w")).select(F.col("_w.doc_id").alias("_id"), F.col("_w.node").alias("_node"))
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), node_of(text_bytes(text)).alias("name"), F.col(doc_id).cast("bigint").alias("key"))
    met = own.join(winners.hint("shuffle_hash"), (F.col("name") == F.col("_node")) & F.col("key").eqNullSafe(F.col("_id")))
    first = met.withColumn("nth", F.row_number().over(W.partitionBy("name", "key").orderBy("_node")))
    return first.filter("nth = 1").select("row.*")
