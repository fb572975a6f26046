"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces (documents, cut at the longest length) are dealt to shards by a hash; a shard packs its own in order
of falling size: a piece goes to the open bin that it fills best; without one, the length of least cost per
filled token is opened. The cost of a bin is its length, a fixed overhead and the square of its length over
ATTENTION, as attention costs more in long sequences; what may yet fill it is the volume of pieces that fit beside
this one. So short pieces share short bins and a long bin is opened where a piece needs it. At the end each bin
is cut down to the shortest permitted length that holds its contents. Shards hold about SHARD_TOKENS
tokens, so only a shard's last bins are filled less well, and no task holds more than a shard.

Tokens are those of a byte-level BPE file (bpe.py), or, without a file, words: runs of other than ASCII white space.

Defined cases: null and empty texts have no tokens and no rows; documents of equal size are taken by id,
piece and text, within a shard; repeated rows are packed each for itself; texts of any length are cut into
pieces; of bins with equal room the youngest takes a piece, of equal costs the shorter length; columns other than
id and text are not read.
"""
from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from capsite.llm.bpe import encoder
from capsite.llm.common import staged, text_bytes

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD, ATTENTION = 32, 8192
SHARD_TOKENS = 2_000_000


def bin_cost(length: int, overhead: int = OVERHEAD, attention: int = ATTENTION) -> float:
    return overhead + length + length * length / attention


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, attention: int = ATTENTION) -> list[tuple[int, int, int]]:
    """(bin, start in bin, length of bin) of each size, sizes being given in falling order."""
    longest = lengths[-1]
    below = np.zeros(longest + 1, np.int64)  # tokens of waiting pieces, by size
    for s in sizes:
        below[s] += s
    fenwick = np.zeros(longest + 1, np.int64)  # prefix sums that allow removals
    for i in range(1, longest + 1):
        fenwick[i] += below[i]
        if (j := i + (i & -i)) <= longest:
            fenwick[j] += fenwick[i]

    def waiting(most: int) -> int:
        total = 0
        while most > 0:
            total += fenwick[most]
            most &= most - 1
        return int(total)

    free: list[int] = []  # rooms of open bins, sorted
    by_room: dict[int, list[int]] = {}
    filled: list[int] = []
    room_of: list[int] = []
    where: list[tuple[int, int]] = []
    for s in sizes:
        i = s
        while i <= longest:
            fenwick[i] -= s
            i += i & -i
        at = bisect.bisect_left(free, s)
        if at < len(free):
            room = free.pop(at)
            b = by_room[room].pop()
        else:
            b = len(filled)
            cost = lambda c: (bin_cost(c, overhead, attention) / (s + min(c - s, waiting(c - s))), c)
            room = min((c for c in lengths if c >= s), key=cost)
            filled.append(0)
            room_of.append(room)
        where.append((b, filled[b]))
        filled[b] += s
        left = room - s
        if left:
            bisect.insort(free, left)
            by_room.setdefault(left, []).append(b)
    final = [next(c for c in lengths if c >= f) for f in filled]
    return [(b, start, final[b]) for b, start in where]


def pieces(docs: DataFrame, doc_id: str, text: str, longest: int, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, key, piece, first_token, n_tokens): documents as pieces of at most ``longest`` tokens."""

    def counts(texts: list[bytes]) -> Iterator[int]:
        if tokenizer is None:
            return (len(t.split()) for t in texts)
        return encoder(tokenizer).counts(t.decode("utf-8", "replace") for t in texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.fromiter(counts(batch.column(2).to_pylist()), np.int64, batch.num_rows)
            count = -(-n // longest)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = piece * longest
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(piece), pa.array(first), pa.array(np.minimum(n[row] - first, longest))], ["doc_id", "key", "piece", "first_token", "n_tokens"])

    body = text_bytes(text)
    cols = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(body).alias("key"), body.alias("text"))
    return cols.mapInArrow(run, "doc_id bigint, key bigint, piece bigint, first_token bigint, n_tokens bigint")


def best_fit_packing(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard_tokens: int = SHARD_TOKENS, tokenizer: str | None = None, attention: int = ATTENTION) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, shard, bin, bin_start, bin_length): every token of every document once.

    tokenizer: path of a byte-level BPE file; None counts words. A bin is named by shard and bin. The number of shards follows from the total of tokens.
    """
    lengths = tuple(sorted(set(lengths)))
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    cut = staged(pieces(docs, doc_id, text, lengths[-1], tokenizer), "pieces")
    total = cut.agg(F.sum("n_tokens")).first()[0] or 0
    n_shards = max(1, -(-total // shard_tokens))
    # The pieces are a written table, so a row's place in it is the same whenever a task is run again; dealing
    # by place as well as by id keeps copies of one row from meeting in one shard.
    spread = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "key", "piece", F.monotonically_increasing_id()), F.lit(n_shards)))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(doc_id=pdf["doc_id"].astype("Int64")).sort_values(["n_tokens", "doc_id", "piece", "key"], ascending=[False, True, True, True], kind="stable")
        placed = pack(pdf["n_tokens"].tolist(), lengths, overhead, attention)
        pdf["bin"], pdf["bin_start"], pdf["bin_length"] = (list(c) for c in zip(*placed))
        return pdf[["doc_id", "piece", "first_token", "n_tokens", "shard", "bin", "bin_start", "bin_length"]]

    return spread.groupBy("shard").applyInPandas(shard, "doc_id bigint, piece bigint, first_token bigint, n_tokens bigint, shard bigint, bin bigint, bin_start bigint, bin_length bigint")
