"""Exact removal of byte strings that also start earlier in the corpus, by suffix arrays of shards.

A shard is about a MiB of whole documents. It is sorted by Larsson-Sadakane refinement: ranks by a prefix of
length h give ranks by 2h, and only groups that are not yet told apart are sorted again, down to the window's
length. Common prefixes of neighbours in the array follow by Kasai's rule; windows that neighbours share are
repeats, and the earliest of each goes on. Shards are merged at the anchors that several of them hold (see
anchors.py): the windows of one shard are looked up by binary search among the sorted ones of the shards before it.

Defined cases: null text is empty; a text below the window length loses nothing; a text longer than two shards
is cut into several; rows with the same id and text are one document (repeated in the result); different texts of
one id are ordered by their hash; null ids come last.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from capsite.llm import anchors as an
from capsite.llm.common import PIECE

WINDOW = 100
GRAM = 32
#: Bytes of documents in a shard.
SHARD = PIECE
#: Places that one lane of Kasai's rule walks.
LANE = 128
U = np.uint64


def suffix_order(x: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of bytes x, the group of each suffix, and the suffixes that took part in the last refinement.

    Suffixes of one group agree in their first ``depth`` bytes or more; without a depth each is its own group.
    What lies past the end ranks lowest (and counts as zeros where a group is not refined further).
    """
    n = len(x)
    bits = max(int(n).bit_length(), 1)
    low = U((1 << bits) - 1)
    h = (64 - bits) // 8
    # As many bytes as leave room for the place: one sort of plain numbers.
    key = np.ndarray((n,), ">u8", np.concatenate([x, np.zeros(8, np.uint8)]), 0, (1,)).astype(np.uint64) >> U(64 - 8 * h)
    key = (key << U(bits)) | np.arange(n, dtype=np.uint64)
    key.sort()
    sa = (key & low).astype(np.int64)
    key >>= U(bits)

    def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return first, np.diff(np.append(first, len(keys)))

    first, size = groups(key)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, size)  # the number of a group is the place at which it begins
    places = np.flatnonzero(np.repeat(size > 1, size))
    near = sa[places]
    while len(places) and (depth is None or h < depth):
        near = suffix = sa[places]
        ahead = rank[np.minimum(suffix + h, n - 1)] + 1
        ahead[suffix + h >= n] = 0
        number = np.cumsum(np.concatenate([[0], np.diff(rank[suffix]) != 0]))
        if bits <= 21:  # group, what follows and place fit one number
            key = (number.astype(np.uint64) << U(2 * bits + 1)) | (ahead.astype(np.uint64) << U(bits)) | suffix.astype(np.uint64)
            key.sort()
            own = (key & low).astype(np.int64)
            first, size = groups(key >> U(bits))
        else:
            order = np.lexsort((ahead, number))
            own = suffix[order]
            first, size = groups(number[order] * (n + 2) + ahead[order])
        sa[places] = own
        rank[own] = np.repeat(places[first], size)
        places = places[np.repeat(size > 1, size)]
        h *= 2
    return sa, rank, near


def common_prefixes(x: np.ndarray, sa: np.ndarray, rank: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Common prefix, up to ``most``, of the suffixes ``near`` with their forerunners in the array, by Kasai's rule; 0 for others.

    A suffix loses one byte against its left neighbour in the text and keeps the rest of its common prefix, if
    that neighbour is told apart from its forerunner; in one group with it, the prefix is ``most`` at least.
    Stretches of neighbouring suffixes step together, eight bytes a comparison.
    """
    n = len(x)
    lcp = np.zeros(n, np.int64)
    if not len(near):
        return lcp
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    tied = np.zeros(n, bool)
    tied[sa[1:]] = rank[sa[1:]] == rank[sa[:-1]]
    pad = np.concatenate([x, np.zeros(most + 16, np.uint8)])
    word = np.ndarray((len(pad) - 8,), "<u8", pad, 0, (1,))
    near = np.sort(near)
    lane = np.cumsum(np.concatenate([[0], np.diff(near) != 1]))
    start = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
    size = np.diff(np.append(start, len(near)))
    cuts = -(-size // LANE)  # long stretches become several lanes
    begin = np.repeat(near[start], cuts) + LANE * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    length = np.minimum(np.repeat(near[start] + size, cuts) - begin, LANE)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    kept = np.zeros(len(begin), np.int64)
    for step in range(int(length[0])):
        live = int(np.searchsorted(-length, -step, "left"))
        i = begin[:live] + step
        j = before[i]
        lcp[i[tied[i]]] = most
        go = np.flatnonzero(~tied[i] & (j >= 0))
        a, b = i[go], j[go]
        got = np.maximum(kept[go] - 1, 0)
        todo = np.flatnonzero(got < most)
        while len(todo):
            differ = word[a[todo] + got[todo]] ^ word[b[todo] + got[todo]]
            same = differ == 0
            lowest = differ[~same]
            lowest &= ~lowest + U(1)  # its lowest bit tells the first byte that differs
            got[todo[~same]] += np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3
            todo = todo[same]
            got[todo] += 8
            todo = todo[got[todo] < most]
        got = np.minimum(np.minimum(got, most), n - np.maximum(a, b))
        lcp[a] = got
        kept[:live] = 0
        kept[go] = got
    return lcp


def may_repeat(grams: np.ndarray, starts: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Those of the windows all of whose grams occur more than once; no other can repeat."""
    bits = max(int(len(grams)).bit_length(), 1)
    low = U((1 << bits) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    key.sort()
    same = (key[1:] ^ key[:-1]) <= low
    once = np.ones(len(grams), np.int32)
    place = (key & low).astype(np.int64)
    once[place[1:][same]] = 0
    once[place[:-1][same]] = 0
    seen = np.concatenate([[0], np.cumsum(once)])
    return starts[seen[starts + window - gram + 1] == seen[starts]]


def in_shard(window: int = WINDOW, gram: int = GRAM):
    """Flags windows that stand earlier in a shard (see anchors.ShardFlags).

    The array is built over the stretches of documents whose windows may repeat; the rest has grams that occur once.
    """

    def flags(x: np.ndarray, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        p = may_repeat(grams, an.window_starts(at, window), window, gram)
        if not len(p):
            return out
        row = np.searchsorted(at, p, "right")
        new = np.concatenate([[True], (np.diff(p) != 1) | (np.diff(row) != 0)])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(p))) + window - 1
        bounds = np.concatenate([[0], np.cumsum(size)])
        y = x[np.repeat(p[first] - bounds[:-1], size) + np.arange(bounds[-1])]
        out[p] = shared_windows(y, bounds, window)[an.window_starts(bounds, window)]
        return out

    return flags


def shared_windows(x: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """True at the places of windows that begin earlier in rows x laid end to end, by suffix array and common prefixes."""
    out = np.zeros(len(x), bool)
    sa, rank, near = suffix_order(x, window)
    lcp = common_prefixes(x, sa, rank, near, window)[sa]
    group = np.cumsum(lcp < window)
    shared = lcp >= window
    shared[:-1] |= shared[1:]
    inside = np.zeros(len(x), bool)
    inside[an.window_starts(at, window)] = True
    place, group = sa[shared], group[shared]
    place, group = place[inside[place]], group[inside[place]]
    if len(place):
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.repeat(np.minimum.reduceat(place, first), np.diff(np.append(first, len(place))))
        out[place[place > least]] = True
    return out


def merged(window: int = WINDOW):
    """Flags windows that stand in an earlier content of their anchor, by binary search (see anchors.MergeFlags)."""

    def flags(contents: list[bytes], group: np.ndarray) -> np.ndarray:
        size = np.array([len(c) for c in contents])
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(contents), np.uint8)
        text = np.ndarray((len(data) - window + 1,), f"S{window}", data, 0, (1,))
        count = size - window + 1
        at = np.cumsum(count) - count
        out = np.zeros(count.sum(), bool)
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        turn = np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))
        order = np.argsort(turn, kind="stable")
        known: list[np.ndarray] = []  # sorted windows of earlier contents; sizes fall at least by half
        for part in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):  # the n-th contents of all anchors at once
            m = count[part]
            inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            strings, own = text[np.repeat(start[part], m) + inner], np.repeat(at[part], m) + inner
            sort = np.argsort(strings, kind="stable")
            strings, own = strings[sort], own[sort]
            fresh = np.ones(len(own), bool)
            for k in known:
                where = np.minimum(np.searchsorted(k, strings), len(k) - 1)
                fresh &= k[where] != strings
            out[own[~fresh]] = True
            new = strings[fresh]
            while known and len(new) and len(known[-1]) <= 2 * len(new):
                last = known.pop()
                new = np.insert(last, np.searchsorted(last, new), new)
            if len(new):
                known.append(new)
        return out

    return flags


def duplicate_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int | None = None, shard: int = SHARD) -> DataFrame:
    """(doc_id, did, t, text, spans): documents with the byte stretches that repeat earlier ones, not yet merged."""
    if not GRAM <= window <= 200:
        raise ValueError(f"window must be {GRAM} to 200 bytes")
    rows = an.keyed(docs, doc_id, text)
    return an.with_spans(rows, _repeats(rows, window, hot, shard))


def _repeats(rows: DataFrame, window: int, hot: int | None = None, shard: int = SHARD, along: str = "doc_id") -> DataFrame:
    return an.repeats(rows, an.Unit("bytes", window, GRAM), in_shard(window), merged(window), hot, shard, along)


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out)


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int | None = None, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): what is left of each document, as bytes, and what went.

    Removed are the bytes covered by a ``window``-byte string that also starts earlier; what is left need
    not be valid UTF-8 at its seams.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = (batch.column(i).to_pylist() for i in range(3))
            merged = [an.merged_spans(s) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(e - s for s, e in m) for m in merged], pa.int64()), pa.array([len(m) for m in merged], pa.int64()), pa.array([kept_bytes(t, m) for t, m in zip(texts, merged)], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    found = duplicate_spans(docs, doc_id, text, window, hot, shard).select("doc_id", "text", "spans")
    return found.mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: sizes and the SHA-256 of what is left."""
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """docs with repeats cut out of the text, all columns kept; rows of which no word is left go.

    Parts of characters at the seams are dropped. Where there is a column of lengths it is brought up to date.
    """
    rows = an.keyed(docs, doc_id, text, carry=True)
    found = an.with_spans(rows, _repeats(rows, window, along="rest"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [kept_bytes(t, an.merged_spans(s)).decode("utf-8", "ignore") if s else t.decode("utf-8", "ignore") for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), batch.column(2)], ["kept", "rest"])

    kind = found.schema["rest"].dataType
    out = found.select("text", "spans", "rest").mapInArrow(cut, StructType([StructField("kept", StringType()), StructField("rest", kind)]))
    out = out.filter(F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    names = [c for c in docs.columns if c != text]
    columns = {c: F.col(f"rest.c{i}") for i, c in enumerate(docs.columns) if c in names}
    if n_chars in columns:
        columns[n_chars] = F.length("kept").cast(docs.schema[n_chars].dataType)
    return out.select(*[(F.col("kept") if c == text else columns[c]).alias(c) for c in docs.columns])
