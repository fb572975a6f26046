"""Removal of repeated word windows by relative Lempel-Ziv parsing.

A reference block is a shard of about a MiB of whole documents, its windows indexed by their hash. Each document is
factored greedily against the part of its block that comes before it: at a place whose window is indexed, the
factor runs on as far as the earliest reference does, word by word; factors of a window or more are repeated
stretches. The next look-up is at the first window that crosses the factor's end, so a window found only elsewhere
in the block isn't missed. What is new in its block is factored again, against the contents that other
blocks have at the same anchors (see anchors.py).

Defined cases as in suffix_dedup.py, ties included: equal windows of one document are repeats of its first. Words
are runs of characters other than ASCII white space, of any length, and compared as they are.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from capsite.llm import anchors as an
from capsite.llm.common import PIECE

WINDOW = 20
GRAM = 8
U = np.uint64


def _common(ids: np.ndarray, i: int, j: int, most: int) -> int:
    """Words that the sequences from i and from j have in common, ``most`` at most."""
    size, step = 0, 64
    while size < most:
        step = min(step, most - size)
        differ = np.flatnonzero(ids[i + size : i + size + step] != ids[j + size : j + size + step])
        if len(differ):
            return size + int(differ[0])
        size += step
        step *= 2
    return size


def factors(ids: np.ndarray, at: np.ndarray, window: int) -> Iterator[tuple[int, int]]:
    """Greedy factors (start, length) of at least a window: each row's words against all that come before them."""
    p = an.window_starts(at, window)
    if not len(p):
        return
    h = an.Spans(an.mix(ids.astype(np.uint64) + U(1))).of(p, p + window)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    first = np.empty(len(p), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
    indexed = np.flatnonzero(first < np.arange(len(p)))  # the others have no equal before them
    end = at[np.searchsorted(at, p[indexed], "right")]
    other = p[first[indexed]]
    other_end = at[np.searchsorted(at, other, "right")]
    k = 0
    while k < len(indexed):
        i = int(p[indexed[k]])
        size = _common(ids, i, int(other[k]), min(int(end[k]) - i, int(other_end[k] - other[k])))
        if size < window:  # other words of the same hash: the remaining places of the hash decide
            same = np.flatnonzero(h[: indexed[k]] == h[indexed[k]])
            size = window if any(_common(ids, i, int(p[s]), window) == window for s in same) else 0
        if size:
            yield i, size
        k = int(np.searchsorted(p[indexed], i + size - window + 1)) if size else k + 1


def flagged(ids: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """True at the places of windows that stand earlier."""
    out = np.zeros(len(ids), bool)
    for start, size in factors(ids, at, window):
        out[start : start + size - window + 1] = True
    return out


def merged(window: int = WINDOW):
    """Factors contents against the earlier ones of their anchor (see anchors.MergeFlags)."""

    def flags(contents: list[bytes], group: np.ndarray) -> np.ndarray:
        rows = [c.split(b" ") for c in contents]
        ids, _ = an.numbered([x for r in rows for x in r])
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return flagged(ids, at, window)[an.window_starts(at, window)]

    return flags


def rlz_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int | None = None, block: int = PIECE) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): words left, joined by one space, and the removed word stretches."""
    if not GRAM <= window <= 200:
        raise ValueError(f"window must be {GRAM} to 200 words")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, spans = (batch.column(i).to_pylist() for i in range(3))
            n_words, n_removed, kept, stretches = [], [], [], []
            for t, s in zip(texts, spans):
                merged = an.merged_spans(s)
                left, total, k = bytearray(), 0, 0
                for first, words in an.word_pieces(t):
                    total = first + len(words)
                    at = first
                    while k < len(merged) and merged[k][0] < total:
                        a, b = merged[k]
                        for w in words[at - first : max(a, at) - first]:
                            left += b" " + w
                        at = max(at, min(b, total))
                        if b > total:
                            break
                        k += 1
                    for w in words[at - first :]:
                        left += b" " + w
                n_words.append(total)
                n_removed.append(sum(b - a for a, b in merged))
                kept.append(bytes(left[1:]))
                stretches.append([{"s": a, "e": b} for a, b in merged])
            kinds = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(stretches, kinds), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    rows = an.keyed(docs, doc_id, text)
    found = an.with_spans(rows, an.repeats(rows, an.Unit("words", window, GRAM), lambda x, at, grams: flagged(x, at, window), merged(window), hot, block))
    return found.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<s:bigint,e:bigint>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return rlz_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
