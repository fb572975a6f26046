"""Exact search for windows that also occur earlier, for sequences of bytes or of words.

First, documents are read in shards of bounded size (a longer document is cut into several, with the windows
dealt out once), and a shard's own method finds the windows that stand earlier in it. Only the earliest of a
window's places in a shard goes on.

A window of W items holds W - k + 1 grams of k items; the one of least hash (the leftmost of equals) is its
anchor. Equal windows have equal anchors at equal offsets, so a window can only stand in another shard if its
anchor does. Neighbouring windows with one anchor form a run, and one row per run is shuffled, without text.
Runs of anchors that several shards hold send their contents, which meet at the anchor and are compared there
item by item: hashes only bring rows together, they decide nothing.

An anchor in more than ``limit`` runs is split: its windows are dealt anew by a longer gram, and those of a
gram that is still as frequent by the whole window, which is aggregated before it is shuffled. So no task holds
all contents of a frequent anchor.
"""
from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from capsite.llm.common import PIECE, id_key, int_batch, staged, text_bytes

U = np.uint64
_rng = np.random.default_rng(20240229)
_GRAM = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Runs of an anchor beyond which it is split, and runs that are compared in one go.
LIMIT, BUCKET = 5_000, 50_000
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values in place."""
    x ^= x >> U(31)
    x *= U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the step and of its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, PIECE + 4096)
        for name, base in (("up", _STEP), ("down", _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


class Spans:
    """Hashes of any stretch of a sequence, from one pass of prefix sums. They propose; equality is left to a comparison."""

    def __init__(self, values: np.ndarray):
        up, self.down = _power(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def hash_word(word: bytes) -> int:
    """64 bits of a cryptographic hash: no structure of the word can make two collide by design."""
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def numbered(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers that are equal exactly where words are, and the 64-bit hash of each word."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return ids, np.fromiter(map(hash_word, known), np.uint64, len(known))[ids] if words else np.zeros(0, np.uint64)


def word_pieces(text: bytes, size: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of stretches of about ``size`` bytes, so that a long text is never one list."""
    at = first = 0
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        words = text[at:end].split()
        yield first, words
        first, at = first + len(words), end


@dataclass(frozen=True)
class Unit:
    """What a sequence consists of: bytes, or words, runs of other than ASCII white space. Grams have ``gram`` items."""

    kind: str
    window: int
    gram: int

    def items(self, text: bytes):
        return text if self.kind == "bytes" else text.split()

    def content(self, items) -> bytes:
        return items if self.kind == "bytes" else b" ".join(items)

    def arrays(self, rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of items end to end as numbers, as values to hash, and where each row begins (one entry more than rows)."""
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        if self.kind == "bytes":
            x = np.frombuffer(b"".join(rows), np.uint8)
            return x, x, at
        return *numbered([w for r in rows for w in r]), at

    def pieces(self, text: bytes, size: int) -> Iterator[tuple[int, bytes | list[bytes]]]:
        """(number of the first item, items) of pieces of about ``size`` bytes that share no window and miss none."""
        if len(text) <= 2 * size:
            yield 0, self.items(text)
        elif self.kind == "bytes":
            for s in range(0, len(text) - self.window + 1, size):
                yield s, text[s : s + size + self.window - 1]
        else:
            tail: list[bytes] = []
            for first, words in word_pieces(text, size):
                words = tail + words
                yield first - len(tail), words
                tail = words[max(len(words) - self.window + 1, 0) :]

    def gram_hashes(self, x: np.ndarray, gram: int) -> np.ndarray:
        """A hash of each gram of neighbouring values."""
        n = len(x) - gram + 1
        if self.kind == "bytes":
            pad = np.concatenate([x, np.zeros(8, np.uint8)])
            h = np.zeros(n, np.uint64)
            for j, i in enumerate([*range(0, gram - 8, 8), gram - 8]):
                h += np.ndarray((n,), "<u8", pad, i, (1,)) * _GRAM[j]
            return mix(h)
        h = x[:n] * _GRAM[0]
        for j in range(1, gram):
            h += x[j : j + n] * _GRAM[j]
        return mix(h)


def least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    s = 1
    while 2 * s <= width:
        v = np.minimum(v[:-s], v[s:])
        s *= 2
    return np.minimum(v[: len(v) - (width - s)], v[width - s :]) if s < width else v


def window_starts(at: np.ndarray, window: int) -> np.ndarray:
    """Places at which a window begins that ends in the same row."""
    size = np.maximum(np.diff(at) - window + 1, 0)
    return np.repeat(at[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def runs(h: np.ndarray, p: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of the runs of the windows of ``spread`` grams, of hashes h, that begin at the rising places p."""
    if not len(p):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = least((h & U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), spread)
    anchor = (low[p] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(p) != 1)])
    first = np.flatnonzero(new)
    return h[anchor[first]], p[first], np.diff(np.append(first, len(p)))


def keyed(docs: DataFrame, doc_id: str, text: str, carry: bool = False) -> DataFrame:
    """(doc_id, did, t, text, rest): rows of one id and text are one document; t orders different texts of one id.

    rest holds the row's other columns with ``carry``, else nothing.
    """
    others = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text] if carry else []
    rest = F.struct(*others) if others else F.lit(None).cast("int")
    body = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), id_key(doc_id).alias("did"), text_bytes(text).alias("text"), rest.alias("rest"))
    return body.select("doc_id", "did", F.xxhash64("text").alias("t"), "text", "rest")


#: Of a shard's rows laid end to end (numbers, row bounds, hashes of grams): true at the places of windows that also begin earlier.
ShardFlags = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Of contents by anchor and, within it, by place, and the numbers of their anchors: flags of all their windows, end to end, likewise.
MergeFlags = Callable[[list[bytes], np.ndarray], np.ndarray]


def _shards(unit: Unit, batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[int, int, int, object]]]:
    """Lists of (did, t, number of the first item, items) of about ``size`` bytes, by place; repeated rows stand once."""
    rows: dict = {}
    held = 0
    for batch in batches:
        for did, t, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for first, items in unit.pieces(text, size):
                if held >= size:
                    yield [(*k, v) for k, v in sorted(rows.items(), key=lambda r: r[0])]
                    rows, held = {}, 0
                rows[did, t, first] = items
                held += len(text) if len(text) <= 2 * size else size
    if rows:
        yield [(*k, v) for k, v in sorted(rows.items(), key=lambda r: r[0])]


def repeats(docs: DataFrame, unit: Unit, in_shard: ShardFlags, merged: MergeFlags, limit: int | None = None, shard: int = PIECE, along: str = "doc_id") -> DataFrame:
    """(did, t, s, e): stretches [s, e) of items covered by windows that also start earlier.

    docs: the frame of keyed(). Earlier means smaller (did, t, start). along: the column that the caller reads
    from with_spans() beside the text. The join that looks contents up keeps it as well, so that both joins need
    the same columns and one exchange of the texts serves both.
    """
    limit = LIMIT if limit is None else limit
    w = unit.window

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId() << 32
        for k, rows in enumerate(_shards(unit, batches, shard)):
            x, values, at = unit.arrays([r[3] for r in rows])
            starts = window_starts(at, w)
            did, t, item = (np.array([r[i] for r in rows], np.int64) for i in range(3))
            grams = unit.gram_hashes(values, unit.gram) if len(starts) else np.zeros(0, np.uint64)
            flags = in_shard(x, at, grams)[starts] if len(starts) else np.zeros(0, bool)
            parts = []
            again, fresh = starts[flags], starts[~flags]
            row = lambda p: np.searchsorted(at, p, "right") - 1
            if len(again):
                in_row = row(again)
                new = np.flatnonzero(np.concatenate([[True], (np.diff(again) != 1) | (np.diff(in_row) != 0)]))
                size = np.diff(np.append(new, len(again))) + w - 1
                r, s = in_row[new], again[new]
                parts.append((np.zeros(len(new), np.int64), did[r], t[r], s - at[r] + item[r], size, np.full(len(new), -1)))
            h, s, n = runs(grams, fresh, w - unit.gram + 1)
            r = row(s)
            parts.append((h.view(np.int64), did[r], t[r], s - at[r] + item[r], n, np.full(len(s), own | k)))
            yield int_batch(**dict(zip(["h", "did", "t", "s", "n", "shard"], map(np.concatenate, zip(*parts)))))

    found = staged(docs.select("did", "t", "text").mapInArrow(first_pass, "h bigint, did bigint, t bigint, s bigint, n bigint, shard bigint"), "runs")
    sure = found.filter("shard < 0").select("did", "t", "s", (F.col("s") + F.col("n")).alias("e"))
    asked = staged(_met(found.filter("shard >= 0")), "asked")
    often = F.col("runs") > limit
    n_often, n = asked.agg(F.count_if(often), F.count(F.lit(1))).first()
    out = sure.unionByName(_compared(_contents(docs, asked.filter(~often), unit, along, shard, _packed(_buckets(n - n_often, docs)), PACKED), unit, merged))
    if n_often:
        # Read from the same exchange of the texts as the others, and cut for these few runs only.
        met = _met(_contents(docs, asked.filter(often), unit, along, shard, _anew(unit, (unit.gram + w) // 2), RUN))
        out = out.unionByName(_compared(met.filter(~often).mapInArrow(_packed(_buckets(n_often, docs)), PACKED), unit, merged))
        # A stretch that common is compared as whole windows; a partial minimum goes before the shuffle.
        single = met.filter(often).select("did", "t", "s", "shard", "content").mapInArrow(_anew(unit, w), RUN)
        first = single.groupBy("content").agg(F.min(F.struct("did", "t", "s")).alias("first"))
        later = single.join(first, "content").filter(F.struct("did", "t", "s") != F.col("first"))
        out = out.unionByName(later.select("did", "t", "s", (F.col("s") + w).alias("e")))
    return out


def _met(rows: DataFrame) -> DataFrame:
    """The runs whose anchor several shards hold, with the number of its runs; a frequent anchor is summed up before the shuffle, and a join that it makes uneven is split by AQE."""
    held = rows.groupBy("h").agg(F.min("shard").alias("_a"), F.max("shard").alias("_b"), F.count(F.lit(1)).alias("runs"))
    return rows.join(held.filter(F.col("_a") != F.col("_b")).select("h", "runs").hint("shuffle_hash"), "h")


RUN = "h bigint, did bigint, t bigint, s bigint, n bigint, shard bigint, content binary"
PACKED = "bucket bigint, rows binary"
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _contents(docs: DataFrame, asked: DataFrame, unit: Unit, along: str, size: int, then: Step, schema: str) -> DataFrame:
    """The asked runs with the items that their windows cover, as the step ``then`` of the same worker makes of them."""
    names = ["h", "s", "n", "shard", "runs"]
    per_doc = asked.groupBy("did", "t").agg(F.collect_list(F.struct(*names)).alias("asked"))
    held = docs.join(per_doc.hint("shuffle_hash"), ["did", "t"]).select("did", "t", "text", "asked", along)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = unit.window - 1
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in (0, 1))))
            once = sorted({k: i for i, k in enumerate(keys)}.values())  # one of repeated rows does
            wanted = batch.column(3)
            ends = wanted.offsets.to_numpy()
            fields = {c: wanted.values.field(c).to_numpy() for c in names}
            held, total = [], 0
            for i in once:
                a, b = int(ends[i]), int(ends[i + 1])
                own: list[bytes] = [b""] * (b - a)
                starts, counts = fields["s"][a:b], fields["n"][a:b]
                order = np.argsort(starts)
                ranked = starts[order]
                for first, items in unit.pieces(batch.column(2)[i].as_py(), size):  # a run lies within one piece
                    for k in order[slice(*np.searchsorted(ranked, (first, first + len(items) - more)))].tolist():
                        s = int(starts[k]) - first
                        own[k] = unit.content(items[s : s + int(counts[k]) + more])
                held.append((i, a, b, own))
                total += sum(map(len, own))
                if total > 4_000_000 or i == once[-1]:
                    pick = np.concatenate([np.arange(a, b) for _, a, b, _ in held])
                    row = pa.array(np.repeat([i for i, *_ in held], [b - a for _, a, b, _ in held]))
                    columns = [*(pa.array(fields[c][pick]) for c in names), batch.column(0).take(row), batch.column(1).take(row), pa.array([c for *_, own in held for c in own], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*names, "did", "t", "content"])
                    held, total = [], 0

    return held.mapInArrow(lambda batches: then(cut(batches)), schema)


def _anew(unit: Unit, gram: int) -> Step:
    """The windows of runs in runs of anchors of ``gram`` items, with their contents."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "did", "t", "s", "n", "shard"]
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                rows = [unit.items(c) for c in part.column("content").to_pylist()]
                _, values, at = unit.arrays(rows)
                h, s, n = runs(unit.gram_hashes(values, gram), window_starts(at, unit.window), unit.window - gram + 1)
                r = np.searchsorted(at, s, "right") - 1
                inner = s - at[r]
                did, t, first, shard = (np.asarray(part.column(c)) for c in ("did", "t", "s", "shard"))
                cut = [unit.content(rows[a][b : b + m + unit.window - 1]) for a, b, m in zip(r.tolist(), inner.tolist(), n.tolist())]
                columns = [h.view(np.int64), did[r], t[r], first[r] + inner, n, shard[r]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(cut, pa.binary())], [*names, "content"])

    return deal


PLACES = ["h", "did", "t", "s", "n"]


def _buckets(n: int, docs: DataFrame) -> int:
    """Buckets for about ``n`` rows, and as many as shuffles have tasks at least."""
    return max(n // BUCKET, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1


def _packed(buckets: int) -> Step:
    """Rows of runs with contents in buckets by anchor, compressed together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blobs() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            own = (mix(rows.column("h").to_numpy().astype(np.uint64)) % U(buckets)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            ids, first = np.unique(own[order], return_index=True)
            rows = rows.take(pa.array(order))
            out = []
            for a, b in zip(first.tolist(), [*first.tolist()[1:], len(own)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(rows.slice(a, b - a))
                out.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out, pa.binary())], ["bucket", "rows"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.select([*PLACES, "content"]))
            if sum(x.num_rows for x in held) >= BUCKET:
                yield blobs()
                held = []
        if held:
            yield blobs()

    return pack


def _compared(packed: DataFrame, unit: Unit, merged: MergeFlags) -> DataFrame:
    """(did, t, s, e) of repeats among the runs of packed buckets."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def whole() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches([x for blob in held for x in pa.ipc.open_stream(blob)])
            order = np.lexsort([table.column(c).to_numpy() for c in reversed(PLACES[:4])])
            for i in range(0, len(order), 10_000):
                yield from table.take(pa.array(order[i : i + 10_000])).combine_chunks().to_batches()

        for batch in batches:
            for b, blob in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if b != bucket and held:
                    yield from resolve(whole())
                    held = []
                bucket = b
                held.append(blob)
        if held:
            yield from resolve(whole())

    resolve = _resolved(unit, merged)
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(unpack, "did bigint, t bigint, s bigint, e bigint")


def _resolved(unit: Unit, merged: MergeFlags, block: int = PIECE):
    """Compares contents, whole anchors at a time in blocks of about ``block`` bytes.

    Contents of an anchor that are equal, byte by byte, need no more: all but the first repeat it. Different
    ones of an anchor, by place, go to merged().
    """
    w = unit.window

    def judge(h: np.ndarray, did: np.ndarray, t: np.ndarray, s: np.ndarray, n: np.ndarray, content: list[bytes]) -> pa.RecordBatch | None:
        # Rows of one document that stands in the table more than once may be cut differently; a window is taken once.
        if ((h[1:] == h[:-1]) & (did[1:] == did[:-1]) & (t[1:] == t[:-1]) & (s[1:] < s[:-1] + n[:-1])).any():
            key, end, rows = None, 0, []
            for i, (k, a, m) in enumerate(zip(zip(h.tolist(), did.tolist(), t.tolist()), s.tolist(), n.tolist())):
                skip = max(end - a, 0) if k == key else 0
                end = max(end, a + m) if k == key else a + m
                key = k
                if skip < m:
                    rows.append((i, a + skip, m - skip, unit.content(unit.items(content[i])[skip:]) if skip else content[i]))
            keep = np.array([r[0] for r in rows])
            h, did, t, s, n, content = h[keep], did[keep], t[keep], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows]
        group = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
        first: dict = {}
        own = np.fromiter((first.setdefault(k, i) for i, k in enumerate(zip(group.tolist(), content))), np.int64, len(content))
        heads = own == np.arange(len(own))
        kinds = np.bincount(group[heads], minlength=group[-1] + 1)
        at = np.concatenate([[0], np.cumsum(n)])
        flags = np.repeat(~heads, n)
        mixed = np.flatnonzero(heads & (kinds[group] > 1))
        if len(mixed):
            size = n[mixed]
            where = np.repeat(at[mixed] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            flags[where] |= merged([content[i] for i in mixed.tolist()], group[mixed])
        hit = np.flatnonzero(flags)
        if not len(hit):
            return None
        run = np.repeat(np.arange(len(n)), n)[hit]
        place = hit - at[run] + s[run]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(run) != 0)]))
        last = np.append(new[1:], len(hit)) - 1
        return int_batch(did=did[run[new]], t=t[run[new]], s=place[new], e=place[last] + w)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list = []
        size = 0

        def take():
            return [*(np.concatenate([c[i] for c in kept]) for i in range(5)), [x for c in kept for x in c[5]]]

        for batch in batches:
            if not batch.num_rows:
                continue
            content = batch.column(5).to_pylist()
            kept.append((*(np.asarray(batch.column(i)) for i in range(5)), content))
            size += sum(map(len, content))
            if size < block:
                continue
            columns = take()
            h, content = columns[0], columns[5]
            edge = np.flatnonzero(h[1:] != h[:-1]) + 1  # the last anchor may go on in the next batch
            ends = np.cumsum([len(c) for c in content])
            at = 0
            while len(edge) and edge[-1] > at:
                room = (ends[at - 1] if at else 0) + block
                to = int(edge[max(np.searchsorted(edge, at, "right"), np.searchsorted(edge, np.searchsorted(ends, room), "right") - 1)])
                if (got := judge(*(c[at:to] for c in columns))) is not None:
                    yield got
                at = to
            kept = [tuple(c[at:] for c in columns)]
            size = sum(map(len, content[at:]))
        if kept and len(kept[0][0]) and (got := judge(*take())) is not None:
            yield got

    return resolve


#: Bits that hold the length of a stretch beside its start.
LENGTH_BITS = 24


def merged_spans(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs of a document's stretches as with_spans() packs them; those that touch become one."""
    out: list[tuple[int, int]] = []
    for x in sorted(spans or ()):
        s = x >> LENGTH_BITS
        e = s + (x & (1 << LENGTH_BITS) - 1)
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = out[-1][0], e
        else:
            out.append((s, e))
    return out


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs of keyed() with the stretches to remove as ``spans``.

    Shares the exchange of docs with repeats() if the text and the column named there are all that is read.
    A stretch lies within one shard, so its length fits beside its start.
    """
    packed = F.shiftleft("s", LENGTH_BITS).bitwiseOR(F.col("e") - F.col("s"))
    per_doc = spans.groupBy("did", "t").agg(F.collect_list(packed).alias("spans"))
    return docs.join(per_doc.hint("shuffle_hash"), ["did", "t"], "left")
