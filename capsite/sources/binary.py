"""BAM and BigWig as Python data sources, written from the public format descriptions.

A BAM file is cut into ranges of compressed blocks. A range begins at the first block boundary in it,
and the reader finds the first record there by checking that several records in a row are plausible.
"""
from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BAM_SCHEMA = "sample string, chr string, strand string, pos bigint, seq string, qual array<tinyint>, mapq int, flag int, cigar string"
BASES = "=ACMGRSVTWYHKDBN"  # fixed values of the format
OPS = "MIDNSHP=X"  # fixed values of the format


def open_binary(path: str):
    """A seekable file, local or in any store that pyarrow reaches."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _size(path: str) -> int:
    with open_binary(path) as f:
        return f.seek(0, io.SEEK_END)


def _block(f, at: int) -> tuple[bytes, int] | None:
    """Inflated block at an offset and the offset of the next; None at the end of the file or if there is no block."""
    f.seek(at)
    head = f.read(18)
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
        return None
    size = struct.unpack_from("<H", head, 16)[0] + 1
    body = f.read(size - 18)
    return zlib.decompress(body[:-8], -15), at + size


class _Blocks:
    """Bytes of consecutive blocks, with the file offset at which the current byte's block begins."""

    def __init__(self, f, at: int):
        self.f, self.next, self.buf, self.marks = f, at, b"", [(0, at)]

    def fill(self, n: int) -> bool:
        while len(self.buf) < n:
            got = _block(self.f, self.next)
            if got is None:
                return False
            self.marks.append((len(self.buf), self.next))
            self.buf += got[0]
            self.next = got[1]
        return True

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise EOFError("truncated file")
        out, self.buf = self.buf[:n], self.buf[n:]
        self.marks = [(max(o - n, 0), a) for o, a in self.marks if o <= n][-1:] + [(o - n, a) for o, a in self.marks if o > n]
        return out

    def at(self) -> int:
        return self.marks[0][1] if len(self.marks) == 1 or self.marks[1][0] > 0 else [a for o, a in self.marks if o <= 0][-1]


def bam_references(blocks: _Blocks) -> list[tuple[str, int]]:
    if blocks.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    blocks.take(struct.unpack("<i", blocks.take(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.take(4))[0]):
        name = blocks.take(struct.unpack("<i", blocks.take(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.take(4))[0]))
    return out


def _plausible(buf: bytes, at: int, refs: int) -> int:
    """Offset after a record that could begin here, or -1."""
    if at + 36 > len(buf):
        return -1
    size, ref, pos, name, _, _, ops, _, length, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", buf, at)
    good = -1 <= ref < refs and -1 <= mate < refs and pos >= -1 and mate_pos >= -1 and name > 0 and length >= 0 and 32 + name + 4 * ops + (length + 1) // 2 + length <= size < 1 << 28
    end = at + 35 + name
    return at + 4 + size if good and (end >= len(buf) or buf[end] == 0) else -1


def _first_record(buf: bytes, refs: int) -> int:
    for start in range(len(buf)):
        at, seen = start, 0
        while seen < 5 and at < len(buf) - 36:
            at = _plausible(buf, at, refs)
            if at < 0:
                break
            seen += 1
        if at >= 0 and seen:
            return start
    return len(buf)


def decode_record(rec: bytes, refs: list[tuple[str, int]]):
    """(chr, strand, pos, seq, qual, mapq, flag, cigar) of a record's bytes after its size."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", rec)
    at = 32 + n_name
    cigar = "".join(f"{v >> 4}{OPS[v & 15]}" for v in struct.unpack_from(f"<{n_ops}I", rec, at))
    at += 4 * n_ops
    packed = rec[at : at + (n_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq]
    at += (n_seq + 1) // 2
    qual = [q if q < 128 else -1 for q in rec[at : at + n_seq]]
    return (refs[ref][0] if ref >= 0 else None), ("-" if flag & 16 else "+"), pos + 1, seq, qual, mapq, flag, cigar


class _Range(InputPartition):
    def __init__(self, path: str, sample: str, start: int, end: int):
        self.path, self.sample, self.start, self.end = path, sample, start, end


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["paths"].split("\n") if "paths" in options else [options["path"]]
        self.samples = options.get("samples", "\n".join(self.paths)).split("\n")
        self.split = int(options.get("splitBytes", 64 << 20))
        self.all_of, self.none_of, self.least = (int(options.get(k, 0)) for k in ("requireFlags", "excludeFlags", "minMapq"))

    def partitions(self):
        return [_Range(p, s, a, a + self.split) for p, s in zip(self.paths, self.samples) for a in range(0, max(_size(p), 1), self.split)]

    def read(self, part: _Range) -> Iterator[tuple]:
        with open_binary(part.path) as f:
            head = _Blocks(f, 0)
            refs = bam_references(head)
            blocks = head
            if part.start:
                at = self._boundary(f, part.start, part.end)
                if at is None:
                    return
                blocks = _Blocks(f, at)
                blocks.fill(1 << 18)
                skip = _first_record(blocks.buf, len(refs))
                if skip:
                    blocks.take(skip)
            while blocks.fill(4) and blocks.at() < part.end:
                record = blocks.take(struct.unpack("<i", blocks.take(4))[0])
                mapq, flag = record[9], struct.unpack_from("<H", record, 14)[0]
                if flag & self.all_of != self.all_of or flag & self.none_of or mapq < self.least:  # before anything is decoded
                    continue
                chrom, *rest = decode_record(record, refs)
                yield (part.sample, chrom, *rest)

    @staticmethod
    def _boundary(f, start: int, end: int) -> int | None:
        """First offset in [start, end) at which two blocks in a row begin."""
        f.seek(start)
        window = f.read(min(end - start, 1 << 17))
        at = window.find(b"\x1f\x8b\x08\x04")
        while at >= 0:
            try:
                got = _block(f, start + at)
                if got and (_block(f, got[1]) or got[1] >= f.seek(0, io.SEEK_END)):
                    return start + at
            except zlib.error:
                pass
            at = window.find(b"\x1f\x8b\x08\x04", at + 1)
        return None


class BamSource(DataSource):
    """format("capsite_bam"): options path, or paths and samples as lines; splitBytes; requireFlags, excludeFlags and minMapq skip records undecoded (255 counts as unknown and passes)."""

    @classmethod
    def name(cls):
        return "capsite_bam"

    def schema(self):
        return BAM_SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


def bigwig_runs(f) -> Iterator[tuple[str, int, int, float]]:
    """(chrom, start0, end, value) of every section of an open BigWig file."""
    head = f.read(64)
    for e in "<>":
        if struct.unpack(e + "I", head[:4])[0] == 0x888FFC26:
            break
    else:
        raise ValueError("not a BigWig file")
    tree, index, packed = *struct.unpack_from(e + "QxxxxxxxxQ", head, 8), struct.unpack_from(e + "I", head, 52)[0]
    names: dict[int, str] = {}

    def chroms(at: int, key: int) -> None:
        f.seek(at)
        leaf, _, n = struct.unpack(e + "BBH", f.read(4))
        items = [f.read(key + 8) for _ in range(n)]
        for x in items:
            if leaf:
                names[struct.unpack_from(e + "I", x, key)[0]] = x[:key].rstrip(b"\0").decode()
            else:
                chroms(struct.unpack_from(e + "Q", x, key)[0], key)

    f.seek(tree)
    key = struct.unpack_from(e + "III", f.read(32))[2]
    chroms(tree + 32, key)

    def leaves(at: int) -> Iterator[tuple[int, int]]:
        f.seek(at)
        leaf, _, n = struct.unpack(e + "BBH", f.read(4))
        items = [struct.unpack_from(e + ("IIIIQQ" if leaf else "IIIIQ"), f.read(32 if leaf else 24)) for _ in range(n)]
        for x in items:
            if leaf:
                yield x[4], x[5]
            else:
                yield from leaves(x[4])

    for at, size in leaves(index + 48):
        f.seek(at)
        data = f.read(size)
        data = zlib.decompress(data) if packed else data
        chrom, start, _, step, span, kind, _, n = struct.unpack_from(e + "IIIIIBBH", data)
        for i in range(n):
            if kind == 1:
                s, t, v = struct.unpack_from(e + "IIf", data, 24 + 12 * i)
            elif kind == 2:
                s, v = struct.unpack_from(e + "If", data, 24 + 8 * i)
                t = s + span
            else:
                v = struct.unpack_from(e + "f", data, 24 + 4 * i)[0]
                s = start + i * step
                t = s + span
            yield names[chrom], s, t, v


class BigWigReader(DataSourceReader):
    def __init__(self, options):
        self.paths = options["paths"].split("\n") if "paths" in options else [options["path"]]
        self.samples = options.get("samples", "\n".join(self.paths)).split("\n")

    def partitions(self):
        return [_Range(p, s, 0, 0) for p, s in zip(self.paths, self.samples)]

    def read(self, part: _Range) -> Iterator[tuple]:
        with open_binary(part.path) as f:
            for chrom, s, t, v in bigwig_runs(f):
                yield part.sample, chrom, s, t, float(v)


class BigWigSource(DataSource):
    """format("capsite_bigwig"): (sample, chr, start0, end, score)."""

    @classmethod
    def name(cls):
        return "capsite_bigwig"

    def schema(self):
        return "sample string, chr string, start0 bigint, end bigint, score double"

    def reader(self, schema):
        return BigWigReader(self.options)


SECTION = "chrom string, start0 bigint, end bigint, n int, raw_size int, packed binary, bases bigint, low double, high double, total double, squares double"


def pack_section(chrom: str, number: int, runs: list[tuple[int, int, float]]) -> tuple:
    """A row of SECTION: sorted (start0, end, value) runs of one chromosome as a compressed section and its summary."""
    raw = struct.pack("<IIIIIBBH", number, runs[0][0], runs[-1][1], 0, 0, 1, 0, len(runs)) + b"".join(struct.pack("<IIf", *r) for r in runs)
    values = [(b - a, v) for a, b, v in runs]
    return (chrom, runs[0][0], runs[-1][1], len(runs), len(raw), zlib.compress(raw), sum(n for n, _ in values), min(v for _, v in values), max(v for _, v in values), sum(n * v for n, v in values), sum(n * v * v for n, v in values))


def packed_sections(rows, lengths: list[tuple[str, int]], per_section: int = 1024):
    """A frame of SECTION rows, in the order of (chr, start0), of a frame sorted like that."""
    import pandas as pd

    ids = {c: i for i, (c, _) in enumerate(sorted(lengths))}
    names = [f.split()[0] for f in SECTION.split(", ")]

    def pack(batches):
        chrom, held = None, []
        for pdf in batches:
            out = []
            for c, a, b, v in zip(pdf["chr"], pdf["start0"], pdf["end"], pdf["score"]):
                if held and (c != chrom or len(held) == per_section):
                    out.append(pack_section(chrom, ids[chrom], held))
                    held = []
                chrom = c
                held.append((a, b, v))
            if out:
                yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame([pack_section(chrom, ids[chrom], held)], columns=names)

    return rows.select("chr", "start0", "end", "score").mapInPandas(pack, SECTION)


def create_binary(path: str):
    """A file to write from the start to the end, local or in any store that pyarrow reaches."""
    if "://" not in path:
        return open(path, "wb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner)


def write_bigwig(path: str, lengths: list[tuple[str, int]], sections: Iterator[tuple], fan: int = 256) -> None:
    """Writes packed sections that come in the order of chromosome name and start; no zoom levels.

    Sections go to a spool file as they come, since the head of the format holds where they end; the index has as
    many levels as its size asks for. Only an entry of 32 bytes for each section stays in memory.
    """
    import shutil
    import tempfile

    ids = {c: i for i, (c, _) in enumerate(sorted(lengths))}
    size, key = dict(lengths), max((len(c) for c, _ in lengths), default=1)
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, max(len(ids), 1), key, 8, len(ids), 0) + struct.pack("<BBH", 1, 0, len(ids))
    tree += b"".join(c.encode().ljust(key, b"\0") + struct.pack("<II", i, size[c]) for c, i in ids.items())
    data_at = 64 + 40 + len(tree)
    at, widest, bases, low, high, total, squares = data_at + 8, 0, 0, float("inf"), float("-inf"), 0.0, 0.0
    level: list[tuple] = []  # (chrom, start, chrom, end, offset, size) of leaves
    with tempfile.TemporaryFile() as spool:
        for chrom, start, end, _, raw_size, packed, n, lo, hi, t, q in sections:
            level.append((ids[chrom], start, ids[chrom], end, at, len(packed)))
            spool.write(packed)
            at += len(packed)
            widest, bases, low, high, total, squares = max(widest, raw_size), bases + n, min(low, lo), max(high, hi), total + t, squares + q
        index_at, count = at, len(level)
        levels = [[level[i : i + fan] for i in range(0, len(level), fan)] or [[]]]  # from the leaves up
        span = lambda g: (g[0][0], g[0][1], max((x[2], x[3]) for x in g)[0], max((x[2], x[3]) for x in g)[1])
        while len(levels[-1]) > 1:
            nodes = [(*span(g), k) for k, g in enumerate(levels[-1])]
            levels.append([nodes[i : i + fan] for i in range(0, len(nodes), fan)])
        bounds = span([(*span(g),) for g in levels[0]]) if count else (0, 0, 0, 0)
        index = [struct.pack("<IIQIIIIQII", 0x2468ACE0, fan, count, *bounds, index_at, 1024, 0)]
        place = index_at + 48
        for depth in range(len(levels) - 1, -1, -1):
            nodes = levels[depth]
            place += sum(4 + (32 if depth == 0 else 24) * len(g) for g in nodes)
            if depth == 0:
                index += [struct.pack("<BBH", 1, 0, len(g)) + b"".join(struct.pack("<IIIIQQ", *x) for x in g) for g in nodes]
                continue
            width = [4 + (32 if depth == 1 else 24) * len(g) for g in levels[depth - 1]]
            offset = [place]
            for w in width:
                offset.append(offset[-1] + w)
            index += [struct.pack("<BBH", 0, 0, len(g)) + b"".join(struct.pack("<IIIIQ", *x[:4], offset[x[4]]) for x in g) for g in nodes]
        summary = struct.pack("<Qdddd", bases, low if count else 0.0, high if count else 0.0, total, squares)
        head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 104, data_at, index_at, 0, 0, 0, 64, max(widest, 1), 0)
        with create_binary(path) as f:
            f.write(head + summary + tree + struct.pack("<Q", count))
            spool.seek(0)
            shutil.copyfileobj(spool, f, 1 << 20)
            for part in index:
                f.write(part)
