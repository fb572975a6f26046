"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder as a byte-to-text state machine.

A merge decision reaches only so far to the right: the pair (a, b) of rank r is made unless b's right edge
was taken earlier, by a rule of lower rank whose own right part might have been taken by one of yet lower
rank, and so on. Following these chains through the merge list gives its sufficient lookahead L in bytes: a
token token of a prefix is final once L bytes beyond its end are known. Every pre-token is fed to a transducer in bounded
pieces: its buffer is merged, tokens that are final leave, and what leaves is hashed and decoded at once.
Transducers of many pre-tokens step side by side in numpy, and results of short pre-tokens are remembered in a
table of bounded size. Texts are cut into pre-tokens chunk by chunk, so that beside the text itself memory does
not grow with it. The decoder is a state machine over tokens: its state is an unfinished character, and a
token's bytes lead to text and to the next state.

Special tokens of the file are matched first, as the tokenizers library does by default. Defined cases: null
text is empty and has no tokens; repeated rows give equal rows; texts may be of any length, with or without space;
null ids stay null; equal ranks don't occur, and of overlapping equal pairs the left one is made; empty
tables give no rows; other columns are not read, so their names don't matter.
"""
from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: The pre-tokenizer of the byte-level format; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_L, _N, _S = "A-Za-zÀ-ÖØ-öø-ÿ", "0-9", r" \t\n\r"
#: The same pattern over texts of these characters only.
PLAIN_TEXT = re.compile(rf"[\x20-\x7e\t\n\rÀ-ÖØ-öø-ÿ]*")
PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Characters of pre-tokens that a worker remembers, and of the longest one.
REMEMBERED, LONGEST = 6_000_000, 100
#: Characters that are cut into pre-tokens at once, and that are encoded together.
CHUNK, TOGETHER = 1 << 15, 1_000_000


def byte_alphabet() -> dict[str, int]:
    """The format's printable stand-in of each byte: visible Latin-1 stands for itself, the rest follows from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens and merges of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level BPE file without prefix space is needed")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.raw: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.raw[i] = bytes(byte[c] for c in token)
        for token, i in self.special.items():
            self.raw[i] = token.encode()
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.size = size
        key = self.left * size + self.right
        self.order = np.argsort(key)
        self.keys = key[self.order]
        self.of_byte = np.zeros(256, np.int64)
        for c, b in byte.items():
            self.of_byte[b] = ids[c]
        self.text = [str(i) for i in range(size)]
        self.lookahead = self._lookahead()
        self.longest = max(map(len, self.raw))
        self.whole = [_text(r) for r in self.raw]  # of tokens that hold whole characters only
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pre_tokens(self, text: str, start: int, end: int) -> Iterator[list[str] | tuple[int, int]]:
        """The pre-tokens of a stretch of text in lists, or the place of one that is longer than a chunk.

        Texts of plain Latin letters take an equal pattern of explicit classes, which is faster. At the end of a
        chunk the last two matches may look different with what follows, so they are cut again in the next one.
        """
        pattern = PLAIN if PLAIN_TEXT.fullmatch(text, start, end) else self.split
        while start < end:
            stop = min(start + CHUNK, end)
            found = pattern.findall(text, start, stop)
            if stop < end:
                del found[-2:]
            if found:
                yield found
                start = end if stop == end else start + sum(map(len, found))
            else:
                stop = pattern.match(text, start, end).end()
                yield start, stop
                start = stop

    def _lookahead(self) -> int:
        """Longest chain of rules, in bytes to the right, that can decide whether a rule applies.

        reach[x] is the most that rules seen so far with left part x look ahead. A rule (a, b) looks at b
        and, through any part on b's right edge, at what such a rule of lower rank looks at.
        """
        reach: dict[int, int] = {}
        edge: dict[int, int] = {}  # token -> its right part, by the rule that made it
        best = 0
        for a, b, c in zip(self.left.tolist(), self.right.tolist(), self.made.tolist()):
            far, part = 0, b
            while part is not None:
                far = max(far, reach.get(part, 0))
                part = edge.get(part)
            look = len(self.raw[b]) + far
            if look > reach.get(a, 0):
                reach[a] = look
            edge.setdefault(c, b)
            best = max(best, look)
        return best

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], len(self.keys))

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each word."""
        ids, size = self.merged(words)
        ids, ends = ids.tolist(), np.cumsum(size).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words end to end and their number for each, all words merged in step: each takes its lowest-ranked pair, leftmost first."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = np.array([len(w) for w in words])
        ids = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), length)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.keys)
        rank = np.full(len(ids), none)
        if len(ids) > 1:
            inner = word[1:] == word[:-1]
            rank[:-1][inner] = self.ranks(ids[:-1][inner], ids[1:][inner])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            lows = np.repeat(low, size)
            over = lows == none
            if over.any():
                done.append((word[over], ids[over]))
                live = ~over
                ids, word, rank, lows = ids[live], word[live], rank[live], lows[live]
                if not len(ids):
                    break
            hit = rank == lows
            # In a chain of overlapping pairs (aaa) every other one is made, from the left.
            before = np.concatenate([[False], hit[:-1]])
            if (hit & before).any():
                head = np.flatnonzero(hit & ~before)
                at = np.arange(len(hit)) - np.repeat(head, np.diff(np.append(head, len(hit))))[: len(hit)] if head[0] == 0 else np.concatenate([np.zeros(head[0], np.int64), np.arange(head[0], len(hit)) - np.repeat(head, np.diff(np.append(head, len(hit))))])
                hit &= at % 2 == 0
            at = np.flatnonzero(hit)
            ids[at] = self.made[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            touched = np.zeros(len(ids), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            back = at[at > 1]
            touched[back - 2] |= ~keep[back - 1]
            ids, word, rank, touched = ids[keep], word[keep], rank[keep], touched[keep]
            again = np.flatnonzero(touched)
            inner = again[again + 1 < len(ids)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[again] = none
            rank[inner] = self.ranks(ids[inner], ids[inner + 1])
        where = np.concatenate([d[0] for d in done])
        what = np.concatenate([d[1] for d in done])
        return what[np.argsort(where, kind="stable")], np.bincount(where, minlength=len(words))


class Transducer:
    """Encodes one pre-token fed in pieces of bytes; tokens come out once no further byte can change them."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.buffer = vocabulary, b""
        self.bound = 2 * (vocabulary.lookahead + vocabulary.longest)

    def feed(self, piece: bytes) -> Iterator[int]:
        at = 0
        while at < len(piece):
            room = max(self.bound - len(self.buffer), 1)
            self.buffer += piece[at : at + room]
            at += room
            if len(self.buffer) >= self.bound:
                yield from self._final(self.v.merge([self.buffer])[0])

    def _final(self, tokens: tuple[int, ...]) -> Iterator[int]:
        """Those tokens of the buffer that are final; the rest stays in it."""
        used = 0
        for token in tokens:
            end = used + len(self.v.raw[token])
            if end + self.v.lookahead > len(self.buffer):
                break
            yield token
            used = end
        self.buffer = self.buffer[used:]

    def finish(self) -> Iterator[int]:
        yield from self.v.merge([self.buffer])[0] if self.buffer else ()
        self.buffer = b""


def _go_on(vocabulary: Vocabulary, words: list[bytes], first: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Ids of words that are longer than a buffer: a transducer each, fed in step, whose buffers are merged together. first: merged first buffers."""
    lanes = [Transducer(vocabulary) for _ in words]
    fed = [t.bound for t in lanes]
    out: list[list[int]] = []
    for t, w, tokens in zip(lanes, words, first):
        t.buffer = w[: t.bound]
        out.append(list(t._final(tokens)))
    live = list(range(len(words)))
    while live:
        for i in live:
            room = lanes[i].bound - len(lanes[i].buffer)
            lanes[i].buffer += words[i][fed[i] : fed[i] + room]
            fed[i] += room
        rest = []
        for i, tokens in zip(live, vocabulary.merge([lanes[i].buffer for i in live])):
            if fed[i] >= len(words[i]):
                out[i] += tokens
            else:
                out[i] += lanes[i]._final(tokens)
                rest.append(i)
        live = rest
    return [tuple(x) for x in out]


def side_by_side(vocabulary: Vocabulary, words: list[bytes]) -> list[tuple[int, ...]]:
    """Ids of each word: a transducer each, all fed one buffer at a time; a word that ends in its first is done with it."""
    bound = Transducer(vocabulary).bound
    out = vocabulary.merge([w[:bound] for w in words])
    more = [i for i, w in enumerate(words) if len(w) > bound]
    for i, ids in zip(more, _go_on(vocabulary, [words[i] for i in more], [out[i] for i in more])):
        out[i] = ids
    return out


def counts_side_by_side(vocabulary: Vocabulary, words: list[bytes]) -> list[int]:
    """The number of ids of each word, in the same way."""
    bound = Transducer(vocabulary).bound
    out = vocabulary.merged([w[:bound] for w in words])[1].tolist()
    more = [i for i, w in enumerate(words) if len(w) > bound]
    for i, ids in zip(more, side_by_side(vocabulary, [words[i] for i in more])):
        out[i] = len(ids)
    return out


class Encoder:
    """Texts to ids, with a bounded memory of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.v, self.remembered, self.known, self.counted = vocabulary, remembered, {}, {}
        self.size = {"known": 0, "counted": 0}  # characters in either table

    def _learn(self, words: set[str], name: str, work) -> dict:
        """Results of all words from the table ``name``; those of moderate length are remembered there."""
        table = getattr(self, name)
        fresh = list(words - table.keys())
        length = sum(map(len, fresh))
        if self.size[name] + length > self.remembered:
            table, fresh = {}, list(words)
            setattr(self, name, table)
            self.size[name] = 0
        found = dict(zip(fresh, work(self.v, [w.encode() for w in fresh])))
        long = {w: x for w, x in found.items() if len(w) > LONGEST} if max(map(len, fresh), default=0) > LONGEST else {}
        for w in long:
            del found[w]
        table.update(found)
        self.size[name] += length
        return table | long if long else table

    def pieces(self, texts: Iterable[str]) -> Iterator[tuple[int, Iterable[int], bool]]:
        """(number of the text, further ids of it, whether they are its last), in order."""
        group: list[tuple[int, object, bool]] = []
        size = 0
        for n, text in enumerate(texts):
            for part in self._parts(text):
                if isinstance(part, tuple):
                    yield from self._flush(group)
                    group, size = [], 0
                    yield from ((n, ids, False) for ids in self._long(text, *part))
                    continue
                group.append((n, part, False))
                size += CHUNK if isinstance(part, list) and len(text) > CHUNK else len(text)
                if size > TOGETHER:
                    yield from self._flush(group)
                    group, size = [], 0
            group.append((n, [], True))
        yield from self._flush(group)

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """All ids of each text."""
        held: list[int] = []
        for _, ids, last in self.pieces(texts):
            held.extend(ids)
            if last:
                yield held
                held = []

    def counts(self, texts: Iterable[str]) -> Iterator[int]:
        """The number of tokens of each text."""
        group: list[tuple[object, bool]] = []
        size = 0

        total = 0
        for text in chain(texts, [None]):
            for part in self._parts(text) if text is not None else ():
                group.append((sum(map(len, self._long(text, *part))) if isinstance(part, tuple) else part if isinstance(part, list) else 1, False))
                size += CHUNK if len(text) > CHUNK else len(text)
            group.append((0, True))
            if size > TOGETHER or text is None:
                look = self._learn(set().union(*[p for p, _ in group if isinstance(p, list)]), "counted", counts_side_by_side).__getitem__
                for part, last in group if text is not None else group[:-1]:
                    total += sum(map(look, part)) if isinstance(part, list) else part
                    if last:
                        yield total
                        total = 0
                group, size = [], 0

    def _parts(self, text: str) -> Iterator[list[str] | tuple[int, int] | int]:
        """Pre-tokens of the stretches between special tokens, and the ids of these."""
        at = 0
        if self.v.specials is not None and any(s in text for s in self.v.special):
            for m in self.v.specials.finditer(text):
                yield from self.v.pre_tokens(text, at, m.start())
                yield self.v.special[m.group()]
                at = m.end()
        yield from self.v.pre_tokens(text, at, len(text))

    def _long(self, text: str, start: int, end: int) -> Iterator[list[int]]:
        t = Transducer(self.v)
        for a in range(start, end, CHUNK):
            yield list(t.feed(text[a : min(a + CHUNK, end)].encode()))
        yield list(t.finish())

    def _flush(self, group: list[tuple[int, object, bool]]) -> Iterator[tuple[int, Iterable[int], bool]]:
        look = self._learn(set().union(*[p for _, p, _ in group if isinstance(p, list)]), "known", side_by_side).__getitem__
        for n, p, last in group:
            yield n, [p] if isinstance(p, int) else list(chain.from_iterable(map(look, p))), last


def _text(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


class Decoder:
    """Ids to text, a token at a time: bytes go through a UTF-8 automaton and leave as whole characters.

    The state is the unfinished character. Ill-formed input gives one replacement character for each maximal
    part of a character.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.part, self.need, self.low, self.high = vocabulary, b"", 0, 0x80, 0xBF

    def feed(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        whole = self.v.whole
        if not self.need:
            out = [whole[i] for i in ids]
            if None not in out:  # the state stays empty
                return "".join(out)
        out = []
        for i in ids:
            if not self.need and whole[i] is not None:
                out.append(whole[i])
            else:
                self._step(self.v.raw[i], out)
        return "".join(out)

    def _step(self, raw: bytes, out: list[str]) -> None:
        at = 0
        while at < len(raw):
            b = raw[at]
            if self.need:
                if self.low <= b <= self.high:
                    self.part += bytes([b])
                    self.need, self.low, self.high, at = self.need - 1, 0x80, 0xBF, at + 1
                    if not self.need:
                        out.append(self.part.decode())
                else:
                    out.append("\ufffd")
                    self.need = 0
            else:
                at += 1
                if b < 0x80:
                    out.append(chr(b))
                elif 0xC2 <= b <= 0xF4:
                    self.part, self.need = bytes([b]), 1 + (b >= 0xE0) + (b >= 0xF0)
                    self.low = 0xA0 if b == 0xE0 else 0x90 if b == 0xF0 else 0x80
                    self.high = 0x9F if b == 0xED else 0x8F if b == 0xF4 else 0xBF
                else:
                    out.append("\ufffd")

    def finish(self) -> str:
        """What an unfinished character at the end becomes."""
        end, self.need = ("\ufffd" if self.need else ""), 0
        return end


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker and file."""
    if path not in _loaded:
        _loaded[path] = Encoder(Vocabulary(path))
    return _loaded[path]


def bpe_round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and the ids themselves with ``with_ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        names = e.v.text
        for batch in batches:
            counts, a, b, ids_of = [], [], [], []
            n, own, decoded, decoder, held = 0, hashlib.sha256(), hashlib.sha256(), Decoder(e.v), []
            for _, ids, last in e.pieces(batch.column(1).to_pylist()):
                if ids:
                    own.update((("," if n else "") + ",".join([names[i] for i in ids])).encode())
                    decoded.update(decoder.feed(ids).encode())
                    n += len(ids)
                    if with_ids:
                        held += ids
                if last:
                    decoded.update(decoder.finish().encode())
                    for column, value in ((counts, n), (a, own.hexdigest()), (b, decoded.hexdigest()), (ids_of, held)):
                        column.append(value)
                    n, own, decoded, decoder, held = 0, hashlib.sha256(), hashlib.sha256(), Decoder(e.v), []
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids_of, pa.list_(pa.int32()))] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    cols = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return cols.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
