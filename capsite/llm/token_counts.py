"""Token counts of a unigram vocabulary by a count-only Viterbi.

An Aho-Corasick automaton lists every vocabulary match of a word by its end; a pass over the matches, in
order of start, carries for each place the best score and the number of pieces on the best path, nothing
else. Tie rule of the tokenizers library: of equal scores the path found first stays, that of the earliest
last piece's start. A character that no one-character piece covers may be passed at the lowest score less ten; with
byte fallback it counts one piece a byte, unless the joined run of such characters is itself a piece.

Words are cut as by the Metaspace rule: spaces become the mark, one is put in front, and a word begins at
each mark. Word counts are remembered in tables that are bounded by their characters. Defined cases: null and
empty texts have no tokens; repeated rows are counted alike; null ids stay null; texts and words may be of any
length; empty tables give no rows; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value
#: Characters of words remembered by a worker, and the length of the longest words that are counted in step.
REMEMBERED, IN_STEP = 12_000_000, 40
BETWEEN = "\x00"


class Unigram:
    """A vocabulary of (piece, score), with an unknown id and byte fallback."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, remembered: int = REMEMBERED):
        self.pieces = {p for p, _ in vocabulary}
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in self.pieces for b in range(256))
        self.find = ahocorasick.Automaton()
        scores = {p: s for p, s in vocabulary if p}
        self.size, self.score = np.array([len(p) for p in scores]), np.array(list(scores.values()))
        for i, p in enumerate(scores):
            self.find.add_word(p, i)
        self.find.make_automaton()
        self.plain = not any(BETWEEN in p for p in scores)
        # Neighbours that stand together in some piece. No piece spans another pair, so where scores are whole
        # numbers, whose sums are exact in any order, a word may be cut there.
        self.pairs = np.unique(np.array([ord(a) << 21 | ord(b) for p in scores for a, b in zip(p, p[1:])], np.int64))
        self.single = np.unique(np.array([ord(p) for p in scores if len(p) == 1], np.int64))
        self.cuts = self.plain and bool(len(self.pairs)) and bool(len(self.single)) and all(float(x).is_integer() for x in self.score)
        self.parts: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.remembered = remembered
        self.held = {"parts": 0, "known": 0}  # characters in either table

    def count(self, word: str) -> int:
        """Pieces of one pre-token."""
        n = len(word)
        if not n:
            return 0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, i in self.find.iter(word):
            ends[end].append((int(self.size[i]), float(self.score[i])))
        score, pieces, back = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        unknown = False
        covered = [any(size == 1 for size, _ in e) for e in ends]
        for end in range(1, n + 1):
            best, from_, skip = None, 0, False
            found = ends[end - 1]
            found.sort(reverse=True)  # earliest start first
            for size, s in found:
                c = s + score[end - size]
                if best is None or c > best:
                    best, from_ = c, end - size
            if not covered[end - 1]:
                c = self.unknown + score[end - 1]
                if best is None or c > best:
                    best, from_, skip = c, end - 1, True
            score[end], back[end] = best, ~from_ if skip else from_
            pieces[end] = pieces[from_] + 1
            unknown |= skip
        return pieces[n] if not unknown else self._with_unknown(word, back)

    def _with_unknown(self, word: str, back: list[int]) -> int:
        """Counts along the best path, joining neighbouring unknown characters."""
        total, at, run_end = 0, len(word), None
        while at > 0 or run_end is not None:
            b = back[at] if at > 0 else 0
            if at > 0 and b < 0:
                run_end = at if run_end is None else run_end
                at = ~b
                continue
            if run_end is not None:
                run = word[at:run_end]
                total += 1 if run in self.pieces or not self.bytes else len(run.encode())
                run_end = None
                continue
            total, at = total + 1, b
        return total

    def count_many(self, words: list[str]) -> list[int]:
        """Pieces of each word, all carried through their places in step.

        Words too long to be worth a step of their own, or with two unknown characters in a row, go one by one.
        """
        if not self.plain:
            return [self.count(w) for w in words]
        alone = [i for i, w in enumerate(words) if len(w) > IN_STEP or not w or BETWEEN in w]
        out = np.zeros(len(words), np.int64)
        for i in alone:
            out[i] = self.count(words[i])
        skip = set(alone)
        index = np.array([i for i in range(len(words)) if i not in skip], np.int64)
        if not len(index):
            return out.tolist()
        own = [words[i] for i in index.tolist()]
        text = BETWEEN.join(own)
        length = np.array([len(w) for w in own])
        start = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
        packed = np.fromiter((e << 32 | i for e, i in self.find.iter(text)), np.int64)
        end, piece = packed >> 32, packed & 0xFFFFFFFF
        size, gain = self.size[piece], self.score[piece]
        covered = np.zeros(len(text), bool)
        covered[end[size == 1]] = True
        covered[start[1:] - 1] = True
        bare = np.flatnonzero(~covered)
        # An unknown character is a piece of its own that comes last; it counts a token a byte with fallback.
        width = np.array([len(text[i].encode()) for i in bare.tolist()], np.int64) if self.bytes else np.ones(len(bare), np.int64)
        end, size, gain = np.append(end, bare), np.append(size, np.ones(len(bare), np.int64)), np.append(gain, np.full(len(bare), self.unknown))
        cost = np.append(np.ones(len(piece), np.int64), width)
        word = np.searchsorted(start, end, "right") - 1
        place = end - start[word] + 1
        last = np.append(np.zeros(len(piece), bool), np.ones(len(bare), bool))
        order = np.lexsort((last, -size, word, place))
        word, place, size, gain, cost = word[order], place[order], size[order], gain[order], cost[order]
        best = np.zeros((len(own), int(length.max()) + 1))
        count = np.zeros(best.shape, np.int64)
        cut = np.searchsorted(place, np.arange(1, best.shape[1] + 1))
        for p in range(1, best.shape[1]):
            a, b = cut[p - 1], cut[p] if p < len(cut) else len(place)
            w, s = word[a:b], size[a:b]
            if not len(w):
                continue
            sums = gain[a:b] + best[w, p - s]
            head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            top = np.maximum.reduceat(sums, head)
            is_top = np.flatnonzero(sums == np.repeat(top, np.diff(np.append(head, len(w)))))
            first = is_top[np.concatenate([[True], w[is_top[1:]] != w[is_top[:-1]]])]
            best[w[head], p] = top
            count[w[head], p] = count[w[first], p - s[first]] + cost[a:b][first]
        out[index] = count[np.arange(len(own)), length]
        twice = np.flatnonzero(np.diff(bare) == 1)
        for j in np.unique(np.searchsorted(start, bare[twice], "right") - 1).tolist():
            out[index[j]] = self.count(own[j])
        return out.tolist()

    def _fresh(self, name: str, seen: set[str]) -> list[str]:
        """Those not in the table, which begins anew when it would grow beyond its bound."""
        fresh = list(seen - getattr(self, name).keys())
        size = sum(map(len, fresh))
        if self.held[name] + size > self.remembered:
            setattr(self, name, {})
            self.held[name], fresh = 0, list(seen)
            size = sum(map(len, fresh))
        self.held[name] += size
        return fresh

    def count_cut(self, words: list[str]) -> list[int]:
        """As count_many, by way of the parts between which no piece reaches; parts are remembered too."""
        words = list(words)
        if not words:
            return []
        if not self.cuts or any(BETWEEN in w or not w for w in words):
            return self.count_many(words)
        text = BETWEEN.join(words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        among = lambda table, key: table[np.minimum(np.searchsorted(table, key), len(table) - 1)] == key
        single = among(self.single, code)
        cut = ~among(self.pairs, code[:-1] << 21 | code[1:]) & (single[:-1] | single[1:])  # unknown characters stay together
        gap = code == 0
        cut |= gap[:-1] | gap[1:]
        at = [0, *(np.flatnonzero(cut) + 1).tolist(), len(text)]
        parts = [text[a:b] for a, b in zip(at, at[1:])]
        seen = set(parts)
        fresh = [p for p in self._fresh("parts", seen) if p != BETWEEN]
        self.parts.update(zip(fresh, self.count_many(fresh)))
        self.parts[BETWEEN] = 0
        counts = np.array([*map(self.parts.__getitem__, parts)])
        first = np.concatenate([[0], np.flatnonzero(gap[np.array(at[:-1])]) + 1]) if parts else np.zeros(0, np.int64)
        return np.add.reduceat(counts, first).tolist() if len(words) else []

    def words(self, text: str) -> list[str]:
        """Pre-tokens without their leading mark."""
        if not text:
            return []
        marked = text.replace(" ", MARK)
        return (marked if marked.startswith(MARK) else MARK + marked)[1:].split(MARK)

    def count_texts(self, texts: list[str], group: int = 1_000_000) -> list[int]:
        """Tokens of each text; the new words of about ``group`` characters of text are counted together."""
        out: list[int] = []
        cut: list[list[str]] = []
        size = 0
        for i, text in enumerate(texts):
            cut.append(self.words(text))
            size += len(text)
            if size < group and i + 1 < len(texts):
                continue
            seen = set().union(*cut)
            fresh = self._fresh("known", seen)
            self.known.update(zip(fresh, self.count_cut([MARK + w for w in fresh])))
            look = self.known.__getitem__
            out += [sum(map(look, words)) for words in cut]
            cut, size = [], 0
        return out


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece model, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


_loaded: dict[str, Unigram] = {}


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens) of whole texts under the unigram reading of the vocabulary at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = Unigram(sentencepiece_vocabulary(path))
        model = _loaded[path]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(model.count_texts(texts), pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    cols = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return cols.mapInArrow(run, "doc_id bigint, n_chars bigint, n_tokens bigint")
