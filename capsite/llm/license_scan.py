"""Licence scan by a positional index of rare words.

Templates are word sequences of licence notices, each with a label and mandatory key phrases. The index lists
the postings (template, position) of every licence word. A first pass counts in how many documents each
licence word occurs. In the second, a document's places of licence words are looked up, the words of highest
inverse document frequency first: a place less the word's position in a template is where the template would
begin, and the sets of these beginnings are intersected word by word over the words of the mandatory phrases,
until none is left or all phrases stand where they belong. A beginning counts when the words that match there
hold enough of the template's weight (inverse document frequency).

Base phrases are templates that consist of one mandatory phrase, so every place of theirs is found.
Defined cases: null text is empty: no words, null places, no labels, score 0. Repeated rows are judged alike; null ids
stay null; texts may be of any length; empty tables give no rows; of words equally rare the alphabetically first
is looked up first, which changes no result; other columns are not read.
"""
from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from capsite.llm.common import text_bytes

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: the same words as the contract's class of characters
#: (label, notice, mandatory phrases); fixed values, wordings of public licence notices.
BASE = [("cc-by", "cc by", ["cc by"]), ("gpl", "general public license", ["general public license"]), ("reserved", "all rights reserved", ["all rights reserved"])]
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2", "except in compliance with the license"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["unless required by applicable law", "without warranties or conditions of any kind"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted", "free of charge", "deal in the software without restriction"]),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ["provided as is", "merchantability", "noninfringement"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license as published by the free software foundation", "version 3 of the license"]),
    ("gpl-2.0", "under the terms of the gnu general public license version 2", ["general public license version 2"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published by the free software foundation", "version 2 of the license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["this library is free software", "lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license", "a copy of the mpl was not distributed"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ["accompanying materials are made available", "eclipse public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["must reproduce the above copyright notice"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["neither the name of", "endorse or promote products derived from this software"]),
    ("bsd", "licensed under the bsd license", ["bsd license"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "cc0 1 0 universal", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ["free and unencumbered software", "released into the public domain"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify", "with or without fee"]),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", ["altered source versions must be plainly marked"]),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("wtfpl", "do what the fuck you want to public license", ["what the fuck you want to public license"]),
]
#: Least share of a template's weight that an alignment must match.
ENOUGH = 0.6


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # lower() of bytes changes A-Z only


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[tuple[int, list[bytes]]]  # place in the template, words


def templates() -> list[Template]:
    out = []
    for label, text, phrases in [*BASE, *TEMPLATES]:
        words = words_of(text.encode())
        placed = []
        for phrase in phrases:
            p = words_of(phrase.encode())
            placed.append((next(i for i in range(len(words)) if words[i : i + len(p)] == p), p))
        out.append(Template(label, words, placed))
    return out


VOCABULARY = frozenset(w for t in templates() for w in t.words)


class Index:
    """Postings by licence word, words ranked by rarity in the corpus."""

    def __init__(self, frequency: dict[bytes, int], n_docs: int):
        self.templates = templates()
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1e-3 for w in VOCABULARY}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            for i, w in enumerate(t.words):
                self.postings[w].append((k, i))
        self.weight = [sum(self.idf[w] for w in t.words) for t in self.templates]
        inside = [{i for at, p in t.phrases for i in range(at, at + len(p))} for t in self.templates]
        mandatory: list[list[tuple[bytes, int]]] = [[] for _ in self.templates]
        for w in sorted(self.postings, key=lambda w: (-self.idf[w], w)):  # rarest first
            for k, i in self.postings[w]:
                if i in inside[k]:
                    mandatory[k].append((w, i))
        self.mandatory = mandatory
        self.needed = [frozenset(w for w, _ in m) for m in mandatory]

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start of its first phrase, score) of all beginnings that hold."""
        own = VOCABULARY.intersection(words)
        may = [k for k, need in enumerate(self.needed) if need <= own]
        if not may:
            return []
        wanted = frozenset().union(*(self.needed[k] for k in may))
        places: dict[bytes, list[int]] = {w: [] for w in wanted}
        for at, w in enumerate(words):
            if w in wanted:
                places[w].append(at)
        found = {}
        n = len(words)
        for k in may:
            begins: set[int] | None = None
            for w, i in self.mandatory[k]:
                here = {at - i for at in places[w]}
                begins = here if begins is None else begins & here
                if not begins:
                    break
            t = self.templates[k]
            for start in begins:
                matched = sum(self.idf[w] for j, w in enumerate(t.words) if 0 <= start + j < n and words[start + j] == w)
                if matched >= ENOUGH * self.weight[k]:
                    found[k, start + t.phrases[0][0]] = matched / self.weight[k]
        return [(k, s, score) for (k, s), score in found.items()]


def document_frequency(docs: DataFrame, text: str) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word occurs, and the number of documents; the vocabulary bounds the result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, defaultdict(int)
        for batch in batches:
            total += batch.num_rows
            for t in batch.column(0).to_pylist():
                for w in VOCABULARY.intersection(words_of(t)):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([b"", *seen], pa.binary()), pa.array([total, *seen.values()], pa.int64())], ["word", "n"])

    rows = docs.select(text_bytes(text).alias("text")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document.

    Places are those of base phrases; labels add the templates'; score is the best share of a template's
    weight that was matched, 0 without a match.
    """
    index = Index(*document_frequency(docs, text))
    n_base = len(BASE)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for t in batch.column(1).to_pylist():
                words = words_of(t)
                hits = index.scan(words)
                base = [s for k, s, _ in hits if k < n_base]
                row = (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({index.templates[k].label for k, _, _ in hits if k < n_base})), ",".join(sorted({index.templates[k].label for k, _, _ in hits})), max((min(x, 1.0) for _, _, x in hits), default=0.0))
                for c, v in zip(out, row):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(scan, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
