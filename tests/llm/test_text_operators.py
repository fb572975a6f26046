"""Licence scan, quality rules, BPE and token counts against brute force and the tokenizers library."""
import hashlib
import os
import random
import re

import pytest

from capsite.llm import bpe, license_scan, quality_rules, token_counts
from capsite.llm.queries import tokenizer_file

BPE_FILE, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
needs_files = pytest.mark.skipif(not os.path.exists(BPE_FILE), reason="no tokenizer files here")
ODD = ["", None, " ", "  \n\n x", "a" * 5000, "don't I'll we've <|endoftext|> x<|endoftext|>", "é😀 ẞ 漢字かな" * 20, "\x00\x01 �", " " * 300 + "x", "1234567890" * 99, "▁ ▁▁x", "the" * 2000, "b\x1cc\x1d d\x85e"]


def texts(n=300, seed=3):
    r = random.Random(seed)
    return ODD + ["".join(r.choice("ab the'sélnr 12.\n\t😀") for _ in range(r.randint(1, 300))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "h", i) for i, t in enumerate(rows)], "doc_id bigint, text string, source string, score bigint")


def test_license_scan(spark):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    r = random.Random(1)
    rows = [" ".join(r.choice(["CC", "by", "cc-by", "all", "rights", "RESERVED.", "general", "public", "license", "É"]) for _ in range(r.randint(0, 60))) for _ in range(200)]
    rows += ["x This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "", None, "All rights reserved " * 5000]
    got = {r["doc_id"]: r for r in license_scan.license_scan(frame(spark, rows)).collect()}
    for i, t in enumerate(rows):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = word.findall(low)
        hits = [(k, p) for p in phrases for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        g = got[i]
        assert (g["n_words"], g["n_base"]) == (len(w), len(hits))
        assert (g["first_word"], g["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert g["base_labels"] == ",".join(sorted({phrases[p] for _, p in hits}))
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1
    assert "gpl-3.0" in got[200]["labels"] and got[201]["labels"] == "mit" and "cc-by-nc" in got[202]["labels"]
    assert license_scan.license_scan(frame(spark, [])).count() == 0


def test_templates_against_every_alignment():
    r = random.Random(2)
    notices = [t for _, t, _ in license_scan.TEMPLATES]
    index = license_scan.Index({w: r.randint(0, 90) for w in license_scan.VOCABULARY}, 100)
    hits = 0
    for _ in range(400):
        words = license_scan.words_of(" ".join(r.choice(["and so on", r.choice(notices), "the license"]) for _ in range(3)).encode())
        for _ in range(r.choice([0, 1, 3, 8])):
            words[r.randrange(len(words))] = b"other"
        words = words[r.randrange(3) :]
        want = {}
        for k, t in enumerate(index.templates):
            for start in range(-len(t.words), len(words)):
                if all(start + at >= 0 and words[start + at : start + at + len(p)] == p for at, p in t.phrases):
                    score = sum(index.idf[w] for j, w in enumerate(t.words) if 0 <= start + j < len(words) and words[start + j] == w) / index.weight[k]
                    if score >= license_scan.ENOUGH:
                        want[k, start + t.phrases[0][0]] = score
        got = {(k, s): score for k, s, score in index.scan(words)}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in got)
        hits += len(got)
    assert hits > 300


def test_repeated_rows_and_null_ids(spark):
    text = "All rights reserved. " + "some ordinary words that differ from one another " * 2
    docs = spark.createDataFrame([(None, text, "h", 1), (1, text, "h", 2), (1, text, "h", 3)], "doc_id bigint, text string, source string, kept int")
    licences, quality = license_scan.license_scan(docs).collect(), quality_rules.quality_rules(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_base"], r["labels"]) for r in licences) == [(0, 1, "reserved"), (1, 1, "reserved"), (1, 1, "reserved")]
    assert len({tuple(r[f] for f in quality_rules.FIELDS) for r in quality}) == 1 and len(quality) == 3


def test_quality_counts(spark):
    rows = texts() + ["one two three four five " * 4, "a\na\n\n \na b", "x" * 20]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    for i, t in enumerate(rows):
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        inside = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert tuple(got[i][f] for f in quality_rules.FIELDS) == want
        assert got[i]["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_host_rules(spark):
    clean = "these are twelve quite ordinary words that make up one clean sentence here"
    mild = clean + " " + "#" * 40
    rows = [(i, mild, "bad") for i in range(40)] + [(50, clean, "bad")] + [(100 + i, clean, "good") for i in range(60)] + [(200, mild, "good"), (201, None, None), (202, mild, None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, source string, _bad int")
    kept = {r["doc_id"] for r in quality_rules.quality_rules(docs).filter("kept").collect()}
    assert 50 in kept and 200 in kept and not kept & set(range(40)) and 201 not in kept
    stage = quality_rules.keep_good(docs)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == kept
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert quality_rules.keep_good(empty).count() == 0 and quality_rules.quality_rules(empty).count() == 0


@needs_files
def test_bpe(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE_FILE)
    rows = texts()
    got = {r["doc_id"]: r for r in bpe.bpe_round_trip(frame(spark, rows), BPE_FILE, with_ids=True).collect()}
    for i, t in enumerate(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@needs_files
def test_bpe_streams(monkeypatch):
    from tokenizers import Tokenizer

    v, library, r = bpe.Vocabulary(BPE_FILE), Tokenizer.from_file(BPE_FILE), random.Random(4)
    for word in ("the" * 5000, "".join(r.choice("ethnaior") for _ in range(20_000)), "=" * 7001):
        t = bpe.Transducer(v)
        out = [x for k in range(0, len(word), 333) for x in t.feed(word[k : k + 333].encode())]
        assert len(t.buffer) < t.bound and [*out, *t.finish()] == library.encode(word).ids
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(30)]
        d = bpe.Decoder(v)
        assert "".join(d.feed([i]) for i in ids) + d.finish() == library.decode(ids, skip_special_tokens=False)
    rows = [t or "" for t in texts(60)] + ["don't we'll  " * 300, "漢字かな😀" * 900, "x" * 3000 + " " * 3000 + "y", ("x'" + "re ") * 500, "\n\n  \t" * 400 + "'ll"]
    want = [library.encode(t, add_special_tokens=False).ids for t in rows]
    for chunk, remembered in ((1 << 15, 20), (1 << 15, 10**6), (50, 10**6), (7, 300)):
        monkeypatch.setattr(bpe, "CHUNK", chunk)
        monkeypatch.setattr(bpe, "TOGETHER", 20 * chunk)
        e = bpe.Encoder(v, remembered)
        assert list(e.encode(rows)) == want and list(e.counts(rows)) == list(map(len, want)) == list(e.counts(rows))
        pieces = list(e.pieces(rows))
        assert [n for n, _, _ in pieces] == sorted(n for n, _, _ in pieces) and sum(last for *_, last in pieces) == len(rows)


@needs_files
def test_every_pre_token_goes_through_the_transducer(monkeypatch):
    v = bpe.Vocabulary(BPE_FILE)
    seen = []
    monkeypatch.setattr(v, "merge", lambda words, merge=v.merge: seen.extend(words) or merge(words))
    word = "ab" * 5000
    assert bpe.side_by_side(v, [word.encode(), b" the"])[1] == tuple(v.merge([b" the"])[0])
    assert max(map(len, seen)) <= bpe.Transducer(v).bound  # nothing longer than a buffer is merged


@needs_files
def test_bpe_and_counts_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, "a b", 2), (1, "a b", 3), (2, None, 4)], "doc_id bigint, text string, n_tokens int")
    for f, path in ((bpe.bpe_round_trip, BPE_FILE), (token_counts.token_counts, PIECES)):
        got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in f(docs, path).collect())
        assert [g[0] for g in got] == [0, 1, 1, 2] and len({g[1] for g in got[:3]}) == 1 and got[3][1] == 0
        assert f(docs.limit(0), path).count() == 0


@needs_files
def test_token_counts(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.sentencepiece_vocabulary(PIECES)
    library = Tokenizer(models.Unigram(vocabulary, 0, True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = texts()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(frame(spark, rows), PIECES).collect()}
    assert all(got[i] == len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(rows))


def test_token_ties():
    from tokenizers import Tokenizer, models

    r = random.Random(8)
    for whole in (True, False):
        pieces = [("<unk>", 0.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("aab", -6.0), ("xy", -9.0), ("abab", -8.0 if whole else -8.1)]
        for fallback in (False, True):
            pieces = pieces + [(f"<0x{b:02X}>", -30.0) for b in range(256)] * fallback
            model, library = token_counts.Unigram(pieces, fallback, 500), Tokenizer(models.Unigram(pieces, 0, fallback))
            words = ["".join(r.choice("abxyé") for _ in range(r.randint(1, 12))) for _ in range(400)]
            want = [len(library.encode(w).ids) for w in words]
            assert model.count_many(words) == model.count_cut(words) == [model.count(w) for w in words] == want
