"""Window dedup by bytes and by words against brute force."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from capsite.llm import anchors, rlz_dedup, suffix_dedup

LAST = 1 << 63


def brute(sequences, window):
    seen, out = set(), []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            key = s[i : i + window] if isinstance(s, bytes) else tuple(s[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append(gone)
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["aa", "b", "cé", "dd", "e"]
    passages = [" ".join(r.choice(words) for _ in range(r.choice([15, 30, 60, 200]))) for _ in range(6)]
    rows = []
    for _ in range(60):
        parts = [r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(words) + str(r.randint(0, 50)) for _ in range(r.randint(1, 40))) for _ in range(r.randint(0, 5))]
        rows.append((r.randint(0, 10**6), r.choice([" ", "\n", "  "]).join(parts) if r.random() < 0.95 else None))
    return rows + [(7_000_001, "a" * 500), (7_000_002, "a" * 130), rows[3], (7_000_003, ""), (7_000_004, rows[5][1]), (None, rows[6][1]), (8_000_000, "ab " * 4000), (8_000_001, "x" + "ab " * 3000)]


@pytest.mark.parametrize("seed", [1, 5])
@pytest.mark.parametrize("hot,shard", [(None, 1 << 22), (2, 1 << 22), (None, 3000), (2, 2000)])
def test_bytes(spark, seed, hot, shard):
    rows = corpus(seed)
    order = sorted(set(rows), key=lambda r: LAST if r[0] is None else r[0])
    want = {}
    for (i, t), gone in zip(order, brute([(t or "").encode() for _, t in order], 100)):
        b = (t or "").encode()
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), kept)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n_removed int, spans string")
    got = suffix_dedup.suffix_dedup(docs, hot=hot, shard=shard).collect()
    assert len(got) == len(rows)
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]] for r in got)


@pytest.mark.parametrize("seed", [1, 5])
@pytest.mark.parametrize("hot,block", [(None, 1 << 20), (2, 1 << 20), (None, 3000), (2, 2000)])
def test_words(spark, seed, hot, block):
    rows = corpus(seed)
    order = sorted(set(rows), key=lambda r: LAST if r[0] is None else r[0])
    words = [(t or "").encode().split() for _, t in order]
    want = {i: (len(w), sum(g), b" ".join(x for x, y in zip(w, g) if not y)) for (i, _), w, g in zip(order, words, brute(words, 20))}
    got = rlz_dedup.rlz_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), hot=hot, block=block).collect()
    assert len(got) == len(rows)
    assert all((r["n_words"], r["n_removed"], bytes(r["kept"])) == want[r["doc_id"]] for r in got)


def test_long_rows_are_cut():
    r = random.Random(0)
    text = bytes(r.choice(b"abc  \n") for _ in range(9000)) + b"x" * 2000 + b" yy" * 300
    for unit in (anchors.Unit("bytes", 100, 32), anchors.Unit("words", 20, 8)):
        whole = unit.items(text)
        windows = [unit.content(whole[i : i + unit.window]) for i in range(len(whole) - unit.window + 1)]
        for size in (300, 700, 20_000):
            cut = [(first + i, unit.content(items[i : i + unit.window])) for first, items in unit.pieces(text, size) for i in range(len(items) - unit.window + 1)]
            assert cut == list(enumerate(windows))


def test_suffix_array_and_prefixes():
    r = random.Random(2)
    rows = [bytes(r.choice(b"ab\x00") for _ in range(r.randint(0, 60))) for _ in range(20)] + [b"abab" * 100, b"\x00" * 50, b"abab" * 90]
    x = np.frombuffer(b"".join(rows), np.uint8)
    b = bytes(x)
    sa, rank, near = suffix_dedup.suffix_order(x)
    assert sa.tolist() == sorted(range(len(x)), key=lambda i: b[i:]) and sorted(rank.tolist()) == list(range(len(x)))
    for depth in (20, 50):
        sa, rank, near = suffix_dedup.suffix_order(x, depth)
        padded = b + bytes(depth)
        assert [padded[i : i + depth] for i in sa] == sorted(padded[i : i + depth] for i in range(len(b)))
        lcp = suffix_dedup.common_prefixes(x, sa, rank, near, depth)
        members = set(near.tolist())
        for k in range(1, len(sa)):
            i, j, n = int(sa[k - 1]), int(sa[k]), 0
            while n < depth and padded[i + n] == padded[j + n]:
                n += 1
            assert rank[i] != rank[j] or lcp[j] == depth
            if max(i, j) + depth <= len(b):
                assert lcp[j] == n if j in members else n < depth


def test_shards_agree_with_brute_force():
    r = random.Random(1)
    for _ in range(30):
        bases = [bytes(r.choice(b"ab c\xc3\xa9") for _ in range(400)) for _ in range(3)]
        contents, group = [], np.sort(np.array([r.randrange(4) for _ in range(60)]))
        for g in group:
            b, i = bases[g % 3] + bytes([g]) * 120, r.randrange(0, 200)
            contents.append(b[i : i + r.randint(100, 184)])
        at = np.concatenate([[0], np.cumsum([len(c) for c in contents])])
        x = np.frombuffer(b"".join(contents), np.uint8)
        flags = suffix_dedup.in_shard(100)(x, at, anchors.Unit("bytes", 100, 32).gram_hashes(x, 32))[anchors.window_starts(at, 100)]
        want = np.concatenate([np.array(g[: len(c) - 99]) for g, c in zip(starts_of(contents, 100), contents)])
        assert (flags == want).all()


def starts_of(sequences, window):
    seen, out = set(), []
    for s in sequences:
        flags = []
        for i in range(len(s) - window + 1):
            key = s[i : i + window]
            flags.append(key in seen)
            seen.add(key)
        out.append(flags)
    return out


def test_merge_by_binary_search():
    r = random.Random(4)
    for _ in range(20):
        contents, group, want = [], [], []
        for g in range(12):
            base = bytes([65 + g]) + bytes(r.choice(b"abcd") for _ in range(240))
            own = [base[i : i + r.randint(100, 140)] for i in (r.randrange(0, 100) for _ in range(r.choice([1, 2, 5, 30])))]
            contents += own
            group += [g] * len(own)
            want += [x for f in starts_of(own, 100) for x in f]
        assert suffix_dedup.merged(100)(contents, np.array(group)).tolist() == want


def thue_morse(a, b, n):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


def test_hashes_decide_nothing(spark):
    """Two words, and two texts, that polynomial hashes modulo a power of two can't tell apart."""
    one, two = thue_morse("a", "b", 1024), thue_morse("b", "a", 1024)
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, one + " " + tail), (2, two + " " + tail), (3, one), (4, two)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_removed"] for r in rlz_dedup.rlz_dedup(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    texts = [t.encode() for _, t in rows]
    want = {i: sum(g) for (i, _), g in zip(rows, brute(texts, 100))}
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.suffix_dedup(docs).collect()} == want


def test_repeated_rows_cut_differently(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(300))
    rows = [(5, "x " + passage), (1, passage[:600])] + [(9, " ".join(word() for _ in range(300))) for _ in range(3)] + [(5, "x " + passage)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    order = sorted(set(rows), key=lambda x: x[0])
    for shard in (1 << 20, 700):
        got = suffix_dedup.suffix_dedup(docs.filter("doc_id < 9"), shard=shard).collect()
        want = {i: sum(g) for (i, _), g in zip(order[:2], brute([t.encode() for _, t in order[:2]], 100))}
        assert len(got) == 5 and all(x["n_removed"] == want[x["doc_id"]] for x in got)


def test_empty_tables_and_carried_columns(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, n_chars bigint")
    assert suffix_dedup.digest(empty).count() == rlz_dedup.digest(empty).count() == suffix_dedup.without_repeats(empty).count() == 0
    r = random.Random(1)
    text = "".join(r.choice("éèàçx") for _ in range(80))
    rows = [(1, text, 80, None, 5), (2, "x " + text, 82, "s", None), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, rest string, t int")
    left = suffix_dedup.without_repeats(docs).collect()
    assert [(r["doc_id"], r["text"], r["n_chars"], r["rest"]) for r in sorted(left)] == [(1, text, 80, None), (2, "x ", 2, "s")]
    assert hashlib.sha256(text.encode()).hexdigest() == suffix_dedup.digest(docs).filter(F.col("doc_id") == 1).first()["kept_sha256"]


def test_long_texts_and_clashing_names(spark):
    """A text of several shards, a copy of a stretch of it across a cut, and columns named like results."""
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(280_000)]
    text = " ".join(words)
    rows = [(1, text, 5, "x", 0), (2, text[1_000_003:1_300_001], 5, "y", 0), (3, "short", 5, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, kept string, did int")
    got = {x["doc_id"]: (x["n_removed"], bytes(x["kept"])) for x in suffix_dedup.suffix_dedup(docs).collect()}
    assert got[1][0] == 0 and got[1][1] == text.encode() and got[2] == (299_998, b"") and got[3] == (0, b"short")
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in rlz_dedup.rlz_dedup(docs).collect()}
    n = len(rows[1][1].split())
    assert got[1] == (280_000, 0) and got[2] in {(n, n), (n, n - 1), (n, n - 2)} and got[3] == (1, 0)
    # nothing but the cut words at the ends can stay
    left = {x["doc_id"]: x["kept"] for x in rlz_dedup.rlz_dedup(docs).collect()}[2]
    assert set(bytes(left).split()) <= {rows[1][1].split()[0].encode(), rows[1][1].split()[-1].encode()}
