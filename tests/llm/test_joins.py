"""Jaccard join, nearest neighbours, URL filter, packing and the pipeline against brute force."""
import os
import random

import numpy as np
import pytest

import corpus_pipeline
from capsite.llm import ann, bpe, components, jaccard_join, packing, quality_rules, suffix_dedup, url_filter
from capsite.llm.queries import tokenizer_file


def near_docs(seed=0):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 60, 200]))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append(" ".join(w))
    rows += ["", None, " \n", "one two", "one two", "one  two"]
    r.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


def brute_links(texts):
    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    distinct = sorted(set(texts))
    sets = [shingles(t) for t in distinct]
    linked = {t: set() for t in distinct}
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                linked[distinct[i]].add(distinct[j])
                linked[distinct[j]].add(distinct[i])
    return linked


def expected(rows):
    linked = brute_links([t or "" for _, t in rows])
    ids = {}
    for i, t in rows:
        ids.setdefault(t or "", []).append(i)
    out, seen = {}, {}
    for t in linked:
        if t not in seen:
            todo, group = [t], set()
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += linked[x]
            least = min(i for x in group for i in ids[x])
            seen.update({x: least for x in group})
    for i, t in rows:
        out[i] = (min(ids[t or ""]), len(ids[t or ""]), seen[t or ""], len(linked[t or ""]))
    return out


@pytest.mark.parametrize("block,few", [(512, 200_000), (4, 0)])
def test_jaccard_join(spark, block, few):
    rows = near_docs()
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, node int, root int")
    got = {r["doc_id"]: (r["copy_id"], r["n_copies"], r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs, block=block, few=few).collect()}
    assert got == expected(rows)


def test_one_of_each(spark):
    rows = near_docs(3)
    docs = spark.createDataFrame([*[(*r, "en") for r in rows], (0, rows[0][1], "fr"), (None, "lonely text of its own", "de")], "doc_id bigint, text string, lang string")
    left = jaccard_join.one_of_each(docs)
    ids = [r["doc_id"] for r in left.collect()]
    assert left.columns == docs.columns and ids.count(None) == 1
    assert sorted(i for i in ids if i is not None) == sorted({v[2] for v in expected(rows).values()})
    assert jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_prefix_length():
    assert jaccard_join.prefix_length(0.8) == 5 and jaccard_join.prefix_length(0.01, recall=0.999999) == 1


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, i) for i in range(301, 340)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    loops = {a for a, b in edges if a == b}
    for few in (0, 10**6):
        got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), few=few).collect()}
        assert got == {x: find(x) for x in parent if x in got} and set(parent) - set(got) <= loops
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors(n=700, d=24, unit=True, seed=1):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, d))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * g.uniform(0.5, 2, (n, 1))
    x[100:220] = x[40]
    return x.astype(np.float32)


@pytest.mark.parametrize("unit", [True, False])
def test_nearest(spark, unit):
    x = vectors(unit=unit)
    odd = [(901, None), (920, [0.0] * 24), (921, [float("nan")] + [1.0] * 23), (940, [None] + [1.0] * 23), (941, []), (960, [float("inf")] + [1.0] * 23)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), block=64).collect()
    score = x.astype(float) @ x.astype(float).T
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert abs(score[r["query_id"], r["vec_id"]] - r["score"]) < 1e-9
    hit = 0
    for q in range(0, 700, 20):
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all((-a[2], a[1]) <= (-b[2], b[1]) for a, b in zip(mine, mine[1:]))
        exact = sorted((i for i in range(700) if i != q), key=lambda i: (-round(score[q, i], 9), i))[:20]
        hit += len({m[1] for m in mine} & set(exact))
    assert set(found) == set(range(0, 700, 20)) and hit / (35 * 20) >= 0.9
    same = sorted(found[40])[:20]
    if unit:
        assert [m[1] for m in same] == list(range(100, 120))


def test_recall_on_the_given_table(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no test data here")
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    odd = table.limit(1).selectExpr("cast(null as bigint) vec_id", "embedding", "label")
    found = {}
    for r in ann.nearest(table.unionByName(odd)).withColumnRenamed("query_id", "q").collect():
        found.setdefault(r["q"], set()).add(r["vec_id"])
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hit, total = hit + len(best & found[ids[i]]), total + 20
    assert hit / total >= 0.95


def test_nearest_small(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (20, [1.0, 0.0]), (3, [1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 2), (0, 2, 20), (0, 3, 1), (20, 1, 0), (20, 2, 2), (20, 3, 1)]
    assert ann.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


@pytest.mark.parametrize("case", ["one long", "lognormal", "wide", "few"])
def test_nearest_lengths(spark, case):
    n, d = {"wide": (900, 100), "few": (15, 64)}.get(case, (900, 64))
    x = np.random.default_rng(4).normal(size=(n, d))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    if case == "one long":
        x[7] *= 20
    elif case == "lognormal":
        x *= np.random.default_rng(3).lognormal(0, 0.5, (n, 1)).astype(np.float32)
    got = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")).collect()
    score = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(score, -np.inf)
    found, hit, k = {}, 0, min(20, n - 1)
    for r in got:
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, n, 20):
        assert len(found[q]) == len(set(found[q])) == k
        hit += len(set(found[q]) & set(np.argsort(-score[q])[:k].tolist()))
    assert hit >= (1 if case == "few" else 0.95) * k * len(range(0, n, 20))


def test_url_filter(spark):
    urls = ["http://A.Example.NET/en/x", "https://example.net/fr/x", "http://notexample.com/de/1", "http://b.example.com/de/1", "http://b.org/fr/", "http://b.org/de/", None, "no scheme", "http://x.net", "http://ads-track.b.org/a/?utm_x=1", "https://www.ads-track.b.org/a", "https://m.ads-track.b.org/a.html?ref=q&utm_a=b#z", "ftp://c.org/x://y.net/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id bigint, url string, host int")
    listed = spark.createDataFrame([("http://ads-track.b.org/a",), (None,), ("junk",)], "url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, listed).collect()}
    assert got == {
        0: ("a.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/fr/x", "net/", "block"), 2: ("notexample.com", "/de/1", None, "allow"), 3: ("b.example.com", "/de/1", "example.com/de/", "block"),
        4: ("b.org", "/fr/", "org/fr/", "allow"), 5: ("b.org", "/de/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("x.net", "", None, "allow"),
        9: ("ads-track.b.org", "/a/", None, "block"), 10: ("www.ads-track.b.org", "/a", None, "block"), 11: ("m.ads-track.b.org", "/a.html", None, "block"), 12: ("c.org", "/x://y.net/", None, "allow"),
    }
    assert url_filter.url_filter(pages, listed.limit(0)).filter("listed").count() == 0


def test_false_positives_go(spark, monkeypatch):
    """With a bit or two a URL the filter passes much that the join must remove."""
    monkeypatch.setattr(url_filter, "BITS_PER_URL", 1)
    listed = [f"https://www.a.org/x/{i}/" for i in range(0, 4000, 2)]
    pages = spark.createDataFrame([(i, f"http://m.a.org/x/{i}.html?ref=1", 0) for i in range(4000)] + [(None, None, 0), (5, "http://a.org/x/5", 0), (5, "http://a.org/x/5", 0)], "page_id bigint, url string, verdict int")
    names = spark.createDataFrame([(u,) for u in listed], "url string")
    got = url_filter.url_filter(pages, names).collect()
    assert len(got) == 4003 and {r["page_id"] for r in got if r["listed"]} == set(range(0, 4000, 2))
    blocks = url_filter.bloom_blocks(names.select(url_filter.canonical(names.url).alias("n")), "n", 2000 // 512).collect()
    bits = sum(bin(b[f"w{i}"] & (1 << 64) - 1).count("1") for b in blocks for i in range(8))
    assert bits > 512 * len(blocks) * 0.99  # so nearly every URL passes it
    assert url_filter.url_filter(pages.limit(0), names).count() == 0


def test_registered_list(spark):
    pages = spark.createDataFrame([(1, "http://m.tionsh.example.org/de/30.html#x"), (2, "http://tionsh.example.org/de/31"), (3, "http://therha.example.com/en/9?ref=a"), (4, "http://therha.example.com/de/9")], "page_id bigint, url string")
    got = {r["page_id"]: (r["listed"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, url_filter.registered_list(spark)).collect()}
    assert got == {1: (True, None, "block"), 2: (False, None, "allow"), 3: (True, None, "block"), 4: (True, "example.com/de/", "block")}


def pack_by_hand(sizes, lengths, overhead, attention):
    """The rules, step by step over lists."""
    bins, out = [], []
    for k, s in enumerate(sizes):
        open_ = [b for b in bins if b[0] - b[1] >= s]
        if open_:
            b = min(open_, key=lambda b: (b[0] - b[1], -bins.index(b)))
            b = max((x for x in open_ if x[0] - x[1] == b[0] - b[1]), key=lambda x: x[2])
        else:
            cost = lambda c: (packing.bin_cost(c, overhead, attention) / (s + min(c - s, sum(x for x in sizes[k + 1 :] if x <= c - s))), c)
            b = [min((c for c in lengths if c >= s), key=cost), 0, 0, len(bins)]
            bins.append(b)
        out.append((b[3], b[1]))
        b[1] += s
        b[2] = k
    return [(b, start, min(c for c in lengths if c >= bins[b][1])) for b, start in out]


def least_cost(sizes, lengths, price):
    """By trying every way to split the sizes into bins."""
    best = [float("inf")]

    def put(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(price(min(c for c in lengths if c >= b)) for b in bins))
            return
        for j in range(len(bins) + 1):
            new = [*bins]
            if j == len(bins):
                new.append(0)
            new[j] += sizes[i]
            if new[j] <= lengths[-1] and (j == len(bins) or bins[j] not in bins[:j]):
                put(i + 1, new)

    put(0, [])
    return best[0]


def test_pack_by_rules_and_against_the_best():
    r = random.Random(12)
    opened = set()
    for _ in range(60):
        sizes = sorted((r.randint(1, 130) if r.random() < 0.7 else r.randint(1, 20) for _ in range(r.randint(1, 40))), reverse=True)
        sizes = [min(s, 128) for s in sizes]
        got = packing.pack(sizes, (16, 32, 64, 128), 3, 200)
        want = pack_by_hand(sizes, (16, 32, 64, 128), 3, 200)
        price = lambda p: sum(packing.bin_cost(c, 3, 200) for c in {b: c for b, _, c in p}.values())
        assert sorted(c for _, c in {b: c for b, _, c in got}.items()) == sorted(c for _, c in {b: c for b, _, c in want}.items()) and price(got) == pytest.approx(price(want))
        opened |= {c for _, _, c in got}
    assert opened == {16, 32, 64, 128}
    total = worst = 0
    for _ in range(25):
        sizes = sorted((r.randint(1, 128) for _ in range(7)), reverse=True)
        best = least_cost(sizes, (16, 32, 64, 128), lambda c: packing.bin_cost(c, 3, 200))
        own = sum(packing.bin_cost(c, 3, 200) for c in {b: c for b, _, c in packing.pack(sizes, (16, 32, 64, 128), 3, 200)}.values())
        assert own >= best - 1e-9
        total, worst = total + own / best / 25, max(worst, own / best)
    assert total < 1.15 and worst < 1.6


def test_packing_opens_several_lengths_in_production():
    r = random.Random(3)
    sizes = sorted((min(4096, int(r.lognormvariate(5.8, 1.1)) + 1) for _ in range(4000)), reverse=True)
    packed = packing.pack(sizes)
    bins = {b: c for b, _, c in packed}
    assert all(sum(c == want for c in bins.values()) > 10 for want in packing.LENGTHS)
    assert sum(sizes) / sum(bins.values()) > 0.95


def test_packing(spark):
    r = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 3, 40, 90, 300])))) for i in range(300)] + [(5, "a b"), (None, "x y z"), (7, None)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id bigint, text string, bin int")
    got = packing.best_fit_packing(docs, lengths=(32, 64, 128), shard_tokens=5000).collect()
    assert sum(x["n_tokens"] for x in got) == sum(len((t or "").split()) for _, t in rows)
    bins = {}
    for x in got:
        bins.setdefault((x["shard"], x["bin"]), []).append(x)
    for own in bins.values():
        own.sort(key=lambda x: x["bin_start"])
        total = sum(x["n_tokens"] for x in own)
        assert all(a["bin_start"] + a["n_tokens"] == b["bin_start"] for a, b in zip(own, own[1:])) and own[0]["bin_start"] == 0
        assert {x["bin_length"] for x in own} == {min(c for c in (32, 64, 128) if c >= total)}
    assert len({k[0] for k in bins}) > 1 and packing.best_fit_packing(docs.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    r = random.Random(9)
    sentence = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 8))) for _ in range(n))
    passage = sentence(80)
    rows = [(i, sentence(150), "en", "s", 0) for i in range(20)] + [(30, "a " + sentence(40) + " " + passage, "en", "s", 0), (31, sentence(60) + " " + passage, "en", "s", 0), (32, "too short", "en", "s", 0)]
    near = rows[3][1].split()
    near[70] = "changed"
    rows += [(40, rows[2][1], "en", "t", 0), (41, " ".join(near), "en", "t", 0), (50, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    good = quality_rules.keep_good(docs)
    assert {x["doc_id"] for x in good.collect()} == {x[0] for x in rows} - {32, 50}
    one = jaccard_join.one_of_each(good)
    assert {x["doc_id"] for x in one.collect()} == {x[0] for x in rows} - {32, 50, 40, 41}
    texts = {x["doc_id"]: x for x in suffix_dedup.without_repeats(one).collect()}
    assert passage[10:-10] in texts[30]["text"] and passage[10:-10] not in texts[31]["text"] and texts[31]["n_chars"] == len(texts[31]["text"])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = bpe.encoder(tokenizer_file("byte_bpe_50k.json"))
    assert sum(x["n_tokens"] for x in packed) == sum(tokens.counts(x["text"] for x in texts.values()))
