"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import embeddings, fingerprints, induced, langid, licenses, mixing, packing, quality, simhash, suffixes, urls
from tidelog.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, size string, score string, key string, id string, rank string, left string"
LONG = " ".join(f"word{i % 977} more{i % 13}" for i in range(20_000))


def rows():
    base = "the quick brown fox jumps over the lazy dog and then runs far away from the old grey barn in the valley below"
    texts = [
        base, base + " today", base, None, "", " \n\t ", "one", "Licensed under the Apache License, Version 2.0.", LONG, LONG + " tail",
        "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich " * 3, "!!! ... ###", base.upper(), "released under the mit license " * 2,
        "a b c d e f g", "a b c d e f g", "naïve café \U0001f600 déjà vu " * 20,
    ]
    out = [(i, t, ("de" if i == 10 else "en") if i % 5 else None, None if i % 7 == 3 else f"s{i % 3}", "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)]
    out += [out[0], out[0], (None, base, "en", "s1", *["x"] * 6), (None, None, None, None, *["x"] * 6)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(r):
    return (r[0] is None, r[0] or 0)


# ---- 1


def brute_links(vectors, least):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in vectors]
    x = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(vectors, ok, strict=True)]
    n = len(vectors)
    adj = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= least] for i in range(n)]
    return adj


def reach(adj):
    comp = list(range(len(adj)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(adj):
            m = min([comp[i], *[comp[j] for j in a]])
            if m < comp[i]:
                comp[i], changed = m, True
    return comp


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    vs = [(i, list(map(float, b))) for i, b in enumerate(base)]
    for i in range(30, 230):  # a dense group, and pairs
        vs.append((i, list(map(float, base[0] + 0.05 * rng.normal(size=16)))))
    for i in range(230, 245):
        vs.append((i, list(map(float, base[i - 230] * 3 + 0.2 * rng.normal(size=16)))))
    vs += [(300, None), (301, []), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [1.0, None] * 8), (305, [1.0, 2.0]), (306, [2.0, 4.0]), vs[1], vs[1]]
    df = spark.createDataFrame([(*v, "x") for v in vs], "vec_id long, embedding array<float>, id string").repartition(4)
    stored = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vs]
    adj = brute_links(stored, 0.95)
    comp = reach(adj)
    low = {}
    for i, (v, _) in enumerate(stored):
        low[comp[i]] = min(low.get(comp[i], v), v)
    want = sorted((v, len(adj[i]), low[comp[i]], v == low[comp[i]]) for i, (v, _) in enumerate(stored))
    got = sorted(tuple(r) for r in embeddings.near_duplicates(df).collect())
    assert got == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_in_a_crowd(spark):
    rng = np.random.default_rng(3)
    n, dim = 6000, 64
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[: n // 2] = np.sqrt(0.7) * x[-1] + np.sqrt(0.3) * x[: n // 2]  # round one centre, below the bound of each other
    for i in range(0, n - 600, 9):  # pairs just within the bound, in the crowd and outside
        a = x[i] / np.linalg.norm(x[i])
        side = rng.normal(size=dim)
        side -= side @ a * a
        x[i + 1] = 0.955 * a + np.sqrt(1 - 0.955**2) * side / np.linalg.norm(side)
    x[-50:-1] = x[-50] + 0.02 * rng.normal(size=(49, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = x @ x.T >= 0.95
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    truth = links.sum(1) - 1
    results = []
    for parts in ("4", "61"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(map(tuple, embeddings.near_duplicates(df).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
    found = np.array([r[1] for r in results[0]])
    assert (found <= truth).all() and found.sum() >= 0.99 * truth.sum()


def test_links_within_large_components(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=16) + 0.04 * rng.normal(size=(150, 16)), np.array([[np.cos(a), np.sin(a)] + [0.0] * 14 for a in np.linspace(0, 3, 150)])])
    y = x / np.linalg.norm(x, axis=1)[:, None]
    links = y @ y.T >= 0.95
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    comp = reach([np.flatnonzero(r).tolist() for r in links])
    assert got == {i: (int(links[i].sum()) - 1, comp[i]) for i in range(300)}


def test_links_that_passes_miss(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))  # in the open
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 4000, 2):  # pairs just within the bound
        side = rng.normal(size=64)
        side -= side @ x[i] * x[i]
        x[i + 1] = 0.9505 * x[i] + np.sqrt(1 - 0.9505**2) * side / np.linalg.norm(side)
    links = x @ x.T >= 0.95
    comp = reach([np.flatnonzero(r).tolist() for r in links])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(df).collect()}
    assert got == {i: (int(links[i].sum()) - 1, comp[i]) for i in range(4000)}


def test_exact_check_alone(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "links", lambda classes, *_: classes.sparkSession.createDataFrame([], "a long, b long"))  # passes that find nothing
    monkeypatch.setattr(embeddings, "BALL", 16)
    monkeypatch.setattr(embeddings, "TILE", 32)
    monkeypatch.setattr(embeddings, "STEP", 500)
    rng = np.random.default_rng(6)
    x = [*np.repeat(rng.normal(size=(40, 16)), 10, 0) + 0.12 * rng.normal(size=(400, 16)), *np.repeat(rng.normal(size=(30, 5)), 4, 0) + 0.2 * rng.normal(size=(120, 5)), np.array([2.0]), np.array([-3.0])]
    stored = [(i, v.tolist()) for i, v in enumerate(x)]
    adj = brute_links(stored, 0.95)
    comp = reach(adj)
    want = sorted((i, len(adj[i]), comp[i], comp[i] == i) for i in range(len(x)))
    df = spark.createDataFrame(stored, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == want


# ---- 2


def brute_url(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def test_urls(spark):
    us = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x#y", "https://example.net/en", "https://notexample.net/en/", "http://x.org/fr/?a=1&b=2", "http://x.example.com/de/1", "http://example.com?x=/de/",
          "https://cheap-casino-win.example.org/en/7", "https://gardenriver.example.org/en/7", "a://b://c.net/x", "http://ÄÖ.net/", "http://x.net/" + "y" * 20_000, "http://x.net/\nq"] * 2
    pages = spark.createDataFrame([(i, u, "h", "z") for i, u in enumerate(us)], "page_id long, url string, verdict string, html string")
    labelled = urls.labelled_urls(spark, 3000)
    model = urls.train(labelled)
    got = {r["page_id"]: r for r in urls.judge(pages, model).collect()}
    assert len(got) == len(us)
    for i, u in enumerate(us):
        host, path, rule = brute_url(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule[0] if rule else None)
        assert got[i]["verdict"] in ("allow", "block") and (not rule or got[i]["verdict"] == rule[1])
    held = urls.judge(urls.labelled_urls(spark, 6000).join(labelled, "url", "left_anti").withColumnRenamed("label", "truth"), model, rules=()).collect()
    assert len(held) > 2000 and np.mean([(r["verdict"] == "block") == (r["truth"] == 1) for r in held]) > 0.9
    assert len({r["score"] for r in held}) > 50

    def used(t):
        return {t["feature"]} | used(t["low"]) | used(t["high"]) if "feature" in t else set()

    assert len(set().union(*map(used, model.trees))) >= 5
    # the trees' scores by walking them row by row
    some = model.described(pages).collect()

    def walk(t, r):
        return t["leaf"] if "leaf" in t else walk(t["low"] if r["_x_" + t["feature"]] <= t["at"] else t["high"], r)

    for r in some:
        assert math.isclose(got[r["page_id"]]["score"], 1 / (1 + math.exp(-model.start - sum(walk(t, r) for t in model.trees))), rel_tol=1e-9)
    for r in some:
        u, h = r["url"] or "", brute_url(r["url"])[0]
        shares = [h.count(c) / len(h) for c in set(h) if c in "abcdefghijklmnopqrstuvwxyz0123456789-._"]
        assert math.isclose(r["_x_entropy"], -sum(q * math.log2(q) for q in shares), abs_tol=1e-9)
        assert r["_x_length"] == len(u) and math.isclose(r["_x_digit_ratio"], len(re.findall("[0-9]", u)) / max(len(u), 1))
        assert r["_x_suffix_rate"] == model.suffixes.get(h.split(".")[-1], model.usual)
    assert urls.judge(pages.limit(0), model).count() == 0
    one = urls.train(urls.labelled_urls(spark, 100).where("label = 0"))
    assert one.trees == []


# ---- 3


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    per = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["size"] == size and 0 <= r["taken"] <= 3 * size and r["left"] == "x"
        p = per[r["source"]]
        p[0], p[1], p[2] = p[0] + size, p[1] + r["taken"], r["target"]
        assert r["source_size"] is not None
    total = sum(p[0] for p in per.values())
    assert abs(sum(p[2] for p in per.values()) - total) < 1e-6 * total
    assert sum(p[1] for p in per.values()) <= total
    assert sorted(map(tuple, mixing.mix_plan(docs).collect()), key=str) == sorted(map(tuple, mixing.mix_plan(docs.repartition(5)).collect()), key=str)
    assert mixing.mix(none).count() == 0


def test_mixing_targets(spark):
    rng = np.random.default_rng(3)
    data = [(i, "w " * int(rng.integers(1, 30)), None, None if i % 41 == 0 else ["a", "b", "c", "d", "hot"][int(rng.choice(5, p=[0.02, 0.1, 0.2, 0.2, 0.48]))], *["x"] * 6) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(data, DOCS)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    names = sorted([k for k in by if k is not None]) + [None]
    sizes = {k: sum(r["size"] for r in by[k]) for k in names}
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    left, capped = sum(sizes.values()), set()
    while True:
        level = left / sum(weight[k] for k in names if k not in capped)
        over = [k for k in names if k not in capped and level * weight[k] > 3 * sizes[k]]
        if not over:
            break
        left -= sum(3 * sizes[k] for k in over)
        capped |= set(over)
    for k in names:
        want = 3 * sizes[k] if k in capped else level * weight[k]
        assert by[k][0]["target"] == pytest.approx(want)
        assert abs(sum(r["taken"] for r in by[k]) - want) <= 60


# ---- 4 and 10


def test_langid(spark, docs, none):
    words = {"en": "the of and to in that was with", "de": "der die und ist nicht schön über für", "fr": "le la être où déjà garçon une des"}
    rng = np.random.default_rng(4)
    data = [(i, " ".join(rng.choice(words[k].split(), 12)), k, None, *["x"] * 6) for i in range(300) for k in [list(words)[i % 3]]]
    df = spark.createDataFrame(data, DOCS)
    model = langid.learned(df)
    got = langid.identify(df.withColumn("held", langid.held_out()), model).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in got if r["held"]]) > 0.98
    for r in langid.identify(docs, model).collect():
        letters = re.search(r"[^\W\d_]", r["text"] or "")
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (letters is None) and r["left"] == "x"
    empty = langid.learned(none)
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}
    alone = langid.learned(df.where("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.identify(df, alone).collect()} == {"en"}
    assert langid.identify(none, model).count() == 0


def test_codewords():
    for n in (2, 3, 4, 5, 9, 20):
        code = langid.codebook(n)
        assert len({tuple(r) for r in code.tolist()}) == n


def test_quality(spark, docs, none):
    rng = np.random.default_rng(5)
    good = lambda: " ".join(rng.choice(["river", "stone", "garden", "music", "travel", "of", "the"], 40)) + "."
    bad = lambda: " ".join(w.upper() + "!!" for w in rng.choice(["win", "cash", "now", "free"], 40))
    data = [(i, good() if i % 3 else bad(), None, None, *["x"] * 6) for i in range(300)]
    df = spark.createDataFrame(data, DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.learned(df, labels)
    got = quality.score(df.withColumn("held", quality.held_out()), model).collect()
    held = [r for r in got if r["held"]]
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 3 > 0) for r in held]) > 0.95
    every = quality.score(docs, model).collect()
    assert len(every) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in every)
    assert len({r["score"] for r in every if not r["text"]}) == 1
    assert quality.score(none, model).count() == 0
    flat = quality.learned(df, labels.where("quality = 1"))
    assert len({r["score"] for r in quality.score(df, flat).collect()}) == 1


# ---- 5


def brute_removed(data, length):
    first = {}
    for i, t in data:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            g = b[p : p + length]
            o = math.inf if i is None else i
            first[g] = min(first.get(g, math.inf), o)
    out = []
    for i, t in data:
        b, o = (t or "").encode(), math.inf if i is None else i
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < o:
                gone[p : p + length] = True
        keep = bytes(np.frombuffer(b, np.uint8)[~gone])
        edges = np.diff(np.concatenate(([0], gone.astype(int)))) == 1
        out.append((i, len(b), int(gone.sum()), int(edges.sum()), hashlib.sha256(keep).hexdigest()))
    return out


def test_suffixes(spark, none):
    rng = np.random.default_rng(6)
    shared = ["".join(rng.choice(list("abcdé \n"), 150)) for _ in range(4)]
    data = []
    for i in range(60):
        parts = ["".join(rng.choice(list("abcdé \n"), int(rng.integers(0, 120)))) for _ in range(3)]
        s = shared[int(rng.integers(4))]
        cut = int(rng.integers(0, 100))
        data.append((i, parts[0] + s[cut : cut + int(rng.integers(40, 150))] + parts[1] + (s[:60] if i % 4 == 0 else "") + parts[2]))
    data += [(60, data[3][1]), (61, data[3][1]), (62, None), (63, ""), (64, "z" * 300), (65, "z" * 120), (66, "ab" * 80), (67, "b" + "ab" * 50), data[5], data[5], (None, data[7][1]), (None, "q" * 70), (None, "q" * 70)]
    df = spark.createDataFrame([(*d, "x", "x", "x") for d in data], "doc_id long, text string, left string, ord string, sha string").repartition(5)
    got = sorted((tuple(r) for r in suffixes.deduplicate(df).collect()), key=lambda r: (key(r), r))
    assert got == sorted(brute_removed(data, 50), key=lambda r: (key(r), r))
    texts = suffixes.deduplicate(df, texts=True)
    assert texts.columns == df.columns and texts.count() == len(data)
    assert {r["doc_id"]: r["text"] for r in texts.collect()}[62] is None
    assert suffixes.deduplicate(none).count() == 0


def test_induced_sorting():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, symbols = int(rng.integers(1, 80)), int(rng.integers(1, 5))
        text = rng.integers(0, symbols, n)
        if rng.random() < 0.4:
            text = np.tile(text, 3)
        depth = int(rng.integers(1, 30))
        for budget in (1 << 28, 64):  # the latter lies on disk
            parts = list(induced.descending(text, symbols, depth, budget))
            sa, lcp = (np.concatenate([p[k] for p in parts]).tolist() for k in (0, 1))
            s = text.tolist()
            assert sorted(sa) == list(range(len(s)))
            for i in range(1, len(s)):
                a, b = s[sa[i - 1] :][:depth], s[sa[i] :][:depth]
                common = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                assert a >= b and lcp[i] == common


# ---- 6


def test_packing(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    want = collections.Counter()
    for r in rows():
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        for k, stop in enumerate(range(first, len(ids) + 1, 2048)):
            start = 0 if k == 0 else stop - 2048
            want[(r[0], k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes()))] += 1
    got = packing.pack(docs, vocabulary()).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(none, vocabulary()).count() == 0


def test_token_ids_of_odd_texts():
    from tokenizers import Tokenizer

    enc, lib = packing.Encoder(vocabulary()), Tokenizer.from_file(vocabulary())
    for t in ["hi <|endoftext|> there", "a<|endoftext|><|endoftext|>", "<|endoftext", "", "  a \n\n b", "it's we'll I'd", "x\u00a0y", "日本 ٣ ²", "<|endoftext|>", "a\x1cb", "tab\t\tq  ", "   ", "é\u0301 ß—“q”"]:
        assert enc.ids(t) == np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_best_fit_decreasing():
    rng = np.random.default_rng(7)
    for _ in range(100):
        cap = int(rng.choice([5, 37, 100]))
        items = rng.integers(1, cap + 1, int(rng.integers(0, 200))).tolist()
        bins = collections.defaultdict(list)
        for length, _, first, offset, n in packing.best_fit_decreasing(collections.Counter(items), cap):
            for k in range(n):
                bins[first + k].append((offset, length))
        free = []
        for x in sorted(items, reverse=True):
            fit = [i for i, f in enumerate(free) if f >= x]
            if fit:
                free[min(fit, key=lambda i: free[i])] -= x
            else:
                free.append(cap - x)
        assert len(bins) == len(free) and sum(map(len, bins.values())) == len(items)
        assert sorted(cap - sum(n for _, n in b) for b in bins.values()) == sorted(free)


# ---- 7


def test_licenses(docs, none):
    got = sorted((tuple(r)[:6] for r in licenses.scan(docs).collect()), key=str)
    want = []
    for r in rows():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        at = [(i, k) for k, p in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((r[0], len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({k for _, k in at}))))
    assert got == sorted(want, key=str)
    by = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert by[7]["labels"] == "apache,apache-2.0" and by[13]["n_base"] == 2 and by[0]["score"] < 0.5
    assert licenses.scan(none).count() == 0


def test_license_with_changes(spark):
    notice = licenses.NOTICES["mit-grant"].split()
    text = "x y " + " ".join([*notice[:8], "really", *notice[8:]])
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["labels"] == "mit-grant" and r["base_labels"] == "" and r["score"] >= 0.8


# ---- 8


def fp(text, k=3):
    import xxhash

    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, none):
    data = rows()
    f = [fp(r[1]) for r in data]
    adj = [[j for j in range(len(f)) if (f[i] ^ f[j]).bit_count() <= 2] for i in range(len(f))]
    comp, low = reach(adj), {}
    for c, r in zip(comp, data, strict=True):
        if r[0] is not None:
            low[c] = min(low.get(c, r[0]), r[0])
    want = sorted(((r[0], f"{x:016x}", low.get(c)) for r, x, c in zip(data, f, comp, strict=True)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want
    assert simhash.near_duplicates(none).count() == 0


def test_trie_links(spark):
    rng = np.random.default_rng(8)
    values = set()
    for _ in range(40):
        x = int(rng.integers(0, 2**63))
        for _ in range(30):
            for b in rng.integers(0, 64, int(rng.integers(0, 3))):
                x ^= 1 << int(b)
            values.add(x - (1 << 64) if x >> 63 else x)
    values = sorted(values)
    bits = np.array(values, np.int64).view(np.uint64)
    adj = [[j for j in range(len(values)) if (int(bits[i]) ^ int(bits[j])).bit_count() <= 2] for i in range(len(values))]
    want = collections.Counter(reach(adj))
    crowd = simhash.CROWD
    for simhash.CROWD in (crowd, 4):  # with and without crowded keys
        from tidelog.llm.common import components

        got = collections.Counter(r["comp"] for r in components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"))).collect())
        assert sorted(got.values()) == sorted(n for n in want.values() if n > 1)
    simhash.CROWD = crowd


def test_similar_groups(spark, docs, none):
    rng = np.random.default_rng(9)
    data = []
    for i in range(40):
        w = [f"w{x}" for x in rng.integers(0, 500, 120)]
        data.append((len(data), " ".join(w)))
        for _ in range(i % 4):
            v = list(w)
            for at in rng.integers(0, 120, int(rng.integers(0, 4))):
                v[at] = "changed"
            data.append((len(data), " ".join(v)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in data]
    adj = [[j for j in range(len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(sets))]
    want = sorted(set(reach(adj)))
    df = spark.createDataFrame([(*d, *["x"] * 8) for d in data], DOCS)
    assert sorted(r["doc_id"] for r in simhash.similar_groups(df).collect()) == want
    got = [r["doc_id"] for r in simhash.similar_groups(docs).collect()]
    assert len(got) == len(set(got)) and 0 in got and 2 not in got and None not in got
    assert simhash.similar_groups(none).count() == 0


def kept(spark, texts, k=5):
    """Documents that stay, from the operator and by brute force."""
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    adj = [[j for j, b in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)] for a in sets]
    df = spark.createDataFrame([(i, t, *["x"] * 8) for i, t in enumerate(texts)], DOCS).repartition(4)
    return sorted(r["doc_id"] for r in simhash.similar_groups(df, k).collect()), sorted(set(reach(adj)))


def test_similar_groups_hub_and_chain(spark):
    rng = np.random.default_rng(10)
    hub = [f"h{x}" for x in range(200)]
    texts = []
    for i in range(300):  # copies near the hub, but hardly any near another
        w = list(hub)
        for at in rng.choice(40, 4, replace=False):
            w[5 * int(at) + 2] = f"own{i}x{at}"
        texts.append(" ".join(w))
    texts.insert(150, " ".join(hub))
    texts += [" ".join(f"c{x}" for x in range(6 * i, 6 * i + 100)) for i in range(300)]  # each near the next only
    got, want = kept(spark, texts)
    assert want == [0, 301]
    assert got == want


def test_similar_groups_at_the_bound(spark):
    rng = np.random.default_rng(11)
    texts = []
    for i in range(400):  # 4 of 5 shingles
        w = [f"s{i}x{j}" for j in range(9)]
        texts += [" ".join(w), " ".join(w[:8])]
    for i in range(150):  # 80 to 83 of 100 shingles, in texts that share a header
        w = [f"l{i}x{j}" for j in range(104 - 60)]
        head = [f"head{j}" for j in range(60)]
        texts += [" ".join(head + w), " ".join(head + w[: len(w) - int(rng.integers(14, 21))])]
    got, want = kept(spark, texts)
    assert got == want


def test_similar_groups_in_crowds(spark, monkeypatch):
    rng = np.random.default_rng(12)
    texts = []
    for i in range(3):
        w = [f"f{i}x{j}" for j in range(150)]
        for _ in range(60):  # some within the bound, some beyond, of several sizes
            v = list(w[: int(rng.integers(100, 151))])
            for at in rng.integers(0, len(v), int(rng.integers(0, 6))):
                v[at] = f"n{rng.integers(10**9)}"
            texts.append(" ".join(v))
    monkeypatch.setattr(simhash, "DENSE", 4)
    for block in (8, 256):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got, want = kept(spark, texts)
        assert got == want and len(want) > 3


def test_similar_groups_of_equal_fingerprints(spark):
    texts = []
    for i in range(6):  # a repeated line fixes all bits, and two of eight are alike
        line = " ".join(f"line{i}x{j}" for j in range(9)) + " "
        texts += [line * 100 + " ".join(f"head{i}x{k}x{j}" for j in range(80)) for k in range(6)]
        texts += [line * 100 + " ".join(f"own{i}x{j}" for j in range(80)) + end for end in (" one", " two")]
    fps = [simhash.simhash(simhash.shingle_hashes(t, 5)) for t in texts]
    assert len(set(fps)) == 6
    got, want = kept(spark, texts)
    assert len(want) == 42 and got == want


def test_similar_groups_of_other_repeats(spark):
    line = " ".join(f"line{j}" for j in range(9)) + " "
    texts = [line * n + " ".join(f"own{i}x{j}" for j in range(300)) for i in range(5) for n in (100, 3, 40)]
    got, want = kept(spark, texts)
    assert want == [0, 3, 6, 9, 12] and got == want


# ---- 9


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_fingerprints(docs, none):
    got = fingerprints.fingerprint(docs).collect()
    assert len(got) == len(rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    texts = {r[0]: r[1] or "" for r in rows() if r[0] is not None}
    ids = sorted(texts, reverse=True)
    for i, a in enumerate(ids[:-1]):
        t, n = texts[a], texts[ids[i + 1]]
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        assert by[a]["n_chars"] == len(t) and by[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(by[a]["near_edited"] - jaccard(shingles(t), shingles(edited))) < 0.4
        assert abs(by[a]["near_next"] - jaccard(shingles(t), shingles(n))) < 0.4
    assert by[0]["fingerprint"] == by[2]["fingerprint"] and by[3]["fingerprint"] == by[4]["fingerprint"] == by[5]["fingerprint"]
    assert fingerprints.fingerprint(none).count() == 0
    one = fingerprints.fingerprint(docs.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_texts_are_shuffled_once(spark, docs):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = fingerprints.fingerprint(docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string")).collect()
    assert len(got) == len(rows())
    assert seen.value == 2 * len(rows())  # for the order of the documents, and for the texts


def brute_signature(words, k, slots=fingerprints.SLOTS, together=fingerprints.TOGETHER):
    """Of each slot the (term, t) with the least sample, by the definition, with variates from the same hashes."""
    h = lambda form, v, seed: xxhash.xxh64_intdigest(struct.pack(form, v), seed)
    u = lambda x, shift, bits: ((x >> shift & (1 << bits) - 1) + 0.5) / (1 << bits)
    found = collections.Counter()
    for i in range(max(len(words) - k, 0) + 1 if words else 0):
        term = 42
        for w in words[i : i + k]:
            term = xxhash.xxh64_intdigest(w.encode(), term)
        found[term] += 1
    out = []
    for slot in range(slots):
        draws = []
        for term, w in found.items():
            base = h("<Q", term, 42)
            one, two = h("<i", 1, h("<i", slot, base)), h("<i", 2, h("<i", slot - slot % together, base))
            r, b, c = -math.log(u(one, 0, 22) * u(one, 22, 22)), u(one, 44, 20), -math.log(u(two, 0, 32) * u(two, 32, 32))
            t = math.floor(math.log(w) / r + b)
            draws.append((c / (math.exp(r * (t - b)) * math.exp(r)), term, t))
        out.append(min(draws)[1:] if draws else None)
    return out


def alike(a, b):
    either = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
    return sum(x == y for x, y in either) / len(either) if either else 1.0


def test_samples_by_definition(docs):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(docs).collect() if r["doc_id"] is not None}
    texts = {r[0]: r[1] or "" for r in rows() if r[0] is not None}
    ids = [i for i in sorted(texts, reverse=True) if i not in (8, 9)]
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    for a in ids[:-1]:
        n = next(i for i in sorted(texts, reverse=True) if i < a)
        k = len(texts[a]) // 3
        own = brute_signature(words(texts[a]), 5)
        assert got[a]["near_edited"] == alike(own, brute_signature(words(texts[a][: len(texts[a]) - k] + texts[n][:k]), 5))
        if n not in (8, 9):
            assert got[a]["near_next"] == alike(own, brute_signature(words(texts[n]), 5))


def test_collision_rate(spark):
    rng = np.random.default_rng(10)
    pairs, data = [], []
    for i in range(60):
        a = [f"t{i}x{x}" for x in rng.integers(0, 30, 200)]
        b = [f"t{i}x{x}" if rng.random() < i / 60 else w for w, x in zip(a, rng.integers(0, 30, 200), strict=True)]
        data.append((i, " ".join(a), " ".join(b), 0))
        pairs.append(jaccard(collections.Counter(a), collections.Counter(b)))
    df = spark.createDataFrame(data, "id long, text string, edited string, same int")
    error = lambda slots: np.array([alike(r["own"], r["edited"]) - pairs[r["id"]] for r in fingerprints.signatures(df, ["id"], slots, words=1).collect()])
    assert abs(error(32).mean()) < 0.03 and np.abs(error(32)).mean() < 0.1
    assert abs(error(256).mean()) < 0.01 and np.abs(error(256)).mean() < 0.04


# ---- names


def test_clashing_names(spark):
    odd = "_ord string, _sha string, _node string, _n string, _o string, _row string, _d string, _s string, _z string, size string, _p string, _x string, _r string, doc_id int, text string, source string, url string"
    df = spark.createDataFrame([(*(f"{k}{i}" for k in range(13)), i, f"text number {i} " * (5 + i), "s", "http://a.net/") for i in range(3)], odd)
    own = [c for c in df.columns if c.startswith("_")]
    want = sorted(tuple(r[c] for c in own) for r in df.collect())
    model = urls.Trees([], {}, 0.5, 0.0)
    lang = langid.train([])
    for out in (mixing.mix(df), suffixes.deduplicate(df, texts=True), simhash.similar_groups(df), urls.judge(df, model), langid.identify(df, lang)):
        assert set(own) <= set(out.columns) and sorted(tuple(r[c] for c in own) for r in out.collect()) == want


def test_integer_ids_and_repeated_labels(spark):
    df = spark.createDataFrame([(i % 40, f"ein text {i}" if i % 2 else f"some words {i}", "de" if i % 2 else "en") for i in range(80)], "doc_id int, text string, lang string")
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(80)], "doc_id int, quality int")
    assert langid.learned(df).langs == ["de", "en"]
    assert 0 <= quality.learned(df, labels, most=2).score("some words") <= 1


def test_long_template(spark):
    text = licenses.NOTICES["mit-text"].split()
    assert len(text) > 63
    changed = [w for i, w in enumerate(text) if i % 40 != 7]
    df = spark.createDataFrame([(1, "x y " + " ".join(text)), (2, " ".join(changed)), (3, "of the software " * 50)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert [(s["label"], s["first"], s["last"], s["cover"]) for s in got[1]["spans"] if s["label"] == "mit-text"] == [("mit-text", 2, len(text) + 1, 1.0)]
    assert "mit-text" not in got[3]["labels"] and 0 < got[3]["score"] < 0.8 and got[2]["score"] > 0
