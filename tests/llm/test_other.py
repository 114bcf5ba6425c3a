import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from marginalia.llm import licenses, topk, url_filter
from marginalia.llm.mixing import mix, mixed_documents

from .fixtures import frame, rows


def test_licences(spark):
    data = [
        (1, "a/b/one.py", "Released under the MIT License.\ncode code code", "x"),
        (2, "a/LICENSE", "Licensed under the Apache License, Version 2.0.", "x"),
        (3, "a/b/c/two.py", "nothing here", "x"),
        (4, "z/three.py", None, "x"),
        (5, None, "", "x"),
        (5, None, "", "x"),
        (6, "a/b/d/long.py", "word " * 50000 + "\nLicensed under CC BY-NC 4.0.", "x"),
        (7, "LICENSE", "All rights reserved.", "x"),
    ]
    got = {r.file_id: (r.license, r.origin, r.from_dir) for r in licenses.scan(spark, spark.createDataFrame(data, "file_id long, path string, text string, term string")).collect()}
    assert got[1] == ("MIT", "header", None) and got[2] == ("Apache-2.0", "file", None) and got[6] == ("CC-BY-NC-4.0", "header", None)
    assert got[3] == ("Apache-2.0", "inherited", "a") and got[4] == ("Proprietary", "inherited", "") and got[5][0] == "Proprietary"
    assert licenses.scan(spark, spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def test_licence_files_of_any_length(spark):
    data = [(1, "a/COPYING", "Released under\nthe MIT License.\n" * 3000), (2, "a/b/one.py", "code")]
    got = {r.file_id: (r.license, r.origin, r.from_dir) for r in licenses.scan(spark, spark.createDataFrame(data, "file_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "file", None), 2: ("MIT", "inherited", "a")}


def test_licence_headers_beside_other_words(spark):
    mit = licenses.TEMPLATES[2][1]
    texts = {
        "Copyright 2020 Jane Doe. All rights reserved.": "Proprietary",
        "Copyright 2020 Jane Doe. Released under the MIT License.": "MIT",
        "(c) 2020 Example Corp. Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "one two three four five six seven eight nine ten Released under the MIT License.": "MIT",
        "word " * 3000 + mit + " word" * 3000: "MIT",
        "# code\n# This work is licensed under the GNU General Public License,\n# version 3.\n\ncode " + "more " * 50: "GPL-3.0",
        "some ordinary words, none of which is a notice of any kind": None,
    }
    data = [(i, f"d{i}/x", t) for i, t in enumerate(texts)] + [(100 + i, f"e{i}/x", "plain words") for i in range(40)]
    got = {r.file_id: (r.license, r.origin) for r in licenses.scan(spark, spark.createDataFrame(data, "file_id long, path string, text string")).collect()}
    for i, (text, name) in enumerate(texts.items()):
        assert got[i][0] == name and (got[i][1] in ("header", "file")) == (name is not None), text[:80]


def plain_terms(text):
    found = re.findall(r"spdx-license-identifier:[ \t]*[a-z0-9.+-]+|[a-z0-9]+(?:\.[0-9]+)*", (text or "").lower())
    return [re.sub(r"[ \t]", "", t) for t in found]


def plain_scan(data, short, long, threshold=0.6):
    """(licence, score, whole) of every text: every passage and every run against every template, with plain loops."""
    idf = Counter(t for _, text in data for t in set(plain_terms(text)))
    weigh = lambda t: math.log((1 + len(data)) / (1 + idf[t])) + 1
    damp = lambda c: {t: 1 + math.log(n) for t, n in c.items()}

    def cosine(x, y):
        norm = lambda v: math.sqrt(sum((n * weigh(t)) ** 2 for t, n in v.items()))
        return sum(n * y[t] * weigh(t) ** 2 for t, n in x.items() if t in y) / (norm(x) * norm(y)) if x and y else 0.0

    out = {}
    for i, text in data:
        tokens, low = plain_terms(text), (text or "").lower()
        found = [(0, -cosine(damp(Counter(tokens)), damp(Counter(plain_terms(t)))), n) for n, t in long]
        passages = [low, *low.split("\n"), *re.split(r"(?<=[.!?;])(?=\s)", low), *re.split(r"\n(?:[^\w\n]*\n)+", low)]
        pieces = {tuple(plain_terms(p)) for p in passages}
        for n, t in short:
            want = Counter(plain_terms(t))
            size = want.total()
            for p in pieces | {tuple(tokens[k : k + size]) for k in range(len(tokens) - size + 1)}:
                found.append((len(p) != len(tokens), -cosine(Counter(p), want), n))
        found = [f for f in found if -f[1] >= threshold]
        if found:
            part, score, name = min((p, round(s, 9), n) for p, s, n in found)
            out[i] = (name, round(-score, 6), not part)
    return out


def test_licence_scan_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = [r for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist() if len(r["text"] or "") < 3000][:60]
    data = [(r["doc_id"], r["text"]) for r in docs]
    short, long = licenses.notices(), licenses.licence_texts()
    filler = [t for r in docs for t in r["text"].split()[:5]]
    for k in range(60):
        words_ = []
        for _ in range(int(rng.integers(1, 4))):
            text = short[int(rng.integers(len(licenses.TEMPLATES)))][1].split()
            words_ += [t if rng.random() < 0.8 else f"x{rng.integers(9)}" for t in text] + [filler[int(i)] for i in rng.integers(len(filler), size=int(rng.integers(6)))]
            words_.append("\n" if rng.random() < 0.5 else ".")
        data.append((10_000 + k, " ".join(words_)))
    data += [(20_000 + k, text) for k, (_, text) in enumerate(long)] + [(30_000, "# SPDX-License-Identifier:  MIT\ncode"), (30_001, "// SPDX-License-Identifier: EPL-1.0"), (30_002, None), (30_003, ""), (30_004, long[0][1][:4000])]
    df = spark.createDataFrame([(i, f"d{i}/x", t) for i, t in data], "file_id long, path string, text string")
    got = {r.file_id: (r.license, round(r.score, 6), r.origin == "file") for r in licenses.scan(spark, df).collect() if r.origin in ("file", "header")}
    want = plain_scan(data, short, long)
    assert got == want and len(got) > 60
    assert all(got[20_000 + k] == (name, pytest.approx(1.0), True) for k, (name, _) in enumerate(long))
    assert got[30_000][0] == "MIT" and 30_001 not in got


def test_licence_weak_terms_are_safe():
    idf = {t: 1.0 + (i % 97) / 10 for i, t in enumerate(sorted({t for _, text in licenses.notices() for t in licenses.terms(text)}))}
    vectors = [licenses.vector_of(n, licenses.terms(text), idf) for n, text in licenses.notices()]
    strong = licenses.strong_terms(vectors, idf, 0.6)
    weak = sorted(idf.keys() - strong)
    assert weak and strong
    assert max(licenses.cosines(dict.fromkeys(weak, 1), vectors, idf))[0] < 0.6
    for _, text in licenses.notices():
        assert max(licenses.cosines({t: n for t, n in licenses.terms(text).items() if t in weak}, vectors, idf))[0] < 0.6


def brute_top(data, k):
    ok = {}
    for i, v in data:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * x) for x in v]
            ok[i] = min(ok.get(i, w), w)
    out = []
    for q in ok:
        if q % 20 == 0:
            held = lambda s: max(min(s, 2**63 - 1), -(2**63))
            scored = sorted((-held(sum(a * b for a, b in zip(ok[q], ok[c]))), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(150)]
    data += [(200 + i, data[3][1]) for i in range(60)]  # a common vector
    data += [(400, None), (401, [None] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (404, []), (420, []), (None, data[0][1]), (20, data[20][1]), (440, [1.0, 2.0]), (441, [1e30, 2.0]), (460, [1e30, 0.5])]
    frame_ = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<float>, score int")
    big = {441, 460, 440}
    got = sorted(tuple(r) for r in topk.top_k(spark, frame_).collect())
    assert [g for g in got if g[0] not in big] == [g for g in brute_top(data, 20) if g[0] not in big]
    assert [g[:3] for g in got if g[0] in big] and topk.top_k(spark, frame_.limit(0)).count() == 0


def test_top_k_bounds_and_reads():
    rng = np.random.default_rng(4)
    x = rng.integers(-400, 400, (2000, 16))
    low = x.min(0).astype(float)
    width = np.maximum(1, np.ceil((x.max(0) - low + 1) / topk.CELLS))
    cells = ((x - low) // width).astype(float)
    ids, q_ids, q = np.arange(2000), np.array([7, 5000]), np.stack([x[7], rng.integers(-400, 400, 16)]).astype(float)
    middle, slack = topk.bounds(q, low, width, cells)
    assert (np.abs(q @ x.T - middle) <= slack[:, None] + 1e-6).all()
    least = topk.least_scores(q_ids, q, ids, low, width, cells, 5)
    row, column, upper = topk.survivors(q_ids, q, least, ids, low, width, cells)
    assert len(row) < 400
    got = topk.refine(q_ids, q, ids, x, row, column, upper, 5)
    want = [(int(i), v, -s) for i, one in zip(q_ids, q, strict=True) for s, v in sorted((-int(s), v) for v, s in enumerate(x @ one) if v != i)[:5]]
    assert list(zip(*(g.tolist() for g in got), strict=True)) == want
    assert list(zip(*(g.tolist() for g in topk.whole_scores(q_ids, q.astype(np.int64), ids, x, 5)), strict=True)) == want


def test_top_k_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(5)
    data = [(i, rng.normal(0, 0.2, 6).astype(np.float32).tolist()) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(150)]
    data += [(i, rng.normal(0, 0.2, 6).astype(np.float32).tolist()) for i in (20, 40, 41)] + [(2000, [2.0**40] * 6), (2001, [2.0**45, *[1.0] * 5]), (2002, [2.0**52, *[1.0] * 5])]
    got = sorted(tuple(r) for r in topk.top_k(spark, spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect())
    assert got == brute_top(data, 20)


def test_urls(spark):
    urls = [(1, "http://Casino.Example.NET/en/1?x"), (2, None), (3, "no scheme"), (4, "https://x.example.com/en/2"), (5, "https://www.example.com/en/2"), (6, "http://a.net/fr/"), (7, "http://netx/fr/"), (8, "http://x.com"), (9, ""), (1, "http://Casino.Example.NET/en/1?x")]
    got = {r.page_id: r for r in url_filter.url_filter(spark, spark.createDataFrame([(*u, "v") for u in urls], "page_id long, url string, verdict string")).collect()}
    assert (got[1].host, got[1].path, got[1].rule) == ("casino.example.net", "/en/1", None) and got[1].verdict == "block"
    assert (got[2].host, got[2].path, got[2].rule) == (got[3].host, got[3].path, got[9].rule) == ("", "", None)
    assert (got[4].rule, got[4].verdict) == ("example.com/en/", "block") and (got[5].rule, got[5].verdict) == ("www.example.com/en/", "allow")
    assert (got[6].rule, got[6].verdict) == ("net/fr/", "block") and got[7].rule is None and got[8].rule is None
    assert url_filter.url_filter(spark, spark.createDataFrame([], "page_id long, url string")).count() == 0


#: Hosts that the labelled table doesn't hold.
UNWANTED = "online-poker mega-casino poker-bets viagra-pills cheap-drugs adult-dating xxx-videos porn-tube quick-loans payday-cash free-malware-scan download-crack phishing-bank-login ad-click-network banner-track win-lottery-prize spam-seo-links link-farm-directory replica-bags hot-cams"
WANTED = "physics opera poetry village school archive geology forest recipes railway astronomy painting parliament gardening bicycle sculpture sailing cathedral medicine festival"


def test_url_model_on_hosts_it_has_not_seen(spark):
    known = url_filter.BLOCKED + url_filter.ALLOWED
    names = [(n, 1) for n in UNWANTED.split()] + [(n, 0) for n in WANTED.split()]
    assert not any(u.removeprefix("www.").removeprefix("m.").startswith(f"{n}.") for u in known for n, _ in names) and len(known) <= 200
    tlds, paths = ("com", "net", "org"), ("en/4", "es/77", "de/3", "fr/9")
    urls = [(f"http://{n}.example.{tlds[i % 3]}/{paths[i % 4]}", y) for i, (n, y) in enumerate(names)]
    weights = url_filter.fit(url_filter.labelled_urls(spark))
    host, path = url_filter.split_url(url_filter.F.col("url"))
    got = spark.createDataFrame(urls, "url string, y int").select("y", url_filter.unwanted(weights, host, path).alias("s")).collect()
    assert sum((r.s >= 0.5) == bool(r.y) for r in got) / len(got) >= 0.85


def test_url_model_matches_brute_force(spark):
    rows_ = [("http://a.b/c", 1), ("http://d.e/f", 0), ("http://a.x/c", 1), (None, 1)]
    df = spark.createDataFrame(rows_, "url string, label int")
    weights = url_filter.fit(df)
    host, path = url_filter.split_url(url_filter.F.col("url"))
    ex = df.filter("url IS NOT NULL").orderBy(url_filter.F.xxhash64("url")).select("label", url_filter.grams(host, path).alias("g")).collect()
    w = np.zeros(url_filter.BUCKETS + 1)
    for _ in range(url_filter.EPOCHS):
        for r in ex:
            x = np.append(np.bincount(r.g, minlength=url_filter.BUCKETS) / math.sqrt(len(r.g)), 1.0)
            w = w * (1 - url_filter.DECAY) + url_filter.STEP * (r.label - 1 / (1 + math.exp(-(w @ x)))) * x
    assert np.allclose(weights, w, atol=1e-9)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        free -= full
    return target


def test_mix(spark):
    got = mix(spark, frame(spark)).collect()
    data = rows()
    size = lambda t: len((t or "").split())
    sizes = {}
    for r in data:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want = brute_targets(sizes)
    assert len(got) == len(data)
    source = {r[0]: r[3] for r in data}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix(spark, frame(spark)).collect()), key=repr)
    assert mix(spark, frame(spark, [])).count() == 0


def test_mixed_rows_hold_the_taken_words(spark):
    data = [r for r in rows() if r[0] is not None][:-1]
    df = frame(spark, data)
    want = {}
    for r in mix(spark, df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    texts = {r[0]: r[1] or "" for r in data}
    got = {}
    for r in mixed_documents(spark, df).collect():
        assert texts[r.doc_id].startswith(r.text or "")
        got[r.doc_id] = got.get(r.doc_id, 0) + len((r.text or "").split())
    assert got == {d: n for d, n in want.items() if n or d in got}
    assert mixed_documents(spark, frame(spark, [])).count() == 0


def test_mixed_documents_place_rows_of_equal_ids_singly(spark):
    def words(n, i):
        return " ".join([f"w{i}"] * n)

    data = [(None, words(4 + i % 3, i), "a") for i in range(30)] + [(i, words(5, i), "a") for i in range(3)]
    data += [(7, words(3, i), s) for i in range(9) for s in ("b", "c")] + [(None, words(6, i), "c") for i in range(20)] + [(None, None, "c"), (8, words(2, 0), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    want, got = {}, {}
    for r in mix(spark, df).groupBy("source_size").sum("taken").collect():
        want[r.source_size] = r[1]
    sizes = {}
    for _, text, source in data:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    taken, per = {}, {}
    for r in mixed_documents(spark, df).collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        per.setdefault((r.source, r.doc_id), []).append(r.text)
    for source, n in sizes.items():
        got[n] = got.get(n, 0) + taken.get(source, 0)
    assert got == want
    for (source, doc_id), texts in per.items():
        rows = [t for d, t, s in data if (d, s) == (doc_id, source) and t]
        assert all(any(t.startswith(x) for t in rows) for x in texts)


def test_mix_of_an_id_that_most_rows_share(spark, monkeypatch):
    from marginalia.llm import mixing

    monkeypatch.setattr(mixing, "RUN", 7)
    data = [(None, "a b c", "s")] * 200 + [(5, "a b", "s")] * 30 + [(i, "x " * (i % 4), "t") for i in range(40)] + [(9, "q", "u")] * 50
    got = mix(spark, spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    sizes = {"s": 660, "t": sum(i % 4 for i in range(40)), "u": 50}
    want, by_size = brute_targets(sizes), {v: k for k, v in sizes.items()}
    assert len(got) == len(data) and sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), len(t.split())) for d, t, _ in data)
    taken = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[by_size[r.source_size]] = taken.get(by_size[r.source_size], 0) + r.taken
    assert all(abs(taken[k] - want[k]) <= 0.5 for k in sizes)
