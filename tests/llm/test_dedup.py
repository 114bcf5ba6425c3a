import hashlib
import re
from collections import Counter

import numpy as np

from marginalia.llm import common
from marginalia.llm import near_dedup as N
from marginalia.llm.exact_dedup import drop_exact_copies, exact_dedup
from marginalia.llm.near_dedup import drop_near_copies, near_dedup

from .fixtures import frame, rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(data):
    sets = [shingles(t) for _, t in data]
    up = list(range(len(data)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(data, sets))]


def test_exact_groups(spark):
    data = [(r[0], r[1]) for r in rows()]
    norm = [(d, (t or "").translate(UPPER)) for d, t in data]
    size = Counter(t for _, t in norm)
    keep = {}
    for d, t in norm:
        if d is not None:
            keep[t] = max(d, keep.get(t, d))
    want = sorted(((d, keep[t], size[t], d == keep[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in norm), key=repr)
    got = sorted((tuple(r) for r in exact_dedup(spark, frame(spark)).collect()), key=repr)
    assert got == want


def test_exact_keeps_one_row_of_each_text(spark):
    got = drop_exact_copies(spark, frame(spark))
    texts = [(r.text or "").translate(UPPER) for r in got.collect()]
    assert sorted(texts) == sorted({(r[1] or "").translate(UPPER) for r in rows()})
    assert got.columns == frame(spark).columns


def test_exact_equal_heads_and_lengths(spark):
    head = "h" * 2000
    data = [(i, head + t) for i, t in enumerate(["a" * 30000, "a" * 29999 + "b", "a" * 30000, "b" + "a" * 29999])]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {0: (2, 2), 1: (1, 1), 2: (2, 2), 3: (3, 1)}


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup(spark, none).count() == 0
    assert drop_exact_copies(spark, none).count() == 0
    assert near_dedup(spark, none).count() == 0
    assert drop_near_copies(spark, none).count() == 0


def test_near_components_match_brute_force(spark):
    want = sorted(((d, n, c, d == c) for d, n, c in brute_components([(r[0], r[1]) for r in rows()])), key=repr)
    got = sorted((tuple(r) for r in near_dedup(spark, frame(spark)).collect()), key=repr)
    assert got == want


def test_near_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 1)
    monkeypatch.setattr(N, "BLOCK", 300)
    monkeypatch.setattr(N, "PIVOT_ROUNDS", 0)
    want = sorted(((d, n, c) for d, n, c in brute_components([(r[0], r[1]) for r in rows()])), key=repr)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup(spark, frame(spark)).collect()), key=repr)
    assert got == want


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
    sketch = N.sketches(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), 1024)
    assert abs((sketch[0] == sketch[1]).mean() - 0.6) < 0.06
    assert (N.sketches(np.array([7], np.uint64), np.array([0, 1]), 128) != N._NONE).all()


def thue_morse(n, a="a", b="b"):
    word = "0"
    for _ in range(n):
        word += word.translate(str.maketrans("01", "10"))
    return word.translate(str.maketrans("01", a + b))


def test_hashes_have_no_ring_collisions(spark):
    words = [thue_morse(n, *pair) for n in (3, 4, 5, 6, 10, 11) for pair in ("ab", "ba", "xy", "yx")]
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    edges = np.cumsum([0, *map(len, words)])
    assert len(set(common.span_hashes(raw, edges[:-1], edges[1:]).tolist())) == len(words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(spark, spark.createDataFrame([(1, thue_morse(10)), (2, thue_morse(10, "b", "a"))], "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2)}


def test_span_hashes_depend_on_the_bytes_alone():
    rng = np.random.default_rng(1)
    spans = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(1, 90, 400)] * 2
    order = rng.permutation(len(spans))
    raw = np.frombuffer(b"".join(spans[i] for i in order), np.uint8)
    edges = np.cumsum([0, *(len(spans[i]) for i in order)])
    first, second = common.span_hashes(raw, edges[:-1], edges[1:], 1, 2)
    seen = {}
    for i, h, g in zip(order, first.tolist(), second.tolist(), strict=True):
        assert seen.setdefault(spans[i], (h, g)) == (h, g)
    assert len({h for h, _ in seen.values()}) == len({g for _, g in seen.values()}) == len(seen) and not {h for h, _ in seen.values()} & {g for _, g in seen.values()}


def test_candidates_hold_pairs_at_the_edge():
    """Pairs just at 0.75, of sets of 4 to 400 shingles: banding and the one-bit filter find all but a few of a million."""
    rng = np.random.default_rng(8)
    sets, pairs = [], 1500
    for i in range(pairs):
        rest = 1 + i % 50
        both = rng.integers(0, 2**63, 6 * rest, dtype=np.uint64)
        sets += [np.unique(np.concatenate([both, rng.integers(0, 2**63, rest, dtype=np.uint64)])) for _ in range(2)]
    sketch = N.mix64(N.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)])))
    a, b = sketch[::2], sketch[1::2]
    band = (a == b).reshape(pairs, -1, N.BAND).all(2).any(1)
    bits = ((a ^ b) & np.uint64(1)).sum(1)
    assert band.all() and (bits <= N.MOST_BITS).all()


def test_many_near_copies_are_one_component_spread_over_tasks(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(80)]
    data = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate(rng.integers(80, size=3000).tolist())]
    data += [(10_000 + i, " ".join(f"v{rng.integers(10**6)}" for _ in range(60))) for i in range(200)]
    got = near_dedup(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id < 10_000} == {0} and all(r.kept for r in got if r.doc_id >= 10_000)



def test_word_shingles_equal_the_plain_ones():
    for _, text in [(r[0], r[1]) for r in rows()]:
        assert {tuple(w.decode() for w in s) for s in N.word_shingles((text or "").encode())} == shingles(text)
