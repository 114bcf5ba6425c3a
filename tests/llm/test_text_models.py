import re
import time
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from marginalia.llm import langid, pieces, quality
from marginalia.llm.html_text import extract, extract_pages

from .fixtures import frame, rows

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(spark, tables):
    docs, labels = tables
    got = quality.quality(spark, docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    truth = got.merge(labels.toPandas(), on="doc_id")
    held = truth[truth.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_quality_awkward_rows(spark, tables):
    got = quality.quality(spark, frame(spark), tables[1]).collect()
    assert len(got) == len(rows())
    assert {r.score for r in quality.quality(spark, frame(spark), tables[1].limit(0)).collect()} == {0.5}
    assert quality.quality(spark, frame(spark, []), tables[1]).count() == 0


def test_quality_features_match_plain_python():
    text = "A bb bb CCC! é.\nx | 12"
    x = dict(zip(quality.FEATURES, quality.features(pa.array([text, None, ""]))[0]))
    raw = text.encode()
    assert x["share_upper"] == pytest.approx(4 / len(raw)) and x["share_wide"] == pytest.approx(2 / len(raw))
    assert x["repeated_next"] == pytest.approx(1 / 8) and x["distinct_words"] == pytest.approx(7 / 8)
    assert (quality.features(pa.array([None, ""])) >= 0).all()


def plain_features(text):
    raw = (text or "").encode()
    counts = {name: sum(b in members for b in raw) for name, members in quality.CLASSES.items()}
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, size = len(words), len(raw)
    many, some = max(n, 1), max(size, 1)
    letters = counts["upper"] + counts["lower"]
    more = [np.log1p(size), np.log1p(n), sum(map(len, words)) / many, sum(len(w) <= 3 for w in words) / many, sum(len(w) > 15 for w in words) / many]
    more += [sum(a == b for a, b in zip(words, words[1:])) / many, len(set(words)) / many, counts["upper"] / max(letters, 1), n / (counts["stop"] + 1), size / (counts["line"] + 1)]
    return [counts[c] / some for c in quality.CLASSES] + more


def test_quality_features_and_scores_match_plain_python(spark, tables):
    docs, labels = tables
    texts = [r.text for r in docs.select("text").limit(300).collect()] + [r[1] for r in rows()]
    assert np.allclose(quality.features(pa.array(texts)), [plain_features(t) for t in texts])
    x, y = quality.labelled(docs, labels, quality.learnable(), 500)
    assert len(x) <= 500 and (quality.labelled(docs.repartition(5), labels.repartition(3), quality.learnable(), 500)[0] == x).all()
    model = quality.fit(x, y)
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        at = [sum(e <= v for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total = model.intercept + sum(t[b] for t, b in zip(model.tables, at, strict=True)) + sum(t[at[i]][at[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_first_step_matches_a_plain_tree():
    """One round on one feature: the best two-level tree by exhaustive search over its cuts."""
    rng = np.random.default_rng(7)
    x = rng.random((400, 1))
    y = ((x[:, 0] > 0.3) & (x[:, 0] < 0.7)).astype(float)
    model = quality.fit(x, y, bins=8, rounds=1, pair_rounds=0, n_pairs=0, rate=1.0)
    b, p = model.bins(x)[:, 0], 1 / (1 + np.exp(-model.intercept))
    g, h = np.array([(y - p)[b == k].sum() for k in range(8)]), np.array([(b == k).sum() * p * (1 - p) for k in range(8)])
    gain = lambda i, j: g[i:j].sum() ** 2 / (h[i:j].sum() + 1)

    def tree(i, j, depth):
        cuts = [(gain(i, c) + gain(c, j), c) for c in range(i + 1, j)] if depth else []
        if not cuts or max(cuts)[0] - gain(i, j) <= 1e-9:
            return [g[i:j].sum() / (h[i:j].sum() + 1)] * (j - i)
        c = max(cuts, key=lambda t: t[0])[1]
        return tree(i, c, depth - 1) + tree(c, j, depth - 1)

    assert np.allclose(model.tables[0], tree(0, 8, 2))


def test_ga2m_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95 and {0, 1} in [set(p) for p in model.pairs]


def test_language_held_out(spark, tables):
    got = langid.identify(spark, tables[0]).toPandas().merge(tables[0].toPandas()[["doc_id", "lang"]], on="doc_id")
    held = got[got.held_out & got.lang.notnull()]
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_language_awkward_rows(spark):
    got = {r.doc_id: r for r in langid.identify(spark, frame(spark)).collect()}
    texts = {r[0]: r[1] for r in rows()}
    for i, r in got.items():
        t = texts.get(i, "w")
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de") and 0 <= r.score <= 1
    assert langid.identify(spark, frame(spark, [])).count() == 0


def test_language_sample_is_bounded_and_holds_every_language(spark):
    data = [(i, f"text {i} " * (1 + i % 7), f"l{i % 40}") for i in range(4000)] + [(5000 + i, "hot text", "hot") for i in range(6000)] + [(7, None, "l1"), (8, "x", None), (None, "x", "l2")]
    df = spark.createDataFrame([*data, *data[:50]], "doc_id long, text string, lang string")
    every = langid.F.lit(True)
    got = langid.sample(df, every, most=400)
    per = pd.Series([y for y, _ in got]).value_counts()
    assert len(per) == 41 and per.max() <= 30 and got == langid.sample(df.repartition(7), every, most=400)
    small = langid.sample(df, every, per_language=50, fit_bytes=100)
    sizes = {}
    for y, t in small:
        sizes.setdefault(y, []).append(len(t))
    assert all(sum(n) <= 100 or len(n) == 1 for n in sizes.values()) and len(sizes) == 41


def test_language_network_matches_plain_python():
    rng = np.random.default_rng(3)
    x, y = rng.integers(1, 256, (40, langid.WINDOW)).astype(np.uint8), rng.integers(0, 3, 40)
    net = langid.train(x, y, ["a", "b", "c"])
    for row, got in zip(x[:5], net.probabilities(x)[:5], strict=True):
        hidden = []
        for w, weight, bias in zip(langid.WIDTHS, net.filters, net.bias, strict=True):
            for f in range(langid.FILTERS):
                answers = [sum(float(net.embedding[row[i + k]] @ weight[k][:, f]) for k in range(w)) for i in range(len(row) - w + 1)]
                hidden.append(max(0.0, max(answers) + float(bias[f])))
        z = np.array([sum(h * float(net.out[i, c]) for i, h in enumerate(hidden)) + float(net.out_bias[c]) for c in range(3)])
        want = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got == pytest.approx(want, abs=1e-4)


def test_windows_hold_every_byte():
    texts = ["", "a" * 128, "b" * 129, "é" * 300]
    raw, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    x, row = langid.windows(raw, bounds)
    assert [bytes(x[row == i].ravel()).rstrip(b"\0").decode() for i in range(4)] == texts


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def encode(v, texts, seed=1, keys=None):
    raws = [t.encode() for t in texts]
    keys = np.arange(len(texts), dtype=np.uint64) if keys is None else keys
    return pieces._encoded(v, np.frombuffer(b"".join(raws), np.uint8), np.cumsum([0, *map(len, raws)]), keys, seed)


def test_pieces_round_trip_and_batches(vocabulary):
    texts = ["The thing and that.", "", "  spaces   inside  ", "▁ meta ☃\n\ttab", "x" * 3000, "worthless nonsense " * 50, "é ß \U0001f600"]
    flat, at, chars = encode(vocabulary, texts)
    assert chars.tolist() == [len(t) for t in texts]
    for i, t in enumerate(texts):
        alone, _, _ = encode(vocabulary, [t], keys=np.array([i], np.uint64))
        assert flat[at[i] : at[i + 1]].tolist() == alone.tolist()


def test_pieces_of_a_text_do_not_depend_on_the_others(vocabulary):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdeit no"), 60)) for _ in range(3000)]
    flat, at, _ = encode(vocabulary, texts)
    for i in (0, 1500, 2999):
        alone, _, _ = encode(vocabulary, [texts[i]], keys=np.array([i], np.uint64))
        assert flat[at[i] : at[i + 1]].tolist() == alone.tolist()
    half, half_at, _ = encode(vocabulary, texts[1000:], keys=np.arange(1000, 3000, dtype=np.uint64))
    assert flat[at[1000] :].tolist() == half.tolist() and (np.diff(at)[1000:] == np.diff(half_at)).all()


def test_pieces_follow_the_enumerated_distribution(vocabulary):
    """All segmentations of short words, their odds by enumeration, against 20,000 draws each."""
    spelled = {bytes(vocabulary.spelling[vocabulary.spelling_at[i] : vocabulary.spelling_at[i + 1]]): i for i in range(len(vocabulary.weight)) if vocabulary.weight[i] > pieces.BYTE_WEIGHT * 1.01}
    for word in ("in", "and", "\u00e9t"):
        text = (" " + word).encode()

        def every(at=0):
            if at == len(text):
                yield (), 1.0
            for end in range(at + 1, len(text) + 1):
                if (i := spelled.get(text[at:end])) is not None:
                    for rest, w in every(end):
                        yield (i, *rest), w * vocabulary.weight[i]

        odds = dict(every())
        total, n = sum(odds.values()), 20_000
        flat, at, _ = encode(vocabulary, [word] * n)
        seen = pd.Series([tuple(flat[at[i] : at[i + 1]]) for i in range(n)]).value_counts()
        for found, w in odds.items():
            p = w / total
            assert abs(seen.get(found, 0) - n * p) < 5 * (n * p * (1 - p)) ** 0.5 + 3, (word, found)
        assert set(seen.index) <= set(odds)


def test_pieces_are_sampled_by_their_probability(vocabulary):
    word = "that"
    n = 4000
    flat, at, _ = encode(vocabulary, [word] * n)
    seen = pd.Series([tuple(flat[at[i] : at[i + 1]]) for i in range(n)]).value_counts(normalize=True)
    spelled = {s: i for i, s in ((i, bytes(vocabulary.spelling[vocabulary.spelling_at[i] : vocabulary.spelling_at[i + 1]])) for i in range(len(vocabulary.weight))) if np.isfinite(vocabulary.weight[i])}
    text = b" that"

    def every(at=0):
        if at == len(text):
            yield (), 1.0
        for end in range(at + 1, len(text) + 1):
            if (i := spelled.get(text[at:end])) is not None and vocabulary.weight[i] > pieces.BYTE_WEIGHT * 1.01:
                for rest, w in every(end):
                    yield (i, *rest), w * vocabulary.weight[i]

    odds = dict(every())
    total = sum(odds.values())
    for found, share in seen.head(3).items():
        assert share == pytest.approx(odds[found] / total, abs=0.03)


def test_pieces_of_documents(spark):
    got = pieces.encode_documents(spark, frame(spark))
    back = {(r.doc_id, r.text) for r in pieces.decode_documents(spark, got).collect()}
    assert back == {(r[0], r[1]) for r in rows()}
    assert pieces.encode_documents(spark, frame(spark, [])).count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><p>Site, header, with, commas, and text, lots of it.</p></header><nav><ul><li><a href=a>A</a></ul></nav>
<article><h1>Head &amp; line</h1><p>First paragraph, with commas, of some length, to score.<p>Second   one&nbsp;here,\n which also has some length and a comma, surely.</p><div class="notice">Notice, to, all, readers, of, this, page, here</div>
<script>var x = "</p><p>";</script><form><p>Mail, address, form, with, text, that, is, long</p></form><p>Short.</p></article>
<aside><p>Side, bar, text, with, many, commas, and, length.</p></aside><div id="comments"><p>Reader, comment, with, many, commas, and, length, too.</p></div><footer>Foot</footer>"""


def test_extraction_keeps_text_around_dropped_inline_elements():
    assert extract('<p>Alpha beta <i aria-hidden="true"></i> gamma</p>') == "Alpha beta gamma"
    assert extract('<div><i hidden>x</i>One <span class="share">Share <b>this</b></span>two <i class="ad">Buy</i><i hidden>y</i> three<span class="share">z</span></div>') == "One two three"
    assert extract('<p>Ends in a span <span class="share">Share</span></p><p>Next <span hidden>x<br>y<hr>z</span>one</p>') == "Ends in a span\nNext one"
    assert extract('<div>Before <span class="ad"><div>Buy</div><ul><li>now</li></ul></span> after</div>') == "Before after"
    assert extract('<p>Not closed <span hidden>gone</p><p>Next.</p>') == "Not closed\nNext."


def test_extraction_of_foreign_elements_and_captions():
    assert extract('<article><p>One<svg viewBox="0 0 1 1"/> two.</p><p>Three.</p><svg><text>no</text></SVG><p>Four.</p></article>') == "One two.\nThree.\nFour."
    assert extract('<p>\u0130\u0130\u0130\u0130 a<script>var x = "</scripts>";</SCRIPT >b c d e f g</p>') == "\u0130\u0130\u0130\u0130 ab c d e f g"
    assert extract("<article><p>Text of the article.</p><figure><img><figcaption>The caption.</figcaption></figure><p>So <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> holds.</p></article>") == "Text of the article.\nThe caption.\nSo x=2 holds."


PROSE = "A first sentence of the article, of some length, with commas. "


def test_extraction_judges_unlikely_words_by_content():
    for around in ('<div class="layout has-sidebar">', '<div id="page-header-wrap">', '<div class="header">', '<article class="post comments-open">', '<div class="search"><article>', '<x-page class="sidebar">'):
        assert extract(f"<body>{around}<p>{PROSE}</p><p>And more.</p>") == f"{PROSE.strip()}\nAnd more.", around
    for part in ('section id="related-work"', 'p id="search-methods"', 'div class="social-history"'):
        assert extract(f"<article><p>{PROSE * 3}</p><{part}>Short.</{part.split()[0]}><p>{PROSE}</p></article>") == f"{(PROSE * 3).strip()}\nShort.\n{PROSE.strip()}", part
    for part in ('div class="related-posts"', 'div class="ad-box"', 'div id="comments"', 'article class="comment"', 'div class="social-media"><a href=x>Follow us</a><a href=y'):
        assert extract(f"<body><div><p>{PROSE * 3}</p></div><{part}>{PROSE * 9}</{part.split()[0]}></body>") == (PROSE * 3).strip(), part
    assert extract(f'<body><div class="notice"><p>{PROSE}</p></div></body>') == PROSE.strip()
    assert extract(f'<body><p>Tiny.</p><x-page class="sidebar"><p>{PROSE * 5}</p></x-page></body>') == "Tiny.\n" + (PROSE * 5).strip()


def test_extraction():
    assert extract(PAGE) == "Head & line\nFirst paragraph, with commas, of some length, to score.\nSecond one here, which also has some length and a comma, surely.\nShort."
    assert extract(None) == extract("") == extract("<p></p>") == ""
    assert extract("just words") == "just words"
    assert extract("<div>" * 3000 + "deep text" + "</div>" * 3000) == "deep text"


def test_extraction_of_buttons_odd_quotes_and_references():
    around = lambda inner: f"<body><article><p>{PROSE * 3}</p>{inner}<p>{PROSE}</p></article></body>"
    want = lambda *inner: "\n".join([(PROSE * 3).strip(), *inner, PROSE.strip()])
    assert extract(around("<p>Some text.<button type=button>Share</button></p>")) == want("Some text.")
    assert extract(around("<p title=it's>One.</p><p data-x='a>b' title=\"it's\">Two.</p>")) == want("One.", "Two.")
    assert extract(around("<h2>References</h2><ul><li><a href=a>First work</a><li><a href=b>Second work</a><li><a href=c>Third work</a></ul>")) == want("References", "First work", "Second work", "Third work")
    menu = "<ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>About</a></ul>"
    assert extract(f"<body><div><p>{PROSE * 3}</p>{menu}<p>{PROSE}</p></div></body>") == want()


@pytest.mark.parametrize("page", ["<div>" * 20000 + "x" + "</span>" * 20000, "<div>text " * 20000, "<ul><li><ul>" + "<div>" * 20000 + "<li>a</li>" * 20000, "<span hidden>" * 20000 + "<p>a</p>" * 20000, "<a b='" * 50000, '<p a="x' * 50000, "<!--" * 50000])
def test_extraction_is_linear(page):
    began = time.perf_counter()
    extract(page)
    assert time.perf_counter() - began < 5


class Article(HTMLParser):
    """The text blocks of the article element, by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.blocks = False, [""]
        self.feed(page)
        self.text = "\n".join(t for b in self.blocks if (t := " ".join(b.split())))

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_extraction_equals_the_planted_articles():
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    assert len(pages) > 200
    for page in pages:
        assert extract(page["html"]) == Article(page["html"] or "").text, page["page_id"]


def test_pages(spark):
    data = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y")]
    got = extract_pages(spark, spark.createDataFrame(data, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars, len(r.text)) for r in got) == sorted([(1, len(extract(PAGE)), len(extract(PAGE)))] * 2 + [(0, 0, 0), (2, 0, 0)])
