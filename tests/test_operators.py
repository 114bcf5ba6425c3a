import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia import tasks
from marginalia.functions import text
from marginalia.operators import analysis, corpus, encoding, ensemble, intervals, linking, ontology, retrieval, scoring, sequence, spans, split, stats, trials
from marginalia.sources import sinks, tables
from marginalia.streaming import ingest

SPANS = "filename string, label string, start_span int, end_span int"
def plain_greedy(gold, pred, scenario, least=40.0):
    """Kinds and pairs of one document's (label, start, end), in list order, by plain loops."""
    free, out = list(range(len(gold))), []
    for j, (label, start, end) in enumerate(pred):
        for i in free:
            g_label, s, e = gold[i]
            shared = min(e, end) - max(s, start)
            if shared <= 0 or (scenario in ("partial", "ent_type") and 100 * shared < least * (e - s)):
                continue
            same = (s, e) == (start, end)
            right = {"strict": same and label == g_label, "exact": same, "partial": same, "ent_type": label == g_label}[scenario]
            out.append(("correct" if right else "partial" if scenario == "partial" else "incorrect", i, j))
            free.remove(i)
            break
        else:
            out.append(("spurious", None, j))
    return out + [("missed", i, None) for i in free]


def random_sides(seed, n=250, labels="AB"):
    rng = random.Random(seed)
    one = lambda: (rng.choice(labels), s := rng.randint(0, 20), s + rng.randint(1, 9))
    return [([one() for _ in range(rng.randint(0, 6))], [one() for _ in range(rng.randint(0, 6))]) for _ in range(n)]


def frames(spark, sides):
    rows = lambda k: [(f"d{i:03}", j + 1, *span) for i, both in enumerate(sides) for j, span in enumerate(both[k])]
    schema = "filename string, position int, label string, start_span int, end_span int"
    return spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema)


def test_greedy_events_equal_plain_loops(spark):
    sides = random_sides(3)
    got = {}
    for r in scoring.greedy_events(*frames(spark, sides)).collect():
        got.setdefault((int(r.filename[1:]), r.scenario), set()).add((r.kind, r.gold_at, r.pred_at))
    for i, (gold, pred) in enumerate(sides):
        for scenario in scoring.SCENARIOS:
            want = {(k, g if g is None else g + 1, p if p is None else p + 1) for k, g, p in plain_greedy(gold, pred, scenario)}
            assert got.get((i, scenario), set()) == want, (i, scenario)


def test_greedy_matching_depends_on_order(spark):
    kinds = lambda pred: sorted(r.kind for r in scoring.greedy_events(*frames(spark, [([("A", 0, 8)], pred)]), scenarios=("strict",)).collect())
    assert kinds([("A", 0, 3), ("A", 0, 8)]) == ["incorrect", "spurious"] and kinds([("A", 0, 8), ("A", 0, 3)]) == ["correct", "spurious"]


def plain_dice(a, b):
    return 2 * max(0, min(a[1], b[1]) - max(a[0], b[0])) / ((a[1] - a[0]) + (b[1] - b[0]))


def plain_units(gold, pred, threshold):
    """Units of one label's spans (id, start, end) after strict matching, by plain loops and all matchings."""
    g, p, units = {i: (s, e) for i, s, e in gold}, {i: (s, e) for i, s, e in pred}, []
    for i in sorted(g):
        j = next((j for j in sorted(p) if p[j] == g[i]), None)
        if j is not None:
            units.append(("UNCREDITED_EXACT", None, (i,), (j,)))
            del g[i], p[j]
    for kind, outer, inner in (("FRAGMENTED", g, p), ("MERGED", p, g)):
        for i, (s, e) in sorted(outer.items(), key=lambda x: (x[1][1] - x[1][0], x[0])):
            inside = [j for j in sorted(inner) if s <= inner[j][0] and inner[j][1] <= e]
            cover = len({c for j in inside for c in range(*inner[j])})
            if len(inside) > 1 and 2 * cover / (e - s + cover) >= threshold:
                units.append(("BOUNDARY_ERROR", kind, (i,), tuple(inside)) if outer is g else ("BOUNDARY_ERROR", kind, tuple(inside), (i,)))
                del outer[i]
                for j in inside:
                    del inner[j]
    total, left = 0.0, (sorted(g), sorted(p))
    small, large = sorted(left, key=len)
    for choice in itertools.permutations(large, len(small)):
        dice = [plain_dice(*((g[a], p[b]) if small is left[0] else (g[b], p[a]))) for a, b in zip(small, choice)]
        total = max(total, sum(d for d in dice if d >= threshold))
    return units, total, set(g), set(p)


@pytest.mark.parametrize("threshold", [0.4, 0.6])
def test_units_equal_plain_pairing(spark, threshold):
    sides = random_sides(5, 150, "A")
    events = analysis.strict_events(*frames(spark, sides))
    units = {}
    for u in analysis.pair_errors(events, threshold).collect():
        units.setdefault(int(u.filename[1:]), []).append(u)
    for i, (gold, pred) in enumerate(sides):
        strict = {(a, b) for k, a, b in plain_greedy(gold, pred, "strict") if k == "correct"}
        rest = lambda spans, side: [(j + 1, s, e) for j, (_, s, e) in enumerate(spans) if j not in {x[side] for x in strict}]  # noqa: B023, E731
        groups, total, g, p = plain_units(rest(gold, 0), rest(pred, 1), threshold)
        found = units.get(i, [])
        assert sorted((u.error_type, u.boundary_kind, tuple(u.gold_ids), tuple(u.pred_ids)) for u in found if u.error_type == "UNCREDITED_EXACT" or u.boundary_kind in ("FRAGMENTED", "MERGED")) == sorted(groups)
        pairs = [u for u in found if u.boundary_kind in analysis.ONE_TO_ONE]
        assert sum(u.dice for u in pairs) == pytest.approx(total) and all(u.dice >= threshold for u in pairs)
        assert sorted(x for u in found for x in u.gold_ids) == list(range(1, len(gold) + 1)) and sorted(x for u in found for x in u.pred_ids) == list(range(1, len(pred) + 1))
        assert {u.gold_ids[0] for u in found if u.error_type == "MISSED"} == g - {u.gold_ids[0] for u in pairs} and {u.pred_ids[0] for u in found if u.error_type == "SPURIOUS"} == p - {u.pred_ids[0] for u in pairs}


def test_pairing_kinds(spark):
    cases = {
        (((0, 8),), ((0, 4), (0, 8))): [("SPURIOUS", None, None), ("UNCREDITED_EXACT", None, None)],
        (((0, 13),), ((0, 22),)): [("BOUNDARY_ERROR", "TOO_LONG", "START")],
        (((0, 10),), ((2, 12),)): [("BOUNDARY_ERROR", "SHIFTED_RIGHT", "NEITHER")],
        (((14, 22),), ((0, 28),)): [("MISSED", None, None), ("SPURIOUS", None, None)],
        (((0, 8),), ((0, 4), (5, 8))): [("BOUNDARY_ERROR", "FRAGMENTED", None)],
        (((0, 14), (17, 23)), ((0, 23),)): [("BOUNDARY_ERROR", "MERGED", None)],
        (((0, 10),), ((0, 10),)): [("CORRECT", None, None)],
        (((5, 15),), ((3, 13),)): [("BOUNDARY_ERROR", "SHIFTED_LEFT", "NEITHER")],
    }
    sides = [([("A", *x) for x in g], [("A", *x) for x in p]) for g, p in cases]
    found = {}
    for u in analysis.pair_errors(analysis.strict_events(*frames(spark, sides))).collect():
        found.setdefault(int(u.filename[1:]), []).append((u.error_type, u.boundary_kind, u.matched_edge))
    assert [sorted(found[i], key=str) for i in range(len(sides))] == list(cases.values())


@given(st.integers(1, 4), st.integers(1, 4), st.randoms())
@settings(max_examples=60, deadline=None)
def test_assignment_is_optimal(n, m, rng):
    w = [[rng.randint(0, 9) for _ in range(m)] for _ in range(n)]
    got = sum(w[a][b] for a, b in analysis.assign(w))
    small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
    best = max(sum(w[a][b] if n <= m else w[b][a] for a, b in zip(small, c)) for c in itertools.permutations(large, len(small)))
    assert got == best


def test_unions_and_clusters_differ_on_touching_ranges(spark):
    df = spark.createDataFrame([("d", "A", 0, 3), ("d", "A", 3, 5), ("d", "A", 4, 6)], SPANS)
    assert sorted(map(tuple, intervals.union_intervals(df, ["filename", "label"]).select("start_span", "end_span").collect())) == [(0, 6)]
    assert intervals.overlap_clusters(df, ["filename"]).select("island").distinct().count() == 2
    assert spans.resolve_overlaps(df, "keep_shortest").count() == 2
    with pytest.raises(Exception, match="overlapping"):
        spans.resolve_overlaps(df, "error").collect()
    with pytest.raises(ValueError):
        spans.resolve_overlaps(df, "other")


def test_empty_scores(spark):
    none = spark.createDataFrame([], SPANS)
    assert scoring.character_scores(none, none).count() == 0
    assert scoring.entity_character_scores(none, none).first().f1 == 0
    row = scoring.character_scores(spark.createDataFrame([("d", "A", 0, 3)], SPANS), none).first()
    assert (row.tp, row.fp, row.fn, row.f1) == (0, 0, 3, 0)


def test_similarities():
    rng, con = random.Random(1), duckdb.connect()
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9))) for _ in range(2))
        assert text.jaro_winkler(a, b) == pytest.approx(con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0], abs=1e-6)
    assert text.token_set_ratio("a b c", "c a") == 1.0 and 0 < text.token_set_ratio("new york", "new jersey") < 1
    assert text.normalize_mention("  ﬁNE Straße ") == "fine strasse" and text.normalize_label(" Enfermedad-Crónica ") == "ENFERMEDAD_CRONICA"


def test_mattr_and_words():
    seq = [random.Random(i).choice("abcdef") for i in range(40)]
    assert stats.mattr(seq, 10) == pytest.approx(np.mean([len(set(seq[i : i + 10])) / 10 for i in range(31)]))
    assert stats.mattr(list("aab"), 10) == pytest.approx(2 / 3) and math.isnan(stats.mattr([]))
    t = "Can't stop: 3.14 é́ done"
    found = stats.word_spans(t)
    assert all(t[w["start"] : w["end"]] == w["text"] for w in found) and found[0]["text"] == "Can't"
    whole = "  One. Two here!  Three\n\nFour"
    assert "".join(s["text"] for s in stats.sentence_spans(whole)) == whole.lstrip()


def crossing(point, entities):
    return any(s < point < e for s, e in entities)


def random_document(rng):
    words_ = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) + ("." if rng.random() < 0.2 else "") for _ in range(rng.randint(1, 40))]
    text = " ".join(words_)
    entities = sorted({(a, min(a + rng.randint(1, 14), len(text))) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 5)))})
    return text, entities


def test_encoding_equals_plain_loops():
    rng = random.Random(8)
    tokenize = encoding.piece_tokens(3, encoding.space_words)
    for _ in range(300):
        text, entities = random_document(rng)
        ids, starts, ends = tokenize(text)
        tokens = list(zip(starts.tolist(), ends.tolist(), strict=True))
        e = np.array([x for x, _ in entities], np.int64), np.array([y for _, y in entities], np.int64)
        assert [text[a] for a, _ in tokens] == [chr(i) for i in ids] and "".join(text[a:b] for a, b in tokens) == text.replace(" ", "")
        begins = np.array([0, *(i + 2 for i in range(len(text) - 2) if text[i] == "." and text[i + 1] == " ")], np.int64)
        joined = [b for i, b in enumerate(begins.tolist()) if not i or not crossing(b, entities)]
        assert encoding.joined_sentences(begins, *e).tolist() == joined
        bounds = encoding.sentence_bounds(encoding.joined_sentences(begins, *e), starts)
        per = [[t for t, (a, _) in enumerate(tokens) if s <= a < end] for s, end in zip(joined, [*joined[1:], len(text) + 1])]
        assert bounds.tolist() == sorted({p[0] for p in per if p} | {0, len(tokens)})
        free = encoding.free_places(starts, *e)
        assert free.tolist() == [t for t, (a, _) in enumerate(tokens) if not crossing(a, entities)] + [len(tokens)]
        longer, buffer = [0], 0
        for b in bounds.tolist()[1:]:
            if b - buffer >= 5:
                longer.append(b)
                buffer = b
        if longer[-1] != len(tokens):
            longer = [*(longer[:-1] if len(longer) > 1 else longer), len(tokens)]
        assert encoding.lengthened(bounds, 5).tolist() == longer
        owner = encoding.owners(starts, ends, *e)
        tags = encoding.iob(owner)
        last = None
        for (a, b), tag in zip(tokens, tags.tolist(), strict=True):
            mine = next((i for i, (_, y) in enumerate(entities) if y > a), None)
            mine = mine if mine is not None and entities[mine][0] < b else None
            assert tag == (0 if mine is None else 2 if mine == last else 1)
            last = mine
        for budget in (6, 11):
            try:
                windows = list(zip(*(w.tolist() for w in encoding.greedy_windows(bounds, free, budget)), strict=True))
                flanked = list(zip(*(w.tolist() for w in encoding.context_windows(bounds, free, budget, 3, 5)), strict=True))
            except ValueError:
                assert any(sum(x < b and a < y for a, b in tokens) > budget - 1 for x, y in entities) or entities
                continue
            assert [t for a, b, *_ in windows for t in range(a, b)] == list(range(len(tokens)))
            assert all(0 < b - a <= budget and a in free and b in free for a, b, *_ in windows)
            assert [t for *_, a, b in flanked for t in range(a, b)] == list(range(len(tokens)))
            assert all(a <= x < y <= b and b - a <= budget and (a == x or a in free) and (b == y or b in free) for a, b, x, y in flanked)


def test_windows_spare_entities():
    starts = np.array([0, 4, 8, 14, 19, 24], np.int64)
    e = np.array([8], np.int64), np.array([18], np.int64)
    free = encoding.free_places(starts, *e)
    assert encoding.greedy_windows(np.array([0, 6]), free, 3)[:2][0].tolist() == [0, 2, 5] and encoding.greedy_windows(np.array([0, 6]), free, 3)[1].tolist() == [2, 5, 6]
    with pytest.raises(ValueError, match="safe cut"):
        encoding.greedy_windows(np.array([0, 6]), encoding.free_places(starts, np.array([0]), np.array([30])), 3)
    assert encoding.context_windows(np.array([0, 300]), np.arange(301), 128, 10)[1].max() - 0 <= 300
    a, b, *_ = encoding.context_windows(np.array([0, 300]), np.arange(301), 128, 10)
    assert (b - a <= 128).all()


def test_encoder_settings():
    with pytest.raises(ValueError):
        encoding.Encoder(())
    with pytest.raises(ValueError):
        encoding.Encoder(("A",), (1,), (2,), 2)
    with pytest.raises(ValueError):
        encoding.window_strategy("context")
    with pytest.raises(ValueError):
        encoding.window_strategy("greedy", 4)
    encoder = encoding.Encoder(("A", "B"), (1,), (2,), 40, "context", 5)
    assert encoding.Encoder.from_description(encoder.describe()) == encoder and encoder.budget == 38
    assert encoding.special_template(lambda t, dressed: [0, 5, 9, 9] if dressed else [5]) == ((0,), (9, 9))
    assert encoding.label_ids(np.array([1, 2, 0, 1]), np.array([0, 0, 1, -1])).tolist() == [1, -100, 0, -100]
    s, e = np.array([0, 2, 9]), np.array([4, 12, 10])
    assert [x.tolist() for x in encoding.resolved(s, e, "keep_longest")] == [[2], [12]] and [x.tolist() for x in encoding.resolved(s, e, "keep_shortest")] == [[9], [10]]
    assert [x.tolist() for x in encoding.resolved(s, e, "merge_same_label_then_keep_longest")] == [[0], [12]]
    with pytest.raises(ValueError):
        encoding.resolved(s, e, "error")


def test_rows_of_another_tokenizer_raise(spark):
    encoder = encoding.Encoder(("A",), (1,), (2,), 10)
    df = spark.createDataFrame([(1, "a b c", [("A", 0, 1)]), (2, None, None), (3, "   ", [])], "doc_id long, text string, entities array<struct<label:string,start:int,end:int>>")
    rows = encoder.encode(df)
    assert [r.doc_id for r in rows.collect()] == [1] and encoding.gold_spans(rows, encoder).count() == 1
    with pytest.raises(Exception, match="another tokenizer"):
        encoding.gold_spans(rows, encoding.Encoder(("A",), (7,), (2,), 10)).collect()


def test_marginals_and_viterbi_by_enumeration():
    rng = np.random.default_rng(0)
    e, t, a, b = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    paths = list(itertools.product(range(3), repeat=4))
    score = np.array([a[p[0]] + b[p[-1]] + sum(e[i, k] for i, k in enumerate(p)) + sum(t[x, y] for x, y in zip(p, p[1:])) for p in paths])
    w = np.exp(score - score.max())
    want = np.array([[w[[p[i] == k for p in paths]].sum() for k in range(3)] for i in range(4)]) / w.sum()
    assert np.allclose(sequence.marginals(e, t, a, b), want) and sequence.viterbi(e, t, a, b) == list(paths[int(score.argmax())])


def test_decoding_of_sequences(spark):
    rows = [(s, i, np.random.default_rng(s * 10 + i).normal(size=2).tolist()) for s in range(3) for i in range(4)]
    z = np.zeros(2)
    got = sequence.decode(spark.createDataFrame(rows, "sequence_id int, position int, emission array<double>"), np.zeros((2, 2)), z, z)
    assert {(r.sequence_id, r.position): r.tag for r in got.collect()} == {(s, i): int(np.argmax(e)) for s, i, e in rows}


def _corpus(spark, n=30):
    docs = spark.createDataFrame([(f"d{i:02}", f"alpha beta {i}") for i in range(n)], "filename string, text string")
    ann = spark.createDataFrame([(f"d{i:02}", "A" if i % 3 else "B", 0, 5, "alpha") for i in range(n)], "filename string, label string, start_span int, end_span int, text string")
    return docs, ann


def test_split(spark):
    built = corpus.build_corpus(*_corpus(spark))
    m = split.assign_partitions(built, [0.6, 0.2, 0.2], n_restarts=4)
    assert {r["partition_name"]: r["count"] for r in m.groupBy("partition_name").count().collect()} == {"train": 18, "validation": 6, "test": 6}
    b = built.join(m, "doc_id").filter("entities_json LIKE '%\"B\"%'").groupBy("partition_name").count().collect()
    assert {r["partition_name"]: r["count"] for r in b} == {"train": 6, "validation": 2, "test": 2}
    assert split.check_assignments(built, m).count() == 0
    changed = built.withColumn("text", F.when(F.col("doc_id") == "d01", "x").otherwise(F.col("text"))).filter("doc_id <> 'd02'")
    assert {tuple(r) for r in split.check_assignments(changed, m).collect()} == {("d01", "changed"), ("d02", "unknown")}
    assert sorted(map(tuple, split.assign_partitions(built, [0.6, 0.2, 0.2], n_restarts=4).collect())) == sorted(map(tuple, m.collect()))


def test_reconciliation(spark):
    docs, ann = _corpus(spark, 4)
    with pytest.raises(ValueError):
        corpus.resolve_mismatch(docs.filter("filename <> 'd00'"), ann)
    wrong = ann.withColumn("text", F.when(F.col("filename") == "d01", "ALPHA").otherwise(F.col("text")))
    with pytest.raises(ValueError):
        corpus.resolve_conflicts(docs, wrong)
    assert corpus.resolve_conflicts(docs, wrong, "rewrite")[1].filter("text = 'alpha'").count() == 4
    assert corpus.resolve_conflicts(docs, wrong, "drop")[0].count() == 3
    assert corpus.violations(corpus.build_corpus(docs, wrong, validate=False)).collect()[0].problem == "entity text differs"
    codes = spark.createDataFrame([("1e5",), ("A1+NO_CODE",), ("A+B1",), ("NO_CODE",), ("C50.1",)], "code string")
    assert [r.ok for r in codes.select(corpus.is_usable_code(F.col("code")).alias("ok")).collect()] == [False, True, False, True, True]


def test_stand_off_files_and_tasks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("fever and high\r\npain", newline="")
    (tmp_path / "in/a.ann").write_text("T1\tSYM 0 5\tfever\nN1\tReference T1 R50\tfever\nT2\tSYM 10 14;15 19\thigh pain\n")
    (tmp_path / "in/b.txt").write_text("no pain")
    (tmp_path / "in/b.ann").write_text("T1\tSYM 3 7\tpain\n")
    got = sorted(map(tuple, tables.read_ann(spark, str(tmp_path / "in")).select("filename", "start_span", "end_span", "text").collect()))
    assert got == [("a", 0, 5, "fever"), ("a", 10, 14, "high"), ("a", 15, 19, "pain"), ("b", 3, 7, "pain")]
    made = tasks.prepare_dataset(spark, str(tmp_path / "out"), str(tmp_path / "in"), str(tmp_path / "in"), ratios=[0.5, 0.5], n_restarts=2)
    assert made["documents"] == 2 and made["labels"] == {"SYM": 4} and sum(made["partitions"].values()) == 2
    built = tables.read_corpus(spark, str(tmp_path / "out/corpus.parquet"))
    table = spans.spans_from_corpus(built)
    sinks.write_table(table.withColumn("score", F.lit("0.5")), str(tmp_path / "pred.tsv"))
    sinks.write_table(table.drop("code"), str(tmp_path / "gold.tsv"))
    sinks.write_table(spark.createDataFrame([("fever", "R50", "x"), ("pain", "R52", "y"), ("", "Z", "z")], "term string, code string, note string"), str(tmp_path / "gaz.tsv"))
    with pytest.raises(Exception):
        sinks.write_table(table, str(tmp_path / "gold.tsv"))
    report = tasks.analyze_predictions(spark, str(tmp_path / "ana"), str(tmp_path / "pred.tsv"), str(tmp_path / "gold.tsv"))
    assert report["error_taxonomy"] == 5
    linked = tasks.link_entities(spark, str(tmp_path / "link"), str(tmp_path / "pred.tsv"), str(tmp_path / "gaz.tsv"), method=["exact", "levenshtein"])
    assert linked["n"] == 1 and linked["recall_at_1"] == 1.0
    assert tables.read_manifest(spark, str(tmp_path / "link/metrics")) == linked
    assert tasks.main(["tasks"]) == 0 and tasks.main([]) == 2


def test_dictionary_mentions(spark):
    t = spark.createDataFrame([("a", "Pain in the PAINT"), ("b", None)], "filename string, text string")
    got = sorted((r.term, r.start_span, r.text) for r in tables.dictionary_mentions(t, ["pain", "paint", "in"]).collect())
    assert got == [("in", 2, "in"), ("in", 5, "in"), ("in", 14, "IN"), ("pain", 0, "Pain"), ("pain", 12, "PAIN"), ("paint", 12, "PAINT")]


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = ingest.document_stream(spark, str(tmp_path / "in"))
    out = ingest.drain(stream.select("doc_id", F.size(stats.words(F.col("text"))).alias("n")), "streamed", str(tmp_path / "cp"))
    assert sorted(map(tuple, out.collect())) == [(1, 2), (2, 0)]


@pytest.mark.parametrize(("method", "threshold"), [("jaro_winkler", 0.9), ("jaro_winkler", 0.8), ("token_set", 0.9), ("token_set", 0.8)])
def test_fuzzy_linking_scores_every_pair_that_reaches_the_threshold(spark, method, threshold):
    rng = random.Random(4)
    terms = ["from", "axc", "vitamin k", "axb", "acbed", "badcfehg", *("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9))) for _ in range(60))]
    texts = ["form", "abc", "k", "ab", "abcde", "abcdefgh", *("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 9))) for _ in range(60))]
    norm = lambda t: " ".join(t.split(" ")).strip() and " ".join(t.split())
    plain = text.jaro_winkler if method == "jaro_winkler" else text.token_set_ratio
    want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(terms) if norm(x) and norm(y) and plain(norm(x), norm(y)) >= threshold}
    mentions = spark.createDataFrame(list(enumerate(texts)), "mention_id int, text string")
    gazetteer = spark.createDataFrame([(j, y, str(j)) for j, y in enumerate(terms)], "entry_id int, term string, code string")
    got = {(r.mention_id, int(r.code)) for r in linking.fuzzy(mentions, gazetteer, method, threshold, 200).collect()}
    blank = {i for i, x in enumerate(texts) if not norm(x)}
    assert {g for g in got if g[0] not in blank} == want


def test_bootstrap_draws_and_intervals(spark):
    rng = np.random.default_rng(1)
    columns = sorted({c for num, den, _ in analysis.INTERVAL_METRICS.values() for c in (num, *den)})
    data = [(f"d{i}", *map(int, rng.integers(0, 9, len(columns)))) for i in range(12)]
    docs = spark.createDataFrame(data, "filename string, " + ", ".join(f"{c} long" for c in columns))
    draws = analysis.bootstrap_draws(docs).toPandas()
    assert draws.groupby("sample").weight.sum().tolist() == [12] * 2000
    again = analysis.bootstrap_draws(docs).toPandas()
    assert sorted(map(tuple, again.to_numpy())) == sorted(map(tuple, draws.to_numpy()))
    weights = draws.pivot(index="sample", columns="filename", values="weight").fillna(0)[[d[0] for d in data]]
    assert len(weights.drop_duplicates()) > 1900
    sums = lambda w: dict(zip(columns, (w @ np.array([d[1:] for d in data])).T, strict=True))

    def metrics(c):
        out = {m: k * c[num] / (sum(c[x] for x in den) + (k - 1) * c[num]) for m, (num, den, k) in analysis.INTERVAL_METRICS.items()}
        p, r = out["entity_char_precision"], out["entity_char_recall"]
        return out | {"entity_char_f1": 2 * p * r / (p + r)}

    one, many = metrics(sums(np.ones((1, 12)))), metrics(sums(weights.to_numpy()))
    got = {r.metric: (r.estimate, r.low, r.high) for r in analysis.bootstrap_intervals(docs, spark.createDataFrame(draws)).collect()}
    assert set(got) == set(one) and len(got) == 9
    for m, found in got.items():
        assert found == pytest.approx((one[m][0], *np.quantile(many[m], [0.025, 0.975])))



def test_naming():
    from marginalia import naming

    assert naming.dataset_name("/data/cardio/txt") == "cardio" and naming.dataset_name(parquet="/a/b.c.parquet") == "b.c" and naming.dataset_name("/x", metadata={"dataset_name": "n"}) == "n"
    assert naming.split_name() == "train_val_80_20" and naming.split_name(folds=5, holdout=1) == "kfold_5_holdout_1"
    assert naming.partition_names(3, 0) == ["test", "fold_01", "fold_02"] and naming.partition_names(2) == ["train", "validation"]
    assert naming.fold_rotations({"mode": "fixed_holdout_kfold", "n_splits": 4, "holdout_fold": 1}) == [0, 2, 3] and naming.fold_rotations({"mode": "train_validation"}) == [None]
    with pytest.raises(ValueError):
        naming.fold_rotations({"mode": "fixed_holdout_kfold", "n_splits": 4, "holdout_fold": 1}, [1])
    space = naming.search_space({"lr": {"type": "loguniform", "low": 1e-5, "high": 1e-3}, "bs": {"type": "choice", "categories": [8, 16]}, "x": 3}, {"x": None, "wd": 0.1})
    assert naming.smoke_configuration(space) == {"lr": 1e-5, "bs": 8, "wd": 0.1} and naming.split_dimensions(space) == (["lr"], ["bs"])
    assert naming.range_position(1e-4, space["lr"]) == pytest.approx(0.5) and naming.edge_note(9.9e-4, space["lr"]).startswith("(top 1%") and not naming.edge_note(1e-4, space["lr"])
    assert naming.batch_sizes(48, 20) == (16, 3) and naming.batch_sizes(7, 3) == (1, 7)
    found = naming.variants(["a/m", "b/n"], ("greedy", "context"), [4, 8], (128,))
    assert len(found) == 6 and found["m|context|8|128"]["context_tokens"] == 8
    with pytest.raises(ValueError):
        naming.variants(["a/m", "b/m"])


def test_trial_report(spark):
    rows = [("t1", 0.9, 0.01, 3, None, 2e-5), ("t2", 0.895, 0.02, 3, None, 5e-5), ("t3", 0.5, 0.01, 3, None, 6e-5), ("t4", float("nan"), None, 1, "lost", 6e-5)]
    df = spark.createDataFrame(rows, "trial_id string, f1 double, f1_std double, n_seeds int, error string, lr double")
    text_ = trials.summarize(df, "f1", True, {"lr": {"type": "uniform", "low": 2e-5, "high": 6e-5}})
    assert "3 completed, 1 errored" in text_ and "best 0.9000 (t1), gap 0.0050" in text_ and "1 more within the noise of 0.0100" in text_ and "(bottom 1% of" in text_
    assert "no trial completed" in trials.summarize(df.filter("error IS NOT NULL"), "f1", True, {})


def test_graph_follows_chains_of_any_depth_and_cycles(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(50)] + [("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    up = ontology.ancestors(edges, spark.createDataFrame([("n50",), ("a",)], "code string"))
    got = {(r.code, r.ancestor): r.distance for r in up.collect()}
    assert got[("n50", "n0")] == 50 and got[("a", "c")] == 1 and got[("a", "b")] == 2 and got[("a", "a")] == 0


def test_vector_indexes(spark):
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=16).tolist()) for i in range(400)] + [(1000, None), (1001, [float("nan")] * 16)]
    v = spark.createDataFrame(data, "id long, vector array<double>")
    q = v.filter("id < 40")
    flat = {(r.query_id, r.id) for r in retrieval.index_search(q, v, 10).collect()}
    for kind, least in (("sq8", 0.95), ("sq4", 0.6), ("ivf_flat_ip", 0.6), ("ivfpq", 0.5)):
        found = {(r.query_id, r.id) for r in retrieval.index_search(q, v, 10, kind, 8, 5).collect()}
        assert len(found & flat) / len(flat) >= least, kind
    with pytest.raises(ValueError):
        retrieval.index_kind("hnsw")
    with pytest.raises(Exception, match="compare"):
        retrieval.vector_search(spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<double>"), v, 3).collect()


def test_embedding_store_refuses_what_differs(spark, tmp_path):
    vocabulary = spark.createDataFrame([("0", "a", "A"), ("1", "b", "B")], "row_id string, term string, code string")
    vectors = spark.createDataFrame([("0", [1.0, 2.0]), ("1", [3.0, 4.0])], "row_id string, vector array<double>")
    path = str(tmp_path / "index")
    assert retrieval.read_embeddings(spark, path, vocabulary, {"m": 1}) is None
    retrieval.write_embeddings(spark, path, vectors, vocabulary, {"m": 1})
    assert retrieval.read_embeddings(spark, path, vocabulary, {"m": 1}).count() == 2
    for v, settings in ((vocabulary, {"m": 2}), (vocabulary.withColumn("term", F.lit("x")), {"m": 1})):
        with pytest.raises(ValueError, match="otherwise"):
            retrieval.read_embeddings(spark, path, v, settings)
    with pytest.raises(ValueError, match="terms"):
        retrieval.write_embeddings(spark, path, vectors.limit(1), vocabulary, {})
    (tmp_path / "half/embeddings.parquet").mkdir(parents=True)
    with pytest.raises(ValueError, match="manifest"):
        retrieval.read_embeddings(spark, str(tmp_path / "half"), vocabulary, {})


def test_labelled_sources(spark, tmp_path):
    df = spark.createDataFrame([("d", "A", 0, 3, "abc"), ("d", "B", 4, 5, "x")], "filename string, label string, start_span int, end_span int, text string")
    assert tables.read_labelled(spark, df, "A", "gold").count() == 1
    with pytest.raises(ValueError):
        tables.read_labelled(spark, df, "C", "gold")
    with pytest.raises(ValueError):
        tables.read_predicted(spark, df, "A")
    sinks.write_table(df.withColumn("end_span", F.lit(0)).withColumn("score", F.lit("0.1")), str(tmp_path / "p.tsv"))
    with pytest.raises(Exception, match="reversed"):
        tables.read_predictions(spark, str(tmp_path / "p.tsv")).collect()
    with pytest.raises(Exception, match="without a code"):
        sinks.write_table(df.select("text", F.lit(" ").alias("code")), str(tmp_path / "m.tsv"))
        tables.read_mentions(spark, str(tmp_path / "m.tsv")).collect()
    assert tables.split_metadata({"splits": [{"file": "a"}, 3]}, "a") == {"file": "a"} and tables.split_metadata(None, "a") is None


def test_token_set_links_equal_brute_force_on_the_tables(spark):
    from marginalia.plans import link_queries, more_queries

    sf = "/root/testdata/sf0.001"
    norm = lambda t: " ".join(t.lower().split())
    terms = {}
    for r in link_queries.gazetteer(spark, sf).collect():
        terms[r.code] = (r.entry_id, norm(r.term))
    want = set()
    for m in link_queries.mentions(spark, sf).collect():
        scored = sorted((-round(text.token_set_ratio(norm(m.text), t), 9), e, c) for c, (e, t) in terms.items() if text.token_set_ratio(norm(m.text), t) >= 0.9)
        want |= {(m.mention_id, c, round(-s, 6), k + 1) for k, (s, _, c) in enumerate(scored[:25])}
    assert {(r.mention_id, r.code, r.score, r["rank"]) for r in more_queries.link_token_set(spark, sf).collect()} == want


def test_text_statistics_equal_plain_counts(spark):
    from marginalia.plans import analysis_queries

    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = analysis_queries.text_statistics(spark, sf).first()
    words_ = [[w["text"].lower() for w in stats.word_spans(t) if any(c.isalnum() for c in w["text"])] for t in texts]
    plain = [np.mean([len(set(w[i : i + 100])) / 100 for i in range(len(w) - 99)]) if len(w) > 100 else len(set(w)) / len(w) if w else None for w in words_]
    assert got.n_documents == len(texts) and got.n_chars == sum(len(t or "") for t in texts) and got.n_words == sum(map(len, words_))
    assert got.words_mean == pytest.approx(np.mean([len(w) for w in words_])) and got.words_q50 == np.quantile([len(w) for w in words_], 0.5)
    assert got.mattr == pytest.approx(sum(m * len(w) for m, w in zip(plain, words_) if m is not None) / sum(len(w) for w in words_ if w))


def test_words_of_the_standard():
    t = "δυσπνοια-ορθοπνοια, (ΑΥ) 12.5 mg can't Ιστορικό:ΧΚΜ\n\nΣΝ: 3:4"
    assert [w["text"] for w in stats.word_spans(t)] == ["δυσπνοια", "-", "ορθοπνοια", ",", "(", "ΑΥ", ")", "12.5", "mg", "can't", "Ιστορικό:ΧΚΜ", "ΣΝ", ":", "3", ":", "4"]
    assert stats.content_words("Can't stop: 12.5 mg, ΑΥ!") == ["can't", "stop", "12.5", "mg", "αυ"] and stats.word_spans("") == []


def test_sentences_by_language(spark):
    def cut(code, t):
        at = stats.sentence_segmenter(code)[0](t)
        return [t[a:b] for a, b in zip(at, [*at, len(t)][1:], strict=True)]

    assert cut("en", "Dr. Smith came. He left. J. Doe, e.g. him, stayed.") == ["Dr. Smith came. ", "He left. ", "J. Doe, e.g. him, stayed."]
    assert cut("de", "Es ist z.B. so. Dr. Maier ging.") == ["Es ist z.B. so. ", "Dr. Maier ging."] and cut("ja", "Dr. A. B") == ["Dr. ", "A. B"]
    assert stats.sentence_segmenter("el")[1]["language"] == "el" and cut("en", "") == []
    for bad in ("english", "", None):
        with pytest.raises(ValueError):
            stats.sentence_segmenter(bad)
    df = spark.createDataFrame([(1, "Dr. A came. B.", "en"), (2, "Dr. A came. B.", None), (3, None, "en")], "doc_id int, text string, lang string")
    assert {r.doc_id: len(r.sentences) for r in stats.language_sentences(df).collect()} == {1: 2, 2: 3, 3: 0}


def test_quantiles_need_no_single_task(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=5000), np.repeat([1.0, 2.0, 7.0], [3, 4000, 5]), np.array([4.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
        points = [0.0, 0.01, 0.5, 0.777, 1.0]
        assert stats.quantile_edges(df, "x", points, 1000) == pytest.approx(np.quantile(values, points).tolist())
    assert stats.quantile_edges(df.limit(0), "x", [0.5]) == []


def test_ensembles(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).mkdir()
        (tmp_path / name / "model.safetensors").write_bytes(name.encode())
    dirs = [str(tmp_path / n) for n in "ab"]
    members = [ensemble.describe_member(spark, d, {"labels": ["X"]}) for d in dirs]
    assert ensemble.shared_label(members) == "X" and members[0]["weights_sha256"] != members[1]["weights_sha256"]
    rows = [(1, w, "B" if w % 3 == 0 else "O", 0.1 if w % 3 == 0 else 0.8, 0.8 if w % 3 == 0 else 0.1, 0.1) for w in range(12)]
    bad = [(1, w, "O", 0.9, 0.05, 0.05) for w in range(12)]
    schema = "doc_id int, word_id int, tag string, p_O double, p_B double, p_I double"
    votes = ensemble.align_votes({dirs[0]: spark.createDataFrame(rows, schema), dirs[1]: spark.createDataFrame(bad, schema)})
    gold = spark.createDataFrame([(1, w, w) for w in range(0, 12, 3)], "doc_id int, first_word int, last_word int")
    plain = ensemble.fit_ensemble(votes, gold, members)
    tuned = ensemble.fit_ensemble(votes, gold, members, "soft", True, True, 25)
    assert plain["threshold"] == 0.5 and plain["weights"] == {d: 0.5 for d in dirs} and tuned["fitted"]["f1"] == 1.0
    assert tuned == ensemble.fit_ensemble(votes, gold, members, "soft", True, True, 25)
    assert {(r.first_word, r.last_word, r.label) for r in ensemble.predict_ensemble(tuned, votes).collect()} == {(w, w, "X") for w in range(0, 12, 3)}
    ensemble.write_ensemble(spark, tuned, str(tmp_path / "e"))
    assert ensemble.read_ensemble(spark, str(tmp_path / "e")) == tuned
    (tmp_path / "a/model.safetensors").write_bytes(b"changed")
    with pytest.raises(ValueError, match="changed"):
        ensemble.read_ensemble(spark, str(tmp_path / "e"))
    with pytest.raises(FileNotFoundError):
        ensemble.member_digest(spark, str(tmp_path / "e"))
    with pytest.raises(ValueError):
        ensemble.shared_label([{"encoding": {"labels": ["X"]}}, {"encoding": {"labels": ["Y"]}}])


def test_run_folders_and_configurations(spark, tmp_path):
    from marginalia import naming

    path = sinks.claim_folder(spark, str(tmp_path / "run"))
    sinks.write_configuration(spark, {"lr": 1e-5, "names": ["a: b", 2], "deep": {"x": None, "y": [{"z": True}], "e": []}}, f"{path}/winner")
    with pytest.raises(ValueError):
        sinks.claim_folder(spark, path)
    lines = spark.read.text(f"{path}/winner", wholetext=True).first()["value"].splitlines()
    assert lines == ['"lr": 1e-05', '"names":', '  - "a: b"', "  - 2", '"deep":', '  "x": null', '  "y":', "    -", '      "z": true', '  "e": []']
    assert sinks.claim_folder(spark, path, overwrite=True) and not list((tmp_path / "run").iterdir()) and naming.yaml_text(3) == "3\n"


def test_splits_are_used_again(spark, tmp_path):
    built = corpus.build_corpus(*_corpus(spark, 12))
    made = tasks.create_split(spark, built, str(tmp_path / "s"), [0.5, 0.5], n_restarts=2)
    before = sorted(map(tuple, spark.read.parquet(str(tmp_path / "s/manifest")).collect()))
    assert made == tasks.create_split(spark, built, str(tmp_path / "s"), [1, 1], random_state=7) and sorted(map(tuple, spark.read.parquet(str(tmp_path / "s/manifest")).collect())) == before
    with pytest.raises(ValueError, match="settings"):
        tasks.create_split(spark, built, str(tmp_path / "s"), [0.7, 0.3])
    with pytest.raises(ValueError, match="fit"):
        tasks.create_split(spark, built.filter("doc_id <> 'd01'"), str(tmp_path / "s"), [0.5, 0.5])
    with pytest.raises(ValueError, match="as many documents"):
        split.stratify(built.limit(1), [0.5, 0.5])


def test_dense_vectors_that_take_no_part(spark):
    from marginalia.operators import dense

    rng = np.random.default_rng(4)
    x = {i: rng.normal(size=4) for i in range(60)} | {60: np.zeros(4)}
    data = [(i, v.tolist()) for i, v in x.items()] + [(61, None), (80, [float("nan")] * 4), (None, [1.0] * 4), (100, [None] * 4)]
    got = [tuple(r)[:3] for r in dense.cosine_top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), 5).orderBy("query_id", "rank").collect()]
    unit = {i: v / max(np.linalg.norm(v), 1e-300) for i, v in x.items()}
    want = [(q, r + 1, i) for q in (0, 20, 40, 60) for r, (_, i) in enumerate(sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in x if i != q)[:5])]
    assert got == want
    with pytest.raises(Exception, match="compare"):
        dense.cosine_top_k(spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0])], "vec_id long, embedding array<double>"), 2).collect()
