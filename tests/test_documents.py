"""Whole documents in one pass against the operators that work on events and units."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.operators import analysis, documents
from marginalia.plans import analysis_queries

from .test_operators import frames, random_sides

SF = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def close(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    g, p = frames(spark, random_sides(11, 300))
    docs = g.select("filename").union(p.select("filename")).distinct().filter("filename <> 'd007'").withColumn("document", F.lit("Ab/c 1-d é(f) 𝔊h ij4"))
    return g, p, docs


def test_document_scores_equal_those_of_events(sides):
    g, p, _ = sides
    want = analysis.document_scores(analysis.strict_events(g, p), g, p)
    got = documents.document_scores(g, p).select(want.columns)
    assert close(got.collect()) == close(want.collect())


@pytest.mark.parametrize("side", ["gold", "pred"])
def test_described_mentions_equal_those_of_units(sides, side):
    from marginalia.operators.spans import with_text

    g, p, docs = sides
    a, b = with_text(g, docs), with_text(p, docs)
    events = analysis.strict_events(a, b)
    want = analysis.describe_mentions(a if side == "gold" else b, analysis.attach_units(events, analysis.pair_errors(events)), side, b if side == "gold" else a).drop("position")
    got = documents.described_mentions(g, p, docs, side).select(want.columns)
    assert close(got.collect()) == close(want.collect())
    assert want.select("outcome").distinct().count() >= 4


def test_documents_are_never_cut_between_batches():
    schema = pa.schema([("filename", pa.string()), ("n", pa.int64())])
    names = ["a", "a", "b", "b", "b", "b", "b", "c", "d", "d"]
    for size in (1, 2, 3, 4, 10):
        batches = pa.table({"filename": names, "n": list(range(10))}, schema).to_batches(max_chunksize=size)
        found = [t.to_pydict() for t in documents.whole_documents(iter([*batches, pa.RecordBatch.from_pylist([], schema)]))]
        assert [n for t in found for n in t["n"]] == list(range(10))
        assert sum(len(set(t["filename"])) for t in found) == 4


@pytest.mark.parametrize("name, most", [("document_scores", 1), ("bootstrap_metrics", 4), ("described_mentions", 2), ("gold_subgroups", 2), ("predicted_subgroups", 6)])
def test_queries_deal_the_spans_once(spark, name, most):
    assert shuffles(getattr(analysis_queries, name)(spark, SF)) <= most


def test_one_sided_and_empty_documents(spark):
    g, p = frames(spark, [([("A", 0, 4)], []), ([], [("A", 1, 3)]), ([("A", 0, 4), ("A", 0, 4)], [("A", 0, 4), ("B", 0, 4)])])
    for a, b in ((g, p), (g, p.limit(0)), (g.limit(0), p), (g.limit(0), p.limit(0))):
        want = analysis.document_scores(analysis.strict_events(a, b), a, b)
        assert close(documents.document_scores(a, b).select(want.columns).collect()) == close(want.collect())


def test_pieces_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["abc", None, "", "x" * 50, "de", "f"])], ["key", "text"])
    for size in (1, 4, 60, 1000):
        found = list(documents.pieces(batch, size))
        assert pa.Table.from_batches(found).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
        assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= size for b in found)
    assert not list(documents.pieces(batch.slice(0, 0)))


@pytest.mark.parametrize("side", ["gold", "pred"])
def test_mentions_of_rows_equal_those_of_dealt_spans(spark, side):
    from marginalia.plans.derive import gold, predicted
    from marginalia.session import table

    docs = table(spark, SF, "documents").select(F.col("doc_id").cast("string").alias("filename"), F.col("text").alias("document"))
    want = documents.described_mentions(gold(spark, SF), predicted(spark, SF), docs, side)
    got = analysis_queries._described(spark, SF, side).select(want.columns)
    assert shuffles(got) == 0
    assert close(got.collect()) == close(want.collect())


def test_gold_subgroups_sum_equal_mentions_before_their_families(spark):
    assert shuffles(analysis_queries.gold_subgroups(spark, SF)) <= 2
    plan = analysis_queries.gold_subgroups(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.rindex("HashAggregate") and plan.count("MapInArrow") == 1


def test_predicted_subgroups_score_the_mentions_once(spark):
    plan = analysis_queries.predicted_subgroups(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_subgroups_of_documents_without_draws(spark):
    m = spark.createDataFrame([("a", "X", "CORRECT", 4, 4, 1.0), ("b", "X", "SPURIOUS", 1, 3, 0.5), ("b", None, "SPURIOUS", 0, 2, 0.0)], "filename string, label string, outcome string, covered_characters long, characters long, entity_char_credit double")
    draws = spark.createDataFrame([(0, "a", 2), (1, "a", 0), (1, "c", 3)], "sample int, filename string, weight int")
    got = {r.value: r.asDict() for r in analysis.subgroups(m, ["label"], "precision", draws).collect()}
    assert (got["X"]["support"], got["X"]["correct"], got["X"]["spurious"], got["X"]["strict_precision"], got["X"]["char_precision"]) == (2, 1, 1, 0.5, 5 / 7)
    assert (got["X"]["strict_precision_low"], got["X"]["strict_precision_high"]) == (1.0, 1.0)
    assert got[None]["support"] == 1 and got[None]["strict_precision_low"] is None


def test_predicted_subgroups_shuffle_neither_mentions_nor_draws(spark):
    plan = analysis_queries.predicted_subgroups(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "collect_list" not in plan
    dealt = plan.index("Exchange hashpartitioning(key")  # a file of one row group isn't one task
    assert plan.index("MapInArrow") < dealt and plan.count("Exchange hashpartitioning") == 3


@pytest.mark.parametrize("side, measure", [("gold", "recall"), ("pred", "precision")])
def test_subgroup_sums_equal_subgroups_of_mentions_and_draws(spark, side, measure):
    from marginalia.plans.derive import LABELS, spans_of

    rows = [(0, "1 a the ٣x the y\u0663 grüße12 wörterbücher of 𝟗𝟗𝟗𝟗𝟗𝟗𝟗𝟗 the"), (1, None), (2, ""), (3, "the of"), (-8, " ".join(["the", "a1", "straßenbahn7"] * 40)), (9, "x"), (10, " ".join(["é", "of", "dé4", "longwords"] * 30))]
    docs = spark.createDataFrame(rows, "key long, text string").withColumn("filename", F.col("key").cast("string"))
    draws = docs.select("filename", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("sample"), "key").withColumn("weight", (F.col("key") * 7 + F.col("sample") * 13) % 4)
    want = analysis.subgroups(documents.described_in_rows(docs, spans_of, LABELS, side), ["label", "has_digit"], measure, draws.drop("key"))
    sums = documents.subgroup_sums(docs, spans_of, LABELS, side, {"has_digit": documents.digits_within}, analysis_queries._weights, list(range(40)))
    got = analysis.subgroup_measures(sums, measure)
    assert got.columns == want.columns and close(got.collect()) == close(want.collect())
    assert want.filter("value = 'present'").count() == 1
    none = documents.subgroup_sums(docs.limit(0), spans_of, LABELS, side, {}, analysis_queries._weights, list(range(40)))
    assert analysis.subgroup_measures(none, measure).count() == 0


def test_digits_within_are_those_of_the_oracle(spark):
    import duckdb
    import numpy as np

    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    want = {r[0] for r in duckdb.sql(r"SELECT c FROM range(1, 1114112) t(c) WHERE c NOT BETWEEN 55296 AND 57343 AND regexp_matches(chr(c::INT), '\p{Nd}')").fetchall()}
    texts = pa.array(["skipped 1", "", None, *("é" + chr(c) + "z" for c in points)]).slice(1)
    n = len(points)
    row = np.arange(n) + 2
    within = lambda s, e: documents.digits_within(texts, row, np.full(n, s), np.full(n, e))
    assert {points[i] for i in np.flatnonzero(within(1, 2)).tolist()} == want and len(want) > 600
    assert not within(0, 1).any() and not within(2, 9).any()
    assert not len(documents.digits_within(texts.slice(0, 0), row[:0], row[:0], row[:0]))
    # those of mention_features, but for digits that Java's Unicode doesn't have
    known = spark.createDataFrame(pa.table({"c": points, "text": [chr(c) for c in points]}))
    digits = {r.c for r in known.filter(analysis.mention_features(F.col("text"))["has_digit"]).collect()}
    assert digits <= want and all(c > 0xFFFF for c in want - digits)
