"""Votes that are packed and combined by document against the plain operators."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import ensemble
from marginalia.plans import link_queries

SF = "/root/testdata/sf0.001"


def members(spark, seed=5):
    rng = random.Random(seed)
    out = {}
    for m in "abc":
        rows = [(d, w, rng.choice("OBI"), *(lambda b, i: (1 - b - i, b, i))(rng.random() / 2, rng.random() / 2)) for d in range(30) for w in range(40) if rng.random() < 0.7]
        rng.shuffle(rows)
        out[m] = spark.createDataFrame([*rows, *rows[:9]], "doc_id long, word_id int, tag string, p_O double, p_B double, p_I double").repartition(3)
    return out


@pytest.mark.parametrize("hard", [True, False])
def test_combined_tables_equal_aligned_votes(spark, hard, monkeypatch):
    monkeypatch.setattr(ensemble, "UNPACKED", 50)
    tables, weights = members(spark), {"a": 2.0, "b": 1.0, "d": 4.0}
    want = ensemble.combine_votes(ensemble.align_votes(tables), weights, hard)
    got = ensemble.combine_tables(tables, weights, hard).select(want.columns)
    rows = lambda df: sorted((r.doc_id, r.word_id, *(round(x, 9) for x in r[2:])) for r in df.collect())
    assert rows(got) == rows(want) and got.schema["word_id"].dataType == want.schema["word_id"].dataType


@pytest.mark.parametrize("hard", [True, False])
def test_search_equals_decoding_each_trial(spark, hard):
    votes = ensemble.align_votes(members(spark)).filter("doc_id <> 4 OR word_id <> 0")
    trials = [{"threshold": 0.4, "a": 1.0, "b": 1.0, "c": 1.0}, {"threshold": 0.55, "a": 0.0, "b": 1.0, "c": 3.0}, {"threshold": 0.05, "a": 1.0, "b": 0.0, "c": 0.0}]
    gold = ensemble.decode(ensemble.combine_votes(votes, {"a": 1.0, "b": 1.0, "c": 1.0}, hard), 0.4).filter("doc_id % 2 = 0").select("doc_id", "first_word", "last_word")
    found = {r.trial: r for r in ensemble.search(votes, gold, trials, hard).collect()}
    for i, t in enumerate(trials):
        spans = ensemble.decode(ensemble.combine_votes(votes, {m: t[m] for m in "abc"}, hard), t["threshold"])
        want = (spans.join(gold, ["doc_id", "first_word", "last_word"]).count(), spans.count(), gold.distinct().count())
        assert (found[i].tp, found[i].n_pred, found[i].n_gold) == want


@pytest.mark.parametrize("name", ["ensemble_search", "aligned_votes"])
def test_votes_are_packed_before_they_are_dealt(spark, name):
    """Each exchange of votes has packed rows, not one for each vote, and votes are dealt once."""
    text = getattr(link_queries, name)(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(doc_id") == 1 and "Window" not in text
    assert "packed" in text


def test_empty_votes_have_no_spans(spark):
    tables = {m: df.limit(0) for m, df in members(spark).items()}
    assert ensemble.combine_tables(tables, {"a": 1.0}, False).count() == 0
    gold = spark.createDataFrame([(1, 2, 3)], "doc_id long, first_word int, last_word int")
    row = ensemble.search(ensemble.align_votes(tables), gold, [{"threshold": 0.5, "a": 1.0}]).first()
    assert (row.tp, row.n_pred, row.n_gold, row.f1) == (0, 0, 1, 0.0)
