"""Model rows decoded and counted within the row."""

import numpy as np
import pyarrow as pa
import pytest

from marginalia.operators import encoding, evaluation
from marginalia.plans import encoding_queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_heads_are_decoded_without_a_shuffle_of_tokens(spark):
    text = plan(encoding_queries.head_gold_spans(spark, SF))
    assert "Window" not in text and text.count("Exchange hashpartitioning") <= 3
    # gold lists and one run of the encoder for both heads
    assert text.count("MapInArrow") <= 2 + text.count("ReusedExchange")


def test_row_report_counts_pairs_before_rows_meet(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(evaluation, "written", lambda df: seen.append(plan(df)) or df)
    encoding_queries.row_report(spark, SF)
    assert len(seen) == 1 and "Window" not in seen[0] and "place" in seen[0]


def test_ends_grow_within_a_row_whatever_the_order_of_words():
    offsets = pa.array([[{"start": 0, "end": 2}, {"start": 2, "end": 3}, {"start": 9, "end": 11}, {"start": 3, "end": 7}], [], [{"start": 0, "end": 1}]])
    words = pa.array([[0, None, 1, 0], [], [0]], pa.list_(pa.int32()))
    row, start, end = encoding._grown(offsets, words)
    assert (row.tolist(), start.tolist(), end.tolist()) == ([0, 0, 0, 0, 2], [0, 2, 9, 3, 0], [7, 3, 11, 7, 1])


def test_runs_open_at_b_and_at_an_inside_tag_after_outside():
    tag, row = np.array([2, 2, 1, 2, 0, 2, 1, 2, 7]), np.array([0, 0, 0, 0, 0, 0, 0, 2, 2])
    start = np.arange(9) * 10
    found = encoding._runs(row, tag, start, start + 5, np.arange(9.0), 4).to_pylist()
    assert [[(s["start_span"], s["end_span"], s["score"]) for s in r] for r in found] == [[(0, 15, 0.5), (20, 35, 2.5), (50, 55, 5.0), (60, 65, 6.0)], [], [(70, 75, 7.0)], []]


def test_counted_pairs_equal_the_pairs(spark):
    encoder = encoding_queries._encoder()
    rows = encoding_queries._logits(encoder.encode(encoding_queries._corpus(spark, SF, "PHRASE").limit(20)))
    want = {(r.gold, r.predicted): r["count"] for r in encoding.token_pairs(rows, encoder).groupBy("gold", "predicted").count().collect()}
    assert {(r.gold, r.predicted): r.n for r in encoding.pair_counts(rows, encoder).collect()} == want and len(want) > 4
    with pytest.raises(Exception, match="rows of another tokenizer"):
        encoding.pair_counts(rows.withColumn("input_ids", rows.labels), encoder).collect()
