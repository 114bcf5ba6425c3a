"""Whole reports as (metric, value): spans, characters, entities and tokens, of tables or of model rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import encoding, scoring


def _long(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """(metric, value) of the columns of a one-row table, by their new names."""
    return df.select(F.inline(F.array(*(F.struct(F.lit(new).alias("metric"), F.col(old).cast("double").alias("value")) for old, new in names.items()))))


def span_metrics(gold: DataFrame, predicted: DataFrame, labels: list[str] | None = None, least: float = 40.0) -> DataFrame:
    """metric, value: the scenarios of the greedy matcher (span_...), characters (char_...) and entities by their characters
    (entity_char_...), of the spans with one of the labels."""
    if labels is not None:
        gold, predicted = (df.filter(F.col("label").isin(*labels)) for df in (gold, predicted))
    characters = scoring.with_prf(scoring.character_scores(gold, predicted, [""]).select("tp", "fp", "fn"))
    entities = scoring.entity_character_scores(gold, predicted)
    out = scoring.flatten(scoring.greedy_scores(gold, predicted, least))
    out = out.unionByName(_long(characters, {"tp": "char_correct", "fp": "char_spurious", "fn": "char_missed", "precision": "char_precision", "recall": "char_recall", "f1": "char_f1"}))
    return out.unionByName(_long(entities, {"n_gold": "entity_char_gold", "n_pred": "entity_char_predicted", "precision": "entity_char_precision", "recall": "entity_char_recall", "f1": "entity_char_f1"}))


def token_report(pairs: DataFrame, by_entity: bool = True, confusion: bool = False, outside: str = "O") -> DataFrame:
    """metric, value of tags (gold, predicted): accuracy, micro and macro scores, counts of each tag, and of each type with
    its prefixes as one; with `confusion` the counts of pairs too. Counted pairs have a column `n`."""
    # every table below is made from these few rows
    pairs = written(scoring.pair_numbers(pairs))
    per = scoring.token_metrics(pairs, outside)
    total = scoring.with_prf(per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))))
    same = F.when(F.col("gold") == F.col("predicted"), 1.0).otherwise(0.0)
    out = _long(pairs.agg(F.coalesce(F.sum(same * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("a")), {"a": "token_accuracy"})
    out = out.unionByName(_long(total, {c: f"token_micro_{c}" for c in ("precision", "recall", "f1")}))
    out = out.unionByName(_long(per.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1"))), {c: f"token_macro_{c}" for c in ("precision", "recall", "f1")}))
    each = lambda df, name: df.select(F.inline(F.array(*(F.struct(F.concat(F.lit(f"token_{name}_"), "tag", F.lit(f"_{c}")).alias("metric"), F.col(c).cast("double").alias("value")) for c in ("tp", "fp", "fn", "precision", "recall", "f1")))))
    out = out.unionByName(each(per, "tag"))
    if by_entity:
        plain = pairs.select(*(F.regexp_replace(c, "^[BI]-", "").alias(c) for c in ("gold", "predicted")), "n")
        out = out.unionByName(each(scoring.token_metrics(plain, outside), "entity"))
    if confusion:
        out = out.unionByName(pairs.select(F.concat(F.lit("token_confusion_"), "gold", F.lit("_"), "predicted").alias("metric"), F.col("n").cast("double").alias("value")))
    return out


def evaluate_rows(rows: DataFrame, encoder: encoding.Encoder, logits: str = "logits", least: float = 40.0, tokens: bool = True, by_entity: bool = True, confusion: bool = False, spans: bool = True) -> DataFrame:
    """metric, value of model rows with logits: gold and predicted spans are rebuilt from the rows, and their tags compared;
    without `spans` or `tokens` the metrics of the others alone."""
    if not (spans or tokens):
        raise ValueError("a report needs spans or tokens")
    parts = []
    if spans:
        parts.append(span_metrics(encoding.gold_spans(rows, encoder), encoding.predicted_spans(rows, encoder, logits), None, least))
    if tokens:
        parts.append(token_report(encoding.pair_counts(rows, encoder, logits), by_entity, confusion))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def evaluate_heads(rows: DataFrame, encoder: encoding.Encoder, logits: str = "logits", least: float = 40.0) -> DataFrame:
    """head, scenario and scores (see `scoring.head_scores`) of rows with many heads."""
    return scoring.head_scores(encoding.head_spans(rows, encoder), encoding.head_spans(rows, encoder, logits), list(encoder.labels), least)


def head_token_reports(rows: DataFrame, encoder: encoding.Encoder, logits: str = "logits", by_entity: bool = True) -> DataFrame:
    """head, metric, value: the token report of each head."""
    out = None
    for i, label in enumerate(encoder.labels):
        one = encoding.head_rows(rows, i).withColumn(logits, F.transform(logits, lambda p: p[i]))  # noqa: B023
        report = token_report(encoding.pair_counts(one, encoder, logits, label), by_entity).select(F.lit(label).alias("head"), "metric", "value")
        out = report if out is None else out.unionByName(report)
    return out
