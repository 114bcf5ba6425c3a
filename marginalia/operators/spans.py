"""Span tables: projection from a corpus, dedupe, overlap policies, relations, decoding of tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import overlap_clusters, overlap_join

KEY = ["filename", "label", "start_span", "end_span"]
ENTITY = "id string, start int, end int, label string, text string, code string"
POLICIES = ("none", "error", "keep_longest", "keep_shortest", "merge_same_label_then_keep_longest")


def spans_from_corpus(corpus: DataFrame, label: str | None = None) -> DataFrame:
    """filename, label, start_span, end_span, text, code of a corpus (doc_id, text, entities_json); the text comes from the document."""
    rows = corpus.select(F.col("doc_id").alias("filename"), F.col("text").alias("document"), F.explode(F.from_json("entities_json", f"array<struct<{ENTITY}>>")).alias("e"))
    rows = rows if label is None else rows.filter(F.col("e.label") == label)
    text = F.substring(F.col("document"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))
    return rows.select("filename", "e.label", F.col("e.start").alias("start_span"), F.col("e.end").alias("end_span"), text.alias("text"), "e.code")


def with_text(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """Spans with their text, from documents (filename, document)."""
    return spans.join(documents, "filename").withColumn("text", F.substring(F.col("document"), F.col("start_span").cast("int") + 1, (F.col("end_span") - F.col("start_span")).cast("int"))).drop("document")


def dedupe_spans(spans: DataFrame) -> DataFrame:
    """One row per (filename, label, start, end); where there is a score, the highest."""
    return spans.groupBy(*KEY).agg(F.max("score").alias("score")) if "score" in spans.columns else spans.dropDuplicates(KEY)


def normalize_spans(spans: DataFrame) -> DataFrame:
    """Typed spans; an end that isn't behind its start raises."""
    typed = spans.select(F.col("filename").cast("string"), F.col("label").cast("string"), F.col("start_span").cast("int"), F.col("end_span").cast("int"), *(c for c in spans.columns if c not in KEY))
    bad = F.raise_error(F.concat(F.lit("empty or reversed span in "), F.col("filename")))
    return typed.withColumn("end_span", F.when(F.col("end_span") <= F.col("start_span"), bad.cast("int")).otherwise(F.col("end_span")))


def _representative(spans: DataFrame, longest: bool) -> DataFrame:
    size = F.col("end_span") - F.col("start_span")
    order = W.partitionBy("filename", "island").orderBy(F.desc(size) if longest else F.asc(size), "start_span", "label")
    return spans.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "island")


def inclusive(spans: DataFrame) -> DataFrame:
    """Spans as scorers of inclusive ends take them: filename, label, start, end."""
    return spans.select("filename", "label", F.col("start_span").alias("start"), (F.col("end_span") - 1).alias("end"))


def resolve_overlaps(spans: DataFrame, policy: str = "none", documents: DataFrame | None = None) -> DataFrame:
    """One span of each overlap cluster of a document, by policy; `error` raises at the first overlap. Merged spans have no
    text of their own: with documents (filename, document) it is read again."""
    if policy not in POLICIES:
        raise ValueError(f"unknown overlap policy {policy!r}")
    if policy == "none":
        return spans
    if policy == "merge_same_label_then_keep_longest":
        merged = overlap_clusters(spans, ["filename", "label"]).groupBy("filename", "label", "island").agg(F.min("start_span").alias("start_span"), F.max("end_span").alias("end_span")).drop("island")
        kept = _representative(overlap_clusters(merged, ["filename"]), True)
        return kept if documents is None else with_text(kept, documents)
    found = overlap_clusters(spans, ["filename"])
    if policy == "error":
        many = F.count(F.lit(1)).over(W.partitionBy("filename", "island")) > 1
        return found.withColumn("filename", F.when(many, F.raise_error(F.concat(F.lit("overlapping entities in "), F.col("filename"))).cast("string")).otherwise(F.col("filename"))).drop("island")
    return _representative(found, policy == "keep_longest")


def span_relations(spans: DataFrame) -> DataFrame:
    """relation, n: how many spans stand in an identical, nested or crossing pair; each counts once for a relation."""
    order = W.partitionBy("filename").orderBy("start_span", "end_span", "label")
    n = spans.select("filename", "start_span", "end_span", F.row_number().over(order).alias("i"))
    a = n.select("filename", F.col("i").alias("ai"), "start_span", "end_span")
    b = n.select("filename", F.col("i").alias("bi"), F.col("start_span").alias("_s"), F.col("end_span").alias("_e"))
    pairs = overlap_join(a, b, ["filename"]).filter("ai < bi")
    relation = F.expr("CASE WHEN start_span = _s AND end_span = _e THEN 'identical' WHEN (start_span <= _s AND _e <= end_span) OR (_s <= start_span AND end_span <= _e) THEN 'nested' ELSE 'crossing' END")
    each = pairs.select("filename", relation.alias("relation"), F.explode(F.array("ai", "bi")).alias("i")).distinct()
    return each.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def decode_bio(tokens: DataFrame, outside: str = "O", key: list[str] | None = None) -> DataFrame:
    """key (the filename), label, start_span, end_span, score of tagged tokens (filename, position, tag, start_span, end_span, score).

    B opens a span, I of the same label goes on with it, and any other I opens one; the score is the tokens' mean.
    """
    key = key or ["filename"]
    order = W.partitionBy(*key).orderBy("position")
    label, kind = F.regexp_replace("tag", "^[BI]-", ""), F.substring("tag", 1, 1)
    tagged = tokens.withColumns({"label": label, "_kind": kind, "_last": F.lag("tag").over(order)})
    goes_on = (F.col("_kind") == "I") & (F.col("_last") != outside) & (F.regexp_replace("_last", "^[BI]-", "") == F.col("label"))
    opens = F.when(F.col("tag") == outside, 0).when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)
    marked = tagged.withColumn("_n", F.sum(opens).over(order.rowsBetween(W.unboundedPreceding, 0))).filter(F.col("tag") != outside)
    return marked.groupBy(*key, "label", "_n").agg(F.min("start_span").alias("start_span"), F.max("end_span").alias("end_span"), F.avg("score").alias("score")).drop("_n")
