"""Interval kernel: unions, clusters and covered lengths of half-open ranges, by windows and keyed overlap joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_islands(spans: DataFrame, key: list[str], touching: bool, start: str = "start_span", end: str = "end_span") -> DataFrame:
    """`spans` with the number of its island within `key`. touching: ranges that only touch share an island."""
    order = W.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = reach.isNull() | (F.col(start) > reach if touching else F.col(start) >= reach)
    return spans.withColumn("_opens", opens.cast("int")).withColumn("island", F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_opens")


def union_intervals(spans: DataFrame, key: list[str]) -> DataFrame:
    """The union of each key's ranges as disjoint ranges; touching ranges merge."""
    found = with_islands(spans.select(*key, "start_span", "end_span"), key, True).groupBy(*key, "island")
    return found.agg(F.min("start_span").alias("start_span"), F.max("end_span").alias("end_span")).drop("island")


def overlap_clusters(spans: DataFrame, key: list[str]) -> DataFrame:
    """`spans` with the island of ranges that overlap directly or through others; touching ranges stay apart."""
    return with_islands(spans, key, False)


#: Characters of a cell of the overlap join: spans are far shorter, and few stand in one cell.
CELL = 256


def overlap_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Every pair of a left and a right range (`_s`, `_e`) of one key that share a character.

    Both sides are dealt to the cells that they touch, so that ranges only meet within a cell, however many a key has; a
    pair counts in the cell where the later of its two ranges starts.
    """
    cells = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / CELL), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / CELL)))
    a, b = left.withColumn("_cell", cells("start_span", "end_span")), right.withColumn("_cell", cells("_s", "_e"))
    met = a.join(b, [*key, "_cell"]).filter("_s < end_span AND start_span < _e")
    return met.filter(F.col("_cell") == F.floor(F.greatest("start_span", "_s") / CELL)).drop("_cell")


def shared_length(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """key, left, right, shared: the lengths of the unions of each key's left and right ranges, and of what they share.

    One sweep over the sorted ends of both sides' ranges, by a window; no range meets another in a join.
    """
    ends = None
    for df, x, y in ((left, 1, 0), (right, 0, 1)):
        marks = F.array(F.struct(F.col("start_span").alias("at"), F.lit(x).alias("x"), F.lit(y).alias("y")), F.struct(F.col("end_span").alias("at"), F.lit(-x).alias("x"), F.lit(-y).alias("y")))
        one = df.select(*key, F.inline(marks))
        ends = one if ends is None else ends.unionByName(one)
    steps = ends.groupBy(*key, "at").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    order = W.partitionBy(*key).orderBy("at")
    run = order.rowsBetween(W.unboundedPreceding, 0)
    swept = steps.select(*key, (F.lead("at").over(order) - F.col("at")).alias("n"), (F.sum("x").over(run) > 0).alias("in_left"), (F.sum("y").over(run) > 0).alias("in_right"))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return swept.groupBy(*key).agg(total(F.col("in_left")).alias("left"), total(F.col("in_right")).alias("right"), total(F.col("in_left") & F.col("in_right")).alias("shared"))


def covered(spans: DataFrame, other: DataFrame, key: list[str], span_id: str) -> DataFrame:
    """span_id, covered: how many of a span's characters lie in the union of the key's other ranges."""
    union = union_intervals(other, key).withColumnsRenamed({"start_span": "_s", "end_span": "_e"})
    sums = overlap_join(spans, union, key).groupBy(span_id).agg(F.sum(F.least("end_span", "_e") - F.greatest("start_span", "_s")).alias("covered"))
    return spans.select(span_id).join(sums, span_id, "left").select(span_id, F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))


def clusters(gold: DataFrame, predicted: DataFrame, key: list[str]) -> DataFrame:
    """key, island, gold, predicted: the spans of both sides that overlap directly or through others, as arrays.

    Both sides have `at`, their place in the list of their document; arrays are in that order. Spans of different
    clusters share no character, so whatever pairs overlapping spans can work on one cluster at a time.
    """
    rows = None
    for df, side in ((gold, 0), (predicted, 1)):
        score = F.col("score").cast("double") if "score" in df.columns else F.lit(None).cast("double")
        one = df.select(*key, F.col("start_span").cast("long").alias("start_span"), F.col("end_span").cast("long").alias("end_span"), F.lit(side).alias("side"), F.col("at").cast("long").alias("at"), F.col("label").alias("_label"), score.alias("score"))
        rows = one if rows is None else rows.unionByName(one)
    item = F.struct("at", F.col("_label").alias("label"), F.col("start_span").alias("s"), F.col("end_span").alias("e"), "score")
    side = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, item)))
    return with_islands(rows, key, False).groupBy(*key, "island").agg(side(0).alias("gold"), side(1).alias("predicted"))
