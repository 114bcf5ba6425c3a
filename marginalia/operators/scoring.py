"""Span scoring: characters, entity-weighted characters, strict spans, tokens, and the greedy matcher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import clusters, overlap_join, shared_length

KEY = ["filename", "label"]
SCENARIOS = ("strict", "exact", "partial", "ent_type")


def ratio(num: Column, den: Column) -> Column:
    """num / den as a double, 0 where den is 0."""
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def with_prf(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Adds precision, recall and f1, unrounded."""
    t, p, n = F.col(tp), F.col(fp), F.col(fn)
    return df.withColumns({"precision": ratio(t, t + p), "recall": ratio(t, t + n), "f1": ratio(2 * t, 2 * t + p + n)})


def span_dice(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    overlap = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
    return ratio(2 * overlap, (e1 - s1) + (e2 - s2))


def character_scores(gold: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Characters right, too many and missed, by `by` (default: label), from the unions of each document and label."""
    by = by or ["label"]
    joined = shared_length(gold, predicted, KEY)
    sums = joined.groupBy(*by) if by != [""] else joined.groupBy()
    return with_prf(sums.agg(F.sum("shared").alias("tp"), (F.sum("right") - F.sum("shared")).alias("fp"), (F.sum("left") - F.sum("shared")).alias("fn")))


def entity_credits(spans: DataFrame, other: DataFrame) -> DataFrame:
    """`spans` (with a unique span_id) and each one's best Dice with the other side's spans of its document and label."""
    o = other.select(*KEY, F.col("start_span").alias("_s"), F.col("end_span").alias("_e"))
    best = overlap_join(spans, o, KEY).groupBy("span_id").agg(F.max(span_dice(F.col("start_span"), F.col("end_span"), F.col("_s"), F.col("_e"))).alias("credit"))
    return spans.join(best, "span_id", "left").na.fill(0.0, ["credit"])


def with_span_id(spans: DataFrame) -> DataFrame:
    """A total order's row number within a document, as text: equal on every run."""
    order = W.partitionBy("filename").orderBy("start_span", "end_span", "label")
    return spans.withColumn("span_id", F.concat_ws("#", "filename", F.row_number().over(order)))


def entity_character_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: recall is the mean credit of gold spans, precision of distinct predicted ones; f1 their harmonic mean."""
    distinct = predicted.select(*KEY, "start_span", "end_span").distinct()
    r = entity_credits(with_span_id(gold), distinct).agg(F.sum("credit").alias("gold_credit"), F.count(F.lit(1)).alias("n_gold"))
    p = entity_credits(with_span_id(distinct), gold).agg(F.sum("credit").alias("pred_credit"), F.count(F.lit(1)).alias("n_pred"))
    # one row each
    one = r.withColumn("k", F.lit(1)).join(p.withColumn("k", F.lit(1)), "k").drop("k")
    one = one.withColumns({"precision": ratio(F.coalesce("pred_credit", F.lit(0.0)), F.col("n_pred")), "recall": ratio(F.coalesce("gold_credit", F.lit(0.0)), F.col("n_gold"))})
    return one.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def strict_matches(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Multiset equality of (filename, label, start, end): key, n_gold, n_pred, matched."""
    key = [*KEY, "start_span", "end_span"]
    sides = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*key, F.lit(0).alias("g"), F.lit(1).alias("p")))
    return sides.groupBy(*key).agg(F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred")).withColumn("matched", F.least("n_gold", "n_pred"))


def strict_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Exact-first strict scores: label null is the micro row over all labels."""
    m = strict_matches(gold, predicted)
    sums = m.cube("label").agg(F.sum("matched").alias("tp"), (F.sum("n_pred") - F.sum("matched")).alias("fp"), (F.sum("n_gold") - F.sum("matched")).alias("fn"))
    return with_prf(sums)


def numbered(spans: DataFrame) -> DataFrame:
    """`spans` with `at`, a span's place in its document: by the column `position` where there is one (the order of a list),
    else by offsets and label."""
    order = ["position"] if "position" in spans.columns else [c for c in ("start_span", "end_span", "label", "score") if c in spans.columns]
    return spans.withColumn("at", F.row_number().over(W.partitionBy("filename").orderBy(*order)).cast("long"))


def _taken(scenario: str, least: float) -> Column:
    """Events (kind, gold_at, pred_at) of a cluster's arrays `gold` and `predicted` under a scenario.

    Predictions come in list order. Each takes the first free gold span, in list order, that it shares a character with (in
    partial and ent_type: at least `least` per cent of the gold span); whether that is right, wrong or partial depends
    on offsets and labels. What finds none is spurious, what is never taken missed.
    """
    shared = lambda g, p: F.least(g["e"], p["e"]) - F.greatest(g["s"], p["s"])
    fits = (lambda g, p: shared(g, p) > 0) if scenario in ("strict", "exact") else (lambda g, p: (shared(g, p) > 0) & (100 * shared(g, p) >= least * (g["e"] - g["s"])))

    def kind(g: Column, p: Column) -> Column:
        same, label = (g["s"] == p["s"]) & (g["e"] == p["e"]), g["label"].eqNullSafe(p["label"])
        right, other = {"strict": (same & label, "incorrect"), "exact": (same, "incorrect"), "partial": (same, "partial"), "ent_type": (label, "incorrect")}[scenario]
        return F.when(g.isNull(), "spurious").when(right, "correct").otherwise(other)

    def step(state: Column, p: Column) -> Column:
        first = F.array(F.get(F.filter(state["free"], lambda g: fits(g, p)), F.lit(0)))
        return F.transform(
            first,
            lambda g: F.struct(
                F.filter(state["free"], lambda x: ~x["at"].eqNullSafe(g["at"])).alias("free"),
                F.concat(state["events"], F.array(F.struct(kind(g, p).alias("kind"), g["at"].alias("gold_at"), p["at"].alias("pred_at")))).alias("events"),
            ),
        )[0]

    none = F.array().cast("array<struct<kind:string,gold_at:bigint,pred_at:bigint>>")
    missed = lambda state: F.concat(state["events"], F.transform(state["free"], lambda g: F.struct(F.lit("missed").alias("kind"), g["at"].alias("gold_at"), F.lit(None).cast("long").alias("pred_at"))))
    return F.aggregate("predicted", F.struct(F.col("gold").alias("free"), none.alias("events")), step, missed)


def greedy_events(gold: DataFrame, predicted: DataFrame, least: float = 40.0, key: list[str] | None = None, scenarios: tuple[str, ...] = SCENARIOS) -> DataFrame:
    """key, scenario, kind, gold_at, pred_at: one row for each pair, spurious prediction and missed gold span.

    Matching is greedy and depends on the order of the lists (`at`, see `numbered`), within `key`: documents, or documents
    and labels. Only spans that overlap, directly or through others, meet; so a cluster is the unit of work, not a document.
    """
    key = key or ["filename"]
    ready = [df if "at" in df.columns else numbered(df) for df in (gold, predicted)]
    each = F.array(*(F.struct(F.lit(s).alias("scenario"), _taken(s, least).alias("events")) for s in scenarios))
    return clusters(*ready, key).select(*key, F.inline(each)).select(*key, "scenario", F.inline("events"))


def greedy_scores(gold: DataFrame, predicted: DataFrame, least: float = 40.0) -> DataFrame:
    """scenario, correct, incorrect, partial, spurious, missed, precision, recall, f1 over all documents."""
    return sum_results(event_counts(greedy_events(gold, predicted, least)))


def event_counts(events: DataFrame, *by: str) -> DataFrame:
    """by, scenario and the number of each kind of event."""
    return events.groupBy(*by, "scenario").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("correct", "incorrect", "partial", "spurious", "missed")))


def head_scores(gold: DataFrame, predicted: DataFrame, labels: list[str], least: float = 40.0) -> DataFrame:
    """head, scenario, counts, precision, recall, f1: each label scored alone, then `micro` with the counts added and
    `macro` with the labels' means (its counts are null). Spans of other labels are left out."""
    g, p = (df.filter(F.col("label").isin(*labels)) for df in (gold, predicted))
    counts = event_counts(greedy_events(g, p, least, KEY), "label")
    spark = gold.sparkSession
    names = ("correct", "incorrect", "partial", "spurious", "missed")
    # a row for each label and scenario
    grid = spark.createDataFrame([(x, s) for x in labels for s in SCENARIOS], "label string, scenario string")
    full = grid.join(counts, ["label", "scenario"], "left").na.fill(0, list(names))
    heads = _with_ratios(full).withColumnRenamed("label", "head")
    micro = sum_results(full).withColumn("head", F.lit("micro"))
    mean = heads.groupBy("scenario").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1"))).withColumn("head", F.lit("macro"))
    return heads.unionByName(micro).unionByName(mean, allowMissingColumns=True)


def _with_ratios(counts: DataFrame) -> DataFrame:
    half = F.when(F.col("scenario").isin("partial", "ent_type"), 0.5).otherwise(0.0)
    tp = F.col("correct") + half * F.col("partial")
    common = F.col("correct") + F.col("incorrect") + F.col("partial")
    sums = counts.withColumns({"precision": ratio(tp, common + F.col("spurious")), "recall": ratio(tp, common + F.col("missed"))})
    return sums.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def sum_results(counts: DataFrame) -> DataFrame:
    """Counts of several results added, with precision, recall and f1; half credit for partial in partial and ent_type."""
    return _with_ratios(counts.groupBy("scenario").agg(*(F.sum(n).alias(n) for n in ("correct", "incorrect", "partial", "spurious", "missed"))))


def flatten(results: DataFrame) -> DataFrame:
    """Long form (metric, value) of `sum_results`: span_<scenario>_<name>, to four decimals."""
    names = ("precision", "recall", "f1", "correct", "incorrect", "partial", "missed", "spurious")
    pairs = F.array(*(F.struct(F.concat(F.lit("span_"), "scenario", F.lit(f"_{n}")).alias("metric"), F.round(F.col(n).cast("double"), 4).alias("value")) for n in names))
    return results.select(F.inline(pairs))


def token_confusion(tokens: DataFrame, tags: list[str]) -> DataFrame:
    """gold, predicted, n for every pair of tags, zeros included, of `tokens` (gold, predicted)."""
    counts = tokens.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    spark = tokens.sparkSession
    grid = spark.createDataFrame([(a, b) for a in tags for b in tags], "gold string, predicted string")
    return grid.join(counts, ["gold", "predicted"], "left").na.fill(0, ["n"])


def pair_numbers(tokens: DataFrame) -> DataFrame:
    """gold, predicted, n of tokens (gold, predicted), or of counted ones, which have a column `n`."""
    return tokens.groupBy("gold", "predicted").agg((F.sum("n") if "n" in tokens.columns else F.count(F.lit(1))).alias("n"))


def token_metrics(tokens: DataFrame, outside: str = "O") -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of each tag but `outside`, from one count of (gold, predicted) pairs, or of their
    numbers `n` where tokens are counted already."""
    pairs = pair_numbers(tokens)
    sides = pairs.select(F.inline(F.array(F.struct(F.col("gold").alias("tag"), F.lit("g").alias("side"), "n", (F.col("gold") == F.col("predicted")).alias("same")), F.struct(F.col("predicted").alias("tag"), F.lit("p").alias("side"), "n", (F.col("gold") == F.col("predicted")).alias("same")))))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    sums = sides.filter(F.col("tag") != outside).groupBy("tag").agg(total(F.expr("side = 'g' AND same")).alias("tp"), total(F.expr("side = 'p' AND NOT same")).alias("fp"), total(F.expr("side = 'g' AND NOT same")).alias("fn"))
    return with_prf(sums)
