"""Error analysis: events, pairing units, taxonomy, boundaries, exposure, subgroups, calibration, bootstrap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .intervals import clusters, covered, overlap_join, shared_length
from .scoring import entity_credits, greedy_events, numbered, ratio, span_dice, with_prf, with_span_id
from .stats import quantile_edges

#: Names of tables and columns that others read. Fixed values.
ERROR_TYPES = ("CORRECT", "BOUNDARY_ERROR", "MISSED", "SPURIOUS", "UNCREDITED_EXACT")
ONE_TO_ONE = ("TOO_LONG", "TOO_SHORT", "SHIFTED_LEFT", "SHIFTED_RIGHT")
SCENARIOS = {
    "fix_boundary_errors": ("BOUNDARY_ERROR",),
    "recover_missed": ("MISSED",),
    "remove_spurious": ("SPURIOUS",),
    "fix_uncredited_exact": ("UNCREDITED_EXACT",),
    "fix_all": ("BOUNDARY_ERROR", "MISSED", "SPURIOUS", "UNCREDITED_EXACT"),
}
SIMILARITY_BINS = {"1.00": 1.0, "[0.95, 1)": 0.95, "[0.90, 0.95)": 0.90, "[0.85, 0.90)": 0.85, "[0.80, 0.85)": 0.80, "< 0.80": 0.0}
FREQUENCY_BINS = {"0": 0, "1": 1, "2-5": 5, "6-10": 10, "11-20": 20}
TRAITS = ("acronym_like", "has_digit", "has_punctuation", "has_parentheses", "has_hyphen", "has_slash", "has_greek")
KEY = ["filename", "label", "start_span", "end_span"]
GROUP = ["family", "value"]
UNIT = "error_type string, boundary_kind string, gold_ids array<bigint>, pred_ids array<bigint>, dice double, start_offset bigint, end_offset bigint"


def exact_events(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """filename, label, start_span, end_span, outcome (TP, FN, FP): equal spans pair off one to one, whatever the order."""
    nth = lambda df: df.select(*KEY).withColumn("nth", F.row_number().over(W.partitionBy(*KEY).orderBy(F.lit(1))))
    g, p = nth(gold).withColumn("g", F.lit(True)), nth(predicted).withColumn("p", F.lit(True))
    both = g.join(p, [*KEY, "nth"], "full")
    return both.select(*KEY, F.when(F.col("g") & F.col("p"), "TP").when(F.col("g"), "FN").otherwise("FP").alias("outcome"))


def strict_events(gold: DataFrame, predicted: DataFrame, target_label: str | None = None) -> DataFrame:
    """filename, label, outcome (TP, FN, FP), gold_id, pred_id, the offsets of both sides, score: every span once.

    The strict scenario of the greedy matcher, each label by itself: a prediction can lose an equal gold span to an earlier
    one that overlaps it. Ids are places in the document's list, see `scoring.numbered`.
    """
    if target_label is not None:
        gold, predicted = (df.filter(F.col("label") == target_label) for df in (gold, predicted))
    g, p = numbered(gold), numbered(predicted)
    right = greedy_events(g, p, key=["filename", "label"], scenarios=("strict",)).filter("kind = 'correct'").select("filename", "gold_at", "pred_at")
    score = F.col("score").cast("double") if "score" in p.columns else F.lit(None).cast("double")
    side = lambda df, name, *more: df.select("filename", "label", F.col("at").alias(f"{name}_id"), F.col("start_span").cast("long").alias(f"{name}_start"), F.col("end_span").cast("long").alias(f"{name}_end"), *more)
    golds = side(g, "gold").join(right.withColumnRenamed("gold_at", "gold_id"), ["filename", "gold_id"], "left")
    preds = side(p, "pred", score.alias("score"))
    hit = golds.join(preds.drop("label").withColumnRenamed("pred_id", "pred_at"), ["filename", "pred_at"], "left")
    columns = ("filename", "label", "outcome", "gold_id", "pred_id", "gold_start", "gold_end", "pred_start", "pred_end", "score")
    found = hit.withColumnRenamed("pred_at", "pred_id").withColumn("outcome", F.when(F.col("pred_id").isNull(), "FN").otherwise("TP"))
    false = preds.join(right.withColumnRenamed("pred_at", "pred_id"), ["filename", "pred_id"], "left_anti").withColumn("outcome", F.lit("FP"))
    return found.select(*columns).unionByName(false.withColumns({c: F.lit(None).cast("long") for c in ("gold_id", "gold_start", "gold_end")}).select(*columns))


def boundary_kind(ds: Column, de: Column) -> Column:
    """How a prediction errs, from its offsets (prediction minus gold)."""
    return F.when((ds <= 0) & (de >= 0), "TOO_LONG").when((ds >= 0) & (de <= 0), "TOO_SHORT").when(ds < 0, "SHIFTED_LEFT").otherwise("SHIFTED_RIGHT")


def matched_edge(ds: Column, de: Column) -> Column:
    return F.when(ds == 0, "START").when(de == 0, "END").otherwise("NEITHER")


def assign(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of a largest-sum assignment, by shortest augmenting paths with potentials."""
    if not weights or not weights[0]:
        return []
    flip = len(weights) > len(weights[0])
    cost = [[-w for w in r] for r in (zip(*weights, strict=True) if flip else weights)]
    n, m, inf = len(cost), len(cost[0]), float("inf")
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, used = [inf] * (m + 1), [False] * (m + 1)
        while owner[j]:
            used[j] = True
            r, delta, nxt = owner[j], inf, 0
            for c in range(1, m + 1):
                if not used[c]:
                    now = cost[r - 1][c - 1] - u[r] - v[c]
                    if now < least[c]:
                        least[c], way[c] = now, j
                    if least[c] < delta:
                        delta, nxt = least[c], c
            for c in range(m + 1):
                if used[c]:
                    u[owner[c]] += delta
                    v[c] -= delta
                else:
                    least[c] -= delta
            j = nxt
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    pairs = [(owner[c] - 1, c - 1) for c in range(1, m + 1) if owner[c]]
    return sorted((c, r) for r, c in pairs) if flip else sorted(pairs)


def _bind(value: Column, make) -> Column:
    """make(value), with the value computed once."""
    return F.transform(F.array(value), make)[0]


def _unit(kind: str, boundary: Column | None, gold_ids: Column, pred_ids: Column, dice: Column | None = None, start: Column | None = None, end: Column | None = None) -> Column:
    """A struct as UNIT has it."""
    none = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    return F.struct(F.lit(kind).alias("error_type"), none(boundary, "string").alias("boundary_kind"), gold_ids.alias("gold_ids"), pred_ids.alias("pred_ids"), none(dice, "double").alias("dice"), none(start, "bigint").alias("start_offset"), none(end, "bigint").alias("end_offset"))


def _ids(spans: Column) -> Column:
    return F.transform(spans, lambda x: x["at"])


def _union_length(spans: Column) -> Column:
    """Characters that an array of spans covers together."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    begin = F.struct(F.lit(-1).cast("bigint").alias("reach"), F.lit(0).cast("bigint").alias("total"))
    return F.aggregate(ordered, begin, lambda a, x: F.struct(F.greatest(a["reach"], x["e"]).alias("reach"), (a["total"] + F.greatest(F.lit(0).cast("bigint"), x["e"] - F.greatest(x["s"], a["reach"]))).alias("total")), lambda a: a["total"])


_SPANS = "array<struct<at:bigint,label:string,s:bigint,e:bigint,score:double>>"
_UNITS = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in UNIT.split(', '))}>>"


def _same(state: Column) -> Column:
    """Equal leftovers, one unit for each number that both sides have of a range, the lowest ids first."""
    def step(a: Column, g: Column) -> Column:
        equal = F.get(F.filter(a["pred"], lambda p: (p["s"] == g["s"]) & (p["e"] == g["e"])), F.lit(0))
        return _bind(
            equal,
            lambda p: F.struct(
                F.when(p.isNull(), F.concat(a["gold"], F.array(g))).otherwise(a["gold"]).alias("gold"),
                F.filter(a["pred"], lambda x: ~x["at"].eqNullSafe(p["at"])).alias("pred"),
                F.when(p.isNull(), a["units"]).otherwise(F.concat(a["units"], F.array(_unit("UNCREDITED_EXACT", None, F.array(g["at"]), F.array(p["at"]), F.lit(1.0), F.lit(0), F.lit(0))))).alias("units"),
            ),
        )

    return F.aggregate(state["gold"], F.struct(F.array().cast(_SPANS).alias("gold"), state["pred"].alias("pred"), state["units"].alias("units")), step)


def _contained(state: Column, outer: str, inner: str, kind: str, threshold: Column) -> Column:
    """Outer spans, the shortest first, that hold two free inner ones or more whose union reaches the threshold."""
    def step(a: Column, c: Column) -> Column:
        inside = F.filter(a["inner"], lambda x: (x["s"] >= c["s"]) & (x["e"] <= c["e"]))
        return _bind(_bind(inside, lambda x: F.struct(x.alias("inside"), _union_length(x).alias("n"))), lambda x: join(a, c, x["inside"], 2 * x["n"] / ((c["e"] - c["s"]) + x["n"])))

    def join(a: Column, c: Column, inside: Column, dice: Column) -> Column:
        ok = (F.size(inside) >= 2) & (dice >= threshold)
        start, end = F.array_min(F.transform(inside, lambda x: x["s"])) - c["s"], F.array_max(F.transform(inside, lambda x: x["e"])) - c["e"]
        # offsets are the prediction's minus gold's, whichever side is the outer one
        unit = _unit("BOUNDARY_ERROR", F.lit(kind), F.array(c["at"]), _ids(inside), dice, start, end) if kind == "FRAGMENTED" else _unit("BOUNDARY_ERROR", F.lit(kind), _ids(inside), F.array(c["at"]), dice, -start, -end)
        return F.struct(
            F.when(ok, F.filter(a["inner"], lambda x: ~F.array_contains(_ids(inside), x["at"]))).otherwise(a["inner"]).alias("inner"),
            F.when(ok, a["outer"]).otherwise(F.concat(a["outer"], F.array(c))).alias("outer"),
            F.when(ok, F.concat(a["units"], F.array(unit))).otherwise(a["units"]).alias("units"),
        )

    by_length = F.transform(F.array_sort(F.transform(state[outer], lambda x: F.struct((x["e"] - x["s"]).alias("n"), x["at"].alias("at"), x.alias("x")))), lambda x: x["x"])
    found = F.aggregate(by_length, F.struct(state[inner].alias("inner"), F.array().cast(_SPANS).alias("outer"), state["units"].alias("units")), step)
    order = lambda spans: F.array_sort(spans)
    return _bind(found, lambda a: F.struct(order(a["outer"] if outer == "gold" else a["inner"]).alias("gold"), order(a["inner"] if outer == "gold" else a["outer"]).alias("pred"), a["units"].alias("units")))


_PAIRS = T.ArrayType(T.StructType([T.StructField("g", T.IntegerType()), T.StructField("p", T.IntegerType())]))


def best_pairs(gold: list[tuple[int, int]], predicted: list[tuple[int, int]], threshold: float) -> list[tuple[int, int]]:
    """(gold place, predicted place) of the one-to-one pairs of the largest total Dice, each at the threshold or more."""
    weights = [[d if (d := 2 * max(0, min(e, f) - max(s, t)) / ((e - s) + (f - t))) >= threshold else 0.0 for t, f in predicted] for s, e in gold]
    return [(i, j) for i, j in assign(weights) if weights[i][j] > 0]


@F.arrow_udf(_PAIRS)
def _assigned(gold: pa.Array, predicted: pa.Array, threshold: pa.Array) -> pa.Array:
    plain = lambda v: [(x["s"], x["e"]) for x in v]
    found = [[{"g": i, "p": j} for i, j in best_pairs(plain(g), plain(p), t)] for g, p, t in zip(gold.to_pylist(), predicted.to_pylist(), threshold.to_pylist(), strict=True)]
    return pa.array(found, pa.list_(pa.struct([("g", pa.int32()), ("p", pa.int32())])))


def _paired(state: Column, pairs: Column) -> Column:
    """Units of a state's leftovers, by the pairs of their places: boundary errors, then what is missed or spurious."""
    def one(x: Column) -> Column:
        g, p = F.get(state["gold"], x["g"]), F.get(state["pred"], x["p"])
        ds, de = p["s"] - g["s"], p["e"] - g["e"]
        return _unit("BOUNDARY_ERROR", boundary_kind(ds, de), F.array(g["at"]), F.array(p["at"]), span_dice(g["s"], g["e"], p["s"], p["e"]), ds, de)

    alone = lambda spans, field: F.filter(F.transform(spans, lambda x, i: F.struct(x["at"].alias("at"), i.alias("i"))), lambda x: ~F.exists(pairs, lambda q: q[field] == x["i"]))
    none = F.array().cast("array<bigint>")
    missed = F.transform(alone(state["gold"], "g"), lambda x: _unit("MISSED", None, F.array(x["at"]), none))
    spurious = F.transform(alone(state["pred"], "p"), lambda x: _unit("SPURIOUS", None, none, F.array(x["at"])))
    return F.concat(state["units"], F.transform(pairs, one), missed, spurious)


def pair_errors(events: DataFrame, threshold: float | Column = 0.6, by: list[str] | None = None) -> DataFrame:
    """unit_id, filename, label, error_type, boundary_kind, matched_edge, gold_ids, pred_ids, dice, start_offset, end_offset.

    Strict matches are CORRECT. What is left of a document and label is taken by overlap cluster: equal spans, one gold span
    in pieces, one prediction over several gold spans, then the one-to-one pairs of the largest total Dice. `threshold` may
    be a column of `events` named in `by`, so that several thresholds share one plan.
    """
    by = by or []
    limit = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    key = ["filename", "label", *by]
    one = lambda c: F.array(F.col(c))
    correct = events.filter("outcome = 'TP'").select(*key, _unit("CORRECT", None, one("gold_id"), one("pred_id"), F.lit(1.0), F.lit(0), F.lit(0)).alias("u")).select(*key, "u.*")
    left = lambda outcome, side: events.filter(F.col("outcome") == outcome).select(*key, F.col(f"{side}_id").alias("at"), F.col(f"{side}_start").alias("start_span"), F.col(f"{side}_end").alias("end_span"))
    state = F.struct(F.col("gold").alias("gold"), F.col("predicted").alias("pred"), F.array().cast(_UNITS).alias("units"))
    found = clusters(left("FN", "gold"), left("FP", "pred"), key)
    for make in (_same, lambda s: _contained(s, "gold", "pred", "FRAGMENTED", limit), lambda s: _contained(s, "pred", "gold", "MERGED", limit)):
        found = found.select(*key, make(state).alias("state"))
        state = F.col("state")
    # most clusters have one span on a side at most by now: no call of Python for them
    several = (F.size("state.gold") > 0) & (F.size("state.pred") > 0)
    pairs = F.when(several, _assigned(F.when(several, F.col("state.gold")).otherwise(F.array().cast(_SPANS)), F.col("state.pred"), limit)).otherwise(F.array().cast("array<struct<g:int,p:int>>"))
    found = found.withColumn("pairs", pairs).select(*key, F.inline(_paired(F.col("state"), F.col("pairs"))))
    units = correct.unionByName(found)
    edge = F.when(F.col("boundary_kind").isin(*ONE_TO_ONE), matched_edge(F.col("start_offset"), F.col("end_offset")))
    return units.select(F.xxhash64(*key, "gold_ids", "pred_ids").alias("unit_id"), *key, "error_type", "boundary_kind", edge.alias("matched_edge"), "gold_ids", "pred_ids", "dice", "start_offset", "end_offset")


def attach_units(events: DataFrame, units: DataFrame) -> DataFrame:
    """`events` with the unit_id and error_type of the unit that holds their span."""
    held = lambda ids, name: units.select("filename", "label", F.explode(ids).alias(name), F.col("unit_id").alias(f"_{name}"), F.col("error_type").alias(f"_{name}_type"))
    both = events.join(held("gold_ids", "gold_id"), ["filename", "label", "gold_id"], "left").join(held("pred_ids", "pred_id"), ["filename", "label", "pred_id"], "left")
    return both.select(*events.columns, F.coalesce("_gold_id", "_pred_id").alias("unit_id"), F.coalesce("_gold_id_type", "_pred_id_type").alias("error_type"))


def error_taxonomy(units: DataFrame) -> DataFrame:
    """error_type, count, share, error_share, cumulative_error_share, for every type; shares of errors are null for CORRECT."""
    names = units.sparkSession.createDataFrame(list(enumerate(ERROR_TYPES)), "place int, error_type string")
    counts = names.join(units.groupBy("error_type").agg(F.count(F.lit(1)).alias("count")), "error_type", "left").na.fill(0, ["count"])
    # five rows
    everything = W.partitionBy()
    error = F.col("error_type") != "CORRECT"
    wrong = F.when(error, F.col("count")).otherwise(0)
    order = W.orderBy(error.cast("int"), F.desc("count"), "place").rowsBetween(W.unboundedPreceding, 0)
    share = lambda c: F.when(error, ratio(c, F.sum(wrong).over(everything)))
    return counts.select("error_type", "count", ratio(F.col("count"), F.sum("count").over(everything)).alias("share"), share(wrong).alias("error_share"), share(F.sum(wrong).over(order)).alias("cumulative_error_share"))


def _strip_edges(text: Column) -> Column:
    """Without white space and punctuation at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^(?U:[\s\p{P}])+", ""), r"(?U:[\s\p{P}])+$", "")


def _texts(units: DataFrame, spans: DataFrame, ids: str, name: str) -> DataFrame:
    """unit_id and the texts of a unit's spans, in the order of their ids."""
    numbers = numbered(spans).select("filename", F.col("at").alias("_id"), "text")
    each = units.select("unit_id", "filename", F.explode(ids).alias("_id")).join(numbers, ["filename", "_id"])
    return each.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_id", "text"))), lambda x: x["text"]).alias(name))


def boundary_errors(units: DataFrame, gold: DataFrame, predicted: DataFrame, exposure: DataFrame | None = None) -> DataFrame:
    """One row for each boundary error: kinds, n_gold, n_predicted, texts (joined by ` | `), dice, offsets, off_by_one,
    whitespace_edge, punctuation_only and, with `exposure` (text, exposure of normalised forms), that of the first gold text."""
    from .linking import normalize

    wrong = units.filter("error_type = 'BOUNDARY_ERROR'")
    rows = wrong.join(_texts(wrong, gold, "gold_ids", "gold_texts"), "unit_id").join(_texts(wrong, predicted, "pred_ids", "pred_texts"), "unit_id")
    one = F.col("boundary_kind").isin(*ONE_TO_ONE)
    edge = F.exists("pred_texts", lambda t: t.rlike(r"^(?U:\s)|(?U:\s)$"))
    out = rows.select(
        "unit_id", "filename", "label", "boundary_kind", "matched_edge", F.size("gold_ids").alias("n_gold"), F.size("pred_ids").alias("n_predicted"),
        F.array_join("gold_texts", " | ").alias("gold_text"), F.array_join("pred_texts", " | ").alias("pred_text"), "dice", "start_offset", "end_offset",
        (one & (F.abs("start_offset") + F.abs("end_offset") == 1)).alias("off_by_one"), edge.alias("whitespace_edge"),
        (one & (_strip_edges(F.col("gold_texts")[0]) == _strip_edges(F.col("pred_texts")[0]))).alias("punctuation_only"), normalize(F.col("gold_texts")[0]).alias("_form"),
    )
    return out.drop("_form") if exposure is None else out.join(exposure.select(F.col("text").alias("_form"), "exposure"), "_form", "left").drop("_form")


def boundary_summary(boundary: DataFrame) -> DataFrame:
    """boundary_kind, matched_edge, count, share, and for one-to-one kinds medians of absolute offsets and shares of flags."""
    one = F.col("boundary_kind").isin(*ONE_TO_ONE)
    only = lambda c: F.when(one, c)
    sums = boundary.groupBy("boundary_kind", "matched_edge").agg(
        F.count(F.lit(1)).alias("count"), F.median(only(F.abs("start_offset"))).alias("median_abs_start_offset"), F.median(only(F.abs("end_offset"))).alias("median_abs_end_offset"),
        F.avg(only(F.col("off_by_one").cast("int"))).alias("off_by_one_share"), F.avg(only(F.col("punctuation_only").cast("int"))).alias("punctuation_only_share"),
    )
    # a row for each kind and edge
    return sums.withColumn("share", ratio(F.col("count"), F.sum("count").over(W.partitionBy())))


def oracle_budget(units: DataFrame) -> DataFrame:
    """scenario, units, tp, fp, fn, observed_f1, oracle_f1, gain: strict F1 if one kind of error were put right."""
    n_gold, n_pred, error = F.size("gold_ids"), F.size("pred_ids"), F.col("error_type") != "CORRECT"
    total = lambda cond, n: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    f1 = lambda tp, fp, fn: F.round(ratio(2 * tp, 2 * tp + fp + fn), 4)
    fixed = {name: F.col("error_type").isin(*kinds) for name, kinds in SCENARIOS.items()}
    sums = units.agg(F.count_if(~error).alias("tp"), total(error, n_pred).alias("fp"), total(error, n_gold).alias("fn"), *(c for name, cond in fixed.items() for c in (F.count_if(cond).alias(f"{name}_units"), total(cond, n_gold).alias(f"{name}_gold"), total(cond, n_pred).alias(f"{name}_pred"))))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rows = []
    for name in SCENARIOS:
        after = tp + F.col(f"{name}_gold"), fp - F.col(f"{name}_pred"), fn - F.col(f"{name}_gold")
        rows.append(F.struct(F.lit(name).alias("scenario"), F.col(f"{name}_units").alias("units"), *(c.alias(n) for n, c in zip(("tp", "fp", "fn"), after, strict=True)), f1(tp, fp, fn).alias("observed_f1"), f1(*after).alias("oracle_f1"), F.round(f1(*after) - f1(tp, fp, fn), 4).alias("gain")))
    return sums.select(F.inline(F.array(*rows)))


def overlap_sensitivity(events: DataFrame, thresholds: list[float], chosen: float = 0.6) -> DataFrame:
    """threshold, chosen, a count for each error type, fragmented, merged: the units when pairing needs more or less overlap.
    All thresholds are paired in one plan."""
    every = events.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in sorted({*thresholds, chosen})))))
    units = pair_errors(every, F.col("threshold"), ["threshold"])
    of = lambda c, v: F.count_if(F.col(c) == v).alias(v.lower())
    return units.groupBy("threshold").agg(*(of("error_type", t) for t in ERROR_TYPES), of("boundary_kind", "FRAGMENTED"), of("boundary_kind", "MERGED")).withColumn("chosen", F.col("threshold") == float(chosen))


def error_surfaces(units: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """surface, total and a count for each error type, of the normalised text of a unit's first gold span, or prediction."""
    from ..functions.text import mention_form

    wrong = units.filter("error_type <> 'CORRECT'").select("unit_id", "filename", "error_type", "gold_ids", "pred_ids")
    held = F.size("gold_ids") > 0
    texts = None
    for spans, ids, cond in ((gold, "gold_ids", held), (predicted, "pred_ids", ~held)):
        numbers = numbered(spans).select("filename", F.col("at").alias("_id"), "text")
        one = wrong.filter(cond).withColumn("_id", F.col(ids)[0]).join(numbers, ["filename", "_id"]).select("error_type", "text")
        texts = one if texts is None else texts.unionByName(one)
    # the function sees each distinct text once
    counts = texts.groupBy("text").agg(*(F.count_if(F.col("error_type") == t).alias(t.lower()) for t in ERROR_TYPES[1:]))
    sums = counts.groupBy(mention_form(F.col("text")).alias("surface")).agg(*(F.sum(t.lower()).alias(t.lower()) for t in ERROR_TYPES[1:]))
    return sums.withColumn("total", sum((F.col(t.lower()) for t in ERROR_TYPES[1:]), F.lit(0)))


def exposure(texts: DataFrame, training: DataFrame, threshold: float = 0.8) -> DataFrame:
    """text, nearest, similarity, exposure (SEEN, LEXICALLY_SIMILAR, NOVEL), frequency of distinct normalised `texts` (text)
    among the normalised forms of `training` (text). Forms below the threshold are NOVEL with a null nearest form."""
    from .linking import normalize, similar_texts

    forms = training.select(normalize(F.col("text")).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("frequency"))
    t = texts.select(normalize(F.col("text")).alias("text")).distinct()
    scored = similar_texts(t, forms.select(F.col("form").alias("norm")), threshold).withColumnsRenamed({"norm": "form", "score": "similarity"})
    first = F.row_number().over(W.partitionBy("text").orderBy(F.desc("similarity"), "form"))
    best = scored.withColumn("n", first).filter("n = 1").select("text", F.col("form").alias("nearest"), "similarity")
    out = t.join(best, "text", "left").join(forms.withColumnRenamed("form", "text"), "text", "left").na.fill(0, ["frequency"])
    kind = F.when(F.col("similarity") == 1, "SEEN").when(F.col("similarity").isNotNull(), "LEXICALLY_SIMILAR").otherwise("NOVEL")
    return out.select("text", "nearest", "similarity", kind.alias("exposure"), "frequency")


def similarity_bin(similarity: Column) -> Column:
    """The bin of a similarity; without one, the last."""
    out = F.lit(list(SIMILARITY_BINS)[-1])
    for name, low in reversed(list(SIMILARITY_BINS.items())[:-1]):
        out = F.when(similarity >= low, name).otherwise(out)
    return out


def frequency_bin(frequency: Column) -> Column:
    out = F.lit(">20")
    for name, high in reversed(FREQUENCY_BINS.items()):
        out = F.when(frequency <= high, name).otherwise(out)
    return out


def word_count_bin(words: Column) -> Column:
    return F.when(words >= 5, "5+").otherwise(F.greatest(words, F.lit(1)).cast("string"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_score, exact_share of (score, correct): right-closed bins between distinct quantiles."""
    # three passes over two columns: what they derive from is computed once
    scored = written(scored.select("score", "correct"))
    cuts = sorted(set(quantile_edges(scored, "score", [i / bins for i in range(bins + 1)])))
    bucket = F.lit(0)
    for i, cut in enumerate(cuts[1:-1], 1):
        bucket = F.when(F.col("score") > cut, F.lit(i)).otherwise(bucket)
    return scored.groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("correct").cast("double")).alias("exact_share"))


def confidence_by_outcome(scored: DataFrame) -> DataFrame:
    points = (0.1, 0.25, 0.5, 0.75, 0.9)
    found = scored.groupBy("outcome").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.percentile("score", F.array(*map(F.lit, points))).alias("q"))
    return found.select("outcome", "n", "mean", *(F.col("q")[i].alias(f"q{round(100 * p):02}") for i, p in enumerate(points)))


def resampled_ratio(documents: DataFrame, draws: DataFrame, num: Column, den: Column) -> DataFrame:
    """sample, value: sum of weighted num over sum of weighted den of (filename, ...) by draws (sample, filename, weight)."""
    rows = documents.join(draws, "filename").select("sample", (F.col("weight") * num).alias("a"), (F.col("weight") * den).alias("b"))
    return rows.groupBy("sample").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("b > 0").select("sample", (F.col("a").cast("double") / F.col("b")).alias("value"))


def interval(values: DataFrame, confidence: float = 0.95) -> DataFrame:
    low = (1 - confidence) / 2
    return values.agg(F.percentile("value", F.lit(low)).alias("low"), F.percentile("value", F.lit(1 - low)).alias("high"), F.count(F.lit(1)).alias("samples"))


#: Ratio metrics of the bootstrap: numerator and denominator counts of a document, and the weight of the numerator.
INTERVAL_METRICS = {
    "span_strict_precision": ("strict_tp", ("strict_tp", "strict_fp"), 1),
    "span_strict_recall": ("strict_tp", ("strict_tp", "strict_fn"), 1),
    "span_strict_f1": ("strict_tp", ("strict_tp", "strict_fp", "strict_fn"), 2),
    "char_precision": ("char_correct", ("char_correct", "char_spurious"), 1),
    "char_recall": ("char_correct", ("char_correct", "char_missed"), 1),
    "char_f1": ("char_correct", ("char_correct", "char_spurious", "char_missed"), 2),
    "entity_char_precision": ("entity_char_predicted_credit", ("entity_char_predicted",), 1),
    "entity_char_recall": ("entity_char_gold_credit", ("entity_char_gold",), 1),
}


def bootstrap_draws(documents: DataFrame, samples: int = 2000, random_state: int = 42) -> DataFrame:
    """sample, filename, weight: how often each document is drawn in each resample of as many documents, 0 left out.

    Each sample has a generator of its own, seeded by random_state and its number; a task holds the weights of one
    sample at a time. The documents are the distinct filenames, in their order.
    """
    if samples < 1:
        raise ValueError("the bootstrap needs one sample at least")
    spark = documents.sparkSession
    names = documents.select("filename").distinct().orderBy("filename").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("filename string, place long")
    n = names.count()

    def draw(batches):
        for batch in batches:
            for sample in batch.column(0).to_pylist():
                weight = np.random.default_rng([random_state, sample]).multinomial(n, np.full(n, 1 / n))
                place = np.flatnonzero(weight)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), sample)), pa.array(place), pa.array(weight[place])], ["sample", "place", "weight"])

    drawn = spark.range(samples if n else 0).mapInArrow(draw, "sample long, place long, weight long")
    return drawn.join(names, "place").select("sample", "filename", "weight")


def bootstrap_intervals(documents: DataFrame, draws: DataFrame, confidence: float = 0.95) -> DataFrame:
    """metric, estimate, low, high of the strict, character and entity-character precision, recall and F1.

    `documents` has a row for each filename with the counts that INTERVAL_METRICS names. Strict and character F1 is
    2 TP / (2 TP + FP + FN); entity-character F1 is the harmonic mean of each resample's precision and recall. Resamples
    without a denominator are left out; a metric without any has nulls.
    """
    counts = sorted({c for num, den, _ in INTERVAL_METRICS.values() for c in (num, *den)})
    total = documents.agg(*(F.sum(F.col(c).cast("double")).alias(c) for c in counts)).select(F.lit(None).cast("long").alias("sample"), *counts)
    drawn = documents.join(draws, "filename").groupBy("sample").agg(*(F.sum(F.col(c).cast("double") * F.col("weight")).alias(c) for c in counts))

    def value(num: str, den: tuple[str, ...], weight: int) -> Column:
        below = sum((F.col(c) for c in den[1:]), F.col(den[0])) + (weight - 1) * F.col(num)
        return F.when(below > 0, weight * F.col(num) / below)

    values = {m: value(*parts) for m, parts in INTERVAL_METRICS.items()}
    p, r = values["entity_char_precision"], values["entity_char_recall"]
    values["entity_char_f1"] = F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
    rows = total.unionByName(drawn.select("sample", *counts)).select("sample", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in values.items()))))
    tail, kept = (1 - confidence) / 2, F.when(F.col("sample").isNotNull(), F.col("value"))
    return rows.groupBy("metric").agg(F.max(F.when(F.col("sample").isNull(), F.col("value"))).alias("estimate"), F.percentile(kept, F.lit(tail)).alias("low"), F.percentile(kept, F.lit(1 - tail)).alias("high"))


def document_scores(events: DataFrame, gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row for each document with a span: counts and strict, character and entity-character scores of it alone, with the
    columns that `bootstrap_intervals` takes."""
    strict = events.groupBy("filename").agg(*(F.count_if(F.col("outcome") == o).alias(f"strict_{o.lower()}") for o in ("TP", "FP", "FN")))
    scored = with_prf(strict, "strict_tp", "strict_fp", "strict_fn").withColumnsRenamed({c: f"strict_{c}" for c in ("precision", "recall", "f1")})
    shared = shared_length(gold, predicted, ["filename", "label"]).groupBy("filename").agg(F.sum("shared").alias("char_correct"), (F.sum("right") - F.sum("shared")).alias("char_spurious"), (F.sum("left") - F.sum("shared")).alias("char_missed"))
    distinct = predicted.select(*KEY).distinct()
    recall = entity_credits(with_span_id(gold.select(*KEY)), distinct).groupBy("filename").agg(F.sum("credit").alias("entity_char_gold_credit"), F.count(F.lit(1)).alias("entity_char_gold"))
    precision = entity_credits(with_span_id(distinct), gold).groupBy("filename").agg(F.sum("credit").alias("entity_char_predicted_credit"), F.count(F.lit(1)).alias("entity_char_predicted"))
    sizes = [df.groupBy("filename").agg(F.count(F.lit(1)).alias(n)) for df, n in ((gold, "n_gold"), (predicted, "n_predicted"))]
    out = scored
    for other in (*sizes, shared, recall, precision):
        out = out.join(other, "filename", "left")
    return out.na.fill(0)


def gold_structure(gold: DataFrame) -> DataFrame:
    """span_id, overlapping, nested of every gold span against the others of its document."""
    n = with_span_id(gold)
    a = n.select("filename", "span_id", "start_span", "end_span")
    hit = overlap_join(a, n.select("filename", F.col("span_id").alias("o"), F.col("start_span").alias("_s"), F.col("end_span").alias("_e")), ["filename"]).filter("span_id <> o")
    nested = ((F.col("_s") <= F.col("start_span")) & (F.col("end_span") <= F.col("_e"))) | ((F.col("start_span") <= F.col("_s")) & (F.col("_e") <= F.col("end_span")))
    flags = hit.groupBy("span_id").agg(F.lit(True).alias("overlapping"), F.max(nested).alias("nested"))
    return a.select("span_id").join(flags, "span_id", "left").na.fill(False, ["overlapping", "nested"])


def mention_features(texts: Column) -> dict[str, Column]:
    """Traits of a mention's surface, by name. Words are UAX #29 words; acronyms have letters, 12 characters and 3 words at
    most, and 60 % of their letters in upper case."""
    from .stats import words

    count = F.greatest(F.size(words(texts)), F.lit(1))
    letters, upper = F.regexp_count(texts, F.lit(r"\p{L}")), F.regexp_count(texts, F.lit(r"\p{Lu}"))
    cased, title = texts.rlike(r"[\p{Lu}\p{Ll}\p{Lt}]"), texts.rlike(r"^([^\p{Lu}\p{Ll}\p{Lt}]*[\p{Lu}\p{Lt}]\p{Ll}*(?![\p{Lu}\p{Ll}\p{Lt}]))+[^\p{Lu}\p{Ll}\p{Lt}]*$")
    casing = F.when(letters == 0, "UNCASED").when(cased & (texts == F.upper(texts)), "UPPERCASE").when(cased & (texts == F.lower(texts)), "LOWERCASE").when(title, "TITLECASE").otherwise("MIXEDCASE")
    return {
        "word_count": count,
        "word_count_bin": word_count_bin(count),
        "casing": casing,
        "acronym_like": (letters > 0) & (F.length(texts) <= 12) & (count <= 3) & (upper >= 0.6 * letters),
        "has_digit": texts.rlike(r"\p{Nd}"),
        "has_punctuation": texts.rlike(r"\p{P}"),
        "has_parentheses": texts.rlike(r"[\p{Ps}\p{Pe}]"),
        "has_hyphen": texts.rlike(r"\p{Pd}"),
        "has_slash": texts.contains("/"),
        "has_greek": texts.rlike(r"\p{IsGreek}"),
    }


def describe_mentions(spans: DataFrame, events: DataFrame, side: str, other: DataFrame, exposures: DataFrame | None = None) -> DataFrame:
    """One row for each span (with a text) of a side, `gold` or `pred`: outcome (its unit's type, of events with units),
    characters, covered_characters, entity_char_credit, features, for gold its structure, and with `exposures` (see
    `exposure`) its exposure and the bins of similarity and frequency."""
    from .linking import normalize

    own = numbered(spans).withColumn("span_id", F.concat_ws("#", "filename", "at"))
    outcome = events.filter(F.col(f"{side}_id").isNotNull()).select("filename", F.col(f"{side}_id").alias("at"), F.col("error_type").alias("outcome"))
    out = own.join(outcome, ["filename", "at"], "left").withColumn("characters", (F.col("end_span") - F.col("start_span")).cast("long"))
    out = out.join(covered(own, other, ["filename"], "span_id").withColumnRenamed("covered", "covered_characters"), "span_id")
    out = out.join(entity_credits(own.select("span_id", *KEY), other).select("span_id", F.col("credit").alias("entity_char_credit")), "span_id")
    features = own.select("text").distinct()
    traits = mention_features(F.col("text"))
    out = out.join(features.select("text", *(c.alias(n) for n, c in traits.items())), "text")
    if side == "gold":
        a = own.select("filename", "span_id", "start_span", "end_span")
        hit = overlap_join(a, own.select("filename", F.col("span_id").alias("o"), F.col("start_span").alias("_s"), F.col("end_span").alias("_e")), ["filename"]).filter("span_id <> o")
        nested = ((F.col("_s") <= F.col("start_span")) & (F.col("end_span") <= F.col("_e"))) | ((F.col("start_span") <= F.col("_s")) & (F.col("_e") <= F.col("end_span")))
        out = out.join(hit.groupBy("span_id").agg(F.lit(True).alias("overlapping"), F.max(nested).alias("nested")), "span_id", "left").na.fill(False, ["overlapping", "nested"])
    if exposures is not None:
        e = exposures.select(F.col("text").alias("_form"), "exposure", "similarity", "nearest", "frequency")
        out = out.withColumn("_form", normalize(F.col("text"))).join(e, "_form", "left").drop("_form")
        out = out.withColumns({"similarity_bin": similarity_bin(F.col("similarity")), "frequency_bin": frequency_bin(F.col("frequency"))})
    return out


def confidence_sweep(gold: DataFrame, predicted: DataFrame, points: int = 20) -> DataFrame:
    """threshold, n_pred, tp, precision, recall, f1 of strict matching at the distinct quantiles of the score.

    Each equal span pairs off one to one, best scores first, so one pass of matching serves every threshold.
    """
    cuts = quantile_edges(predicted, "score", [i / points for i in range(points + 1)])
    n_gold = gold.count()
    g = gold.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_gold"))
    nth = F.row_number().over(W.partitionBy(*KEY).orderBy(F.desc("score")))
    p = predicted.withColumn("nth", nth).join(g, KEY, "left").select("score", (F.col("nth") <= F.coalesce("n_gold", F.lit(0))).cast("int").alias("hit"))
    # a row for each score and threshold that it reaches
    at = p.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hit")).select("n", "hit", F.explode(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: F.col("score") >= c)).alias("threshold"))
    sums = at.groupBy("threshold").agg(F.sum("n").alias("n_pred"), F.sum("hit").alias("tp"))
    return sums.select("threshold", "n_pred", "tp", ratio(F.col("tp"), F.col("n_pred")).alias("precision"), ratio(F.col("tp"), F.lit(n_gold)).alias("recall"), ratio(2 * F.col("tp"), F.col("n_pred") + F.lit(n_gold)).alias("f1"))


def subgroup_value(name: str, column: Column) -> Column:
    """A family's value as text; traits are absent or present."""
    return F.when(column, "present").otherwise("absent") if name in (*TRAITS, "overlapping", "nested") else column.cast("string")


def subgroups(mentions: DataFrame, families: list[str], measure: str = "recall", draws: DataFrame | None = None, confidence: float = 0.95) -> DataFrame:
    """family, value, support, a count for each outcome, and the strict, char and entity_char `measure`, of mentions (see
    `describe_mentions`); with `draws` (sample, filename, weight) also the interval of each measure."""
    pairs = F.array(*(F.struct(F.lit(n).alias("family"), subgroup_value(n, F.col(n)).alias("value")) for n in families))
    parts = {"strict": ((F.col("outcome") == "CORRECT").cast("long"), F.lit(1)), "char": (F.col("covered_characters"), F.col("characters")), "entity_char": (F.col("entity_char_credit"), F.lit(1))}
    named = [c.alias(f"_{k}_{n}") for k, both in parts.items() for n, c in zip(("num", "den"), both, strict=True)]
    sums = [f"_{k}_{n}" for k in parts for n in ("num", "den")]
    counts = ["support", *(t.lower() for t in ERROR_TYPES)]
    # equal mentions (of a document, if it is drawn) are summed before they are given to their families
    own = ["filename"] if draws is not None else []
    held = mentions.select(*own, *families, "outcome", *named).groupBy(*own, *families, "outcome").agg(F.count(F.lit(1)).alias("support"), *(F.sum(c).alias(c) for c in sums))
    held = held.select(*own, "support", *(F.when(F.col("outcome") == t, F.col("support")).otherwise(0).alias(t.lower()) for t in ERROR_TYPES), *sums, F.inline(pairs))
    total = lambda columns, weight=F.lit(1): [F.sum(F.col(c) * weight).alias(c) for c in columns]
    if draws is not None:
        # sample null, of weight 1, is the document itself: estimates and intervals come from one pass over the mentions
        drawn = draws.groupBy("filename").agg(F.collect_list(F.struct(F.col("sample"), F.col("weight"))).alias("_draws"))
        kinds = dict(draws.dtypes)
        itself = F.array(F.struct(F.lit(None).cast(kinds["sample"]).alias("sample"), F.lit(1).cast(kinds["weight"]).alias("weight")))
        per = held.groupBy("filename", *GROUP).agg(*total([*counts, *sums])).join(drawn, "filename", "left")
        per = per.select(*GROUP, *counts, *sums, F.inline(F.concat(itself, F.coalesce("_draws", F.array().cast(f"array<struct<sample:{kinds['sample']},weight:{kinds['weight']}>>")))))
        held = per.select(*GROUP, "sample", *((F.col(c) * F.col("weight")).alias(c) for c in (*counts, *sums)))
    return subgroup_measures(held, measure, confidence)


def subgroup_measures(sums: DataFrame, measure: str = "recall", confidence: float = 0.95) -> DataFrame:
    """The rows of `subgroups` from partial sums by family, value and, if there is such a column, sample; see
    `documents.subgroup_sums`. Sample null is the estimate, the others give the intervals."""
    parts = ("strict", "char", "entity_char")
    counts, both = ["support", *(t.lower() for t in ERROR_TYPES)], [f"_{k}_{n}" for k in parts for n in ("num", "den")]
    ends = []
    if "sample" in sums.columns:
        sums = sums.groupBy(*GROUP, "sample").agg(*(F.sum(c).alias(c) for c in (*counts, *both)))
        tail = (1 - confidence) / 2
        for k in parts:
            share = F.when(F.col("sample").isNotNull() & (F.col(f"_{k}_den") > 0), F.col(f"_{k}_num") / F.col(f"_{k}_den"))
            ends += [F.percentile(share, F.lit(tail)).alias(f"{k}_{measure}_low"), F.percentile(share, F.lit(1 - tail)).alias(f"{k}_{measure}_high")]
    whole = lambda c: F.sum(F.when(F.col("sample").isNull(), F.col(c)) if ends else F.col(c)).alias(c)
    found = sums.groupBy(*GROUP).agg(*map(whole, [*counts, *both]), *ends)
    lows = [f"{k}_{measure}_{end}" for k in parts for end in ("low", "high")] if ends else []
    return found.select(*GROUP, *(F.col(c).cast("long").alias(c) for c in counts), *(ratio(F.col(f"_{k}_num"), F.col(f"_{k}_den")).alias(f"{k}_{measure}") for k in parts), *lows)


def has_varying_scores(predicted: DataFrame, least: float = 0.01) -> bool:
    """Whether there are two scores at least, `least` apart."""
    if "score" not in predicted.columns:
        return False
    found = predicted.agg(F.count("score").alias("n"), (F.max(F.col("score").cast("double")) - F.min(F.col("score").cast("double"))).alias("range")).first()
    return found["n"] > 1 and found["range"] >= least
