"""Ontology graph: closures, undirected distances, and where a predicted code stands to a gold one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .linking import list_metrics
from .scoring import ratio

DIRECTIONS = ("exact", "narrow", "broad")


def graph(hierarchy: DataFrame, concepts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes are code and semantic_tag of every concept and edge end, edges parent, child, relation."""
    relation = F.coalesce(F.nullif(F.trim("relation"), F.lit("")), F.lit("is_a")) if "relation" in hierarchy.columns else F.lit("is_a")
    edges = hierarchy.select("parent", "child", relation.alias("relation")).dropDuplicates(["parent", "child"])
    ends = edges.select(F.col("parent").alias("code")).union(edges.select("child")).withColumn("semantic_tag", F.lit(None).cast("string"))
    known = ends if concepts is None else ends.unionByName(concepts.select("code", (F.col("semantic_tag") if "semantic_tag" in concepts.columns else F.lit(None)).cast("string").alias("semantic_tag")))
    return known.groupBy("code").agg(F.max("semantic_tag").alias("semantic_tag")), edges


def _grown(start: DataFrame, steps: DataFrame) -> DataFrame:
    """code, reached, distance: least number of steps (at, to) from each code to all that it reaches, 0 to itself.

    A join for each level, and each level is written, so a plan holds one of them; pairs that are known aren't followed
    again, so cycles end and no depth is too great.
    """
    found = written(start.select("code", F.col("code").alias("reached"), F.lit(0).alias("distance")))
    level, d = found, 0
    while True:
        d += 1
        onward = level.select("code", F.col("reached").alias("at")).join(steps, "at").select("code", F.col("to").alias("reached")).distinct()
        level = written(onward.join(found.select("code", "reached"), ["code", "reached"], "left_anti").withColumn("distance", F.lit(d)))
        if level.isEmpty():
            return found
        found = written(found.unionByName(level))


def ancestors(edges: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """code, ancestor, distance (least) over edges (parent, child); every node is its own ancestor at 0. With `codes` (code)
    only theirs are followed."""
    nodes = edges.select(F.col("parent").alias("code")).union(edges.select("child")).distinct()
    start = nodes if codes is None else nodes.join(codes.select("code").distinct(), "code", "left_semi")
    return _grown(start, edges.select(F.col("child").alias("at"), F.col("parent").alias("to")).distinct()).withColumnRenamed("reached", "ancestor")


def relations(pairs: DataFrame, edges: DataFrame, tags: DataFrame) -> DataFrame:
    """The columns of `pairs` (gold, pred, ...) with direction, distance, gold_tag, pred_tag, same_tag.

    exact: one code (0). narrow: the prediction lies below gold. broad: above it, or a relative of the same tag with a common
    ancestor. Else, and where a code is null or not in the graph, unrelated. The distance is the least number of steps
    down, up, or in any direction, null without a path. `tags` is (code, tag). Only codes of the pairs are followed.
    """
    keys = pairs.select("gold", "pred").distinct()
    needed = keys.select(F.col("gold").alias("code")).union(keys.select("pred")).filter("code IS NOT NULL").distinct()
    up = written(ancestors(edges, needed))
    above = lambda low, high, name: up.select(F.col("code").alias(low), F.col("ancestor").alias(high), F.col("distance").alias(name))
    both = keys.join(above("pred", "gold", "down"), ["pred", "gold"], "left").join(above("gold", "pred", "up"), ["gold", "pred"], "left")
    common = keys.join(up.select(F.col("code").alias("gold"), "ancestor"), "gold").join(up.select(F.col("code").alias("pred"), "ancestor"), ["pred", "ancestor"]).select("gold", "pred", F.lit(True).alias("common")).distinct()
    t = lambda c: tags.select(F.col("code").alias(c), F.col("tag").alias(f"{c}_tag"))
    found = written(both.join(common, ["gold", "pred"], "left").join(t("gold"), "gold", "left").join(t("pred"), "pred", "left"))
    # whatever way the rest is connected: only gold codes that have no direct path are followed
    rest = found.filter("down IS NULL AND up IS NULL AND gold <> pred").select(F.col("gold").alias("code")).distinct()
    nodes = edges.select(F.col("parent").alias("code")).union(edges.select("child")).distinct()
    ways = edges.select(F.col("parent").alias("at"), F.col("child").alias("to")).union(edges.select("child", "parent")).distinct()
    around = _grown(nodes.join(rest, "code", "left_semi"), ways).select(F.col("code").alias("gold"), F.col("reached").alias("pred"), F.col("distance").alias("around"))
    out = found.join(around, ["gold", "pred"], "left")
    same, tagged = F.col("gold") == F.col("pred"), F.coalesce((F.col("gold_tag") == F.col("pred_tag")) & (F.col("gold_tag") != ""), F.lit(False))
    direction = F.when(same, "exact").when(F.col("down").isNotNull(), "narrow").when(F.col("up").isNotNull(), "broad").when(F.col("around").isNotNull() & tagged & F.col("common"), "broad").otherwise("unrelated")
    out = out.select(F.col("gold").alias("_g"), F.col("pred").alias("_p"), direction.alias("direction"), F.when(same, 0).otherwise(F.coalesce("down", "up", "around")).cast("int").alias("distance"), "gold_tag", "pred_tag", tagged.alias("same_tag"))
    joined = pairs.join(out, pairs["gold"].eqNullSafe(out["_g"]) & pairs["pred"].eqNullSafe(out["_p"]), "left").drop("_g", "_p")
    return joined.na.fill({"direction": "unrelated", "same_tag": False})


def summary(related: DataFrame, by: str | None = None) -> DataFrame:
    """n, count and rate of exact, narrow, broad and non_rel (everything else), mean_distance of those that have one."""
    kind = lambda d: F.col("direction") == d
    tests = {**{d: kind(d) for d in DIRECTIONS}, "non_rel": ~F.col("direction").isin(*DIRECTIONS)}
    grouped = related.groupBy(by) if by else related.groupBy()
    sums = grouped.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(f"{d}_count") for d, c in tests.items()), F.coalesce(F.avg("distance"), F.lit(0.0)).alias("mean_distance"))
    return sums.withColumns({f"{d}_rate": ratio(F.col(f"{d}_count"), F.col("n")) for d in tests})


def first_code(codes: Column) -> Column:
    """The first code of a list, null of an empty one."""
    return F.get(codes, F.lit(0))


def graph_metrics(rows: DataFrame, edges: DataFrame, tags: DataFrame, k_values: tuple[int, ...] = (1, 5), by: str | None = None) -> DataFrame:
    """One row, or with `by` one for each of its values: the summary of the first codes of rows (gold_code, codes) and the
    metrics of their lists."""
    keep = [by] if by else []
    related = relations(rows.select(*keep, F.col("gold_code").alias("gold"), first_code(F.col("codes")).alias("pred")), edges, tags)
    one, two = summary(related, by), list_metrics(rows, k_values, by=by).drop("n")
    if by:
        return one.join(two.withColumnRenamed(by, "_by"), one[by].eqNullSafe(F.col("_by"))).drop("_by")
    return one.withColumn("_k", F.lit(1)).join(two.withColumn("_k", F.lit(1)), "_k").drop("_k")


def direction_table(related: DataFrame, column: str = "direction") -> DataFrame:
    """column, count, mean_distance, normalized (the share of all rows)."""
    total = related.count()
    sums = related.groupBy(column).agg(F.count(F.lit(1)).alias("count"), F.avg("distance").alias("mean_distance"))
    return sums.withColumn("normalized", F.col("count") / F.lit(max(total, 1)))
