"""Stratified splits with manifests, their checks, balance reports and fold aggregates."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..naming import partition_names
from .corpus import entities, fingerprints


def label_counts(corpus: DataFrame) -> DataFrame:
    """doc_id, label, n in long form; a document without entities has one row with a null label and 0."""
    counts = entities(corpus).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return corpus.select("doc_id").join(counts, "doc_id", "left").na.fill(0, ["n"])


def normalize_ratios(ratios: list[float]) -> list[float]:
    if len(ratios) < 2 or min(ratios) <= 0:
        raise ValueError("two ratios above 0 at least")
    return [r / sum(ratios) for r in ratios]


def assign_once(counts: np.ndarray, ratios: list[float], rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """(objective, partition of each row) of one greedy run over a documents x labels matrix.

    Documents with rare labels go first, ties at random. Each goes to the open partition where the squared deviations of
    labels, of entities (a quarter) and of documents (a tenth), over their scales, grow least.
    """
    n, k = len(counts), len(ratios)
    exact = np.array(ratios) * n
    room = np.floor(exact).astype(int)
    order = np.lexsort((rng.random(k), -(exact - room)))
    room[order[: n - room.sum()]] += 1
    totals, sizes = counts.sum(0), counts.sum(1)
    rarity = (counts / np.maximum(totals, 1)).sum(1)
    feature = np.column_stack([counts, sizes, np.ones(n)]).astype(float)
    goal = np.outer(room / max(n, 1), feature.sum(0))
    scale = np.sqrt(np.maximum(goal, 1) * np.maximum(feature.sum(0) / k, 1))
    weight = np.array([1.0] * counts.shape[1] + [0.25, 0.1])
    state, out = np.zeros_like(goal), np.empty(n, int)
    for i in np.lexsort((rng.random(n), -sizes, -rarity)):
        before, after = (state - goal) / scale, (state + feature[i] - goal) / scale
        cost = ((after**2 - before**2) * weight).sum(1)
        cost[room == 0] = np.inf
        best = np.flatnonzero(cost <= cost.min() + 1e-12)
        p = int(best[0] if len(best) == 1 else rng.choice(best))
        out[i], room[p] = p, room[p] - 1
        state[p] += feature[i]
    return float(((((state - goal) / scale) ** 2) * weight).sum()), out


def stratify(corpus: DataFrame, ratios: list[float], random_state: int = 42, n_restarts: int = 64) -> DataFrame:
    """doc_id, partition: the best of `n_restarts` greedy runs, the restarts as tasks.

    The matrix of one split is the unit of work and is sent to every restart: annotated corpora are small; for larger
    ones split strata apart first.
    """
    ratios = normalize_ratios(ratios)
    long = label_counts(corpus).toPandas()
    if long.doc_id.nunique() < len(ratios):
        raise ValueError(f"{len(ratios)} partitions need as many documents at least, not {long.doc_id.nunique()}")
    wide = long.pivot_table(index="doc_id", columns="label", values="n", fill_value=0, aggfunc="sum", dropna=True)
    ids = sorted(long.doc_id.unique())
    matrix = wide.reindex(ids, fill_value=0).to_numpy(float) if len(wide.columns) else np.zeros((len(ids), 1))
    spark = corpus.sparkSession

    def run(batches):
        for pdf in batches:
            for i in pdf.id:
                objective, found = assign_once(matrix, ratios, np.random.default_rng(random_state + int(i)))
                yield pd.DataFrame([(int(i), objective, found.tolist())], columns=["restart", "objective", "found"])

    best = spark.range(n_restarts).mapInPandas(run, "restart long, objective double, found array<int>").orderBy("objective", "restart").first()
    return spark.createDataFrame(pd.DataFrame({"doc_id": ids, "partition": best["found"], "objective": best["objective"]}), "doc_id string, partition int, objective double")


def assign_partitions(corpus: DataFrame, ratios: list[float], names: list[str] | None = None, random_state: int = 42, n_restarts: int = 64, holdout: int | None = None) -> DataFrame:
    """The manifest of a split: a fingerprinted row for each document."""
    names = partition_names(len(ratios), holdout, names)
    found = stratify(corpus, ratios, random_state, n_restarts)
    rows = found.join(fingerprints(corpus), "doc_id").join(corpus.select("doc_id", "n_entities"), "doc_id")
    named = F.element_at(F.array(*map(F.lit, names)), F.col("partition") + 1)
    return rows.select("doc_id", "document_fingerprint", "n_entities", F.col("partition").cast("short").alias("fold"), F.lit("stratified").alias("strategy"), F.lit(json.dumps(normalize_ratios(ratios))).alias("ratios"), F.lit(len(ratios)).cast("short").alias("n_partitions"), F.lit(random_state).cast("long").alias("random_state"), F.lit(n_restarts).cast("short").alias("n_restarts"), F.col("objective").alias("stratification_objective"), F.lit(holdout).cast("short").alias("holdout_index"), named.alias("partition_name"))


def check_assignments(corpus: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id, problem: missing, unknown, changed and repeated documents of a manifest."""
    now = fingerprints(corpus).withColumnRenamed("document_fingerprint", "now")
    both = now.join(manifest.select("doc_id", "document_fingerprint"), "doc_id", "full")
    problem = F.when(F.col("now").isNull(), "unknown").when(F.col("document_fingerprint").isNull(), "missing").when(F.col("now") != F.col("document_fingerprint"), "changed")
    twice = manifest.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit("repeated").alias("problem"))
    return both.select("doc_id", problem.alias("problem")).filter("problem IS NOT NULL").unionByName(twice)


def balance_report(labelled: DataFrame, folds: list[float]) -> DataFrame:
    """metric, fold, observed, expected, difference of (doc_id, fold, label, n): documents, entities and each label.

    Documents are expected by ratio, everything else by the fold's share of the documents; missing folds count 0.
    """
    spark = labelled.sparkSession
    docs = labelled.select("doc_id", "fold").distinct().groupBy("fold").agg(F.count(F.lit(1)).alias("observed")).select(F.lit("n_documents").alias("metric"), "fold", "observed")
    ents = labelled.groupBy("fold").agg(F.sum("n").alias("observed")).select(F.lit("n_entities").alias("metric"), "fold", "observed")
    labels = labelled.filter("label IS NOT NULL").groupBy(F.concat(F.lit("label:"), "label").alias("metric"), "fold").agg(F.sum("n").alias("observed"))
    seen = docs.unionByName(ents).unionByName(labels)
    ratio = spark.createDataFrame([(i, float(r)) for i, r in enumerate(folds)], "fold int, ratio double")
    # a row for each metric and fold
    grid = seen.select("metric").distinct().withColumn("fold", F.explode(F.lit(list(range(len(folds))))))
    full = grid.join(seen, ["metric", "fold"], "left").na.fill(0, ["observed"]).join(F.broadcast(ratio), "fold")
    by_metric = W.partitionBy("metric")
    share = docs.select("fold", F.col("observed").alias("d"))
    total = docs.agg(F.sum("observed")).first()[0] or 1
    full = full.join(F.broadcast(share), "fold", "left").na.fill(0, ["d"])
    expected = F.sum("observed").over(by_metric) * F.when(F.col("metric") == "n_documents", F.col("ratio")).otherwise(F.col("d") / F.lit(total))
    return full.withColumn("expected", expected).select("metric", "fold", "observed", "expected", F.when(F.col("expected") > 0, F.col("observed") / F.col("expected") - 1).otherwise(0.0).alias("difference"))


def aggregate_metrics(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Mean and sample deviation of each column; a single run deviates by 0."""
    aggs = [a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))]
    return rows.groupBy(*by).agg(*aggs)


def best_epochs(epochs: DataFrame, run: str, epoch: str, metric: str, greater: bool = True) -> DataFrame:
    """The best row of each run, the earliest among equals."""
    order = F.desc(metric) if greater else F.asc(metric)
    return epochs.withColumn("_n", F.row_number().over(W.partitionBy(run).orderBy(order, epoch))).filter("_n = 1").drop("_n")


def integrity(manifest: DataFrame) -> DataFrame:
    """problem, n: documents in several partitions, partitions without documents, names with several folds; no row is right."""
    twice = manifest.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated document").alias("problem"), "n")
    folds = manifest.agg(F.count_distinct("fold").alias("k"), F.max("n_partitions").alias("p")).select(F.lit("empty partition").alias("problem"), (F.col("p") - F.col("k")).cast("long").alias("n"))
    names = manifest.groupBy("partition_name").agg(F.count_distinct("fold").alias("k")).filter("k > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("name of several folds").alias("problem"), "n")
    return twice.unionByName(folds).unionByName(names).filter("n > 0")


def manifest_settings(manifest: DataFrame) -> dict:
    """ratios, n_partitions, holdout_index, partition names by fold, of a manifest whose rows agree; others raise."""
    found = manifest.select("ratios", "n_partitions", "holdout_index").distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("the rows of the manifest don't agree on their split")
    names = {r["fold"]: r["partition_name"] for r in manifest.select("fold", "partition_name").distinct().collect()}
    return {"ratios": json.loads(found[0]["ratios"]), "n_partitions": found[0]["n_partitions"], "holdout_index": found[0]["holdout_index"], "partition_names": [names[i] for i in sorted(names)]}
