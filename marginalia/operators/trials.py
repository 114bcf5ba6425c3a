"""Trial tables of parameter searches: outcomes, noise, dimension effects, convergence, costs, best trials and epochs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..naming import edge_note, split_dimensions

#: What a run reports about its costs. Fixed values.
TOTALS, PEAKS = ("duration_sec", "energy_kwh", "emissions_kg_co2"), ("gpu_peak_vram_allocated_gb", "gpu_peak_vram_reserved_gb")


def trials_table(results: DataFrame, metric: str, config: list[str]) -> DataFrame:
    """trial_id, trial_path, error, the sampled values named in `config`, and what was reported: one row for each result
    (trial_id, path, error, config map, metrics map of doubles). What a result lacks is null."""
    reported = [metric, f"{metric}_std", "n_seeds", "oom", "per_device_train_batch_size", "gradient_accumulation_steps", *TOTALS, *PEAKS]
    numbers = [F.try_element_at("metrics", F.lit(c)).alias(c) for c in reported if c != "oom"]
    return results.select("trial_id", F.col("path").alias("trial_path"), "error", *(F.try_element_at("config", F.lit(c)).alias(c) for c in config), *numbers, (F.try_element_at("metrics", F.lit("oom")) > 0).alias("oom"))


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def with_outcome(trials: DataFrame, metric: str) -> DataFrame:
    """Adds outcome: errored, oom, completed (with a finite score), or unscored."""
    has = lambda c, test: test if c in trials.columns else F.lit(False)
    errored, oom = has("error", F.col("error").isNotNull()), has("oom", F.coalesce(F.col("oom").cast("boolean"), F.lit(False)))
    return trials.withColumn("outcome", F.when(errored, "errored").when(oom, "oom").when(_finite(metric), "completed").otherwise("unscored"))


def best_trial(trials: DataFrame, metric: str, greater: bool = True, key: str = "trial_id") -> DataFrame:
    """The trial with the best finite score, the first by its key among equals; no row where there is none."""
    order = F.desc(metric) if greater else F.asc(metric)
    return trials.filter(_finite(metric)).orderBy(order, key).limit(1)


def spearman(trials: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation of two columns in each group, ties with their mean rank."""
    def rank(c: str):
        w = W.partitionBy(*by).orderBy(c)
        ties = F.count(F.lit(1)).over(W.partitionBy(*by, c))
        return F.rank().over(w) + (ties - 1) / 2

    ranked = trials.select(*by, rank(x).alias("rx"), rank(y).alias("ry"))
    return (ranked.groupBy(*by) if by else ranked.groupBy()).agg(F.try_divide(F.covar_pop("rx", "ry"), F.stddev_pop("rx") * F.stddev_pop("ry")).alias("rho"), F.count(F.lit(1)).alias("n"))


def category_effects(trials: DataFrame, category: str, metric: str) -> DataFrame:
    return trials.groupBy(category).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(F.lit(1)).alias("n"))


def dimension_effects(completed: DataFrame, metric: str, space: Mapping[str, Mapping]) -> DataFrame:
    """dimension, category, rho, mean, std, n: rank correlations of numeric dimensions (of three trials and two values at
    least: those of one value have none), means by category of the others."""
    numeric, categorical = split_dimensions(space)
    out = None
    for name in (n for n in numeric if n in completed.columns):
        one = spearman(completed, name, metric, []).filter("n >= 3").select(F.lit(name).alias("dimension"), F.lit(None).cast("string").alias("category"), "rho", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("std"), "n")
        out = one if out is None else out.unionByName(one)
    for name in (n for n in categorical if n in completed.columns):
        one = category_effects(completed, name, metric).select(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("category"), F.lit(None).cast("double").alias("rho"), "mean", "std", "n")
        out = one if out is None else out.unionByName(one)
    return out.filter("category IS NOT NULL OR rho IS NOT NULL") if out is not None else completed.sparkSession.createDataFrame([], "dimension string, category string, rho double, mean double, std double, n long")


def top_k_mean(epochs: DataFrame, run: str, metric: str, k: int = 3, greater: bool = True) -> DataFrame:
    """Mean of each run's k best values."""
    n = F.row_number().over(W.partitionBy(run).orderBy(F.desc(metric) if greater else F.asc(metric)))
    return epochs.select(run, metric, n.alias("n")).filter(F.col("n") <= k).groupBy(run).agg(F.avg(metric).alias("top_k_mean"))


def noise_scale(trials: DataFrame, std: str, seeds: str) -> DataFrame:
    """Median deviation across seeds of the trials with several seeds and a deviation above 0."""
    return trials.filter((F.col(seeds) > 1) & (F.col(std) > 0)).agg(F.median(std).alias("noise"))


def standing(completed: DataFrame, metric: str, greater: bool = True) -> DataFrame:
    """One row: best, runner_up, gap, noise, tied: how many other trials lie within the noise of the best."""
    sign = 1.0 if greater else -1.0
    scores = completed.select((F.col(metric).cast("double") * sign).alias("s"), F.col(f"{metric}_std").alias("std") if f"{metric}_std" in completed.columns else F.lit(None).cast("double").alias("std"), F.col("n_seeds") if "n_seeds" in completed.columns else F.lit(0).alias("n_seeds"))
    # the two best of each task, then of all
    two = [r["s"] for r in scores.orderBy(F.desc("s")).limit(2).collect()]
    best, second = (F.lit(two[i] if len(two) > i else None).cast("double") for i in (0, 1))
    noise = F.lit(noise_scale(scores, "std", "n_seeds").first()["noise"]).cast("double")
    tied = F.when(noise.isNotNull(), F.count_if(best - F.col("s") <= noise) - 1)
    return scores.agg(F.first(best * sign).alias("best"), F.first(second * sign).alias("runner_up"), F.first(best - second).alias("gap"), F.first(noise).alias("noise"), tied.alias("tied"))


def convergence(epochs: DataFrame, metric: str, cap: int, greater: bool = True, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """One row: runs with evaluated epochs, at_cap (as many epochs as the cap or more), median_best_epoch (the earliest of the
    best ones, from 1, as a whole number)."""
    rows = epochs.filter(F.col("split") == "eval") if "split" in epochs.columns else epochs
    value = F.col(metric).cast("double") * (1.0 if greater else -1.0)
    numbered = rows.select(run, value.alias("v"), F.row_number().over(W.partitionBy(run).orderBy(epoch)).alias("i"))
    per = numbered.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.max_by("i", F.when(F.col("v").isNotNull(), F.struct("v", -F.col("i")))).alias("best"), F.count("v").alias("scored"))
    return per.agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("n") >= cap).alias("at_cap"), F.median(F.when(F.col("scored") > 0, F.col("best"))).cast("int").alias("median_best_epoch"))


def costs(trials: DataFrame) -> DataFrame:
    """One row: totals of time, energy and emissions, peaks of memory, over all trials."""
    return trials.agg(*(F.sum(c).alias(c) for c in TOTALS if c in trials.columns), *(F.max(c).alias(c) for c in PEAKS if c in trials.columns))


def summarize(trials: DataFrame, metric: str, greater: bool, space: Mapping[str, Mapping]) -> str:
    """A report of a search: counts, the best trial and what stands near it, notes on values at the ends of their ranges."""
    marked = with_outcome(trials, metric)
    counts = {r["outcome"]: r["n"] for r in marked.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines = [f"{metric}: " + ", ".join(f"{n} {name}" for name, n in sorted(counts.items()))]
    completed = marked.filter("outcome = 'completed'")
    if not counts.get("completed"):
        return "\n".join([*lines, "no trial completed"])
    place, best = standing(completed, metric, greater).first(), best_trial(completed, metric, greater).first().asDict()
    lines.append(f"best {place['best']:.4f} ({best['trial_id']})" + (f", gap {place['gap']:.4f}" if place["gap"] is not None else ""))
    if place["noise"] is not None:
        lines.append(f"{place['tied']} more within the noise of {place['noise']:.4f}")
    lines += [f"{name} = {best[name]} {edge_note(best[name], spec)}".rstrip() for name, spec in space.items() if name in best]
    spent = costs(trials).first().asDict() if any(c in trials.columns for c in (*TOTALS, *PEAKS)) else {}
    return "\n".join([*lines, *(f"{k} {v:.4g}" for k, v in spent.items() if v is not None)])
