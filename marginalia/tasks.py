"""Tasks by name, and their command line: python -m marginalia.tasks run config.json | tasks."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .session import build_session
from .sources import sinks, tables


def prepare_dataset(spark: SparkSession, output_dir: str, documents: str, annotations: str, codes: str | None = None, on_mismatch: str = "error", on_conflict: str = "raise", on_code_mismatch: str = "raise", ratios: list[float] | None = None, random_state: int = 42, n_restarts: int = 64, normalize_labels: bool = False, overwrite: bool = False) -> dict:
    """Documents and annotations to a validated corpus, and a fingerprinted split of it."""
    from .functions.text import normalize_labels as normal
    from .operators import corpus, split

    docs, ann = tables.read_documents(spark, documents), tables.read_annotations(spark, annotations)
    ann = normal(ann) if normalize_labels else ann
    if codes:
        ann = corpus.resolve_codes(ann, tables.read_codes(spark, codes), on_code_mismatch)
    docs, ann = corpus.resolve_mismatch(docs, ann, on_mismatch)
    docs, ann = corpus.resolve_conflicts(docs, ann, on_conflict)
    sinks.write_corpus(corpus.build_corpus(docs, ann), f"{output_dir}/corpus.parquet", overwrite=overwrite)
    built = spark.read.parquet(f"{output_dir}/corpus.parquet")
    manifest = {"documents": built.count(), "labels": {r["label"]: r["n"] for r in corpus.count_labels(built).collect()}}
    if ratios:
        manifest["partitions"] = create_split(spark, built, f"{output_dir}/split", ratios, random_state=random_state, n_restarts=n_restarts, overwrite=overwrite)
    sinks.write_manifest(spark, manifest, f"{output_dir}/manifest")
    return manifest


def create_split(spark: SparkSession, corpus, output_dir: str, ratios: list[float], holdout: int | None = None, names: list[str] | None = None, random_state: int = 42, n_restarts: int = 64, reuse: bool = True, overwrite: bool = False) -> dict:
    """A stratified split of a corpus, written, with the number of documents in each partition.

    With `reuse` a stored manifest is taken again if it fits the corpus and the settings; one that doesn't raises.
    """
    from .operators import split
    from .session import written

    path = spark._jvm.org.apache.hadoop.fs.Path(f"{output_dir}/manifest/_SUCCESS")
    stored = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    if reuse and stored:
        found = written(spark.read.parquet(f"{output_dir}/manifest"))
        if problems := split.check_assignments(corpus, found).limit(3).collect() + split.integrity(found).collect():
            raise ValueError(f"the stored split doesn't fit the corpus: {[tuple(p) for p in problems]}")
        settings = split.manifest_settings(found)
        if settings["n_partitions"] != len(ratios) or settings["holdout_index"] != holdout or max(abs(a - b) for a, b in zip(settings["ratios"], split.normalize_ratios(ratios), strict=True)) > 1e-9:
            raise ValueError(f"the stored split has other settings: {settings}")
        overwrite = True
    else:
        found = written(split.assign_partitions(corpus, ratios, names, random_state, n_restarts, holdout))
    sinks.write_split(corpus, found, output_dir, overwrite)
    return {r["partition_name"]: r["count"] for r in found.groupBy("partition_name").count().collect()}


def link_entities(spark: SparkSession, output_dir: str, spans: str, gazetteer: str, method: str | list[str] = "tfidf", top_k: int = 25, keep_gold: bool = False, hierarchy: str | None = None, concepts: str | None = None, overwrite: bool = False) -> dict:
    """Spans with a text to linked spans; several methods are fused by reciprocal ranks. Spans with a gold code are scored, and
    with a hierarchy also by where their first code stands in it."""
    from .operators import linking, ontology
    from .operators.retrieval import matcher

    rows = tables.read_spans(spark, spans).withColumn("mention_id", F.xxhash64("filename", "label", "start_span", "end_span"))
    rows = rows if "gold_code" in rows.columns else rows.withColumn("gold_code", F.lit(None).cast("string"))
    g = tables.read_gazetteer(spark, gazetteer)
    names = [method] if isinstance(method, str) else method
    found = {m: matcher(m)(rows, g, k=top_k) for m in names}
    candidates = next(iter(found.values()))
    if len(found) > 1:
        terms = g.groupBy("code").agg(F.min("term").alias("term"))
        candidates = linking.reciprocal_rank_fusion(found, top_k=top_k).join(terms, "code")
    linked = linking.link(rows, candidates)
    out = linking.complete(rows, linked) if keep_gold else linked
    sinks.write_table(out, f"{output_dir}/linked.parquet", overwrite)
    scored = rows.filter("gold_code IS NOT NULL")
    report = {} if keep_gold or scored.isEmpty() else linking.retrieval_metrics(candidates, scored).first().asDict()
    if report and hierarchy:
        nodes, edges = ontology.graph(tables.read_hierarchy(spark, hierarchy), tables.read_concepts(spark, concepts) if concepts else None)
        tops = scored.select("mention_id", F.col("gold_code").alias("gold")).join(candidates.filter("rank = 1").select("mention_id", F.col("code").alias("pred")), "mention_id", "left")
        report |= ontology.summary(ontology.relations(tops, edges, nodes.withColumnRenamed("semantic_tag", "tag"))).drop("n").first().asDict()
    sinks.write_manifest(spark, report, f"{output_dir}/metrics")
    return report


def analyze_predictions(spark: SparkSession, output_dir: str, predictions: str, reference: str, training: str | None = None, target_label: str | None = None, overlap_threshold: float = 0.6, similarity_threshold: float = 0.8, sensitivity: list[float] | None = None, bootstrap_samples: int = 2000, random_state: int = 42, overwrite: bool = False) -> dict:
    """Predictions against gold spans as tables: events, units, mentions, taxonomy, boundaries, budget, surfaces, scores by
    document with intervals, subgroups, and where scores vary, confidence. Returns the rows of each table."""
    from .operators import analysis, scoring
    from .session import written

    gold, pred = tables.read_reference(spark, reference), tables.read_predictions(spark, predictions)
    if target_label:
        gold, pred = tables.read_labelled(spark, gold, target_label, "the reference"), tables.read_predicted(spark, pred, target_label)
    elif gold.isEmpty():
        raise ValueError("the reference has no span")
    events = written(analysis.strict_events(gold, pred))
    units = written(analysis.pair_errors(events, overlap_threshold))
    attached = written(analysis.attach_units(events, units))
    exposures = None
    if training:
        known = tables.read_labelled(spark, training, target_label, "the training data") if target_label else tables.read_reference(spark, training)
        exposures = written(analysis.exposure(gold.select("text").union(pred.select("text")), known.select("text"), similarity_threshold))
    mentions = {side: written(analysis.describe_mentions(own, attached, side, other, exposures)) for side, own, other in (("gold", gold, pred), ("pred", pred, gold))}
    documents = written(analysis.document_scores(events, gold, pred))
    draws = written(analysis.bootstrap_draws(documents, bootstrap_samples, random_state))
    families = ["word_count_bin", "casing", *analysis.TRAITS, *(["exposure", "similarity_bin", "frequency_bin"] if training else [])]
    boundary = written(analysis.boundary_errors(units, gold, pred, exposures))
    made = {
        "events": attached, "units": units, "gold_mentions": mentions["gold"], "predicted_mentions": mentions["pred"], "documents": documents,
        "gold_subgroups": analysis.subgroups(mentions["gold"], [*families, "overlapping", "nested"], "recall", draws), "predicted_subgroups": analysis.subgroups(mentions["pred"], families, "precision", draws),
        "error_taxonomy": analysis.error_taxonomy(units), "boundary_errors": boundary, "boundary_summary": analysis.boundary_summary(boundary), "oracle_error_budget": analysis.oracle_budget(units),
        "overlap_sensitivity": analysis.overlap_sensitivity(events, sensitivity or [0.4, 0.5, 0.7, 0.8], overlap_threshold), "error_surfaces": analysis.error_surfaces(units, gold, pred),
        "bootstrap_intervals": analysis.bootstrap_intervals(documents, draws), "characters": scoring.character_scores(gold, pred), "scenarios": scoring.greedy_scores(gold, pred),
    }
    if analysis.has_varying_scores(pred):
        scored = mentions["pred"].filter("score IS NOT NULL").withColumn("correct", F.col("outcome") == "CORRECT")
        made |= {"confidence_by_outcome": analysis.confidence_by_outcome(scored), "calibration": analysis.calibration(scored), "confidence_sweep": analysis.confidence_sweep(gold, pred.filter("score IS NOT NULL"))}
    paths = sinks.write_tables(made, output_dir, overwrite)
    return {name: spark.read.parquet(path).count() for name, path in paths.items()}


TASKS = {"core.prepare_dataset": prepare_dataset, "nel.link_entities": link_entities, "ner.analyze_predictions": analyze_predictions}


def resolve_task(name: str):
    if name not in TASKS:
        raise ValueError(f"unknown task {name!r}; there are {', '.join(sorted(TASKS))}")
    return TASKS[name]


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["tasks"]:
        print("\n".join(sorted(TASKS)))
        return 0
    if len(argv) != 2 or argv[0] != "run":
        print("usage: run CONFIG.json | tasks", file=sys.stderr)
        return 2
    try:
        with open(argv[1], encoding="utf-8") as f:
            config = json.load(f)
        print(json.dumps(resolve_task(config.pop("task"))(build_session(), **config), indent=2, ensure_ascii=False))
    except (ValueError, FileNotFoundError, TypeError, KeyError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
