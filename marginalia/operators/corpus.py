"""Corpora: building from documents and annotations, validation, counts, fingerprints, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .spans import ENTITY

ENTITIES = f"array<struct<{ENTITY}>>"


def build_corpus(documents: DataFrame, annotations: DataFrame, validate: bool = True) -> DataFrame:
    """doc_id, text, entities_json, n_entities of documents (filename, text) and annotations (filename, label, start_span,
    end_span, text[, code]). Entities stand in (start, end) order with the ids T1..Tn."""
    a = annotations if "code" in annotations.columns else annotations.withColumn("code", F.lit(None).cast("string"))
    item = F.struct(F.col("start_span").cast("int").alias("start"), F.col("end_span").cast("int").alias("end"), "label", F.col("text").alias("surface"), "code")
    lists = a.groupBy("filename").agg(F.array_sort(F.collect_list(item)).alias("items"))
    named = F.transform("items", lambda e, i: F.struct(F.concat(F.lit("T"), (i + 1).cast("string")).alias("id"), e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"), e["surface"].alias("text"), e["code"].alias("code")))
    joined = documents.join(lists, "filename", "left")
    corpus = joined.select(F.col("filename").alias("doc_id"), "text", F.coalesce(F.to_json(named), F.lit("[]")).alias("entities_json"), F.coalesce(F.size("items"), F.lit(0)).alias("n_entities"))
    if validate and (bad := violations(corpus).limit(5).collect()):
        raise ValueError(f"invalid corpus: {[tuple(r) for r in bad]}")
    return corpus


def violations(corpus: DataFrame) -> DataFrame:
    """doc_id, problem of every broken rule of a corpus."""
    e = F.from_json("entities_json", ENTITIES)
    rows = corpus.select("doc_id", "text", "n_entities", e.alias("e"))
    wrong = lambda test: F.exists("e", test)
    problems = F.array(
        F.when(F.col("doc_id").isNull(), "null doc_id"),
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "blank text"),
        F.when(F.coalesce(F.col("n_entities"), F.lit(-1)) != F.size("e"), "n_entities differs"),
        F.when(wrong(lambda x: (x["start"] < 0) | (x["start"] >= x["end"]) | (x["end"] > F.length("text"))), "offsets outside the text"),
        F.when(wrong(lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]) != x["text"]), "entity text differs"),
        F.when(wrong(lambda x: F.trim(x["code"]) == ""), "blank code"),
    )
    found = rows.select("doc_id", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))
    twice = corpus.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit("repeated doc_id").alias("problem"))
    return found.unionByName(twice)


def entities(corpus: DataFrame) -> DataFrame:
    return corpus.select("doc_id", F.explode(F.from_json("entities_json", ENTITIES)).alias("e")).select("doc_id", "e.*")


def count_labels(corpus: DataFrame) -> DataFrame:
    return entities(corpus).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def count_codes(corpus: DataFrame) -> DataFrame:
    """One row: coded, no_code, composite, distinct_codes of a corpus's entities."""
    code = F.nullif(F.trim("code"), F.lit(""))
    return entities(corpus).agg(F.count(code).alias("coded"), F.count_if(code == "NO_CODE").alias("no_code"), F.count_if(code.contains("+")).alias("composite"), F.count_distinct(code).alias("distinct_codes"))


def fingerprints(corpus: DataFrame) -> DataFrame:
    """doc_id, document_fingerprint: SHA-256 of the compact JSON of the four columns."""
    return corpus.select("doc_id", F.sha2(F.to_json(F.struct("doc_id", "text", "entities_json", "n_entities")), 256).alias("document_fingerprint"))


def is_usable_code(code: Column) -> Column:
    """Not a number in scientific notation, and each +-part is NO_CODE or has a digit."""
    return ~code.rlike(r"^(?U:\d)(\.(?U:\d)+)?[eE][+-]?(?U:\d)+$") & F.forall(F.split(code, r"\+"), lambda p: (p == "NO_CODE") | p.rlike(r"(?U)\d"))


def resolve_codes(annotations: DataFrame, codes: DataFrame, on_mismatch: str = "raise") -> DataFrame:
    """Annotations with the usable code of their (filename, start, end). Codes without an annotation, and keys with several
    codes, raise or are left out (`skip`)."""
    key = ["filename", "start_span", "end_span"]
    usable = codes.filter(F.col("code").isNotNull() & is_usable_code(F.col("code"))).select(*key, "code").distinct()
    counted = usable.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*key)))
    if on_mismatch == "raise":
        lost = usable.join(annotations, key, "left_anti").count()
        clash = counted.filter("n > 1").count()
        if lost or clash:
            raise ValueError(f"{lost} codes have no annotation, {clash} share a span")
    return annotations.drop("code").join(counted.filter("n = 1").drop("n"), key, "left")


def resolve_mismatch(documents: DataFrame, annotations: DataFrame, policy: str = "error") -> tuple[DataFrame, DataFrame]:
    """Documents and annotations of the same files. error: a file on one side only raises; documents: every document
    stays and lost annotations go; annotations: documents without annotations go too."""
    if policy not in ("error", "documents", "annotations"):
        raise ValueError(f"unknown policy {policy!r}")
    files = annotations.select("filename").distinct()
    if policy == "error":
        bare, lost = documents.join(files, "filename", "left_anti").count(), files.join(documents, "filename", "left_anti").count()
        if bare or lost:
            raise ValueError(f"{bare} documents have no annotations, {lost} annotated files no document")
        return documents, annotations
    kept = documents if policy == "documents" else documents.join(files, "filename", "left_semi")
    if kept.isEmpty():
        raise ValueError("no document is left")
    return kept, annotations.join(documents.select("filename"), "filename", "left_semi")


def resolve_conflicts(documents: DataFrame, annotations: DataFrame, policy: str = "raise") -> tuple[DataFrame, DataFrame]:
    """Annotations whose text differs from the document's: raise, rewrite the text, or drop the whole document."""
    if policy not in ("raise", "rewrite", "drop"):
        raise ValueError(f"unknown policy {policy!r}")
    docs = documents.select("filename", F.col("text").alias("_document"))
    mention = F.substring(F.col("_document"), F.col("start_span").cast("int") + 1, (F.col("end_span") - F.col("start_span")).cast("int"))
    checked = annotations.join(docs, "filename").withColumn("_mention", mention).drop("_document")
    differs = ~F.col("text").eqNullSafe(F.col("_mention"))
    if policy == "rewrite":
        return documents, checked.withColumn("text", F.col("_mention")).drop("_mention")
    bad = checked.filter(differs).select("filename").distinct()
    if policy == "raise":
        if n := checked.filter(differs).count():
            raise ValueError(f"{n} annotations differ from their documents")
        return documents, checked.drop("_mention")
    return documents.join(bad, "filename", "left_anti"), checked.drop("_mention").join(bad, "filename", "left_anti")
