"""Sources: text folders, stand-off annotations, codes, span tables, gazetteers, hierarchies. Files are read by
Spark alone, but for those that `sinks.write_each` wrote."""

from __future__ import annotations

import fnmatch
import json
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import DONE, filename_of, local_folder

SPAN = "filename string, label string, start_span string, end_span string, text string"


def _stem() -> Column:
    """A file's name without its ending, or the filename that its folder `filename=...` names."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, r"/filename=([^/]+)/[^/]+$", 1)
    return F.when(folder != "", F.url_decode(folder)).otherwise(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def _texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """filename, value: the whole files of a folder. A folder of folders by filename is read as `sinks.write_by_file` wrote it,
    without the last line end of each file; other folders in a folder aren't read. What `sinks.write_each` wrote is read by
    tasks of many files, as Spark plans a few files to a task."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not re.search(r"[*?{\[,]", path) and (folder := local_folder(spark, path)) and os.path.exists(f"{folder}/{DONE}"):
        return _many_files(spark, folder, pattern)
    by_folder = len(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/filename=*/*")) or []) > 0
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(by_folder).lower()).text(path, wholetext=True)
    return files.select(_stem().alias("filename"), F.regexp_replace("value", "\n\\z", "").alias("value") if by_folder else F.col("value"))


#: Files of a task; characters of a batch of texts, rows of a batch of spans.
FILES, BYTES, ROWS = 2000, 1 << 22, 50_000


def _many_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """filename, value of the files that `sinks.write_each` finished; one task lists their names."""
    patterns = pattern.strip("{}").split(",")
    with open(f"{folder}/{DONE}") as f:
        tasks = int(f.read()) // FILES + 1

    def listed(batches):
        for _ in batches:
            names = [e.name for e in os.scandir(folder) if e.name[0] not in "._" and any(fnmatch.fnmatchcase(e.name, p) for p in patterns)]
            for at in range(0, len(names), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 10_000], pa.string())], ["name"])

    def read(batches):
        for batch in batches:
            names, texts, held = [], [], 0
            for name in batch.column(0).to_pylist():
                with open(f"{folder}/{name}", "rb", buffering=0) as f:
                    texts.append(f.read().decode("utf-8", "replace"))
                names.append(filename_of(name))
                held += len(texts[-1])
                if held >= BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts)], ["filename", "value"])
                    names, texts, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(texts)], ["filename", "value"])

    names = spark.range(0, 1, 1, 1).mapInArrow(listed, "name string")
    return names.repartition(tasks).mapInArrow(read, "filename string, value string")


def _lines_fixed(value: Column) -> Column:
    """Line ends as \\n, which offsets count on."""
    return F.regexp_replace(value, "\r\n?", "\n")


def read_documents(spark: SparkSession, documents: str | dict[str, str], pattern: str = "*.txt") -> DataFrame:
    """filename, text of a folder of texts or of a dictionary."""
    if isinstance(documents, dict):
        return spark.createDataFrame(sorted(documents.items()), "filename string, text string")
    return _texts(spark, documents, pattern).select("filename", _lines_fixed(F.col("value")).alias("text"))


def read_tsv(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """A TSV with a header: every column text, empty fields empty, NA a text like any other; a quoted field may hold line ends
    (a file is then one task's: large tables belong in Parquet)."""
    df = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', inferSchema=False, nullValue="\0", multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if missing := set(required or ()) - set(df.columns):
        raise ValueError(f"{path} lacks the columns {sorted(missing)}")
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """TSV, JSON lines or Parquet, by suffix."""
    if path.endswith((".tsv", ".txt")):
        return read_tsv(spark, path)
    if path.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path}")


def canonical(annotations: DataFrame, *more: str) -> DataFrame:
    """Typed annotations; an end that isn't behind its start raises."""
    start, end = F.col("start_span").cast("int"), F.col("end_span").cast("int")
    bad = F.raise_error(F.concat(F.lit("empty or reversed annotation in "), F.col("filename"))).cast("int")
    code = [F.col("code")] if "code" in annotations.columns else []
    return annotations.select("filename", "label", start.alias("start_span"), F.when(end > start, end).otherwise(bad).alias("end_span"), "text", *code, *more)


def read_annotation_tsv(spark: SparkSession, path: str) -> DataFrame:
    return canonical(read_tsv(spark, path, ["filename", "label", "start_span", "end_span", "text"]))


def read_ann(spark: SparkSession, path: str, pattern: str = "{*.ann,part-*.txt}") -> DataFrame:
    """filename, label, start_span, end_span, text, code of stand-off files. A discontinuous annotation gives a row for each
    fragment; its text must be the fragments joined by spaces. Codes come from the N lines that name the annotation."""
    rows = _texts(spark, path, pattern).mapInArrow(_spans_of_files, "filename string, label string, start_span string, end_span string, text string, code string")
    return canonical(rows)


def _spans_of_files(batches):
    """The fragments of stand-off files (filename, value), see `read_ann`."""
    columns = ("filename", "label", "start_span", "end_span", "text", "code")
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], columns)
    rows: list[tuple] = []
    for batch in batches:
        for filename, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            lines = [line.split("\t") for line in re.sub("\r\n?", "\n", value or "").split("\n") if line[:1] in ("T", "N")]
            codes: dict[str, str] = {}
            for f in lines:
                if f[0][0] == "N" and len(noted := f[1].split(" ")) > 2:
                    codes[noted[1]] = min(noted[2], codes.get(noted[1], noted[2]))
            for f in lines:
                if f[0][0] != "T":
                    continue
                number, (label, ranges), whole, at = f[0], f[1].split(" ", 1), f[2], 0
                parts = [r.split(" ") for r in ranges.split(";")]
                sizes = [int(r[1]) - int(r[0]) for r in parts]
                if sum(sizes) + len(sizes) - 1 != len(whole):
                    raise ValueError(f"fragments don't fit the text of {number} in {filename}")
                for r, size in zip(parts, sizes, strict=True):
                    rows.append((filename, label, r[0], r[1], whole[at : at + size], codes.get(number)))
                    at += size + 1
            if len(rows) >= ROWS:
                yield made(rows)
                rows = []
    if rows:
        yield made(rows)


def read_annotations(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    if isinstance(source, DataFrame):
        return canonical(source)
    return read_annotation_tsv(spark, source) if source.endswith(".tsv") else read_ann(spark, source)


def read_codes(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """filename, start_span, end_span, code; span_ini and span_end are other names of the offsets."""
    df = source if isinstance(source, DataFrame) else read_tsv(spark, source)
    df = df.withColumnsRenamed({"span_ini": "start_span", "span_end": "end_span"})
    return df.select("filename", F.col("start_span").cast("int"), F.col("end_span").cast("int"), F.trim("code").alias("code"))


def read_corpus(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    from ..operators.corpus import violations

    corpus = spark.read.parquet(path)
    if validate and (bad := violations(corpus).limit(5).collect()):
        raise ValueError(f"invalid corpus: {[tuple(r) for r in bad]}")
    return corpus


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A span table by suffix, checked as annotations are; a score that isn't a number is null."""
    raw = read_table(spark, path)
    found = canonical(raw, *(["score"] if "score" in raw.columns else [])).drop("code")
    return found.withColumn("score", F.expr("try_cast(score AS double)")) if "score" in raw.columns else found


def read_reference(spark: SparkSession, reference: str, target_label: str | None = None) -> DataFrame:
    """Gold spans of a Parquet corpus or an annotation table, of one label if named."""
    from ..operators.spans import spans_from_corpus

    if reference.rstrip("/").endswith(".parquet"):
        found = spans_from_corpus(read_corpus(spark, reference, validate=False)).drop("code")
    else:
        found = read_annotations(spark, reference)
    return found if target_label is None else found.filter(F.col("label") == target_label)


def read_labelled(spark: SparkSession, source: str | DataFrame, target_label: str, name: str) -> DataFrame:
    """The spans of one label that an analysis works on; none raises."""
    df = source if isinstance(source, DataFrame) else read_reference(spark, source)
    found = df.filter(F.col("label") == target_label)
    if found.isEmpty():
        raise ValueError(f"{name} has no span of {target_label}")
    return found


def read_predicted(spark: SparkSession, source: str | DataFrame, target_label: str) -> DataFrame:
    """Predictions of one label; one of another label raises."""
    df = source if isinstance(source, DataFrame) else read_predictions(spark, source)
    if others := [r["label"] for r in df.filter(~F.col("label").eqNullSafe(F.lit(target_label))).select("label").distinct().limit(5).collect()]:
        raise ValueError(f"predictions of other labels than {target_label}: {others}")
    return df


def read_mentions(spark: SparkSession, path: str) -> DataFrame:
    """Mentions with a code: filename, label, offsets, text, code, is_abbreviation and is_composite as booleans, and all other
    columns as a map. A blank code raises."""
    from ..functions.text import parse_bool

    df = read_tsv(spark, path, ["text", "code"])
    flags = ("is_abbreviation", "is_composite")
    known = {"filename", "label", "start_span", "end_span", "text", "code", *flags}
    rest = [c for c in df.columns if c not in known]
    code = F.when(F.trim("code") == "", F.raise_error(F.concat(F.lit("a mention without a code: "), F.col("text"))).cast("string")).otherwise(F.trim("code"))
    optional = lambda c, t: (F.expr(f"try_cast(nullif({c}, '') AS {t})") if c in df.columns else F.lit(None).cast(t)).alias(c)
    metadata = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c))]) if rest else F.create_map().cast("map<string,string>")
    return df.select(optional("filename", "string"), optional("label", "string"), optional("start_span", "int"), optional("end_span", "int"), "text", code.alias("code"), *((parse_bool(F.col(c)) if c in df.columns else F.lit(None).cast("boolean")).alias(c) for c in flags), metadata.alias("metadata"))


#: Columns that linking adds. Fixed values.
LINKED = ("code", "code_term", "code_score", "candidates_json", "code_source")


def read_spans(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Spans to link: a code is a gold code, and what an earlier linking added goes."""
    df = source if isinstance(source, DataFrame) else read_table(spark, source)
    linked = {"code_term", "code_score", "candidates_json"} <= set(df.columns)
    if linked:
        return df.drop(*LINKED)
    if "code" not in df.columns:
        return df
    return df.withColumn("gold_code", F.nullif(F.trim("code"), F.lit(""))).drop("code")


def optional_text(value: Column) -> Column:
    """Trimmed, blank as null."""
    return F.nullif(F.trim(value.cast("string")), F.lit(""))


def has_gold(corpus: DataFrame) -> bool:
    """Whether any document of a corpus has an entity."""
    return not corpus.filter(F.col("n_entities") > 0).isEmpty()


def resolve_gold(spark: SparkSession, reference: str | DataFrame | None, corpus: DataFrame, target_label: str) -> DataFrame | None:
    """Gold spans: the reference's, else the corpus's own, else None."""
    from ..operators.spans import spans_from_corpus

    if reference is not None:
        return reference.filter(F.col("label") == target_label) if isinstance(reference, DataFrame) else read_reference(spark, reference, target_label)
    return spans_from_corpus(corpus, target_label) if has_gold(corpus) else None


def read_metadata(spark: SparkSession, parquet: str) -> dict | None:
    """metadata.json beside a Parquet table, None where there is none."""
    beside = parquet.rstrip("/").rpartition("/")[0]
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{beside}/metadata.json")
    return json.loads(spark.read.text(f"{beside}/metadata.json", wholetext=True).first()["value"]) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def split_metadata(metadata: dict | None, filename: str) -> dict | None:
    """The entry of a metadata's splits that names a file."""
    return next((s for s in (metadata or {}).get("splits", []) if isinstance(s, dict) and s.get("file") == filename), None)


def read_gazetteer(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """entry_id, term, code, label, semantic_tag, metadata; blank terms or codes go, an empty one raises."""
    df = source if isinstance(source, DataFrame) else read_table(spark, source)
    known = {"term", "code", "label", "semantic_tag", "sem_tag"}
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns], F.lit(None).cast("string"))
    rest = [c for c in df.columns if c not in known]
    metadata = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]) if rest else F.lit(None).cast("map<string,string>")
    out = df.select(pick("term").alias("term"), pick("code").alias("code"), pick("label").alias("label"), pick("semantic_tag", "sem_tag").alias("semantic_tag"), metadata.alias("metadata")).filter("term IS NOT NULL AND code IS NOT NULL")
    if out.isEmpty():
        raise ValueError("the gazetteer is empty")
    return out.select(F.xxhash64("term", "code", "label").alias("entry_id"), "*")


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path)
    aliases = F.split("aliases", r"\|") if "aliases" in df.columns else F.array().cast("array<string>")
    return df.withColumn("aliases", F.filter(aliases, lambda a: a != ""))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """parent, child, relation (is_a where there is none)."""
    df = read_table(spark, path)
    relation = F.coalesce(F.nullif(F.trim("relation"), F.lit("")), F.lit("is_a")) if "relation" in df.columns else F.lit("is_a")
    return df.select(F.col("parent_code").alias("parent"), F.col("child_code").alias("child"), relation.alias("relation"))


def dictionary_mentions(texts: DataFrame, terms: list[str]) -> DataFrame:
    """Every occurrence, in any case, overlaps too, of the terms in texts (filename, text), by their offsets.

    One linear pass over a text with an automaton of all terms; characters whose lower case has another length count
    as themselves, so offsets fit the text."""
    import ahocorasick
    import pandas as pd

    wanted = sorted({t.lower() for t in terms if t})

    def run(batches):
        automaton = ahocorasick.Automaton()
        for t in wanted:
            automaton.add_word(t, t)
        automaton.make_automaton()
        for pdf in batches:
            rows = []
            for name, text in pdf[["filename", "text"]].itertuples(index=False, name=None):
                low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text or "")
                rows += [(name, t, e + 1 - len(t), e + 1, text[e + 1 - len(t) : e + 1]) for e, t in automaton.iter(low)] if wanted else []
            yield pd.DataFrame(rows, columns=["filename", "term", "start_span", "end_span", "text"])

    return texts.select("filename", "text").mapInPandas(run, "filename string, term string, start_span int, end_span int, text string")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
