"""Sinks: corpora, tables, manifests. Spark writes them, so any path that Spark knows will do; tasks write small files of local
folders themselves."""

from __future__ import annotations

import json
import os
import re
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_corpus(corpus: DataFrame, path: str, compression: str = "zstd", overwrite: bool = False) -> None:
    corpus.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = {c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))}
    return df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """TSV, JSON lines or Parquet by suffix; an existing path raises unless `overwrite`."""
    writer = lambda d: d.write.mode("overwrite" if overwrite else "errorifexists")
    if path.endswith((".tsv", ".txt")):
        writer(flat(df)).csv(path, sep="\t", header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif path.endswith((".jsonl", ".ndjson")):
        writer(df).json(path)
    elif path.endswith(".parquet"):
        writer(df).parquet(path)
    else:
        raise ValueError(f"no writer for {path}")


def write_manifest(spark: SparkSession, manifest: dict, path: str, overwrite: bool = True) -> None:
    text = json.dumps(manifest, indent=2, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_split(corpus: DataFrame, manifest: DataFrame, path: str, overwrite: bool = False) -> None:
    """The corpus in one folder for each partition, and the manifest beside it."""
    mode = "overwrite" if overwrite else "errorifexists"
    joined = corpus.join(manifest.select("doc_id", "partition_name"), "doc_id")
    joined.write.mode(mode).partitionBy("partition_name").parquet(f"{path}/corpus")
    manifest.write.mode(mode).parquet(f"{path}/manifest")


def read_split(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/corpus")
    return rows if names is None else rows.filter(F.col("partition_name").isin(names))


def write_by_file(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """One folder `filename=...` with one text file for each filename of (filename, value), in any order of rows: what
    `tables.read_documents` and `tables.read_ann` read again. Files are written by the tasks that hold them."""
    lines.select("filename", "value").repartition("filename").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("filename").text(path)


#: In a folder that `write_each` has finished: the number of its files. Spark's readers pass over it.
DONE = "_FILES"


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The folder as the operating system names it if its scheme is `file`, else None. As for Spark's own readers of that scheme,
    it has to be one that all executors share."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def file_name(filename: str, ending: str) -> str:
    """The filename and its ending; one that wouldn't do as the name of a file is quoted behind `filename=`."""
    plain = re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", filename)
    return f"{filename if plain else 'filename=' + quote(filename, safe='')}{ending}"


def filename_of(name: str) -> str:
    """The filename that a name of `file_name`, or any other with an ending, stands for."""
    stem = name.rpartition(".")[0] or name
    return unquote(stem.removeprefix("filename=")) if stem.startswith("filename=") else stem


def write_each(lines: DataFrame, path: str, ending: str, overwrite: bool = False, once: bool = False) -> None:
    """One file for each filename of (filename, value), named by it. Rows of one filename are its lines, in any order; `once`
    says that each filename has one row. A null filename raises.

    Tasks write the files of a local folder themselves: each under another name first, so a task that runs twice does no
    harm. The file `_FILES` comes last. Elsewhere it is `write_by_file`, whose committer handles each file several times."""
    spark = lines.sparkSession
    folder = local_folder(spark, path)
    if folder is None:
        return write_by_file(lines, path, overwrite)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        if not overwrite:
            raise ValueError(f"{path} exists: pass overwrite, or another folder")
        fs.delete(target, True)
    fs.mkdirs(target)

    def put(filename: str, values: list[bytes]) -> None:
        name = file_name(filename, ending)
        own = f"{folder}/_{uuid.uuid4().hex}"
        with open(own, "wb", buffering=0) as f:
            f.write(b"\n".join(values))
        os.replace(own, f"{folder}/{name}")

    def run(batches):
        n, last, values = 0, None, []
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).cast("binary").to_pylist()
            for filename, value in zip(names, texts, strict=True):
                if filename is None:
                    raise ValueError("a row without a filename")
                if values and filename != last:
                    put(last, values)
                    n, values = n + 1, []
                last = filename
                values.append(value or b"")
        if values:
            put(last, values)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = lines.select("filename", "value")
    rows = rows if once else rows.repartition("filename").sortWithinPartitions("filename")
    n = rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    with open(f"{folder}/{DONE}", "w") as f:
        f.write(str(n))


def write_documents(documents: DataFrame, path: str, overwrite: bool = False) -> None:
    """Texts of (filename, text), a file each."""
    write_each(documents.select("filename", F.col("text").alias("value")), path, ".txt", overwrite)


def ann_lines(spans: DataFrame) -> DataFrame:
    """filename, value: the stand-off lines of spans (filename, label, start_span, end_span, text[, code]) as one text.

    Spans are T1..Tn by their offsets; a code stands in a line N of the same number. Line ends and tabs in a text are spaces;
    a span with a null gives no line T. Spans are dealt and sorted by filename once.
    """
    code = F.col("code") if "code" in spans.columns else F.lit(None).cast("string")
    item = F.struct(F.col("start_span").cast("int").alias("s"), F.col("end_span").cast("int").alias("e"), "label", F.translate("text", "\n\r\t", "   ").alias("text"), code.alias("code"))
    rows = spans.select("filename", item.alias("i")).select("filename", "i.*").repartition("filename")
    rows = rows.sortWithinPartitions("filename", *(F.col(c).asc_nulls_last() for c in ("s", "e", "label", "text", "code")))

    def run(batches):
        made: tuple[list, list] = ([], [])
        last, lines, n = None, [], 0

        def end() -> None:
            made[0].append(last)
            made[1].append("\n".join(lines))

        for batch in batches:
            for filename, s, e, label, text, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n and filename != last:
                    end()
                    lines, n = [], 0
                last, n = filename, n + 1
                if None not in (s, e, label, text):
                    lines.append(f"T{n}\t{label} {s} {e}\t{text}")
                if code is not None and text is not None:
                    lines.append(f"N{n}\tReference T{n} {code}\t{text}")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in made], ["filename", "value"])
            made = ([], [])
        if n:
            end()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in made], ["filename", "value"])

    return rows.mapInArrow(run, "filename string, value string")


def write_ann(spans: DataFrame, path: str, overwrite: bool = False) -> None:
    write_each(ann_lines(spans), path, ".ann", overwrite, once=True)


def write_stats(frame: DataFrame, output_dir: str, stem: str, overwrite: bool = False) -> None:
    """The same rows as JSON lines and as Parquet."""
    for suffix in ("jsonl", "parquet"):
        write_table(frame, f"{output_dir}/{stem}.{suffix}", overwrite)


def write_tables(tables: dict[str, DataFrame], output_dir: str, overwrite: bool = False) -> dict[str, str]:
    """Each table as Parquet under `tables`; returns their paths."""
    paths = {name: f"{output_dir}/tables/{name}.parquet" for name in tables}
    for name, df in tables.items():
        write_table(df, paths[name], overwrite)
    return paths


def claim_folder(spark: SparkSession, path: str, overwrite: bool = False) -> str:
    """Makes a run's folder; one that holds files raises, or is emptied with `overwrite`."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and len(fs.listStatus(target)):
        if not overwrite:
            raise ValueError(f"{path} holds files: pass overwrite, or another folder")
        fs.delete(target, True)
    fs.mkdirs(target)
    return path


def write_configuration(spark: SparkSession, configuration: dict, path: str, overwrite: bool = True) -> None:
    """A configuration as YAML."""
    from ..naming import yaml_text

    spark.createDataFrame([(yaml_text(configuration).rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)
