"""Folders with a file for each document."""

import os

import pytest
from pyspark.sql import functions as F

from marginalia.sources import sinks, tables

NAMES = ["1", "a b", "a+b", "a/b", "_x", ".y", "filename=3", "é𝔊", "50%", "c.d", "-"]


def test_every_document_is_one_file(spark, tmp_path):
    texts = ["", "a", "b\n", "c\r\nd\r", "é𝔊\n\n", " x ", "\ty", "z" * 100_000, "_", "#", "T1"]
    docs = spark.createDataFrame(list(zip(NAMES, texts, strict=True)), "filename string, text string").repartition(5)
    path = f"file://{tmp_path}/docs"
    sinks.write_documents(docs, path)
    assert len([x for x in os.listdir(tmp_path / "docs") if x.endswith(".txt")]) == len(NAMES)
    assert not [x for x in os.listdir(tmp_path / "docs") if os.path.isdir(tmp_path / "docs" / x)]
    want = {n: t.replace("\r\n", "\n").replace("\r", "\n") for n, t in zip(NAMES, texts, strict=True)}
    assert {r.filename: r.text for r in tables.read_documents(spark, path).collect()} == want
    with pytest.raises(ValueError):
        sinks.write_documents(docs, path)
    sinks.write_documents(docs.limit(0), path, overwrite=True)
    assert tables.read_documents(spark, path).count() == 0


def test_rows_of_a_filename_are_lines_of_its_file(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", None), ("a", "x")], "filename string, text string").repartition(3)
    sinks.write_documents(docs, str(tmp_path / "docs"))
    assert sorted(map(tuple, tables.read_documents(spark, str(tmp_path / "docs")).collect())) == [("a", "x\nx"), ("b", "")]
    with pytest.raises(Exception, match="without a filename"):
        sinks.write_documents(docs.withColumn("filename", F.lit(None).cast("string")), str(tmp_path / "none"))


def test_files_are_written_and_read_by_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILES", 100)
    docs = spark.range(450).select(F.col("id").cast("string").alias("filename"), F.concat(F.lit("t"), "id").alias("text"))
    sinks.write_documents(docs, str(tmp_path / "docs"))
    found = tables.read_documents(spark, str(tmp_path / "docs"))
    assert found.rdd.getNumPartitions() <= 5
    assert {(r.filename, r.text) for r in found.collect()} == {(str(i), f"t{i}") for i in range(450)}


def test_stand_off_files_hold_every_span_and_code(spark, tmp_path):
    spans = [("a", "X", 0, 3, "a\tb", "C1"), ("a", "X", 0, 3, "a\tb", None), ("a", "Y", 4, 5, None, "C2"), ("a", "X", 5, 6, "é", "C3"), ("b/c", "X", 1, 3, "𝔊h", None)]
    frame = spark.createDataFrame(spans, "filename string, label string, start_span long, end_span long, text string, code string")
    lines = {r.filename: r.value for r in sinks.ann_lines(frame.repartition(4)).collect()}
    assert lines["a"] == "T1\tX 0 3\ta b\nN1\tReference T1 C1\ta b\nT2\tX 0 3\ta b\nT4\tX 5 6\té\nN4\tReference T4 C3\té"
    assert sinks.ann_lines(frame)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    sinks.write_ann(frame, str(tmp_path / "ann"))
    found = sorted(map(tuple, tables.read_ann(spark, str(tmp_path / "ann")).collect()), key=repr)
    assert found == sorted([("a", "X", 0, 3, "a b", "C1"), ("a", "X", 0, 3, "a b", None), ("a", "X", 5, 6, "é", "C3"), ("b/c", "X", 1, 3, "𝔊h", None)], key=repr)


def test_stand_off_files_are_parsed_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a.ann").write_text("N1\tReference T1 R52\tx\nT1\tSYM 0 5;6 10\tfever pain\r\nN2\tReference T1 R50\tx\n#1\tnote\nN3\tReference T9\n")
    (tmp_path / "b.ann").write_text("")
    found = tables.read_ann(spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("a", "SYM", 0, 5, "fever", "R50"), ("a", "SYM", 6, 10, "pain", "R50")]
    (tmp_path / "c.ann").write_text("T1\tSYM 0 5\tpain\n")
    with pytest.raises(Exception, match="fragments don't fit"):
        tables.read_ann(spark, str(tmp_path)).collect()
