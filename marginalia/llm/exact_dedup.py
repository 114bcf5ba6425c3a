"""Exact deduplication by distributed most-significant-digit radix partitioning.

The first digit is the length of the normalised text with its first bytes; each later digit is the next run of
bytes, sixteen times as long as the one before. A group leaves when it holds one text row or when its texts have
ended, so equality is decided by the bytes alone. Rows of unique texts never move more than the first digit.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, drop_ids, give_back, keep_ids, lower_ascii, map_arrow, maybe_in, id_filter, slices, text_buffers

#: Bytes of the first two digits; later ones grow by GROWTH.
FIRST, SECOND, GROWTH = 64, 1024, 16


def _normalised(batch: pa.RecordBatch):
    """(row range, lower-cased bytes, bounds) of the second column, a bounded slice of bytes at a time."""
    raw, bounds = text_buffers(batch.column(1))
    for i, j in slices(bounds):
        yield i, j, lower_ascii(raw[bounds[i] : bounds[j]]).tobytes(), bounds[i : j + 1] - bounds[i]


def _heads(df: DataFrame, id_type: str) -> DataFrame:
    def make(batch):
        for i, j, data, at in _normalised(batch):
            texts = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([t[:FIRST] for t in texts], pa.binary()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ],
                ["doc_id", "n", "head", "sha"],
            )

    return map_arrow(df, make, f"doc_id {id_type}, n long, head binary, sha string")


def _bodies(df: DataFrame, id_type: str) -> DataFrame:
    def make(batch):
        for i, j, data, at in _normalised(batch):
            texts = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary())],
                ["doc_id", "n", "sha", "body"],
            )

    return map_arrow(df, make, f"doc_id {id_type}, n long, sha string, body binary")


def exact_dedup(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and empty texts are equal.
    Of equal texts the row with the largest id stays; a null id is below all others. Rows that repeat both id and
    text count each, and are all marked as kept when theirs is the largest id. Other columns are ignored, whatever
    their names. An empty table gives an empty result. Text length is not bounded: texts only ever travel as rows.
    A hot text is pre-aggregated before its rows meet the group table, whose join can be split by AQE.
    """
    ws = Workspace(spark, "exact")
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    heads = ws.put(_heads(docs, id_type), "heads")
    groups = ws.put(heads.groupBy("n", "head").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("n", "head"), "groups")
    flagged = ws.put(heads.join(groups.withColumn("hit", F.lit(True)), ["n", "head"], "left").select("doc_id", "sha", F.coalesce("hit", F.lit(False)).alias("open")), "flagged")
    ws.drop(heads, groups)
    open_ids = flagged.filter("open").select("doc_id")
    alone = F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"
    parts = [drop_ids(flagged.filter("NOT open"), "doc_id", open_ids).select("doc_id", *alone)]

    rows = ws.put(
        _bodies(keep_ids(docs, "doc_id", open_ids), id_type).select(F.monotonically_increasing_id().alias("row"), "*", F.lit(0).cast("long").alias("gid")),
        "bodies",
    )
    longest = rows.agg(F.max("n")).first()[0]
    digit, done = SECOND, 0
    while longest is not None:
        done += digit
        key = ["gid", "n", "digit"]
        dealt = rows.withColumn("digit", F.substring("body", 1, digit)).withColumn("body", F.expr(f"substring(body, {digit + 1})"))
        groups = ws.put(
            dealt.groupBy(*key).agg(F.min("row").alias("next"), F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"),
            "digit",
        )
        over = F.col("next").isNull() | (F.col("n") <= done)
        step = ws.put(
            dealt.join(groups, key, "left").select(
                "row", "doc_id", "n", "sha", over.alias("over"), F.coalesce("next", "gid").alias("gid"),
                F.when(F.col("next").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                F.when(~over, F.col("body")).alias("body"),
            ),
            "step",
        )
        ws.drop(rows, groups)
        parts.append(step.filter("over").select("doc_id", "keep_id", "group_size", "sha"))
        if done >= longest:
            break
        rows = step.filter("NOT over").select("row", "doc_id", "n", "sha", "body", "gid")
        digit *= GROWTH
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


@F.arrow_udf(T.StringType())
def normalised_sha256(text: pa.Array) -> pa.Array:
    raw, bounds = text_buffers(text)
    found = []
    for i, j in slices(bounds):
        data, at = lower_ascii(raw[bounds[i] : bounds[j]]).tobytes(), bounds[i : j + 1] - bounds[i]
        found += [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        del data
    give_back()
    return pa.array(found, pa.string())


def drop_exact_copies(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, of which exactly one stays for each normalised text.

    Ids that lose a row, or that several rows share, are looked up by (id, text); all others pass without a shuffle.
    """
    ws = Workspace(spark, "exact-keep")
    found = ws.put(exact_dedup(spark, documents, id_col, text_col).select("doc_id", "kept", "text_sha256"), "found")
    shared = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id")
    doubtful = ws.put(found.filter("NOT kept").select("doc_id").unionByName(shared), "doubtful")
    bitmap = id_filter(doubtful)
    near = maybe_in(documents, id_col, bitmap).withColumn("_sha", normalised_sha256(F.col(text_col)))
    keep = found.filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha256"))
    near = near.join(keep, near[id_col].eqNullSafe(keep["_id"]) & (near["_sha"] == keep["_sha256"]), "left_semi").dropDuplicates([id_col, "_sha"]).drop("_sha")
    return maybe_in(documents, id_col, bitmap, negate=True).unionByName(near)
