"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame and SQL functions only. Rows never gather by source: source sizes are pre-aggregated, each source's order by
a seeded hash is cut in BUCKETS buckets whose sums are pre-aggregated too, and only the one bucket of a source in which
its target is reached is put in order row by row. The table of sources is the size of the sources, not of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace

WEIGHTS, SHARE, EPOCHS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Hexadecimal digits of the hash that name a bucket: 4,096 buckets. Rows of a large group that are made in one run.
DIGITS, RUN = 3, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_of(doc_id: Column, seed: str = SEED) -> Column:
    """The seeded place of a document in its source, as 16 hexadecimal digits."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 16)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target of each source of `sized` (source, size).

    Sources in code-point order, null last, weigh `weights` in turn. In the order of cap / weight, the first source
    whose cap isn't below its part of what the sources before it leave fixes the level; those before stop at their cap.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    sums = sums.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double")).withColumn("cap", (epochs * F.col("source_size")).cast("double"))
    everything = W.partitionBy()
    ranked = W.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(ranked.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(ranked.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (F.lit(share) * F.sum("source_size").over(everything) - before) / left
    sums = sums.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), "level"))).over(everything)["level"])
    return sums.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def _plan(ws: Workspace, documents: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """(rows, plan). rows: doc_id, source, size, h. plan, by source: target, base (whole repetitions), extra (words of
    the fractional one), cut and before (the bucket in which the extra words end, and the words ahead of it)."""
    rows = ws.put(documents.select("doc_id", "source", words_of(F.col("text")).alias("size"), order_of(F.col("doc_id"), seed).alias("h")), "rows")
    plan = source_targets(rows)
    plan = plan.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = ws.put(plan.withColumn("extra", F.floor(F.col("target") + 0.5).cast("long") - F.col("base") * F.col("source_size")), "targets")
    by_bucket = rows.groupBy("source", F.substring("h", 1, DIGITS).alias("bucket")).agg(F.sum("size").alias("s"))
    ahead = F.coalesce(F.sum("s").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_bucket = by_bucket.withColumn("before", ahead).withColumnRenamed("source", "src")
    met = by_bucket.join(plan, by_bucket["src"].eqNullSafe(plan["source"])).filter("before < extra AND extra <= before + s")
    cut = met.groupBy("src").agg(F.min("bucket").alias("cut"), F.min("before").alias("before"))
    plan = plan.join(cut, plan["source"].eqNullSafe(cut["src"]), "left").drop("src")
    return rows, ws.put(plan.withColumnsRenamed({"source": "plan_source"}), "plan")


def _placed(rows: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows outside the cut bucket of their source, with the words taken beyond `base` repetitions; groups of equal rows
    inside it, with their number n, how many are taken whole and the words of the next one).

    Equal rows are counted before they are put in order, so that an id that very many rows share is one row here.
    """
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["plan_source"]))
    bucket, inside = F.substring("h", 1, DIGITS), F.coalesce(F.substring("h", 1, DIGITS) == F.col("cut"), F.lit(False))
    easy = joined.filter(~inside).withColumn("more", F.when(bucket < F.col("cut"), F.col("size")).otherwise(0))
    alike = joined.filter(inside).groupBy("source", "h", "doc_id", "size", "source_size", "target", "base", "extra", "before").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.coalesce(F.sum(F.col("size") * F.col("n")).over(W.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = alike.withColumn("room", F.greatest(F.lit(0).cast("long"), F.col("extra") - F.col("before") - ahead))
    whole = F.when(F.col("size") > 0, F.least(F.col("n"), F.expr("room div greatest(size, 1)"))).otherwise(0)
    groups = groups.withColumn("whole", whole.cast("long"))
    return easy, groups.withColumn("part", F.when((F.col("whole") < F.col("n")) & (F.col("size") > 0), F.col("room") - F.col("whole") * F.col("size")).otherwise(0).cast("long"))


def mix(spark: SparkSession, documents: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per row of `documents` (doc_id, text, source): doc_id, size, source_size, target, taken.

    A null or empty text has size 0 and nothing is taken of it. A source without words has the target 0. Each source's
    taken words are its target, rounded. Rows that repeat an id count each. Without rows the result is empty.
    """
    ws = Workspace(spark, "mix")
    rows, plan = _plan(ws, documents, seed)
    easy, groups = _placed(rows, plan)
    columns = "doc_id", "size", "source_size", "target", (F.col("base") * F.col("size") + F.col("more")).cast("long").alias("taken")
    some = (F.col("part") > 0).cast("long")
    kinds = F.array(*(F.struct(m.cast("long").alias("more"), k.cast("long").alias("k")) for m, k in ((F.col("size"), F.col("whole")), (F.col("part"), some), (F.lit(0), F.col("n") - F.col("whole") - some))))
    each = groups.select("doc_id", "size", "source_size", "target", "base", F.inline(kinds)).filter("k > 0")
    # a group's rows are made again in runs, so that a large group isn't one task's
    runs = each.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(k - 1) div {RUN}")))).withColumn("k", F.least(F.lit(RUN).cast("long"), F.col("k") - F.col("run") * RUN))
    hard = runs.repartition(F.col("run"), F.col("doc_id")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    return easy.select(*columns).unionByName(hard.select(*columns))


def mixed_documents(spark: SparkSession, documents: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of `documents`, all columns, as often as the mix takes them.

    A fractional repetition holds the first words of its text with the white space before them; there is at most one
    for each source. Texts don't move: each row finds its count from the table of sources, and only rows of the cut
    buckets are looked up, by source, id and size. Rows that share all three are told apart only where the target is
    reached among them, at most once for each source.
    """
    ws = Workspace(spark, "mix-rows")
    rows, plan = _plan(ws, documents, seed)
    small = plan.select(*(F.col(c).alias(f"_{c}") for c in ("plan_source", "base", "cut")))
    joined = documents.join(small, documents["source"].eqNullSafe(small["_plan_source"])).withColumn("_bucket", F.substring(order_of(F.col("doc_id"), seed), 1, DIGITS))
    inside = F.coalesce(F.col("_bucket") == F.col("_cut"), F.lit(False))
    easy = joined.filter(~inside).withColumn("_copies", F.col("_base") + F.when(F.col("_bucket") < F.col("_cut"), 1).otherwise(0))
    _, groups = _placed(rows, plan)
    hard = ws.put(groups.select(F.col("source").alias("_source"), F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("n").alias("_n"), F.col("whole").alias("_whole"), F.col("part").alias("_more")), "hard")
    near = joined.filter(inside).withColumn("_words", words_of(F.col("text")))
    near = near.join(hard, near["source"].eqNullSafe(hard["_source"]) & near["doc_id"].eqNullSafe(hard["_id"]) & (near["_words"] == hard["_size"]))
    mixed = (F.col("_n") > 1) & ((F.col("_whole") > 0) | (F.col("_more") > 0)) & (F.col("_whole") < F.col("_n"))
    numbered = near.filter(mixed).withColumn("_nr", F.row_number().over(W.partitionBy("_source", "_id", "_size").orderBy("text")))
    near = near.filter(~mixed).withColumn("_nr", F.lit(1)).unionByName(numbered)
    near = near.withColumn("_copies", F.col("_base") + F.when(F.col("_nr") <= F.col("_whole"), 1).otherwise(0))
    part = F.array_join(F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col("_more").cast("int")), "")
    partial = near.filter("_more > 0 AND _nr = _whole + 1").withColumn("text", part)
    columns = documents.columns
    repeated = [x.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long")))).select(columns) for x in (easy, near)]
    return repeated[0].unionByName(repeated[1]).unionByName(partial.select(columns))
