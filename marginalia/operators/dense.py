"""Dense retrieval: exact cosine top-k of a stated query set against all vectors, block by block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .retrieval import normalize_vector, usable, vector_search


def cosine_top_k(vectors: DataFrame, k: int, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose id is divisible by `every`, among all others; ties to smaller ids.

    Null ids and vectors, and vectors with a number that isn't finite, take no part; a vector of zeros scores 0 with all;
    vectors of several lengths raise.
    """
    rows = usable(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter("id IS NOT NULL"))
    unit = rows.select("id", normalize_vector(F.col("vector")).alias("vector"))
    found = vector_search(unit.filter(F.col("id") % every == 0), unit, k + 1).filter("query_id <> id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
