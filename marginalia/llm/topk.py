"""Exact top-k search by inner product with vector-approximation files.

Vectors are dealt to blocks. The approximation file of a block holds one byte for each component, the exact file the
integers themselves. First only approximations meet the queries: as all cells of a component are equally wide, a vector's
score is the query's product with its cells' middles, give or take a slack that is one number for the query and the block.
The k-th best lower bound of any block bounds a query's k-th result from below; vectors whose upper bound doesn't reach it
are out. Only blocks with vectors left are read exactly, and of those only these vectors, in the order of their upper
bounds until no bound that is left can reach the k-th result of the block. Block results are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, give_back

#: Results of a query, cells of a component, vectors of a block, queries of a block, exact vectors read at a time.
K, CELLS, BLOCK, QUERIES, STEP = 20, 64, 8192, 1024, 64
_KINDS = (np.int8, np.int16, np.int32, np.int64)


def _pack(copies: int):
    """A grouped function: the rows (dim, block, id, vector) of a block as one row of binaries.

    Rows that repeat an id count once, with the least vector. Of equal vectors only the `copies` smallest ids stay:
    with ties going to smaller ids, no other can be among the results.
    """
    schema = pa.schema([("dim", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("kind", pa.int32()), ("exact", pa.binary()), ("low", pa.binary()), ("width", pa.binary()), ("cells", pa.binary()), ("largest", pa.float64())])

    def pack(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        ids = group["id"].to_numpy()
        x = group["vector"].combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, x = ids[first], x[first]
        if copies:
            kind = np.unique(x, axis=0, return_inverse=True)[1].ravel() if dim else np.zeros(len(ids), int)
            by = np.argsort(kind, kind="stable")
            start = np.concatenate([[True], kind[by][1:] != kind[by][:-1]])
            place = np.arange(len(by)) - np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
            stay = np.sort(by[place < copies])
            ids, x = ids[stay], x[stay]
        low, high = (x.min(0), x.max(0)) if dim else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        span = high.astype(float) - low.astype(float)
        width = np.maximum(1, np.ceil((span + 1) / CELLS))
        cells = np.minimum((x.astype(float) - low.astype(float)) // width, CELLS - 1).astype(np.uint8)
        kind = next(i for i, t in enumerate(_KINDS) if not x.size or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max))
        row = [dim, group["block"][0].as_py(), ids.tobytes(), kind, x.astype(_KINDS[kind]).tobytes(), low.astype(np.int64).tobytes(), width.tobytes(), cells.tobytes(), float(np.abs(x.astype(float)).max(initial=0))]
        return pa.table([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    return pack, "dim long, block long, ids binary, kind int, exact binary, low binary, width binary, cells binary, largest double"


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle score of each query and vector, slack of each query): scores lie within the slack of the middle."""
    base = q @ (low + (width - 1) / 2)
    return (q * width) @ cells.T + base[:, None], np.abs(q) @ ((width - 1) / 2)


def _without_self(scores: np.ndarray, q_ids: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Scores with a query's own vector at minus infinity; `ids` ascend."""
    own = np.minimum(np.searchsorted(ids, q_ids), max(len(ids) - 1, 0))
    hit = np.flatnonzero(ids[own] == q_ids) if len(ids) else []
    scores[hit, own[hit] if len(ids) else []] = -np.inf
    return scores


def least_scores(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray, k: int) -> np.ndarray:
    """A score that the k-th result of each query reaches at least, from the cells of one block."""
    if len(ids) <= k:
        return np.full(len(q), -np.inf)
    found = []
    for a in range(0, len(q), 128):
        middle, slack = bounds(q[a : a + 128], low, width, cells)
        middle = _without_self(middle, q_ids[a : a + 128], ids)
        found.append(np.partition(middle, len(ids) - k, axis=1)[:, len(ids) - k] - slack)
    return np.concatenate(found)


def survivors(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, vector place, upper bound) of the vectors that may reach `least`, by query, largest bounds first."""
    rows, columns, uppers = [], [], []
    for a in range(0, len(q), 128):
        middle, slack = bounds(q[a : a + 128], low, width, cells)
        upper = _without_self(middle, q_ids[a : a + 128], ids) + slack[:, None]
        row, column = np.nonzero((upper >= least[a : a + 128, None] - 1e-6) & (upper > -np.inf))
        rows.append(row + a)
        columns.append(column)
        uppers.append(upper[row, column])
    row, column, upper = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((rows, int), (columns, int), (uppers, float)))
    order = np.lexsort((-upper, row))
    return row[order].astype(np.int32), column[order].astype(np.int32), upper[order]


def refine(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, exact: np.ndarray, row: np.ndarray, column: np.ndarray, upper: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best among its survivors, whose exact vectors are read as far as needed."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    edges = np.searchsorted(row, np.arange(len(q_ids) + 1))
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        left, up = column[lo:hi], upper[lo:hi]
        best, score, at = np.zeros(0, int), np.zeros(0), 0
        while at < len(left) and (len(best) < k or up[at] >= score[-1]):
            more = left[at : at + STEP]
            at += STEP
            best, score = np.concatenate([best, more]), np.concatenate([score, exact[more].astype(float) @ q[i]])
            order = np.lexsort((ids[best], -score))[:k]
            best, score = best[order], score[order]
        found.append((np.full(len(best), q_ids[i]), ids[best], score.astype(np.int64)))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def whole_scores(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, exact: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by whole Python integers, for scores that a double can't hold; they are kept within a long."""
    out = []
    for i, one in zip(q_ids.tolist(), q.astype(object), strict=True):
        score = [max(min(int(s), 2**63 - 1), -(2**63)) for s in exact.astype(object).dot(one)] if q.shape[1] else [0] * len(ids)
        out += [(i, v, -s) for s, v in sorted((-s, v) for s, v in zip(score, ids.tolist(), strict=True) if v != i)[:k]]
    return tuple(np.array([r[c] for r in out], np.int64) for c in range(3))


def _numbers(row: dict, name: str, kind=np.int64, dim: int | None = None) -> np.ndarray:
    found = np.frombuffer(row[name], kind)
    return found if dim is None else found.reshape(-1, dim) if dim else np.zeros((len(row["ids" if name in ("exact", "cells") else "q_ids"]) // 8, 0), kind)


def _queries(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return _numbers(row, "q_ids"), _numbers(row, "q_exact", _KINDS[row["q_kind"]], row["dim"])


def _cells(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _numbers(row, "ids"), _numbers(row, "low").astype(float), _numbers(row, "width", float), _numbers(row, "cells", np.uint8, row["dim"]).astype(float)


def _each(df: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow over rows of blocks, one at a time."""

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                yield from make(batch.slice(n, 1).to_pylist()[0])
        give_back()

    return df.mapInArrow(run, schema)


def top_k(spark: SparkSession, embeddings: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose id is divisible by `every`, among all other rows.

    Components are floor(scale * x); scores are integer inner products, ties go to the smaller id. Null ids, null
    vectors and vectors with a null or non-finite component take no part; vectors of different lengths aren't compared.
    Rows that repeat an id count once (with different vectors: the least). Fewer candidates give fewer results. Values
    beyond a long are held at its ends. Other columns are ignored; an empty table gives an empty result.
    """
    ws = Workspace(spark, "topk")
    x = F.col("vector")
    finite = F.forall(x, lambda v: F.coalesce((F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v.cast("double")), F.lit(False)))
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).filter(F.col("id").isNotNull() & x.isNotNull() & finite)
    rows = ws.put(rows.select("id", F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("vector"), F.size(x).cast("long").alias("dim")), "rows")
    total = rows.count()
    blocks, parts = max(1, -(-total // BLOCK)), max(1, -(-total // (every * QUERIES)))
    dealt = lambda df, n: df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("dim", "block")
    packed = ws.put(dealt(rows, blocks).applyInArrow(*_pack(k + 1)), "blocks")
    asked = dealt(rows.filter(F.col("id") % every == 0), parts).applyInArrow(*_pack(0))
    asked = ws.put(asked.select("dim", F.col("block").alias("part"), F.col("ids").alias("q_ids"), F.col("kind").alias("q_kind"), F.col("exact").alias("q_exact"), F.col("largest").alias("q_largest")), "queries")
    # the stated query set against all rows, block by block; scores that a double can't hold go another way
    spread = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    fits = F.col("q_largest") * F.col("largest") * F.greatest(F.lit(1), F.col("dim")) < 2.0**52
    approximate = packed.select("dim", "block", "ids", "low", "width", "cells", "largest")
    met = spread.join(approximate, ["dim", "block"]).filter(fits)

    def first(r):
        q_ids, q = _queries(r)
        least = least_scores(q_ids, q.astype(float), *_cells(r), k)
        yield pa.RecordBatch.from_arrays([pa.array([r["dim"]] * len(q_ids), pa.int64()), pa.array([r["part"]] * len(q_ids), pa.int64()), pa.array(q_ids), pa.array(least)], ["dim", "part", "id", "least"])

    least = _each(met, first, "dim long, part long, id long, least double").groupBy("dim", "part", "id").agg(F.max("least").alias("least"))
    # as many rows as a block of queries has
    bars = least.groupBy("dim", "part").agg(F.sort_array(F.collect_list(F.struct("id", "least"))).alias("bars"))
    bars = ws.put(bars.select("dim", "part", F.transform("bars", lambda b: b["least"]).alias("least")), "least")

    def second(r):
        q_ids, q = _queries(r)
        row, column, upper = survivors(q_ids, q.astype(float), np.array(r["least"]), *_cells(r))
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int64()), pa.array([r["part"]], pa.int64()), pa.array([r["block"]], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (row, column, upper))], ["dim", "part", "block", "row", "column", "upper"])

    left = ws.put(_each(met.join(bars, ["dim", "part"]), second, "dim long, part long, block long, row binary, column binary, upper binary"), "survivors")
    exact = packed.select("dim", "block", "ids", "kind", "exact")

    def third(r):
        q_ids, q = _queries(r)
        found = refine(q_ids, q.astype(float), _numbers(r, "ids"), _numbers(r, "exact", _KINDS[r["kind"]], r["dim"]), _numbers(r, "row", np.int32), _numbers(r, "column", np.int32), _numbers(r, "upper", float), k)
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)) for f in found], ["query_id", "vec_id", "score"])

    found = _each(left.join(asked, ["dim", "part"]).join(exact, ["dim", "block"]), third, "query_id long, vec_id long, score long")

    def whole(r):
        q_ids, q = _queries(r)
        yield pa.RecordBatch.from_arrays([pa.array(f) for f in whole_scores(q_ids, q, _numbers(r, "ids"), _numbers(r, "exact", _KINDS[r["kind"]], r["dim"]), k)], ["query_id", "vec_id", "score"])

    large = spread.join(packed.select("dim", "block", "ids", "kind", "exact", "largest"), ["dim", "block"]).filter(~fits)
    found = found.unionByName(_each(large, whole, "query_id long, vec_id long, score long"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
