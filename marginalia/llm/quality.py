"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Cyclic boosting of shallow trees learns one lookup table per feature and one per chosen pair of features; a score is
the sum of the tables' entries at a text's bins. The fit sees a bounded sample of labelled rows (`SAMPLE` rows, the
smallest by a hash of the id); scoring reads every whole text once, in Arrow batches, next to the JVM columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, map_arrow, slices, small_batches, span_hashes, text_buffers, words

#: Labelled rows that a fit may read at most.
SAMPLE = 20_000
#: Score from which a document is kept.
THRESHOLD = 0.3

#: Byte classes: one count each. Fixed values.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\v\f",
    "line": b"\n",
    "stop": b".?",
    "shout": b"!",
    "comma": b",;:",
    "mark": b"#$%&*+=<>@^_~\\",
    "pipe": b"|",
    "bracket": b"()[]{}/",
    "wide": bytes(range(128, 256)),
}
_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _members in enumerate(CLASSES.values()):
    _CLASS[list(_members)] = _i
FEATURES = [*(f"share_{c}" for c in CLASSES), "log_bytes", "log_words", "word_bytes", "short_words", "long_words", "repeated_next", "distinct_words", "upper_of_letters", "words_per_stop", "bytes_per_line"]


def features(text: pa.Array) -> np.ndarray:
    """(rows, features) of whole texts; null counts as empty, an empty text has zeros."""
    raw, bounds = text_buffers(text)
    return np.concatenate([np.zeros((0, len(FEATURES))), *(_features(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]) for i, j in slices(bounds))])


def _features(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    rows, kinds = len(bounds) - 1, len(CLASSES) + 1
    size = np.diff(bounds)
    of = np.repeat(np.arange(rows), size)
    counts = np.bincount(of * kinds + _CLASS[raw], minlength=rows * kinds).reshape(rows, kinds).astype(float)
    starts, ends, row = words(raw, bounds)
    n = np.bincount(row, minlength=rows).astype(float)
    length = ends - starts
    hashes = span_hashes(raw, starts, ends)
    same = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    per = lambda found, where: np.bincount(where, weights=found, minlength=rows)
    some, many = np.maximum(size, 1), np.maximum(n, 1)
    letters = counts[:, 0] + counts[:, 1]
    more = [
        np.log1p(size),
        np.log1p(n),
        per(length, row) / many,
        per(length <= 3, row) / many,
        per(length > 15, row) / many,
        per(same, row[1:]) / many,
        per(fresh, r) / many,
        counts[:, 0] / np.maximum(letters, 1),
        n / (counts[:, 5] + 1),
        size / (counts[:, 4] + 1),
    ]
    return np.column_stack([counts[:, : len(CLASSES)] / some[:, None], *more])


@dataclass
class GA2M:
    """intercept + sum of tables[f][bin_f] + sum of pair_tables[i, j][bin_i, bin_j], through the logistic function."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            total += t[b[:, f]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins in two."""
    gl, hl = g.cumsum()[:-1], h.cumsum()[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(gain.argmax()) if len(gain) else -1
    return (float(gain[at]), at + 1) if at >= 0 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton step of a tree of `depth` levels over ordered bins, as a table."""
    gain, cut = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and Newton step of the best tree of one cut in each of two features."""
    best, table = 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    ga, ha, gb, hb = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    q = [(cg[:-1, :-1], ch[:-1, :-1]), (ga - cg[:-1, :-1], ha - ch[:-1, :-1]), (gb - cg[:-1, :-1], hb - ch[:-1, :-1]), (cg[-1, -1] - ga - gb + cg[:-1, :-1], ch[-1, -1] - ha - hb + ch[:-1, :-1])]
    if not q[0][0].size:
        return best, table
    gain = sum(x**2 / (y + 1) for x, y in q) - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [_leaf(x[i, j], y[i, j]) for x, y in q]
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), table


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1) -> GA2M:
    """Cyclic boosting of the main effects, then of the pairs whose best tree gains most on what is left.

    Without rows the score is 0.5; with one class it is that class's smoothed share.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model = GA2M(float(np.log(mean / (1 - mean))), edges, [np.zeros(len(e) + 1) for e in edges])
    if len(set(y.tolist())) < 2:
        return model
    b, total = model.bins(x), np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, f], g, len(table)), np.bincount(b[:, f], h, len(table)))
            table += step
            total += step[b[:, f]]

    def grid(i, j, g, h):
        shape = len(model.tables[i]), len(model.tables[j])
        at = b[:, i] * shape[1] + b[:, j]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_pair_tree(*grid(i, j, g, h))[0], i, j) for i in range(len(edges)) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:n_pairs] if gain > 1e-6]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _pair_tree(*grid(i, j, *slopes()))[1]
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def labelled(documents: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `sample` labelled ids for which `learn` (a condition on the column doc_id) holds.

    An id with several labels counts by their mean, 1 from a half up. Ids go by their hash, so reruns agree.
    """
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & learn)
        .groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # at most `sample` rows of an id and a label; an id may have more rows, of which the first by hash and features count
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", F.xxhash64("doc_id").alias("h"), "y")

    def make(batch):
        x = features(batch.column(0))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([lists, batch.column(1), batch.column(2)], ["x", "h", "y"])

    got = map_arrow(rows, make, "x array<double>, h long, y int").orderBy("h", "x", "y").limit(sample).collect()
    return np.array([r.x for r in got], float).reshape(-1, len(FEATURES)), np.array([r.y for r in got], float)


def train(documents: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, **names: str) -> GA2M:
    return fit(*labelled(documents, labels, learn, sample, **names))


def scorer(model: GA2M):
    """A function from a text column to a score column in [0, 1]."""

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        found = pa.array(model.score(features(text)), pa.float64())
        give_back()
        return found

    return score


def learnable() -> Column:
    """Ids that a fit may learn from; the others are held out."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def quality(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `documents`, from its whole text.

    Null and empty texts get the score of a text without bytes. A null doc_id isn't held out. Repeated rows get
    equal scores. Without labelled rows each score is 0.5. Other columns of either table are ignored.
    """
    small_batches(spark)
    score = scorer(train(documents, labels, learnable()))
    return documents.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), score(F.col("text")).alias("score")).select(
        "*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `documents`, all columns, that score THRESHOLD or more."""
    small_batches(spark)
    score = scorer(train(documents, labels, learnable()))
    return documents.filter(score(F.col("text")) >= THRESHOLD)
