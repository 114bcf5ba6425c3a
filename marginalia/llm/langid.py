"""Language identification by a byte convolutional network, trained in numpy.

Every text is cut in windows of WINDOW bytes, the last one padded. A window's bytes are embedded, filters of several
widths run over them, the largest answer of each filter goes through a softmax layer, and a text's probabilities are
its windows' mean, weighed by their letters. The fit sees a bounded sample of labelled rows, with the whole texts of
them: those whose hash lies below a bound that lets PER_LANGUAGE rows of a language through in the mean (fewer where
there are more than SAMPLE / PER_LANGUAGE languages), and of these the first by the hash up to FIT_BYTES bytes of a
language. Prediction reads every byte of every text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, text_buffers

WINDOW, EMBEDDING, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
PER_LANGUAGE, FIT_BYTES, SAMPLE = 600, 1 << 20, 12_000
EPOCHS, BATCH, RATE = 4, 128, 3e-3

_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = 1
_ANY_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Largest answer, and its place, of each filter in each window (rows of bytes)."""
        values, places = [], []
        for w, weight, bias in zip(WIDTHS, self.filters, self.bias, strict=True):
            n = x.shape[1] - w + 1
            answer = np.zeros((len(x), n, FILTERS), np.float32)
            for k in range(w):
                answer += (self.embedding @ weight[k])[x[:, k : k + n]]
            place = answer.argmax(1)
            values.append(np.take_along_axis(answer, place[:, None, :], 1)[:, 0] + bias)
            places.append(place)
        return values, places

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.languages)))
        tables = [[np.ascontiguousarray(self.embedding @ weight[k]) for k in range(w)] for w, weight in zip(WIDTHS, self.filters, strict=True)]
        for a in range(0, len(x), 256):
            part, pooled = x[a : a + 256], []
            for w, table, bias in zip(WIDTHS, tables, self.bias, strict=True):
                n = part.shape[1] - w + 1
                answer = table[0][part[:, :n]]
                for k in range(1, w):
                    answer += table[k][part[:, k : k + n]]
                pooled.append(answer.max(1) + bias)
            out[a : a + 256] = _softmax(np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.out_bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Adam on the cross-entropy of windows x (n, WINDOW) of languages y; classes weigh alike."""
    rng = np.random.default_rng(seed)
    normal = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    net = Network(languages, normal(256, EMBEDDING, s=0.3), [normal(w, EMBEDDING, FILTERS, s=0.3) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(FILTERS * len(WIDTHS), len(languages), s=0.2), np.zeros(len(languages), np.float32))
    if len(languages) < 2:
        return net
    weigh = len(y) / (len(languages) * np.maximum(np.bincount(y, minlength=len(languages)), 1))
    params = [net.embedding, *net.filters, *net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for a in range(0, len(y), BATCH):
            t += 1
            at = order[a : a + BATCH]
            bx, by = x[at], y[at]
            values, places = net.pooled(bx)
            flat = np.concatenate(values, 1)
            hidden = np.maximum(flat, 0)
            p = _softmax(hidden @ net.out + net.out_bias)
            p[np.arange(len(by)), by] -= 1
            slope = (p * weigh[by][:, None] / len(by)).astype(np.float32)
            back = (slope @ net.out.T) * (flat > 0)
            grads = [np.zeros_like(q) for q in params]
            grads[-2][...], grads[-1][...] = hidden.T @ slope, slope.sum(0)
            rows = np.arange(len(by))[:, None]
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                grads[1 + len(WIDTHS) + i][...] = g.sum(0)
                for k in range(w):
                    byte = bx[rows, places[i] + k]
                    grads[1 + i][k] = np.einsum("nfe,nf->ef", net.embedding[byte], g)
                    np.add.at(grads[0], byte.ravel(), (g[:, :, None] * net.filters[i][k].T[None]).reshape(-1, EMBEDDING))
            for q, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def windows(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, row of each): every byte of every text in one window, zeros behind the last; empty texts have none."""
    size = np.diff(bounds)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    start = bounds[:-1][row] + (np.arange(len(row)) - np.repeat(np.concatenate([[0], n.cumsum()[:-1]]), n)) * WINDOW
    at = start[:, None] + np.arange(WINDOW)[None, :]
    inside = at < bounds[1:][row][:, None]
    out = np.zeros(at.shape, np.uint8)
    out[inside] = raw[at[inside]]
    return out, row


def learnable() -> Column:
    """Ids that a fit may learn from; the others are held out."""
    return F.crc32(F.col("doc_id").cast("string")) % 3 != 1


def sample(documents: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, fit_bytes: int = FIT_BYTES, most: int = SAMPLE) -> list[tuple[str, bytes]]:
    """(language, text) of the rows that a fit learns from, in a fixed order; rows that repeat count once.

    Rows are chosen by a hash of id and text against a bound for their language: no language gathers in a task. Each
    language has its share of `most` rows, in the mean; of a language's rows the first by the hash stay that fit in
    `fit_bytes` together (one at least). Texts of no other rows leave their tasks.
    """
    named = documents.select("text", F.col("lang").alias("y"), F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"), "doc_id", "lang")
    named = named.filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & F.col("text").isNotNull() & learn).select("y", "h", "text")
    # `most` languages at most, the most frequent: a bounded table
    counts = named.groupBy("y").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "y").limit(most)
    languages = counts.count()
    share = max(1, min(per_language, most // max(languages, 1)))
    # a part of all hashes, so that some `share` rows of a language lie in it; all of them where there are few
    part = F.least(F.lit(1.0), F.lit(float(share)) / F.col("n"))
    below = named.join(F.broadcast(counts), "y").filter((F.pmod(F.col("h"), F.lit(1 << 40)).cast("double") < part * float(1 << 40)))
    # a bounded number of rows without their texts: twice the share of each language at most, the least by the hash
    sizes = below.groupBy("h", "y").agg(F.max(F.octet_length("text")).alias("size")).orderBy("h", "y").limit(2 * share * max(languages, 1)).collect()
    used: dict[str, int] = {}
    chosen = []
    for r in sizes:
        if not used.get(r["y"]) or used[r["y"]] + r["size"] <= fit_bytes:
            used[r["y"]] = used.get(r["y"], 0) + max(r["size"], 1)
            chosen.append((r["h"], r["y"]))
    keys = documents.sparkSession.createDataFrame(chosen, "h long, y string")
    got = named.join(F.broadcast(keys), ["h", "y"]).groupBy("h", "y").agg(F.min("text").alias("text")).collect()
    return [(r["y"], r["text"].encode()) for r in sorted(got, key=lambda r: (r["h"], r["y"]))]


def fit(documents: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Network | None:
    """A network of the learnable rows (doc_id, text, lang), from every window of the chosen texts; None where there are none."""
    chosen = sample(documents, learn, per_language)
    languages = sorted({y for y, _ in chosen})
    if not languages:
        return None
    index = {name: i for i, name in enumerate(languages)}
    x, row = windows(np.frombuffer(b"".join(t for _, t in chosen), np.uint8), np.cumsum([0, *(len(t) for _, t in chosen)]))
    return train(x, np.array([index[chosen[r][0]] for r in row], int), languages)


def predict(net: Network | None, text: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, probability) of each text; `und` and 0 where it is null, has no letter, or nothing was learned."""
    raw, bounds = text_buffers(text)
    names, scores = [], []
    for i, j in slices(bounds):
        data, at = raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        x, row = windows(data, at)
        plain = np.concatenate([[0], (_LETTER[data] * (data < 128)).cumsum()])
        has = np.diff(plain[at]) > 0
        for r in np.flatnonzero(~has):
            has[r] = bool(_ANY_LETTER.search(data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace")))
        if net is None:
            names += ["und"] * (j - i)
            scores.append(np.zeros(j - i))
            continue
        p = net.probabilities(x) * (_LETTER[x].sum(1) + 0.01)[:, None]
        total = np.zeros((j - i, len(net.languages)))
        np.add.at(total, row, p)
        total /= np.maximum(total.sum(1, keepdims=True), 1e-300)
        best = total.argmax(1)
        names += [net.languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
        scores.append(np.where(has, np.minimum(total[np.arange(j - i), best], 1.0), 0.0))
    return names, np.concatenate([np.zeros(0), *scores])


def identify(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `documents`, from its whole text.

    A null text, or one without a letter, is `und` with the score 0. A null doc_id isn't held out and isn't learned
    from. Repeated rows get equal answers. Other columns are ignored; an empty table gives an empty result.
    """
    net = fit(documents, learnable())
    docs = documents.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make(batch):
        names, scores = predict(net, batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return map_arrow(docs, make, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
