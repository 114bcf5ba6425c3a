"""Candidate retrieval: vocabularies, stored embeddings, vector search by exact or clustered indexes, the pipeline."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import linking

#: Names of the columns of a term and of a code, in the order in which they are looked for. Fixed values.
TERMS, CODES = ("term", "text", "mention"), ("code", "gold_code", "concept_id")
#: Kinds of index by their names and other spellings. Fixed values.
KINDS = {
    "flatip": "flatip", "ip": "flatip", "innerproduct": "flatip", "flatl2": "flatl2", "l2": "flatl2", "sq8": "sq8", "scalarquantizer": "sq8", "quantized": "sq8", "quantizedip": "sq8", "sq4": "sq4",
    "ivfflatip": "ivfflatip", "ivf32,flat": "ivfflatip", "ivfflatl2": "ivfflatl2", "ivfsq8": "ivfsq8", "ivfsq8ip": "ivfsq8", "ivf32,sq8": "ivfsq8", "ivfpq": "ivfpq",
}


def index_kind(name: str) -> str:
    """The kind of index that a name means, whatever its case, spaces and dashes."""
    key = name.lower().replace(" ", "").replace("-", "").replace("_", "")
    if key not in KINDS:
        raise ValueError(f"unknown index {name!r}; there are {', '.join(sorted(set(KINDS.values())))}")
    return KINDS[key]


def build_vocabulary(gazetteer: DataFrame, additional: list[DataFrame] | None = None, term: str | None = None, code: str | None = None, deduplicate: bool = True, remove_guillemets: bool = True) -> DataFrame:
    """row_id, term, code of a gazetteer and further tables, which come first. Blank rows go, quotation marks « » too; of a
    pair that repeats the first stays. Nothing left raises."""
    def part(df: DataFrame, source: int) -> DataFrame:
        def pick(given: str | None, names: tuple[str, ...]) -> str:
            found = given or next((n for n in names if n in df.columns), None)
            if found is None or found not in df.columns:
                raise ValueError(f"none of the columns {names} is there")
            return found

        t, c = F.col(pick(term, TERMS)).cast("string"), F.col(pick(code, CODES)).cast("string")
        t = F.translate(t, "«»", "") if remove_guillemets else t
        return df.select(F.lit(source).alias("source"), F.monotonically_increasing_id().alias("place"), F.trim(t).alias("term"), F.trim(c).alias("code")).filter("term <> '' AND code <> ''")

    sources = [*(additional or []), gazetteer]
    rows = part(sources[0], 0)
    for i, df in enumerate(sources[1:], 1):
        rows = rows.unionByName(part(df, i))
    if deduplicate:
        rows = rows.groupBy("term", "code").agg(F.min(F.struct("source", "place")).alias("o")).select("o.source", "o.place", "term", "code")
    if rows.isEmpty():
        raise ValueError("the vocabulary has no pair of a term and a code")
    return rows.select(F.concat_ws("-", F.lpad(F.col("source").cast("string"), 3, "0"), F.lpad(F.col("place").cast("string"), 19, "0")).alias("row_id"), "term", "code")


def gazetteer_fingerprint(vocabulary: DataFrame, order: str = "row_id") -> str:
    """SHA-256 of the sorted lines `term TAB code` with their places: equal vocabularies in one order have one.

    Each row is hashed where it stands; the hashes of ordered ranges are hashed on the driver, some bytes for a row of a
    gazetteer.
    """
    import hashlib

    digest = hashlib.sha256()
    lines = vocabulary.orderBy(order).select(F.concat(F.col("term"), F.lit("\t"), F.col("code"), F.lit("\n")).alias("line"))
    for row in lines.toLocalIterator(prefetchPartitions=True):
        digest.update(row["line"].encode())
    return digest.hexdigest()


def write_embeddings(spark: SparkSession, index_dir: str, vectors: DataFrame, vocabulary: DataFrame, settings: dict) -> dict:
    """Vectors (row_id, vector) and their vocabulary as Parquet, and the manifest last: without it there is no index."""
    from ..sources.sinks import write_manifest

    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high")).first()
    terms = vocabulary.count()
    if shape["n"] != terms:
        raise ValueError(f"{shape['n']} vectors for {terms} terms")
    if shape["low"] != shape["high"]:
        raise ValueError("the vectors have several lengths")
    vectors.write.mode("overwrite").parquet(f"{index_dir}/embeddings.parquet")
    vocabulary.write.mode("overwrite").parquet(f"{index_dir}/vocabulary.parquet")
    manifest = {**settings, "fingerprint": gazetteer_fingerprint(vocabulary), "n_terms": terms, "dim": shape["low"]}
    write_manifest(spark, manifest, f"{index_dir}/manifest")
    return manifest


def read_embeddings(spark: SparkSession, index_dir: str, vocabulary: DataFrame, settings: dict) -> DataFrame | None:
    """The stored vectors, None where nothing is stored. Another vocabulary, other settings or a store without a manifest raise."""
    from ..sources.tables import read_manifest

    path = spark._jvm.org.apache.hadoop.fs.Path(index_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{index_dir}/manifest/_SUCCESS")):
        raise ValueError(f"{index_dir} has no manifest: an unfinished index, or something else")
    stored = read_manifest(spark, f"{index_dir}/manifest")
    expected = {**settings, "fingerprint": gazetteer_fingerprint(vocabulary), "n_terms": vocabulary.count()}
    differ = sorted(k for k in (stored.keys() - {"dim"}) | expected.keys() if stored.get(k) != expected.get(k))
    if differ:
        raise ValueError(f"the index in {index_dir} was built otherwise: {json.dumps({k: [stored.get(k), expected.get(k)] for k in differ}, default=str)}")
    vectors = spark.read.parquet(f"{index_dir}/embeddings.parquet")
    shape = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if (shape["n"], shape["dim"]) != (stored["n_terms"], stored["dim"]):
        raise ValueError(f"the vectors in {index_dir} don't have the shape of their manifest")
    return vectors


def norm(vector: Column, p: float = 2.0) -> Column:
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x.cast("double")), F.lit(p)))
    return F.pow(total, F.lit(1.0 / p))


def normalize_vector(vector: Column, p: float = 2.0) -> Column:
    """A vector of p-norm 1; zeros stay."""
    n = norm(vector, p)
    return F.transform(vector, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def usable(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows whose vector isn't null and holds finite numbers only."""
    x = F.col(vector)
    return vectors.filter(x.isNotNull() & F.forall(x, lambda v: F.coalesce((F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v.cast("double")), F.lit(False))))


def hashed_ngrams(text: Column, low: int = 3, high: int = 5, features: int = 4096) -> Column:
    """Buckets of the hashed n-grams of a normalised text, with repeats: a sparse vector of counts."""
    return F.transform(linking.char_ngrams(text, low, high), lambda g: F.pmod(F.xxhash64(g), F.lit(features)).cast("int"))


def hashed_search(mentions: DataFrame, gazetteer: DataFrame, k: int = 25, threshold: float = 0.0, similarity: str = "cosine", features: int = 4096, overfetch: int = 5) -> DataFrame:
    """mention_id, code, term, score, rank by hashed n-gram counts: cosine, dot or l2 (minus the squared distance).

    As with a flat index: `overfetch` times k entries are fetched for a mention, then entries of another label go and one
    entry stays for each code. Entries without a common bucket have a score of 0, or only their lengths for l2: those are
    not among the first as long as k entries share a bucket; the others follow in the order of their ids for cosine.
    """
    if similarity not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown similarity {similarity!r}")

    def vectors(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
        tf = rows.select(key, F.explode(hashed_ngrams(F.col(text), features=features)).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).cast("double").alias("w"))
        return tf, tf.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))

    entries, entry_sizes = vectors(gazetteer, "entry_id", "term")
    queries, query_sizes = vectors(mentions.select("text").distinct(), "text", "text")
    dots = queries.withColumnRenamed("w", "qw").join(entries, "g").groupBy("text", "entry_id").agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    sized = dots.join(entry_sizes, "entry_id").join(query_sizes.withColumnRenamed("size", "qsize"), "text")
    dot, a, b = F.col("dot"), F.col("size"), F.col("qsize")
    score = {"cosine": dot / (a * b), "dot": dot, "l2": -(a * a + b * b - 2 * dot)}[similarity]
    place = F.row_number().over(W.partitionBy("text").orderBy(F.desc(F.round("score", 9)), "entry_id"))
    fetched = sized.select("text", "entry_id", score.alias("score")).withColumn("place", place).filter(F.col("place") <= max(k * overfetch, k)).drop("place")
    fetched = fetched.filter(F.col("score") >= threshold) if similarity != "l2" else fetched
    return linking._ranked(mentions, fetched.join(linking._entries(gazetteer), "entry_id"), k, False)


def _blocks(queries: DataFrame, vectors: DataFrame, block: int, part: int) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt to blocks by a hash; every block of queries meets every block of vectors."""
    total, asked = vectors.count(), queries.count()
    blocks, parts = max(1, -(-total // block)), max(1, -(-asked // part))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    q = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), dealt(parts).cast("int").alias("p"), F.col("id").alias("qid"), F.col("vector").alias("qv"))
    v = vectors.select(dealt(blocks).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), "id", "vector")
    return q, v


_FOUND = "query_id long, id long, score double"


def _nearest(metric: str, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        sizes = {n for t, c in ((left, "qv"), (right, "vector")) for n in t[c].combine_chunks().value_lengths().unique().to_pylist()}
        if len(sizes) > 1:
            raise ValueError(f"vectors of {sorted(sizes)} numbers don't compare")
        mat = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, -1)
        x, y, ids = mat(left, "qv"), mat(right, "vector"), right["id"].to_numpy()
        score = x @ y.T if metric == "ip" else -((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T)
        score = np.round(score, 9)
        n = min(k, len(ids))
        best = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :n]
        return pa.table([np.repeat(left["qid"].to_numpy(), n), ids[best].ravel(), np.take_along_axis(score, best, 1).ravel()], schema=schema)

    return run


def vector_search(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "ip", block: int = 16384, part: int = 1024) -> DataFrame:
    """query_id, id, score, rank: the k best vectors (id, vector) of each query (id, vector) by inner product (`ip`) or least
    squared distance (`l2`, negated), exactly, block by block; ties to smaller ids. Rows with null or non-finite vectors
    are left out; vectors of another length raise."""
    q, v = _blocks(usable(queries), usable(vectors), block, part)
    found = q.groupBy("b", "p").cogroup(v.groupBy("b", "p")).applyInArrow(_nearest(metric, k), _FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _k_means(x: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """Centres of the rows of x, from rows at even distances; a centre without rows stays."""
    n = max(1, min(n, len(x)))
    centres = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([((x[a : a + 512, None, :] - centres[None]) ** 2).sum(2).argmin(1) for a in range(0, len(x), 512)])
        centres = np.array([x[own == i].mean(0) if (own == i).any() else centres[i] for i in range(n)])
    return centres


def centroids(vectors: DataFrame, n_lists: int, sample: int = 20_000) -> np.ndarray:
    """Centres of k-means over a sample of the vectors (the smallest by a hash of the id): the cells of a clustered index."""
    rows = usable(vectors).orderBy(F.xxhash64("id"), "id").select("vector").limit(sample).collect()
    x = np.array([r["vector"] for r in rows], float)
    return _k_means(x, n_lists) if len(x) else np.zeros((1, 0))


def _cells(centres: np.ndarray, n: int):
    schema = "id long, vector array<double>, cell int"

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            near = np.argsort(((x[:, None, :] - centres[None]) ** 2).sum(2), axis=1, kind="stable")[:, :n]
            rows = np.repeat(np.arange(batch.num_rows), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)).cast(pa.int64()), batch.column(1).take(pa.array(rows)).cast(pa.list_(pa.float64())), pa.array(near.ravel().astype(np.int32))], ["id", "vector", "cell"])

    return run, schema


def clustered_search(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "ip", n_lists: int = 64, n_probe: int = 8, salt: int = 8) -> DataFrame:
    """As `vector_search` over the vectors in the `n_probe` cells nearest to a query; every vector is in one cell. Cells are
    dealt to `salt` tasks each, so that a full cell isn't one task's."""
    centres = centroids(vectors, n_lists)
    own = usable(vectors).select("id", "vector").mapInArrow(*_cells(centres, 1)).withColumn("s", F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int"))
    asked = usable(queries).select("id", "vector").mapInArrow(*_cells(centres, min(n_probe, len(centres))))
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("s"), F.col("id").alias("qid"), F.col("vector").alias("qv"))
    found = asked.groupBy("cell", "s").cogroup(own.groupBy("cell", "s")).applyInArrow(_nearest(metric, k), _FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def quantized(vectors: DataFrame, bits: int = 8) -> DataFrame:
    """Vectors as a scalar quantiser of `bits` gives them back: each component at one of 2^bits even steps of its range."""
    wide = usable(vectors).select("id", F.posexplode("vector").alias("i", "x"))
    # a row for each component
    ranges = wide.groupBy("i").agg(F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))
    edges = ranges.orderBy("i").collect()
    lows, steps = [r["low"] for r in edges], [max((r["high"] - r["low"]) / (2**bits - 1), 1e-30) for r in edges]
    if not edges:
        return usable(vectors).select("id", "vector")
    low, step = F.array(*map(F.lit, lows)), F.array(*map(F.lit, steps))
    return usable(vectors).select("id", F.transform("vector", lambda x, i: F.get(low, i) + F.round((x.cast("double") - F.get(low, i)) / F.get(step, i)) * F.get(step, i)).alias("vector"))


def product_quantized(vectors: DataFrame, parts: int = 8, bits: int = 8, sample: int = 20_000) -> DataFrame:
    """Vectors as a product quantiser gives them back: each of `parts` runs of components (fewer, if they don't divide the
    length) is the nearest of 2^bits centres of a sample's runs."""
    rows = usable(vectors).orderBy(F.xxhash64("id"), "id").select("vector").limit(sample).collect()
    x = np.array([r["vector"] for r in rows], float)
    if not len(x):
        return usable(vectors).select("id", "vector")
    m = max(d for d in range(1, min(parts, x.shape[1]) + 1) if x.shape[1] % d == 0)
    books = [_k_means(part, 2**bits) for part in np.split(x, m, axis=1)]

    def run(batches):
        for batch in batches:
            y = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            back = [book[((part[:, None, :] - book[None]) ** 2).sum(2).argmin(1)] for part, book in zip(np.split(y, m, axis=1), books, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(list(np.concatenate(back, 1)), pa.list_(pa.float64()))], ["id", "vector"])

    return usable(vectors).select("id", "vector").mapInArrow(run, "id long, vector array<double>")


def index_search(queries: DataFrame, vectors: DataFrame, k: int, kind: str = "flatip", n_lists: int = 64, n_probe: int = 8) -> DataFrame:
    """A search by the kind of index: flatip and flatl2 are exact; sq8, sq4 and ivfpq search quantised vectors, and ivf... the
    `n_probe` nearest of `n_lists` cells."""
    kind = index_kind(kind)
    stored = product_quantized(vectors) if kind == "ivfpq" else quantized(vectors, 4 if kind == "sq4" else 8) if "sq" in kind else vectors
    metric = "l2" if kind.endswith("l2") else "ip"
    return clustered_search(queries, stored, k, metric, n_lists, n_probe) if kind.startswith("ivf") else vector_search(queries, stored, k, metric)


def term_search(queries: DataFrame, vectors: DataFrame, vocabulary: DataFrame, k: int, kind: str = "flatip", overfetch: int = 5) -> DataFrame:
    """mention_id, code, term, score, rank: of `overfetch` times k terms (id, term, code) the best of each code."""
    found = index_search(queries, vectors, k * overfetch, kind).join(vocabulary.select("id", "term", "code"), "id")
    rows = found.select(F.col("query_id").alias("mention_id"), F.col("id").alias("entry_id"), "term", "code", "score")
    return linking.top_candidates(rows, k)


def candidate_pipeline(data: DataFrame, vocabulary: DataFrame, method: str = "tfidf", top_k: int = 200, k_values: tuple[int, ...] = (1, 5, 25, 100, 200), mention: str = "text", gold: str | None = "code") -> tuple[DataFrame, DataFrame | None]:
    """(predictions, metrics): `data` (mention_id, ...) with codes, candidates, scores, predicted_code, predicted_term,
    predicted_score, retrieval_method; and the metrics of the rows with a gold code, None where there is no such column."""
    if top_k < 1:
        raise ValueError("top_k is 1 at least")
    if mention not in data.columns:
        raise ValueError(f"there is no column {mention!r}")
    entries = vocabulary.withColumn("entry_id", F.col("row_id")) if "entry_id" not in vocabulary.columns else vocabulary
    mentions = data.select("mention_id", F.coalesce(F.col(mention).cast("string"), F.lit("")).alias("text"))
    found = matcher(method)(mentions, entries, k=top_k)
    rows = linking.ranked_lists(found, data, top_k)
    first = lambda c: F.get(c, F.lit(0))
    rows = rows.withColumns({"predicted_code": first("codes"), "predicted_term": first("candidates"), "predicted_score": first("scores"), "retrieval_method": F.lit(method)})
    if gold is None or gold not in data.columns:
        return rows, None
    metrics = linking.list_metrics(rows, k_values, gold).withColumn("method", F.lit(method)).withColumn("n_input_rows", F.col("n") + F.col("n_without_gold"))
    return rows, metrics


def matcher(method: str):
    """A generator of candidates by its name; its settings are keywords."""
    by_name = {
        "exact": linking.exact, "levenshtein": linking.levenshtein, "bm25": linking.bm25, "tfidf": linking.tfidf, "matrix": linking.sparse, "hashing": hashed_search,
        "jaro_winkler": lambda m, g, k=25, threshold=0.8: linking.fuzzy(m, g, "jaro_winkler", threshold, k), "token_set": lambda m, g, k=25, threshold=0.8: linking.fuzzy(m, g, "token_set", threshold, k),
    }
    if method not in by_name:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(sorted(by_name))}")
    return by_name[method]
