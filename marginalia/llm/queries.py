"""Registered queries of the training-data operators, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_documents

    return scan_documents(spark, _table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(spark, _table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(spark, _table(spark, sf_dir, "pages"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    return encode_documents(spark, _table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(spark, _table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(spark, _table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(spark, _table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(spark, _table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(spark, _table(spark, sf_dir, "documents"))


#: ASCII-only lower-casing of a text, null as empty.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op7_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256({_LOWER}) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY {_LOWER})
    """,
    "op4_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (n + m - c)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT x AS doc_id, x AS low FROM both_ways UNION SELECT b.y, r.low FROM reach r JOIN both_ways b ON b.x = r.doc_id WHERE r.low < b.y)
        SELECT s.doc_id, len(sh) AS n_shingles, coalesce(least(s.doc_id, r.low), s.doc_id) AS component_id, coalesce(least(s.doc_id, r.low), s.doc_id) = s.doc_id AS kept
        FROM s LEFT JOIN (SELECT doc_id, min(low) AS low FROM reach GROUP BY 1) r USING (doc_id)
    """,
    "op8_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
        SELECT query_id, rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 20
    """,
    "op10_mixing": """
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                          substr(md5('mix-1-' || coalesce(doc_id::VARCHAR, 'null')), 1, 16) AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
        r AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
                     (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                       / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
        t AS (SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, cap / w) FROM r WHERE level * w <= cap) * w), cap) AS target FROM r),
        q AS (SELECT d.doc_id, d.size, d.h, t.*, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (base * size + greatest(0, least(size, floor(target + 0.5)::BIGINT - base * source_size - ahead)))::BIGINT AS taken FROM q
    """,
}


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_language_id": op3_language_id,
        "op4_near_dedup": op4_near_dedup,
        "op5_html_text": op5_html_text,
        "op6_pieces": op6_pieces,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_exact_topk": op8_exact_topk,
        "op9_url_filter": op9_url_filter,
        "op10_mixing": op10_mixing,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = dict(ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
