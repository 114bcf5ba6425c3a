"""Further queries: sweeps, subgroups, surfaces, sparse and fuzzy linking, examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis, linking, stats
from ..session import table
from .derive import SPANS_SQL, gold, predicted
from .link_queries import _BASE, _TOP, gazetteer, mentions


def confidence_sweep(spark, sf):
    found = analysis.confidence_sweep(gold(spark, sf), predicted(spark, sf))
    return found.select(F.round("threshold", 6).alias("threshold"), "n_pred", "tp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


def link_sparse(spark, sf):
    return linking.sparse(mentions(spark, sf), gazetteer(spark, sf), 5).select("mention_id", "code", F.round("score", 6).alias("score"), "rank")


def link_filled(spark, sf):
    m, g = mentions(spark, sf), gazetteer(spark, sf)
    return linking.fill_zero(linking.exact(m, g), m, g, 3).select("mention_id", "code", "score", "rank")


def link_jaro_winkler(spark, sf):
    return linking.fuzzy(mentions(spark, sf), gazetteer(spark, sf), "jaro_winkler", 0.9).select("mention_id", "code", F.round("score", 6).alias("score"), "rank")


def link_token_set(spark, sf):
    return linking.fuzzy(mentions(spark, sf), gazetteer(spark, sf), "token_set", 0.9).select("mention_id", "code", F.round("score", 6).alias("score"), "rank")


def training_pairs(spark, sf):
    c = linking.levenshtein(mentions(spark, sf), gazetteer(spark, sf)).filter("rank = 1").select("mention_id", "term")
    t = mentions(spark, sf).join(c, "mention_id").select(F.col("text").alias("anchor"), F.col("term").alias("positive"), F.when(F.col("mention_id") % 2 == 0, "aluminium rod").otherwise("").alias("negative"))
    return linking.labelled_pairs(t)


def language_sentences(spark, sf):
    """The number of sentences by the rules of each document's language, and where the last one begins."""
    d = stats.language_sentences(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return d.select("doc_id", F.size("sentences").alias("n"), F.element_at(F.transform("sentences", lambda s: s["start"]), -1).alias("last"))


def exact_quantiles(spark, sf):
    points = [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 0.99, 1.0]
    found = stats.quantile_edges(table(spark, sf, "lineitem"), "l_extendedprice", points)
    return spark.createDataFrame([(p, round(v, 4)) for p, v in zip(points, found, strict=True)], "p double, value double")


QUERIES = {f.__name__: f for f in (exact_quantiles, language_sentences, confidence_sweep, link_sparse, link_filled, link_jaro_winkler, link_token_set, training_pairs)}

ORACLES = {
    "exact_quantiles": "SELECT unnest([0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 0.99, 1.0])::DOUBLE AS p, unnest(list_transform(q, lambda v: round(v, 4))) AS value FROM (SELECT quantile_cont(l_extendedprice::DOUBLE, [0.0, 0.1, 0.25, 0.333, 0.5, 0.9, 0.99, 1.0]) AS q FROM lineitem)",
    "training_pairs": f"""WITH {_BASE}, scored AS (SELECT mention_id, code, term, entry_id, 1 - levenshtein(norm, lower(term))::DOUBLE / greatest(length(norm), length(term)) AS score FROM mt JOIN gaz ON 1 - levenshtein(norm, lower(term))::DOUBLE / greatest(length(norm), length(term)) >= 0.8::DOUBLE - 1e-12), {_TOP},
        t AS (SELECT m.text AS anchor, top.term AS positive, CASE WHEN mention_id % 2 = 0 THEN 'aluminium rod' ELSE '' END AS negative FROM top JOIN m USING (mention_id) WHERE rank = 1),
        p AS (SELECT anchor AS mention, positive AS candidate, 1 AS label FROM t UNION ALL SELECT anchor, negative, 0 FROM t) SELECT mention, candidate, max(label)::INTEGER AS label FROM p WHERE trim(mention) <> '' AND trim(candidate) <> '' GROUP BY mention, candidate""",
    "link_sparse": f"""WITH {_BASE}, grams(n) AS (VALUES (3), (4), (5)),
        eg AS (SELECT entry_id, 'c:' || substring(lower(term), i::INT, n) AS g FROM gaz, grams, range(1, 200) r(i) WHERE i + n - 1 <= length(term) UNION ALL SELECT entry_id, 'w:' || array_to_string(ws[i : i + n - 1], ' ') FROM (SELECT entry_id, string_split(lower(term), ' ') AS ws FROM gaz), (VALUES (1), (2)) v(n), range(1, 60) r(i) WHERE i + n - 1 <= len(ws)),
        qg AS (SELECT mention_id, 'c:' || substring(norm, i::INT, n) AS g FROM mt, grams, range(1, 200) r(i) WHERE i + n - 1 <= length(norm) UNION ALL SELECT mention_id, 'w:' || array_to_string(ws[i : i + n - 1], ' ') FROM (SELECT mention_id, string_split(norm, ' ') AS ws FROM mt), (VALUES (1), (2)) v(n), range(1, 60) r(i) WHERE i + n - 1 <= len(ws)),
        et AS (SELECT entry_id, g, count(*) AS tf FROM eg GROUP BY ALL), df AS (SELECT g, ln((1.0::DOUBLE + (SELECT count(*) FROM gaz)) / (1 + count(*))) + 1 AS idf FROM et GROUP BY g),
        ew AS (SELECT entry_id, g, g[1] AS kind, tf * idf AS w FROM et JOIN df USING (g)), eu AS (SELECT entry_id, g, kind, w / sqrt(sum(w * w) OVER (PARTITION BY entry_id, kind)) AS w FROM ew),
        qw AS (SELECT mention_id, g, g[1] AS kind, count(*) * any_value(idf) AS w FROM qg JOIN df USING (g) GROUP BY ALL), qu AS (SELECT mention_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY mention_id, kind)) AS qw FROM qw),
        sc AS (SELECT mention_id, entry_id, sum(CASE WHEN kind = 'w' THEN 0.25::DOUBLE ELSE 1 END * qw * w) AS score FROM qu JOIN eu USING (g) GROUP BY ALL), scored AS (SELECT mention_id, code, term, score, entry_id FROM sc JOIN gaz USING (entry_id)), {_TOP}
        SELECT mention_id, code, round(score, 6) AS score, rank FROM top WHERE rank <= 5""",
    "confidence_sweep": f"""WITH {SPANS_SQL}, q AS (SELECT unnest(list_distinct(quantile_cont(score, [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1]))) AS t FROM pred),
        g AS (SELECT filename, label, start_span, end_span, count(*) AS n FROM gold GROUP BY ALL), p AS (SELECT filename, label, start_span, end_span, t, count(*) AS n FROM pred, q WHERE score >= t GROUP BY ALL),
        s AS (SELECT t AS threshold, sum(p.n)::BIGINT AS n_pred, sum(least(p.n, coalesce(g.n, 0)))::BIGINT AS tp FROM p LEFT JOIN g USING (filename, label, start_span, end_span) GROUP BY t)
        SELECT round(threshold, 6) AS threshold, n_pred, tp, round(tp::DOUBLE / n_pred, 6) AS precision, round(tp::DOUBLE / (SELECT count(*) FROM gold), 6) AS recall, round(2.0::DOUBLE * tp / (n_pred + (SELECT count(*) FROM gold)), 6) AS f1 FROM s""",
    "link_filled": f"""WITH {_BASE}, scored AS (SELECT mention_id, code, term, 1.0::DOUBLE AS score, entry_id FROM mt JOIN gaz ON norm = lower(term) UNION ALL SELECT mention_id, code, term, 0.0::DOUBLE, entry_id FROM mt, gaz WHERE norm <> lower(term)), {_TOP}
        SELECT mention_id, code, score, rank FROM top WHERE rank <= 3""",
    "link_jaro_winkler": f"""WITH {_BASE}, scored AS (SELECT mention_id, code, term, entry_id, jaro_winkler_similarity(norm, lower(term)) AS score FROM mt, gaz WHERE jaro_winkler_similarity(norm, lower(term)) >= 0.9), {_TOP} SELECT mention_id, code, round(score, 6) AS score, rank FROM top WHERE rank <= 25""",
}
