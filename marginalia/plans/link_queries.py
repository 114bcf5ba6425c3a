"""Queries on linking, the ontology and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble, linking, ontology
from ..session import table
from .derive import WORDS_SQL, words


def gazetteer(spark, sf):
    names = table(spark, sf, "part").groupBy(F.col("p_name").alias("term")).agg(F.min("p_partkey").alias("k"))
    return names.select(F.col("k").alias("entry_id"), "term", F.col("k").cast("string").alias("code"))


def mentions(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("mention_id"), F.col("p_name").alias("name"))
    at = (F.col("mention_id") % F.length("name") + 1).cast("int")
    cut = F.concat(F.substring("name", F.lit(1), at - 1), F.substring("name", at + 1, F.length("name")))
    swap = F.concat(F.substring("name", F.lit(1), at - 1), F.lit("x"), F.substring("name", at + 1, F.length("name")))
    text = F.when(F.col("mention_id") % 3 == 0, cut).when(F.col("mention_id") % 3 == 1, swap).otherwise(F.col("name"))
    m = part.withColumn("text", text)
    return m.join(gazetteer(spark, sf).select(F.col("term").alias("name"), F.col("code").alias("gold_code")), "name").select("mention_id", "text", "gold_code")


_BASE = """
    gaz AS (SELECT p_name AS term, min(p_partkey) AS entry_id, min(p_partkey)::VARCHAR AS code FROM part GROUP BY p_name),
    m0 AS (SELECT p_partkey AS mention_id, p_name AS name, (p_partkey % length(p_name) + 1)::INT AS cut FROM part),
    m AS (SELECT mention_id, CASE WHEN mention_id % 3 = 0 THEN substring(name, 1, cut - 1) || substring(name, cut + 1) WHEN mention_id % 3 = 1 THEN substring(name, 1, cut - 1) || 'x' || substring(name, cut + 1) ELSE name END AS text, code AS gold_code FROM m0 JOIN gaz ON name = term),
    mt AS (SELECT mention_id, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM m)
"""
_TOP = """top0 AS (SELECT mention_id, code, term, round(score, 9) AS score, entry_id FROM scored), top1 AS (SELECT *, row_number() OVER (PARTITION BY mention_id, code ORDER BY score DESC, entry_id) AS b FROM top0),
    top AS (SELECT mention_id, code, term, score, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, entry_id)::INTEGER AS rank FROM top1 WHERE b = 1)"""
_BM25 = """toks AS (SELECT entry_id, unnest(string_split(lower(term), ' ')) AS tok, len(string_split(lower(term), ' ')) AS len FROM gaz), tf AS (SELECT entry_id, len, tok, count(*) AS tf FROM toks GROUP BY ALL),
    st AS (SELECT count(*) AS n, avg(len(string_split(term, ' '))) AS a FROM gaz), idf AS (SELECT tok, ln(1 + ((SELECT n FROM st) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf GROUP BY tok),
    q AS (SELECT DISTINCT mention_id, tok FROM (SELECT mention_id, unnest(string_split(norm, ' ')) AS tok FROM mt) WHERE tok <> ''),
    sc AS (SELECT mention_id, entry_id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (SELECT a FROM st)))) AS score FROM q JOIN tf USING (tok) JOIN idf USING (tok) GROUP BY ALL),
    scored AS (SELECT mention_id, code, term, score, entry_id FROM sc JOIN gaz USING (entry_id))"""
_GRAMS = "list_transform(range(1, length(w) - n + 2), lambda i: substring(w, i, n))"
_TFIDF = """ew AS (SELECT entry_id, ' ' || unnest(string_split(lower(term), ' ')) || ' ' AS w FROM gaz), eg AS (SELECT entry_id, unnest(list_transform(range(1, length(w) - n + 2), lambda i: substring(w, i, n))) AS g FROM ew, (VALUES (3), (4), (5)) v(n) WHERE length(w) >= n),
    etf AS (SELECT entry_id, g, count(*) AS tf FROM eg GROUP BY ALL), gi AS (SELECT g, ln((1.0::DOUBLE + (SELECT count(*) FROM gaz)) / (1 + count(*))) + 1 AS idf FROM etf GROUP BY g),
    ewt AS (SELECT entry_id, g, tf * idf AS w FROM etf JOIN gi USING (g)), eu AS (SELECT entry_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY entry_id)) AS w FROM ewt),
    qw AS (SELECT mention_id, ' ' || tok || ' ' AS w FROM (SELECT mention_id, unnest(string_split(norm, ' ')) AS tok FROM mt) WHERE tok <> ''),
    qg AS (SELECT mention_id, unnest(list_transform(range(1, length(w) - n + 2), lambda i: substring(w, i, n))) AS g FROM qw, (VALUES (3), (4), (5)) v(n) WHERE length(w) >= n),
    qt AS (SELECT mention_id, g, count(*) * idf AS w FROM qg JOIN gi USING (g) GROUP BY mention_id, g, idf), qu AS (SELECT mention_id, g, w / sqrt(sum(w * w) OVER (PARTITION BY mention_id)) AS qw FROM qt),
    sc AS (SELECT mention_id, entry_id, sum(qw * w) AS score FROM qu JOIN eu USING (g) GROUP BY ALL), scored AS (SELECT mention_id, code, term, score, entry_id FROM sc JOIN gaz USING (entry_id))"""


def link_exact(spark, sf):
    return linking.exact(mentions(spark, sf), gazetteer(spark, sf))


def link_levenshtein(spark, sf):
    return linking.levenshtein(mentions(spark, sf), gazetteer(spark, sf), 0.8).select("mention_id", "code", F.round("score", 6).alias("score"), "rank")


def link_bm25(spark, sf):
    return linking.bm25(mentions(spark, sf), gazetteer(spark, sf), 5).select("mention_id", "code", F.round("score", 6).alias("score"), "rank")


def link_tfidf(spark, sf):
    return linking.tfidf(mentions(spark, sf), gazetteer(spark, sf), 5).select("mention_id", "code", F.round("score", 6).alias("score"), "rank")


def _fused(spark, sf):
    m, g = mentions(spark, sf), gazetteer(spark, sf)
    return linking.reciprocal_rank_fusion({"bm25": linking.bm25(m, g), "levenshtein": linking.levenshtein(m, g)}, top_k=5)


def link_fused(spark, sf):
    return _fused(spark, sf).select("mention_id", "code", F.round("score", 6).alias("score"), "best_rank", "rank")


def retrieval_metrics(spark, sf):
    return linking.retrieval_metrics(linking.bm25(mentions(spark, sf), gazetteer(spark, sf)), mentions(spark, sf))


def linked_spans(spark, sf):
    m = mentions(spark, sf)
    return linking.link(m, linking.levenshtein(m, gazetteer(spark, sf))).select("mention_id", "text", "code", "code_term", F.round("code_score", 6).alias("code_score"))


def _ontology(spark, sf):
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    code = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = nation.select(code("R", "n_regionkey").alias("parent"), code("N", "n_nationkey").alias("child")).union(supplier.select(code("N", "s_nationkey"), code("S", "s_suppkey")))
    tags = edges.select(F.col("parent").alias("code")).union(edges.select("child")).distinct().withColumn("tag", F.substring("code", 1, 1))
    c = table(spark, sf, "customer")
    gold = F.when(F.col("c_custkey") % 2 == 0, code("N", "c_nationkey")).otherwise(F.concat(F.lit("R"), (F.col("c_custkey") % 5).cast("string")))
    pred = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("N"), (F.col("c_custkey") % 27).cast("string"))).otherwise(F.concat(F.lit("S"), (F.col("c_custkey") % 100 + 1).cast("string")))
    return c.select(gold.alias("gold"), pred.alias("pred")), edges, tags


def ontology_relations(spark, sf):
    return ontology.relations(*_ontology(spark, sf)).groupBy(F.col("direction").alias("relation"), "distance", "same_tag").agg(F.count(F.lit(1)).alias("n"))


def ontology_summary(spark, sf):
    found = ontology.summary(ontology.relations(*_ontology(spark, sf)))
    return found.select("n", *(c for d in ("exact", "narrow", "broad", "non_rel") for c in (f"{d}_count", F.round(f"{d}_rate", 6).alias(f"{d}_rate"))), F.round("mean_distance", 6).alias("mean_distance"))


def graph_metrics(spark, sf):
    """By the parity of the customer: the codes of a list of three, and where the first of them stands."""
    pairs, edges, tags = _ontology(spark, sf)
    rows = pairs.select(F.col("gold").alias("gold_code"), F.array("pred", F.lit("N3"), "gold").alias("codes"), F.substring("pred", 1, 1).alias("label"))
    found = ontology.graph_metrics(rows, edges, tags, (1, 2, 3), "label")
    return found.select("label", "n", "exact_count", "narrow_count", "broad_count", "non_rel_count", *(F.round(c, 6).alias(c) for c in ("mean_distance", "recall_at_1", "recall_at_2", "recall_at_3", "mrr", "coverage", "mean_candidates")))


def direction_table(spark, sf):
    found = ontology.direction_table(ontology.relations(*_ontology(spark, sf)))
    return found.select("direction", "count", F.round("mean_distance", 6).alias("mean_distance"), F.round("normalized", 6).alias("normalized"))


def _vocabulary(spark, sf):
    from ..operators.retrieval import build_vocabulary

    named = lambda df: df.select(F.col("p_name").alias("term"), F.col("p_partkey").alias("code"))
    part = table(spark, sf, "part")
    extra = part.filter("p_partkey % 3 = 0").select(F.concat(F.lit("«"), "p_name", F.lit("»")).alias("mention"), F.col("p_partkey").cast("string").alias("concept_id"))
    return build_vocabulary(named(part), [extra])


def vocabulary(spark, sf):
    v = _vocabulary(spark, sf)
    return v.select("term", "code", F.substring("row_id", 1, 3).cast("int").alias("source"))


def candidate_lists(spark, sf):
    """Rows with aligned lists of the three best by BM25, and the first of them."""
    from ..operators.retrieval import candidate_pipeline

    m, g = mentions(spark, sf).withColumnRenamed("gold_code", "code"), gazetteer(spark, sf)
    rows, _ = candidate_pipeline(m, g, "bm25", 3, (1, 3))
    return rows.select("mention_id", F.array_join("codes", " ").alias("codes"), F.array_join("candidates", "|").alias("candidates"), "predicted_code", F.round("predicted_score", 5).alias("predicted_score"), "retrieval_method")


def candidate_metrics(spark, sf):
    from ..operators.retrieval import candidate_pipeline

    m = mentions(spark, sf).withColumn("code", F.when(F.col("mention_id") % 4 == 0, "").otherwise(F.col("gold_code"))).drop("gold_code")
    _, metrics = candidate_pipeline(m, gazetteer(spark, sf), "bm25", 5, (1, 5))
    return metrics.select("method", "n", "n_input_rows", "n_without_gold", *(F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_5", "mrr", "coverage", "mean_candidates")))


def labelled_links(spark, sf):
    """Exact links where mentions and entries have labels: equal, blank or other ones."""
    kind = lambda c: F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("")), (F.col(c) % 3 + 1).cast("int"))
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("term"), F.col("p_partkey").cast("string").alias("code"), kind("p_partkey").alias("label"))
    m = table(spark, sf, "part").select(F.col("p_partkey").alias("mention_id"), F.upper("p_name").alias("text"), kind("p_size").alias("label"))
    return linking.exact(m, names).select("mention_id", "code", "rank")


def reranked(spark, sf):
    c = linking.bm25(mentions(spark, sf), gazetteer(spark, sf), 5)
    scores = c.select("mention_id", "code", ((F.col("mention_id") * 13 + F.col("code").cast("long") * 7) % 101).cast("double").alias("similarity"))
    return linking.rerank(c, scores, 3).select("mention_id", "code", "score", "rank")


def parsed_codes(spark, sf):
    """Lists as JSON, with single quotes, and bare codes."""
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('["A1", "'), "p_brand", F.lit('", "A1"]'))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("['B2', '"), "p_brand", F.lit("']"))).when(F.col("p_partkey") % 4 == 2, F.col("p_brand")).otherwise(F.lit(" "))
    codes = linking.unique_codes(linking.parse_codes(text))
    return table(spark, sf, "part").select("p_partkey", F.array_join(codes, " ").alias("codes"))


def _triplets(spark, sf):
    part = table(spark, sf, "part")
    return part.select(F.col("p_brand").alias("anchor"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("p_type")).alias("positive"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("negative"))


def graph_pairs(spark, sf):
    return linking.graph_pairs(_triplets(spark, sf))


def ranking_examples(spark, sf):
    r = linking.ranking_examples(_triplets(spark, sf))
    return r.select("query", F.array_join("positives", "|").alias("positives"), F.array_join("negatives", "|").alias("negatives"))


def hashed_links(spark, sf):
    """Of each mention, the best entries by hashed n-grams: their cosines, whatever the buckets are."""
    from ..operators.retrieval import hashed_search

    found = hashed_search(mentions(spark, sf), gazetteer(spark, sf), 1, 0.5, features=1 << 30)
    return found.select("mention_id", "code", F.round("score", 6).alias("score"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def vector_ip(spark, sf):
    from ..operators.retrieval import index_search

    v = _vectors(spark, sf)
    return index_search(v.filter("id % 25 = 0"), v, 5, "Flat-IP").select("query_id", "id", "rank", F.round("score", 4).alias("score"))


def vector_l2(spark, sf):
    from ..operators.retrieval import index_search

    v = _vectors(spark, sf)
    return index_search(v.filter("id % 25 = 0"), v, 5, "L2").select("query_id", "id", "rank", F.round("score", 4).alias("score"))


def vector_all_cells(spark, sf):
    """The clustered index with every cell probed finds what the flat one does."""
    from ..operators.retrieval import clustered_search

    v = _vectors(spark, sf)
    return clustered_search(v.filter("id % 25 = 0"), v, 5, "ip", 12, 12).select("query_id", "id", "rank", F.round("score", 4).alias("score"))


def normalized_vectors(spark, sf):
    from ..operators.retrieval import norm, normalize_vector

    v = _vectors(spark, sf).withColumn("u", normalize_vector(F.col("vector"), 1.0))
    return v.select("id", F.round(norm(F.col("vector")), 5).alias("l2"), F.round(norm(F.col("u"), 1.0), 5).alias("l1_after"), F.round(F.col("u")[0], 6).alias("first"))


def ontology_ancestors(spark, sf):
    return ontology.ancestors(_ontology(spark, sf)[1])


def _votes(spark, sf):
    w = words(spark, sf).select(F.col("doc_id"), F.col("word_no").alias("word_id"), F.explode(F.array(*map(F.lit, ("a", "b", "c")))).alias("member"), F.length("token").alias("len"))
    m = F.ascii("member") - 96
    b, i = ((F.col("doc_id") * 7 + F.col("word_id") * 13 + m * 29) % 10).cast("double") / 20, ((F.col("doc_id") * 3 + F.col("word_id") * 11 + F.col("len") + m * 17) % 10).cast("double") / 20
    return w.withColumns({"p_B": b, "p_I": i}).withColumn("p_O", 1 - F.col("p_B") - F.col("p_I")).withColumn("tag", F.when((F.col("p_B") >= F.col("p_O")) & (F.col("p_B") >= F.col("p_I")), "B").when(F.col("p_I") >= F.col("p_O"), "I").otherwise("O"))


_WEIGHTS = {"a": 2.0, "b": 1.0, "c": 1.0}
_VOTES = f"""WITH {WORDS_SQL}, v0 AS (SELECT doc_id, word_no AS word_id, length(token) AS len, unnest(['a', 'b', 'c']) AS member, unnest([1, 2, 3]) AS mi FROM words),
    v1 AS (SELECT doc_id, word_id, member, ((doc_id * 7 + word_id * 13 + mi * 29) % 10)::DOUBLE / 20 AS p_B, ((doc_id * 3 + word_id * 11 + len + mi * 17) % 10)::DOUBLE / 20 AS p_I, CASE member WHEN 'a' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS w FROM v0),
    v AS (SELECT *, 1 - p_B - p_I AS p_O FROM v1),
    c AS (SELECT doc_id, word_id, sum(w * p_B) / sum(w) AS p_B, sum(w * p_I) / sum(w) AS p_I FROM v GROUP BY ALL),
    k AS (SELECT *, CASE WHEN p_B + p_I - 0.5::DOUBLE > 1e-9 THEN 1 ELSE 0 END AS isin FROM c),
    o AS (SELECT *, CASE WHEN isin = 1 AND (coalesce(lag(isin) OVER (PARTITION BY doc_id ORDER BY word_id), 0) = 0 OR p_B - p_I > 1e-9) THEN 1 ELSE 0 END AS opens FROM k),
    n AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY word_id ROWS UNBOUNDED PRECEDING) AS g FROM o)"""


def ensemble_spans(spark, sf):
    return ensemble.decode(ensemble.combine_votes(_votes(spark, sf), _WEIGHTS, False)).select("doc_id", "first_word", "last_word", F.round("score", 6).alias("score"))


def ensemble_hard_votes(spark, sf):
    return ensemble.combine_votes(_votes(spark, sf), {"a": 1.0, "b": 1.0, "c": 1.0}, True).groupBy(F.round("begin", 4).alias("begin"), F.round("inside", 4).alias("inside")).agg(F.count(F.lit(1)).alias("n"))


_SEARCHED = [{"threshold": 0.5, "a": 1.0, "b": 1.0, "c": 1.0}, {"threshold": 0.3, "a": 2.0, "b": 1.0, "c": 1.0}, {"threshold": 0.6, "a": 0.0, "b": 1.0, "c": 3.0}]


def ensemble_search(spark, sf):
    """Three trials of weights and a threshold, against every tenth word as an entity of its own or with the next."""
    w = words(spark, sf)
    gold_ = w.filter("word_no % 10 = 3").select("doc_id", F.col("word_no").alias("first_word"), (F.col("word_no") + F.col("doc_id") % 2).alias("last_word"))
    return ensemble.search(_votes(spark, sf), gold_, _SEARCHED).select("trial", "threshold", "tp", "n_pred", "n_gold", F.round("f1", 6).alias("f1"))


def aligned_votes(spark, sf):
    """Members that lack some words, and a word that one has twice."""
    v = _votes(spark, sf).drop("len")
    tables_ = {m: v.filter(F.col("member") == m).filter((F.col("word_id") + F.ascii("member")) % 5 != 0).drop("member") for m in "abc"}
    tables_["a"] = tables_["a"].unionByName(tables_["a"].filter("word_id % 7 = 1"))
    return ensemble.combine_tables(tables_, _WEIGHTS, False).select("doc_id", "word_id", *(F.round(c, 6).alias(c) for c in ("begin", "inside", "p_B", "p_I")))


def _emissions(spark, sf):
    li = table(spark, sf, "lineitem")
    e = F.array(*(((F.col("l_orderkey") * (7 + k) + F.col("l_linenumber") * (3 + 5 * k) + k) % 11).cast("double") / 4 for k in range(3)))
    return li.select(F.col("l_orderkey").alias("sequence_id"), F.col("l_linenumber").alias("position"), e.alias("emission")).dropDuplicates(["sequence_id", "position"])


_TRANSITIONS, _FIRST, _LAST = [[0.3, 0.11, -1.07], [0.02, -0.6, 0.71], [0.13, 0.17, 0.4]], [0.5, 0.23, -2.0], [0.1, 0.0, 0.29]


def tag_sequences(spark, sf):
    """The best path and the marginals of short sequences."""
    import numpy as np

    from ..operators import sequence

    found = sequence.decode(_emissions(spark, sf), np.array(_TRANSITIONS), np.array(_FIRST), np.array(_LAST))
    return found.select("sequence_id", "position", "tag", F.round("probability", 5).alias("probability"))


def dense_topk(spark, sf):
    from ..operators.dense import cosine_top_k

    return cosine_top_k(table(spark, sf, "embeddings"), 10).select("query_id", "rank", "vec_id")


QUERIES = {f.__name__: f for f in (link_exact, link_levenshtein, link_bm25, link_tfidf, link_fused, retrieval_metrics, linked_spans, ontology_relations, ontology_ancestors, ontology_summary, graph_metrics, direction_table, vocabulary, candidate_lists, candidate_metrics, labelled_links, reranked, parsed_codes, graph_pairs, ranking_examples, hashed_links, vector_ip, vector_l2, vector_all_cells, normalized_vectors, ensemble_spans, ensemble_hard_votes, ensemble_search, aligned_votes, tag_sequences, dense_topk)}

_LEV = "scored AS (SELECT mention_id, code, term, entry_id, 1 - levenshtein(norm, lower(term))::DOUBLE / greatest(length(norm), length(term)) AS score FROM mt JOIN gaz ON 1 - levenshtein(norm, lower(term))::DOUBLE / greatest(length(norm), length(term)) >= 0.8::DOUBLE - 1e-12)"
_ONTO = """edges AS (SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child FROM nation UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier),
    up AS (SELECT code, code AS ancestor, 0 AS distance FROM (SELECT parent AS code FROM edges UNION SELECT child FROM edges) UNION SELECT up.code, e.parent, up.distance + 1 FROM up JOIN edges e ON e.child = up.ancestor),
    anc AS (SELECT code, ancestor, min(distance) AS distance FROM up GROUP BY ALL)"""
def _sequences_sql() -> str:
    """Every path of each short sequence with its score: the best one, and the shares of the tags in all."""
    e = ", ".join(f"((l_orderkey * {7 + k} + l_linenumber * {3 + 5 * k} + {k}) % 11)::DOUBLE / 4" for k in range(3))
    pick = lambda values: "[" + ", ".join(f"{v}::DOUBLE" for v in values) + "]"
    moves = "[" + ", ".join(pick(r) for r in _TRANSITIONS) + "]"
    return f"""WITH RECURSIVE em AS (SELECT l_orderkey AS sid, l_linenumber AS pos, [{e}] AS e, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
        ahead AS (SELECT sid, i, n, t AS tag, {pick(_FIRST)}[t + 1] + e[t + 1] AS a, {pick(_FIRST)}[t + 1] + e[t + 1] AS best, [t] AS path FROM em, (VALUES (0), (1), (2)) v(t) WHERE i = 1
            UNION ALL SELECT sid, i, n, tag, ln(sum(exp(a + move))) + any_value(e[tag + 1]) AS a, max(best + move) + any_value(e[tag + 1]), list_append(arg_max(path, best + move), tag) FROM (
                SELECT p.sid, p.i + 1 AS i, p.n, v.t AS tag, p.a, p.best, p.path, {moves}[p.tag + 1][v.t + 1] AS move, m.e FROM ahead p JOIN em m ON m.sid = p.sid AND m.i = p.i + 1, (VALUES (0), (1), (2)) v(t)) GROUP BY sid, i, n, tag),
        behind AS (SELECT sid, i, t AS tag, {pick(_LAST)}[t + 1] AS b FROM em, (VALUES (0), (1), (2)) v(t) WHERE i = n
            UNION ALL SELECT sid, i, tag, ln(sum(exp(b + move))) AS b FROM (SELECT p.sid, p.i - 1 AS i, v.t AS tag, p.b + m.e[p.tag + 1] AS b, {moves}[v.t + 1][p.tag + 1] AS move FROM behind p JOIN em m ON m.sid = p.sid AND m.i = p.i, (VALUES (0), (1), (2)) v(t) WHERE p.i > 1) GROUP BY sid, i, tag),
        path AS (SELECT sid, arg_max(path, best + {pick(_LAST)}[tag + 1]) AS path FROM ahead WHERE i = n GROUP BY sid),
        marg AS (SELECT a.sid, a.i, a.tag, exp(a.a + b.b) / sum(exp(a.a + b.b)) OVER (PARTITION BY a.sid, a.i) AS p FROM ahead a JOIN behind b USING (sid, i, tag))
        SELECT em.sid AS sequence_id, em.pos AS position, path[em.i]::INTEGER AS tag, round(p, 5) AS probability FROM em JOIN path USING (sid) JOIN marg ON marg.sid = em.sid AND marg.i = em.i AND marg.tag = path[em.i]"""


_SEQUENCES = _sequences_sql()
_RELATED = """p AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'N' || c_nationkey ELSE 'R' || (c_custkey % 5) END AS gold, CASE WHEN c_custkey % 3 = 0 THEN 'N' || (c_custkey % 27) ELSE 'S' || (c_custkey % 100 + 1) END AS pred FROM customer),
    ways AS (SELECT parent AS x, child AS y FROM edges UNION SELECT child, parent FROM edges), hop AS (SELECT code, code AS at_code, 0 AS d FROM (SELECT DISTINCT gold AS code FROM p WHERE gold IN (SELECT code FROM anc)) UNION SELECT hop.code, ways.y, d + 1 FROM hop JOIN ways ON ways.x = hop.at_code WHERE d < 6), near AS (SELECT code, at_code, min(d) AS d FROM hop GROUP BY ALL),
    related AS (SELECT p.*, gold[1] = pred[1] AND gold IN (SELECT code FROM anc) AND pred IN (SELECT code FROM anc) AS same_tag,
        CASE WHEN gold = pred THEN 'exact' WHEN dn.distance IS NOT NULL THEN 'narrow' WHEN u.distance IS NOT NULL THEN 'broad' WHEN gold[1] = pred[1] AND EXISTS (SELECT 1 FROM anc a JOIN anc b ON a.ancestor = b.ancestor WHERE a.code = p.gold AND b.code = p.pred) THEN 'broad' ELSE 'unrelated' END AS relation,
        CASE WHEN gold = pred THEN 0 ELSE coalesce(dn.distance, u.distance, near.d) END::INTEGER AS distance
        FROM p LEFT JOIN anc dn ON dn.code = p.pred AND dn.ancestor = p.gold LEFT JOIN anc u ON u.code = p.gold AND u.ancestor = p.pred LEFT JOIN near ON near.code = p.gold AND near.at_code = p.pred)"""
_TRIPLETS = "t AS (SELECT p_brand AS anchor, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS positive, CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END AS negative FROM part)"
_VECTORS = """SELECT query_id, id, rank, round(score, 4) AS score FROM (SELECT q.vec_id AS query_id, c.vec_id AS id, round({score}, 9) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({score}, 9) DESC, c.vec_id)::INTEGER AS rank
        FROM embeddings q JOIN embeddings c ON q.vec_id % 25 = 0) WHERE rank <= 5"""
ORACLES = {
    "link_exact": f"WITH {_BASE}, scored AS (SELECT mention_id, code, term, 1.0::DOUBLE AS score, entry_id FROM mt JOIN gaz ON norm = lower(term)), {_TOP} SELECT * FROM top WHERE rank <= 25",
    "link_levenshtein": f"WITH {_BASE}, {_LEV}, {_TOP} SELECT mention_id, code, round(score, 6) AS score, rank FROM top WHERE rank <= 25",
    "link_bm25": f"WITH {_BASE}, {_BM25}, {_TOP} SELECT mention_id, code, round(score, 6) AS score, rank FROM top WHERE rank <= 5",
    "link_tfidf": f"WITH {_BASE}, {_TFIDF}, {_TOP} SELECT mention_id, code, round(score, 6) AS score, rank FROM top WHERE rank <= 5",
    "link_fused": f"""WITH {_BASE}, {_BM25}, {_TOP}, {_LEV.replace('scored AS', 'lscored AS')}, {_TOP.replace('scored', 'lscored').replace('top', 'ltop')},
        u AS (SELECT mention_id, code, min(rank) AS r FROM top WHERE rank <= 25 GROUP BY ALL UNION ALL SELECT mention_id, code, min(rank) FROM ltop WHERE rank <= 25 GROUP BY ALL),
        f AS (SELECT mention_id, code, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score, min(r) AS best_rank FROM u GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, best_rank, code)::INTEGER AS rank FROM f)
        SELECT mention_id, code, round(score, 6) AS score, best_rank, rank FROM k WHERE rank <= 5""",
    "retrieval_metrics": f"""WITH {_BASE}, {_BM25}, {_TOP}, t AS (SELECT * FROM top WHERE rank <= 25), c AS (SELECT mention_id, count(*) AS n FROM t GROUP BY ALL), h AS (SELECT mention_id, min(rank) AS hit FROM t JOIN m USING (mention_id) WHERE code = gold_code GROUP BY ALL)
        SELECT count(*) AS n, avg(CASE WHEN hit <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS recall_at_1, avg(CASE WHEN hit <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS recall_at_5, avg(CASE WHEN hit <= 25 THEN 1.0::DOUBLE ELSE 0 END) AS recall_at_25, avg(coalesce(1.0::DOUBLE / hit, 0)) AS mrr, avg(CASE WHEN c.n > 0 THEN 1.0::DOUBLE ELSE 0 END) AS coverage, avg(coalesce(c.n, 0)::DOUBLE) AS mean_candidates
        FROM m LEFT JOIN c USING (mention_id) LEFT JOIN h USING (mention_id)""",
    "linked_spans": f"WITH {_BASE}, {_LEV}, {_TOP} SELECT m.mention_id, m.text, code, term AS code_term, round(score, 6) AS code_score FROM m LEFT JOIN (SELECT * FROM top WHERE rank = 1) t USING (mention_id)",
    "ontology_ancestors": f"WITH RECURSIVE {_ONTO} SELECT * FROM anc",
    "ontology_relations": f"WITH RECURSIVE {_ONTO}, {_RELATED} SELECT relation, distance, same_tag, count(*) AS n FROM related GROUP BY ALL",
    "ontology_summary": f"""WITH RECURSIVE {_ONTO}, {_RELATED} SELECT count(*) AS n, count_if(relation = 'exact') AS exact_count, round(avg((relation = 'exact')::INT), 6) AS exact_rate, count_if(relation = 'narrow') AS narrow_count, round(avg((relation = 'narrow')::INT), 6) AS narrow_rate,
        count_if(relation = 'broad') AS broad_count, round(avg((relation = 'broad')::INT), 6) AS broad_rate, count_if(relation = 'unrelated') AS non_rel_count, round(avg((relation = 'unrelated')::INT), 6) AS non_rel_rate, round(coalesce(avg(distance), 0), 6) AS mean_distance FROM related""",
    "direction_table": f"WITH RECURSIVE {_ONTO}, {_RELATED} SELECT relation AS direction, count(*) AS count, round(avg(distance), 6) AS mean_distance, round(count(*)::DOUBLE / (SELECT count(*) FROM related), 6) AS normalized FROM related GROUP BY relation",
    "graph_metrics": f"""WITH RECURSIVE {_ONTO}, {_RELATED}, l AS (SELECT pred[1] AS label, relation, distance, gold, list_distinct([pred]) AS one, pred, CASE WHEN pred = 'N3' OR pred = gold OR gold = 'N3' THEN CASE WHEN pred = gold AND gold = 'N3' THEN 1 ELSE 2 END ELSE 3 END AS size, CASE WHEN pred = gold THEN 1 WHEN gold = 'N3' THEN 2 WHEN pred = 'N3' THEN 2 ELSE 3 END AS hit FROM related)
        SELECT label, count(*) AS n, count_if(relation = 'exact') AS exact_count, count_if(relation = 'narrow') AS narrow_count, count_if(relation = 'broad') AS broad_count, count_if(relation = 'unrelated') AS non_rel_count, round(coalesce(avg(distance), 0), 6) AS mean_distance,
            round(avg((hit <= 1)::INT), 6) AS recall_at_1, round(avg((hit <= 2)::INT), 6) AS recall_at_2, round(avg((hit <= 3)::INT), 6) AS recall_at_3, round(avg(1.0::DOUBLE / hit), 6) AS mrr, 1.0::DOUBLE AS coverage, round(avg(size), 6) AS mean_candidates FROM l GROUP BY label""",
    "vocabulary": "SELECT term, code, min(source)::INTEGER AS source FROM (SELECT p_name AS term, p_partkey::VARCHAR AS code, 1 AS source FROM part UNION ALL SELECT p_name, p_partkey::VARCHAR, 0 FROM part WHERE p_partkey % 3 = 0) GROUP BY term, code",
    "candidate_lists": f"""WITH {_BASE}, {_BM25}, {_TOP}, t AS (SELECT mention_id, code, term, score, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, code, term) AS k FROM top WHERE rank <= 3)
        SELECT m.mention_id, coalesce(string_agg(t.code, ' ' ORDER BY k), '') AS codes, coalesce(string_agg(term, '|' ORDER BY k), '') AS candidates, arg_min(t.code, k) AS predicted_code, round(arg_min(t.score, k), 5) AS predicted_score, 'bm25' AS retrieval_method FROM m LEFT JOIN t USING (mention_id) GROUP BY m.mention_id""",
    "candidate_metrics": f"""WITH {_BASE}, {_BM25}, {_TOP}, t AS (SELECT mention_id, code, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, code, term) AS k FROM top WHERE rank <= 5), c AS (SELECT mention_id, count(*) AS n FROM t GROUP BY ALL), h AS (SELECT mention_id, min(k) AS hit FROM t JOIN m USING (mention_id) WHERE code = gold_code GROUP BY ALL),
        g AS (SELECT hit, coalesce(c.n, 0) AS n FROM m LEFT JOIN c USING (mention_id) LEFT JOIN h USING (mention_id) WHERE mention_id % 4 <> 0)
        SELECT 'bm25' AS method, count(*) AS n, (SELECT count(*) FROM m) AS n_input_rows, (SELECT count(*) FROM m) - count(*) AS n_without_gold, round(avg(coalesce(hit <= 1, false)::INT), 6) AS recall_at_1, round(avg(coalesce(hit <= 5, false)::INT), 6) AS recall_at_5, round(avg(coalesce(1.0::DOUBLE / hit, 0)), 6) AS mrr, round(avg((n > 0)::INT), 6) AS coverage, round(avg(n), 6) AS mean_candidates FROM g""",
    "labelled_links": """WITH k AS (SELECT p_partkey AS id, lower(p_name) AS name, ['A', 'B', ''][(p_partkey % 3 + 1)::INT] AS el, ['A', 'B', ''][(p_size % 3 + 1)::INT] AS ml FROM part),
        c AS (SELECT m.id AS mention_id, e.id FROM k m JOIN k e USING (name) WHERE m.ml = '' OR e.el = '' OR m.ml = e.el) SELECT mention_id, id::VARCHAR AS code, row_number() OVER (PARTITION BY mention_id ORDER BY id)::INTEGER AS rank FROM c QUALIFY rank <= 25""",
    "reranked": f"""WITH {_BASE}, {_BM25}, {_TOP}, s AS (SELECT mention_id, code, rank AS old, ((mention_id * 13 + code::BIGINT * 7) % 101)::DOUBLE AS score FROM top WHERE rank <= 5)
        SELECT mention_id, code, score, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, old, code)::INTEGER AS rank FROM s QUALIFY rank <= 3""",
    "parsed_codes": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'A1 ' || p_brand WHEN 1 THEN 'B2 ' || p_brand WHEN 2 THEN p_brand ELSE '' END AS codes FROM part",
    "graph_pairs": f"WITH {_TRIPLETS} SELECT DISTINCT anchor, positive AS candidate, 1.0::DOUBLE AS label FROM t WHERE positive <> '' UNION ALL SELECT DISTINCT anchor, negative, 0.0 FROM t WHERE negative <> '' AND negative <> positive",
    "ranking_examples": f"""WITH {_TRIPLETS}, p AS (SELECT anchor, string_agg(positive, '|' ORDER BY positive) AS positives FROM (SELECT DISTINCT anchor, positive FROM t WHERE positive <> '') GROUP BY anchor),
        n AS (SELECT anchor, string_agg(negative, '|' ORDER BY negative) AS negatives FROM (SELECT DISTINCT anchor, negative FROM t WHERE (anchor, negative) NOT IN (SELECT (anchor, positive) FROM t)) GROUP BY anchor)
        SELECT a.anchor AS query, coalesce(positives, '') AS positives, coalesce(negatives, '') AS negatives FROM (SELECT DISTINCT anchor FROM t) a LEFT JOIN p USING (anchor) LEFT JOIN n USING (anchor)""",
    "hashed_links": f"""WITH {_BASE}, eg AS (SELECT entry_id, substring(lower(term), i::INT, n) AS g FROM gaz, (VALUES (3), (4), (5)) v(n), range(1, 100) r(i) WHERE i + n - 1 <= length(term)), et AS (SELECT entry_id, g, count(*)::DOUBLE AS w FROM eg GROUP BY ALL),
        qg AS (SELECT mention_id, substring(norm, i::INT, n) AS g FROM mt, (VALUES (3), (4), (5)) v(n), range(1, 100) r(i) WHERE i + n - 1 <= length(norm)), qt AS (SELECT mention_id, g, count(*)::DOUBLE AS w FROM qg GROUP BY ALL),
        es AS (SELECT entry_id, sqrt(sum(w * w)) AS s FROM et GROUP BY ALL), qs AS (SELECT mention_id, sqrt(sum(w * w)) AS s FROM qt GROUP BY ALL),
        d AS (SELECT mention_id, entry_id, sum(q.w * e.w) / (any_value(qs.s) * any_value(es.s)) AS score FROM qt q JOIN et e USING (g) JOIN es USING (entry_id) JOIN qs USING (mention_id) GROUP BY ALL),
        scored AS (SELECT mention_id, code, term, score, entry_id FROM d JOIN gaz USING (entry_id) WHERE score >= 0.5), {_TOP} SELECT mention_id, code, round(score, 6) AS score FROM top WHERE rank = 1""",
    "vector_ip": _VECTORS.format(score="list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"),
    "vector_l2": _VECTORS.format(score="-pow(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 2)"),
    "vector_all_cells": _VECTORS.format(score="list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])"),
    "normalized_vectors": "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS l2, 1.0::DOUBLE AS l1_after, round(embedding[1]::DOUBLE / list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS first FROM embeddings",
    "ensemble_spans": f"{_VOTES} SELECT doc_id, min(word_id) AS first_word, max(word_id) AS last_word, round(avg(CASE WHEN opens = 1 THEN p_B ELSE p_I END), 6) AS score FROM n WHERE isin = 1 GROUP BY doc_id, g",
    "ensemble_hard_votes": f"""{_VOTES}, t AS (SELECT doc_id, word_id, CASE WHEN p_B >= p_O AND p_B >= p_I THEN 'B' WHEN p_I >= p_O THEN 'I' ELSE 'O' END AS tag FROM v),
        s AS (SELECT doc_id, word_id, round(avg(CASE WHEN tag = 'B' THEN 1.0::DOUBLE ELSE 0 END), 4) AS begin, round(avg(CASE WHEN tag = 'I' THEN 1.0::DOUBLE ELSE 0 END), 4) AS inside FROM t GROUP BY ALL) SELECT begin, inside, count(*) AS n FROM s GROUP BY ALL""",
    "ensemble_search": " UNION ALL ".join(f"""SELECT {i}::INTEGER AS trial, {t['threshold']}::DOUBLE AS threshold, tp, n_pred, n_gold, round(2.0::DOUBLE * tp / (n_pred + n_gold), 6) AS f1 FROM ({_VOTES
        .replace("CASE member WHEN 'a' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END", f"CASE member WHEN 'a' THEN {t['a']}::DOUBLE WHEN 'b' THEN {t['b']}::DOUBLE ELSE {t['c']}::DOUBLE END").replace('0.5::DOUBLE > 1e-9', f"{t['threshold']}::DOUBLE > 1e-9")},
        sp AS (SELECT doc_id, min(word_id) AS first_word, max(word_id) AS last_word FROM n WHERE isin = 1 GROUP BY doc_id, g), gd AS (SELECT DISTINCT doc_id, word_no AS first_word, word_no + doc_id % 2 AS last_word FROM words WHERE word_no % 10 = 3)
        SELECT (SELECT count(*) FROM sp JOIN gd USING (doc_id, first_word, last_word)) AS tp, (SELECT count(*) FROM sp) AS n_pred, (SELECT count(*) FROM gd) AS n_gold)""" for i, t in enumerate(_SEARCHED)),
    "aligned_votes": f"""WITH {WORDS_SQL}, v0 AS (SELECT doc_id, word_no AS word_id, length(token) AS len, unnest(['a', 'b', 'c']) AS member, unnest([1, 2, 3]) AS mi FROM words),
        v AS (SELECT doc_id, word_id, ((doc_id * 7 + word_id * 13 + mi * 29) % 10)::DOUBLE / 20 AS b, ((doc_id * 3 + word_id * 11 + len + mi * 17) % 10)::DOUBLE / 20 AS i, CASE member WHEN 'a' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS w FROM v0 WHERE (word_id + 96 + mi) % 5 <> 0)
        SELECT doc_id, word_id, round(sum(w * b) / sum(w), 6) AS begin, round(sum(w * i) / sum(w), 6) AS inside, round(sum(w * b) / sum(w), 6) AS "p_B", round(sum(w * i) / sum(w), 6) AS "p_I" FROM v GROUP BY doc_id, word_id""",
    "tag_sequences": _SEQUENCES,
    "dense_topk": """SELECT query_id, rank, vec_id FROM (SELECT q.vec_id AS query_id, c.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id)::INTEGER AS rank
        FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id) WHERE rank <= 10""",
}
