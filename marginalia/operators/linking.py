"""Entity linking: lexical candidate generation by inverted indexes, fusion, top-k, retrieval metrics.

Mentions are (mention_id, text), a gazetteer (entry_id, term, code). Generators return mention_id, code, term, score,
rank; they work on distinct texts and meet the gazetteer through shared tokens or n-grams, never by a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Lower case, white space collapsed, ends trimmed."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def catalogue(gazetteer: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """term, code, label, source, norm_term; one row per (norm_term, code, label), the gazetteer's before the extra ones."""
    rows = gazetteer.select("term", "code", "label", F.lit("gazetteer").alias("source"), F.lit(0).alias("p"))
    if extra is not None:
        rows = rows.unionByName(extra.select("term", "code", "label", F.lit("train").alias("source"), F.lit(1).alias("p")))
    rows = rows.withColumn("norm_term", normalize(F.col("term")))
    first = F.row_number().over(W.partitionBy("norm_term", "code", "label").orderBy("p", "term"))
    return rows.withColumn("n", first).filter("n = 1").drop("n", "p")


def labels_compatible(a: Column, b: Column) -> Column:
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(blank(a) == blank(b), F.lit(True))


def top_candidates(scored: DataFrame, k: int, decimals: int = 9) -> DataFrame:
    """The best entry of each code, then the k best codes of each mention; ties go to the lower entry_id.

    Scores count to `decimals` places, so that the order of a sum doesn't decide a tie."""
    return _best(scored, ["mention_id"], k, decimals).select("mention_id", "code", "term", "score", "rank")


def _best(scored: DataFrame, key: list[str], k: int, decimals: int = 9) -> DataFrame:
    """`scored` with rank: the best entry of each code, of the k best codes of a key."""
    scored = scored.withColumn("score", F.round("score", decimals))
    best = F.row_number().over(W.partitionBy(*key, "code").orderBy(F.desc("score"), "entry_id"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "entry_id"))
    return scored.withColumn("b", best).filter("b = 1").drop("b").withColumn("rank", rank).filter(F.col("rank") <= k)


def _label(df: DataFrame) -> Column:
    return (F.col("label") if "label" in df.columns else F.lit(None)).cast("string")


def _entries(gazetteer: DataFrame, *columns: Column) -> DataFrame:
    """entry_id, term, code, entry_label and more columns of the entries."""
    return gazetteer.select("entry_id", "term", "code", _label(gazetteer).alias("entry_label"), *columns)


def _ranked(mentions: DataFrame, scored: DataFrame, k: int, normalized: bool = True) -> DataFrame:
    """The candidates of each mention from scores of distinct texts (text, entry_id, entry_label, code, term, score), of
    entries whose label doesn't differ from the mention's.

    Mentions of one text and label have the same candidates: those are chosen once, so that a text that many mentions and
    many entries share costs their sum and k rows a mention, not their product."""
    text = normalize(F.col("text")) if normalized else F.col("text")
    m = mentions.select("mention_id", text.alias("text"), F.coalesce(F.trim(_label(mentions)), F.lit("")).alias("mention_label"))
    key = ["text", "mention_label"]
    fits = m.select(*key).distinct().join(scored, "text").filter(labels_compatible(F.col("mention_label"), F.col("entry_label")))
    chosen = _best(fits, key, k).select(*key, "entry_id", "code", "term", "score")
    return top_candidates(m.join(chosen, key), k)


def exact(mentions: DataFrame, gazetteer: DataFrame, k: int = 25) -> DataFrame:
    """Equality of normalised texts, by an equi-join."""
    return _ranked(mentions, _entries(gazetteer, normalize(F.col("term")).alias("text"), F.lit(1.0).alias("score")), k)


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def levenshtein(mentions: DataFrame, gazetteer: DataFrame, threshold: float = 0.8, k: int = 25) -> DataFrame:
    """Similarity 1 - distance / longer length of at least `threshold` (0.75 or more).

    d edits leave at least max(len) - 1 - 2 d bigrams in common, so a pair that reaches the threshold shares a bigram
    unless its texts have under three characters; those meet by their first character or equality instead.
    """
    if threshold < 0.75:
        raise ValueError("a bigram index finds every pair from a similarity of 0.75 up")
    texts = mentions.select(normalize(F.col("text")).alias("text")).distinct()
    terms = _entries(gazetteer, normalize(F.col("term")).alias("norm"))
    near = similar_texts(texts, terms.select("norm").distinct(), threshold)
    return _ranked(mentions, near.join(terms, "norm").drop("norm"), k)


def _numbered_grams(text: Column) -> Column:
    """Bigrams with their numbers among the equal ones: as a set they are the text's bag of bigrams."""
    grams = _grams(text, 2)
    return F.transform(grams, lambda g, i: F.concat(g, F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def similar_texts(texts: DataFrame, norms: DataFrame, threshold: float) -> DataFrame:
    """text, norm, score of the pairs of distinct texts (text) and (norm) whose edit similarity reaches the threshold.

    Of two texts of lengths up to L, at most (1 - threshold) L edits apart, two bags of bigrams share all but two for each
    edit. So if both keep only their rarest bigrams, as many as may be lost and one, they still share one: a common bigram
    of many texts is rarely anyone's key. Texts of under three characters meet by equality.
    """
    if threshold < 0.75:
        raise ValueError("a bigram index finds every pair from a similarity of 0.75 up")
    bags = [rows.select(F.col(c).alias("value"), F.when(F.length(c) < 3, F.array(F.col(c))).otherwise(_numbered_grams(F.col(c))).alias("bag")) for rows, c in ((texts, "text"), (norms, "norm"))]
    rarity = bags[1].select(F.explode("bag").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))

    def keys(rows: DataFrame, name: str) -> DataFrame:
        ranked = rows.select("value", F.explode("bag").alias("g")).join(rarity, "g", "left").groupBy("value").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("bag"))
        size = F.length("value")
        lost = F.array_max(F.transform(F.sequence(size, F.greatest(size, F.floor(size / threshold + 1e-9).cast("int"))), lambda n: size - n + 2 * F.floor((1 - threshold) * n + 1e-9).cast("int")))
        return ranked.select(F.col("value").alias(name), F.explode(F.transform(F.slice("bag", F.lit(1), lost + 1), lambda x: x["g"])).alias("g"))

    longer = F.greatest(F.length("text"), F.length("norm"), F.lit(1))
    near = keys(bags[0], "text").join(keys(bags[1], "norm"), "g").filter(F.least(F.length("text"), F.length("norm")) >= threshold * longer - 1e-9).select("text", "norm").distinct()
    return near.withColumn("score", 1 - F.levenshtein("text", "norm").cast("double") / longer).filter(F.col("score") >= threshold - 1e-12)


def tokens(text: Column) -> Column:
    return F.filter(F.split(normalize(text), " "), lambda t: t != "")


def bm25(mentions: DataFrame, gazetteer: DataFrame, k: int = 25, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 of the distinct query tokens over the terms' tokens; entries without a shared token aren't ranked."""
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("BM25 needs k1 > 0 and 0 <= b <= 1")
    terms = gazetteer.withColumn("toks", tokens(F.col("term"))).withColumn("len", F.size("toks"))
    total = terms.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).first()
    postings = terms.select("entry_id", "len", F.explode("toks").alias("tok")).groupBy("entry_id", "len", "tok").agg(F.count(F.lit(1)).alias("tf"))
    idf = postings.groupBy("tok").agg(F.log(1 + (F.lit(total["n"]) - F.count(F.lit(1)) + 0.5) / (F.count(F.lit(1)) + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(total["avg"])))
    weighted = postings.join(idf, "tok").select("tok", "entry_id", weight.alias("w"))
    texts = mentions.select("text").distinct()
    query = texts.select("text", F.explode(F.array_distinct(tokens(F.col("text")))).alias("tok"))
    scored = query.join(weighted, "tok").groupBy("text", "entry_id").agg(F.sum("w").alias("score"))
    return _ranked(mentions, scored.join(_entries(gazetteer), "entry_id"), k, False)


def char_wb(text: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams of each word between two spaces, repeats included, words apart; a shorter padded word counts whole."""
    padded = F.transform(tokens(text), lambda t: F.concat(F.lit(" "), t, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))).otherwise(F.array().cast("array<string>"))))))


def tfidf(mentions: DataFrame, gazetteer: DataFrame, k: int = 25) -> DataFrame:
    """Cosine of character n-gram TF-IDF vectors: idf = ln((1 + n) / (1 + df)) + 1, n-grams outside the terms ignored."""
    n = gazetteer.count()
    tf = gazetteer.select("entry_id", F.explode(char_wb(F.col("term"))).alias("g")).groupBy("entry_id", "g").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("g").agg((F.log((1.0 + F.lit(n)) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    unit = lambda v, key: v.join(v.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), key).select(key, "g", (F.col("w") / F.col("norm")).alias("w"))
    entries = unit(tf.join(idf, "g").select("entry_id", "g", (F.col("tf") * F.col("idf")).alias("w")), "entry_id")
    texts = mentions.select("text").distinct()
    q = texts.select("text", F.explode(char_wb(F.col("text"))).alias("g")).groupBy("text", "g").agg(F.count(F.lit(1)).alias("tf")).join(idf, "g").select("text", "g", (F.col("tf") * F.col("idf")).alias("w"))
    scored = unit(q, "text").withColumnRenamed("w", "qw").join(entries, "g").groupBy("text", "entry_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score"))
    return _ranked(mentions, scored.join(_entries(gazetteer), "entry_id"), k, False)


def reciprocal_rank_fusion(rankings: dict[str, DataFrame], k: int = 60, top_k: int | None = None) -> DataFrame:
    """mention_id, code, score, best_rank, sources, rank: sum of 1 / (k + rank) over sources; ties by best rank, then code."""
    rows = None
    for name, r in rankings.items():
        one = r.filter(F.col("code").isNotNull()).groupBy("mention_id", "code").agg(F.min("rank").alias("r")).withColumn("source", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    fused = rows.groupBy("mention_id", "code").agg(F.round(F.sum(1.0 / (k + F.col("r"))), 12).alias("score"), F.min("r").alias("best_rank"), F.array_sort(F.collect_list("source")).alias("sources"))
    ranked = fused.withColumn("rank", F.row_number().over(W.partitionBy("mention_id").orderBy(F.desc("score"), "best_rank", "code")))
    return ranked if top_k is None else ranked.filter(F.col("rank") <= top_k)


def retrieval_metrics(candidates: DataFrame, gold: DataFrame, k_values: tuple[int, ...] = (1, 5, 25)) -> DataFrame:
    """One row: n, recall_at_k for each k, mrr, coverage, mean_candidates over the mentions with a gold code."""
    g = gold.filter(F.col("gold_code").isNotNull()).select("mention_id", "gold_code")
    per = candidates.groupBy("mention_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    hits = candidates.join(g, "mention_id").filter("code = gold_code").groupBy("mention_id").agg(F.min("rank").alias("hit"))
    rows = g.join(per, "mention_id", "left").join(hits, "mention_id", "left")
    at = lambda k: F.avg(F.when(F.col("hit") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}")
    return rows.agg(F.count(F.lit(1)).alias("n"), *map(at, k_values), F.avg(F.coalesce(1.0 / F.col("hit"), F.lit(0.0))).alias("mrr"), F.avg(F.when(F.col("n_candidates") > 0, 1.0).otherwise(0.0)).alias("coverage"), F.avg(F.coalesce(F.col("n_candidates"), F.lit(0)).cast("double")).alias("mean_candidates"))


def link(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mentions with code, code_term, code_score and candidates_json of their ranking; unlinked ones have nulls."""
    first = candidates.filter("rank = 1").select("mention_id", "code", F.col("term").alias("code_term"), F.col("score").alias("code_score"))
    packed = candidates.groupBy("mention_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "code", "term", "score")))).alias("candidates_json"))
    return mentions.join(first, "mention_id", "left").join(packed, "mention_id", "left")


def complete(spans: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows with a gold code keep it (code_source `gold`); the others take the linked one."""
    gold = F.nullif(F.trim("gold_code"), F.lit(""))
    joined = spans.join(linked.select("mention_id", F.col("code").alias("_c"), "code_term", "code_score", "candidates_json"), "mention_id", "left")
    blank = lambda c: F.when(gold.isNull(), F.col(c)).alias(c)
    return joined.select(*spans.columns, F.coalesce(gold, "_c").alias("code"), *map(blank, ("code_term", "code_score", "candidates_json")), F.when(gold.isNotNull(), "gold").when(F.col("_c").isNotNull(), "predicted").alias("code_source"))


def word_ngrams(text: Column, high: int = 2) -> Column:
    """Words and runs of up to `high` words."""
    t = tokens(text)
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(high)), lambda n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))))


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """n-grams across words, of the normalised text."""
    t = normalize(text)
    return F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))).otherwise(F.array().cast("array<string>"))))


def sparse(mentions: DataFrame, gazetteer: DataFrame, k: int = 25, word_weight: float = 0.25) -> DataFrame:
    """Character n-gram cosine plus `word_weight` times the word n-gram cosine, one inverted index for both."""
    n = gazetteer.count()
    both = lambda c: F.concat(F.transform(char_ngrams(c), lambda g: F.concat(F.lit("c:"), g)), F.transform(word_ngrams(c), lambda g: F.concat(F.lit("w:"), g)))

    def vectors(rows: DataFrame, key: str, column: str, idf: DataFrame | None):
        tf = rows.select(key, F.explode(both(F.col(column))).alias("g")).groupBy(key, "g").agg(F.count(F.lit(1)).alias("tf"))
        idf = tf.groupBy("g").agg((F.log((1.0 + F.lit(n)) / (1 + F.count(F.lit(1)))) + 1).alias("idf")) if idf is None else idf
        w = tf.join(idf, "g").select(key, "g", F.substring("g", 1, 1).alias("kind"), (F.col("tf") * F.col("idf")).alias("w"))
        size = w.groupBy(key, "kind").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
        return w.join(size, [key, "kind"]).select(key, "g", "kind", (F.col("w") / F.col("size")).alias("w")), idf

    entries, idf = vectors(gazetteer, "entry_id", "term", None)
    q, _ = vectors(mentions.select("text").distinct(), "text", "text", idf)
    part = F.when(F.col("kind") == "w", word_weight).otherwise(1.0) * F.col("qw") * F.col("w")
    scored = q.select("text", "g", F.col("w").alias("qw")).join(entries, "g").groupBy("text", "entry_id").agg(F.sum(part).alias("score")).join(_entries(gazetteer), "entry_id")
    return _ranked(mentions, scored, k, False)


def fill_zero(candidates: DataFrame, mentions: DataFrame, gazetteer: DataFrame, k: int) -> DataFrame:
    """Rankings of fewer than `k` codes filled with unseen codes at score 0, in the order of entry_id.

    A mention needs no entry beyond the k + k first codes, so the filling is bounded by k."""
    first = gazetteer.groupBy("code").agg(F.min(F.struct("entry_id", "term")).alias("e")).select("code", "e.entry_id", "e.term").orderBy("entry_id").limit(2 * k)
    have = mentions.select("mention_id").join(candidates.groupBy("mention_id").agg(F.count(F.lit(1)).alias("n")), "mention_id", "left").na.fill(0, ["n"]).filter(F.col("n") < k)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("entry_id", "code", "term"))).alias("all")).first()["all"]
    spare = F.array(*(F.struct(F.lit(r["entry_id"]).alias("entry_id"), F.lit(r["code"]).alias("code"), F.lit(r["term"]).alias("term")) for r in listed))
    more = have.select("mention_id", "n", F.inline(spare)).join(candidates.select("mention_id", "code"), ["mention_id", "code"], "left_anti")
    place = F.row_number().over(W.partitionBy("mention_id").orderBy("entry_id"))
    filled = more.withColumn("rank", (F.col("n") + place).cast("int")).filter(F.col("rank") <= k).select("mention_id", "code", "term", F.lit(0.0).alias("score"), "rank")
    return candidates.unionByName(filled)


def _numbered_characters(text: Column) -> Column:
    """Each character of `text` with its number among the equal ones: as a set they are the text's multiset of characters."""
    head = lambda i: F.substring(text, F.lit(1), i)
    number = lambda i: F.length(head(i)) - F.length(F.replace(head(i), F.substring(text, i, F.lit(1)), F.lit("")))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, i, F.lit(1)), number(i).cast("string"))))


def _pairs_by_characters(texts: DataFrame, norms: DataFrame, method: str, threshold: float) -> DataFrame:
    """(text, norm) that may reach the threshold by the characters they have in common, none left out but those that a
    shared key finds.

    Jaro is at most (c / a + c / b + 1) / 3 for c common characters, and Jaro-Winkler raises it by the first character
    at most where no bigram is shared; without a shared word the token set ratio is at most 2 c / (a + b). So each side
    needs a least c, and two sets with that many in common share one of their rarest len - c + 1 elements.
    """
    jaro = method == "jaro_winkler"
    form = (lambda c: c) if jaro else (lambda c: F.array_join(F.array_distinct(F.filter(F.split(c, " "), lambda t: t != "")), " "))
    least = 3 * (threshold - 0.1) / 0.9 - 1 if jaro else threshold
    share = least - 1 if jaro else threshold / (2 - threshold)
    sides = [rows.select(F.col(c).alias("value"), _numbered_characters(form(F.col(c))).alias("chars")).filter("chars IS NOT NULL") for rows, c in ((texts, "text"), (norms, "norm"))]
    rarity = sides[1].select(F.explode("chars").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))

    def prefix(rows: DataFrame, name: str) -> DataFrame:
        ranked = rows.select("value", F.explode("chars").alias("g")).join(rarity, "g", "left").groupBy("value").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("chars"))
        ranked = ranked.select("value", F.transform("chars", lambda x: x["g"]).alias("chars"))
        kept = F.size("chars") - F.greatest(F.lit(1), F.ceil(F.size("chars") * F.lit(share) - 1e-9)).cast("int") + 1
        return ranked.select(F.col("value").alias(name), F.col("chars").alias(f"{name}_chars"), F.explode(F.slice("chars", F.lit(1), kept)).alias("g"))

    a, b = F.size("text_chars"), F.size("norm_chars")
    reach = lambda c: (c / a + c / b if jaro else 2 * c / (a + b)) >= least - 1e-9
    near = prefix(sides[0], "text").join(prefix(sides[1], "norm"), "g").filter(reach(F.least(a, b)))
    return near.filter(reach(F.size(F.array_intersect("text_chars", "norm_chars")))).select("text", "norm").distinct()


def fuzzy(mentions: DataFrame, gazetteer: DataFrame, method: str = "jaro_winkler", threshold: float = 0.8, k: int = 25) -> DataFrame:
    """Jaro-Winkler or token-set similarity of at least `threshold` of distinct texts to the terms.

    Pairs come from shared character bigrams (and words for token sets), and from common characters where there are
    enough of them for the threshold without either, so no pair that reaches it is left out."""
    from ..functions.text import similarity

    texts = mentions.select(normalize(F.col("text")).alias("text")).distinct()
    terms = _entries(gazetteer, normalize(F.col("term")).alias("norm"))
    norms = terms.select("norm").distinct()
    grams = lambda c: F.when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(_grams(c, 2)))
    words = lambda c: F.array_distinct(F.transform(tokens(c), lambda t: F.concat(F.lit(" "), t, F.lit(" "))))
    key = (lambda c: F.concat(grams(c), words(c))) if method == "token_set" else grams
    near = texts.select("text", F.explode(key(F.col("text"))).alias("g")).join(norms.select("norm", F.explode(key(F.col("norm"))).alias("g")), "g").select("text", "norm")
    near = near.unionByName(_pairs_by_characters(texts, norms, method, threshold)).distinct()
    scored = near.withColumn("score", similarity(F.col("text"), F.col("norm"), method)).filter(F.col("score") >= threshold).join(terms, "norm")
    return _ranked(mentions, scored.drop("norm"), k)


def ranked_lists(candidates: DataFrame, mentions: DataFrame, top_k: int = 200, min_score: float = 0.0) -> DataFrame:
    """`mentions` with aligned lists `codes`, `candidates`, `scores` of their rankings (mention_id, code, term, score), best
    first, ties by code and term, one entry for each code; empty lists where there is no candidate."""
    kept = candidates.filter(F.col("score") >= min_score)
    best = kept.groupBy("mention_id", "code").agg(F.min(F.struct((-F.col("score")).alias("s"), "term")).alias("b"))
    lists = best.groupBy("mention_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("b.s", "code", "b.term"))), 1, top_k).alias("l"))
    out = mentions.join(lists, "mention_id", "left")
    pick = lambda make, t: F.coalesce(F.transform("l", make), F.array().cast(f"array<{t}>"))
    return out.withColumns({"codes": pick(lambda x: x["code"], "string"), "candidates": pick(lambda x: x["term"], "string"), "scores": pick(lambda x: -x["s"], "double")}).drop("l")


def rerank(candidates: DataFrame, scores: DataFrame, k: int = 10) -> DataFrame:
    """The rankings again by a scorer's (mention_id, code, similarity): the k best codes, ties by the old rank.

    Of several candidates of one code the last counts, as in a look-up by code."""
    by_code = candidates.groupBy("mention_id", "code").agg(F.max_by("term", "rank").alias("term"), F.max("rank").alias("old"))
    joined = by_code.join(scores.groupBy("mention_id", "code").agg(F.max("similarity").alias("score")), ["mention_id", "code"])
    rank = F.row_number().over(W.partitionBy("mention_id").orderBy(F.desc("score"), "old", "code"))
    return joined.withColumn("rank", rank).filter(F.col("rank") <= k).select("mention_id", "code", "term", "score", "rank")


def word_patterns(text: Column) -> Column:
    """Lower-cased words, with those that hyphens, underscores and slashes hold together as one."""
    return F.regexp_extract_all(normalize(text), F.lit(r"(?U)\w+(?:[-_/]\w+)*"), F.lit(0))


def parse_codes(value: Column) -> Column:
    """A list of codes of a text: a JSON list, a list with single quotes, or one code; blank texts give an empty list."""
    text = F.trim(value)
    listed = F.coalesce(F.from_json(text, "array<string>"), F.from_json(F.translate(text, "'()", '"[]'), "array<string>"))
    codes = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when(text.rlike(r"^[\[(].*[\])]$"), F.coalesce(listed, F.array(text))).otherwise(F.array(text))
    return F.filter(codes, lambda c: c.isNotNull() & (c != ""))


def unique_codes(codes: Column) -> Column:
    """The distinct codes that aren't blank, in the order in which they come first."""
    return F.filter(F.array_distinct(codes), lambda c: c.isNotNull() & (c != ""))


def list_metrics(rows: DataFrame, k_values: tuple[int, ...] = (1, 5, 25), gold: str = "gold_code", codes: str = "codes", by: str | None = None) -> DataFrame:
    """n, recall_at_k, mrr, coverage, mean_candidates of rows with a gold code and a list of codes; with `by` one row for each
    of its values. Rows without a gold code are counted in n_without_gold and left out of the rest."""
    has = F.coalesce(F.trim(F.col(gold).cast("string")), F.lit("")) != ""
    ranked = rows.withColumn("_codes", unique_codes(F.col(codes))).withColumn("_hit", F.array_position("_codes", F.col(gold).cast("string")))
    over = lambda c: F.coalesce(F.avg(F.when(has, c)), F.lit(0.0))
    at = lambda k: over(F.when((F.col("_hit") > 0) & (F.col("_hit") <= k), 1.0).otherwise(0.0)).alias(f"recall_at_{k}")
    grouped = ranked.groupBy(by) if by else ranked.groupBy()
    return grouped.agg(F.count_if(has).alias("n"), F.count_if(~has).alias("n_without_gold"), *map(at, k_values), over(F.when(F.col("_hit") > 0, 1.0 / F.col("_hit")).otherwise(0.0)).alias("mrr"), over(F.when(F.size("_codes") > 0, 1.0).otherwise(0.0)).alias("coverage"), over(F.size("_codes").cast("double")).alias("mean_candidates"))


def graph_pairs(triplets: DataFrame) -> DataFrame:
    """anchor, candidate, label: distinct positives (1.0) and negatives (0.0) of triplets; a negative that is its row's
    positive goes."""
    clean = triplets.select(*(F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("anchor", "positive", "negative"))).filter("anchor <> ''")
    positive = clean.filter("positive <> ''").select("anchor", F.col("positive").alias("candidate"), F.lit(1.0).alias("label")).distinct()
    return positive.unionByName(clean.filter("negative <> '' AND negative <> positive").select("anchor", F.col("negative").alias("candidate"), F.lit(0.0).alias("label")).distinct())


def ranking_examples(triplets: DataFrame) -> DataFrame:
    """query, positives, negatives of triplets (anchor, positive, negative); blanks go, a negative that is a positive goes."""
    clean = triplets.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) for c in ("anchor", "positive", "negative"))).filter("anchor IS NOT NULL")
    sets = clean.groupBy("anchor").agg(F.array_sort(F.collect_set("positive")).alias("positives"), F.array_sort(F.collect_set("negative")).alias("negatives"))
    return sets.select(F.col("anchor").alias("query"), "positives", F.array_except("negatives", "positives").alias("negatives"))


def labelled_pairs(triplets: DataFrame) -> DataFrame:
    """mention, candidate, label: distinct positives (1) and negatives (0) of triplets."""
    rows = triplets.select(F.inline(F.array(F.struct(F.col("anchor").alias("mention"), F.col("positive").alias("candidate"), F.lit(1).alias("label")), F.struct(F.col("anchor").alias("mention"), F.col("negative").alias("candidate"), F.lit(0).alias("label")))))
    rows = rows.filter("trim(mention) <> '' AND trim(candidate) <> ''")
    return rows.groupBy("mention", "candidate").agg(F.max("label").alias("label"))
