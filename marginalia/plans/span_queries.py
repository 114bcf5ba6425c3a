"""Queries on spans: unions, clusters, scores, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, scoring, spans
from .derive import GOLD_SQL, SPANS_SQL, gold, predicted

_PRF = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0 END AS f1"


def _islands(name: str, source: str, compare: str) -> str:
    """`source` with islands; ranges are made distinct first, so that no two rows tie in a window."""
    return f"""
    {name}d AS (SELECT DISTINCT filename, label, start_span, end_span FROM {source}),
    {name}0 AS (SELECT *, max(end_span) OVER (PARTITION BY filename, label ORDER BY start_span, end_span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}d),
    {name}1 AS (SELECT * EXCLUDE (reach), sum(CASE WHEN reach IS NULL OR start_span {compare} reach THEN 1 ELSE 0 END) OVER (PARTITION BY filename, label ORDER BY start_span, end_span ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM {name}0),
    {name} AS (SELECT s.*, island FROM {source} s JOIN {name}1 USING (filename, label, start_span, end_span))"""


_UNIONS = f"""{_islands('gi', 'gold', '>')}, gu AS (SELECT filename, label, min(start_span) AS s, max(end_span) AS e FROM gi GROUP BY filename, label, island),
    {_islands('pi', 'pred', '>')}, pu AS (SELECT filename, label, min(start_span) AS s, max(end_span) AS e FROM pi GROUP BY filename, label, island)"""
_CHARS = f"""WITH {SPANS_SQL}, {_UNIONS},
    gt AS (SELECT filename, label, sum(e - s) AS n FROM gu GROUP BY ALL), pt AS (SELECT filename, label, sum(e - s) AS n FROM pu GROUP BY ALL),
    hit AS (SELECT filename, label, sum(least(g.e, p.e) - greatest(g.s, p.s)) AS tp FROM gu g JOIN pu p USING (filename, label) WHERE p.s < g.e AND g.s < p.e GROUP BY ALL),
    j AS (SELECT filename, label, coalesce(gt.n, 0) AS g, coalesce(pt.n, 0) AS p, coalesce(tp, 0) AS tp FROM gt FULL JOIN pt USING (filename, label) LEFT JOIN hit USING (filename, label))"""


def greedy_sql(key: str, scenarios: tuple[str, ...] = ("strict", "exact", "partial", "ent_type"), least: float = 40.0) -> str:
    """Greedy matching in SQL: the clusters of `key` (filename, or filename and label), and a step for each prediction.

    Ends in `events` (filename, label, scenario, kind, gold_at, pred_at, island); label is empty where the key has none."""
    label = "label" if "label" in key else "''"
    names = ", ".join(f"('{s}')" for s in scenarios)
    return f"""{SPANS_SQL}, gn AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY start_span, end_span, label) AS ord FROM gold),
    pn AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY start_span, end_span, label, score) AS ord FROM pred),
    both_sides AS (SELECT filename, {label} AS label, start_span, end_span FROM gn UNION SELECT filename, {label}, start_span, end_span FROM pn), {_islands('ci', 'both_sides', '>=')},
    gl AS (SELECT c.filename, c.label, island, list({{'ord': ord, 'label': g.label, 's': g.start_span, 'e': g.end_span}} ORDER BY ord) AS g FROM gn g JOIN ci c ON c.filename = g.filename AND c.label = {label.replace('label', 'g.label')} AND c.start_span = g.start_span AND c.end_span = g.end_span GROUP BY ALL),
    pl AS (SELECT c.filename, c.label, island, list({{'ord': ord, 'label': p.label, 's': p.start_span, 'e': p.end_span}} ORDER BY ord) AS p FROM pn p JOIN ci c ON c.filename = p.filename AND c.label = {label.replace('label', 'p.label')} AND c.start_span = p.start_span AND c.end_span = p.end_span GROUP BY ALL),
    cl AS (SELECT filename, label, island, coalesce(g, []) AS g, coalesce(p, []) AS p FROM gl FULL JOIN pl USING (filename, label, island)),
    run AS (SELECT filename, label, island, scenario, 0 AS i, g AS free, p, NULL::VARCHAR AS kind, NULL::BIGINT AS gold_at, NULL::BIGINT AS pred_at FROM cl, (VALUES {names}) v(scenario)
        UNION ALL SELECT filename, label, island, scenario, i, CASE WHEN hit IS NULL THEN free ELSE list_filter(free, lambda x: x.ord <> hit.ord) END, p,
            CASE WHEN hit IS NULL THEN 'spurious' WHEN scenario = 'ent_type' THEN CASE WHEN hit.label = now.label THEN 'correct' ELSE 'incorrect' END
                 WHEN hit.s = now.s AND hit.e = now.e AND (scenario <> 'strict' OR hit.label = now.label) THEN 'correct' WHEN scenario = 'partial' THEN 'partial' ELSE 'incorrect' END, hit.ord, now.ord
        FROM (SELECT *, list_filter(free, lambda x: least(x.e, now.e) > greatest(x.s, now.s) AND (scenario IN ('strict', 'exact') OR 100 * (least(x.e, now.e) - greatest(x.s, now.s)) >= {least} * (x.e - x.s)))[1] AS hit
              FROM (SELECT filename, label, island, scenario, i + 1 AS i, free, p, p[i + 1] AS now FROM run WHERE i < len(p)))),
    events AS (SELECT filename, label, island, scenario, kind, gold_at, pred_at FROM run WHERE kind IS NOT NULL
        UNION ALL SELECT filename, label, island, scenario, 'missed', (unnest(free)).ord, NULL FROM run WHERE i = len(p))"""


#: Strict events of the greedy matcher, as `ev`; starts a statement.
EVENTS_SQL = f"""WITH RECURSIVE {greedy_sql('filename, label', ('strict',))},
    hits AS (SELECT filename, gold_at, pred_at FROM events WHERE kind = 'correct'),
    evg AS (SELECT g.filename, g.label, g.start_span, g.end_span, g.ord, h.pred_at FROM gn g LEFT JOIN hits h ON h.filename = g.filename AND h.gold_at = g.ord),
    evp AS (SELECT p.filename, p.label, p.start_span, p.end_span, p.ord, p.score, h.gold_at FROM pn p LEFT JOIN hits h ON h.filename = p.filename AND h.pred_at = p.ord),
    ev AS (SELECT filename, label, start_span, end_span, CASE WHEN pred_at IS NULL THEN 'FN' ELSE 'TP' END AS outcome FROM evg UNION ALL SELECT filename, label, start_span, end_span, 'FP' FROM evp WHERE gold_at IS NULL)"""

_COUNTS = "count_if(kind = 'correct') AS correct, count_if(kind = 'incorrect') AS incorrect, count_if(kind = 'partial') AS partial, count_if(kind = 'spurious') AS spurious, count_if(kind = 'missed') AS missed"
_RATIOS = """pr AS (SELECT *, CASE WHEN scenario IN ('partial', 'ent_type') THEN 0.5::DOUBLE ELSE 0 END * partial + correct AS tp, correct + incorrect + partial + spurious AS np, correct + incorrect + partial + missed AS ng FROM sums),
    rt AS (SELECT * EXCLUDE (tp, np, ng), CASE WHEN np > 0 THEN tp / np ELSE 0 END AS precision, CASE WHEN ng > 0 THEN tp / ng ELSE 0 END AS recall FROM pr),
    scored AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rt)"""
_ROUNDED = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def _groups_sql(name: str, source: str, outer: str, inner: str, kind: str, threshold: str) -> str:
    """One pass over the outer spans of each cluster of `source` (..., g, p, units), the shortest first; ends in `name`."""
    unit = "{'kind': '%s', 'g': [now.ord], 'p': ids, 'dice': dice, 'ds': lo - now.s, 'de': hi - now.e}" if outer == "g" else "{'kind': '%s', 'g': ids, 'p': [now.ord], 'dice': dice, 'ds': now.s - lo, 'de': now.e - hi}"
    return f"""
    {name}r AS (SELECT key, list_sort(list_transform({outer}, lambda x: {{'n': x.e - x.s, 'ord': x.ord, 's': x.s, 'e': x.e}})) AS todo, 0 AS i, {inner} AS free, {outer} AS kept, units FROM {source}
        UNION ALL SELECT key, todo, i, CASE WHEN ok THEN list_filter(free, lambda x: NOT list_contains(ids, x.ord)) ELSE free END, CASE WHEN ok THEN list_filter(kept, lambda x: x.ord <> now.ord) ELSE kept END, CASE WHEN ok THEN list_append(units, {unit % kind}) ELSE units END
        FROM (SELECT *, len(inside) >= 2 AND dice >= {threshold} AS ok, list_transform(inside, lambda x: x.ord) AS ids, list_min(list_transform(inside, lambda x: x.s)) AS lo, list_max(list_transform(inside, lambda x: x.e)) AS hi FROM (
            SELECT *, 2.0::DOUBLE * n / (now.e - now.s + n) AS dice FROM (
            SELECT *, list_reduce(list_prepend({{'s': -1::BIGINT, 'e': -1::BIGINT, 't': 0::BIGINT}}, list_sort(list_transform(inside, lambda x: {{'s': x.s, 'e': x.e, 't': 0::BIGINT}}))), lambda a, x: {{'s': a.s, 'e': greatest(a.e, x.e), 't': a.t + greatest(0, x.e - greatest(x.s, a.e))}}).t AS n FROM (
            SELECT *, list_filter(free, lambda x: x.s >= now.s AND x.e <= now.e) AS inside FROM (SELECT key, todo, i + 1 AS i, free, kept, units, todo[i + 1] AS now FROM {name}r WHERE i < len(todo))))))),
    {name} AS (SELECT key, {'kept' if outer == 'g' else 'free'} AS g, {'free' if outer == 'g' else 'kept'} AS p, units FROM {name}r WHERE i = len(todo))"""


def units_sql(thresholds: str = "(0.6)") -> str:
    """EVENTS_SQL and the diagnostic units of each threshold, as `units` (t, filename, label, error_type, boundary_kind,
    matched_edge, g, p, dice, ds, de); one-to-one pairs by trying every matching of a cluster."""
    empty = "[]::STRUCT(kind VARCHAR, g BIGINT[], p BIGINT[], dice DOUBLE, ds BIGINT, de BIGINT)[]"
    return f"""{EVENTS_SQL},
    th AS (SELECT t::DOUBLE AS t FROM (VALUES {thresholds}) v(t)),
    lg AS (SELECT filename, label, start_span, end_span, ord, row_number() OVER (PARTITION BY filename, label, start_span, end_span ORDER BY ord) AS nth FROM evg WHERE pred_at IS NULL),
    lp AS (SELECT filename, label, start_span, end_span, ord, row_number() OVER (PARTITION BY filename, label, start_span, end_span ORDER BY ord) AS nth FROM evp WHERE gold_at IS NULL),
    same AS (SELECT lg.filename, lg.label, lg.ord AS g, lp.ord AS p FROM lg JOIN lp USING (filename, label, start_span, end_span, nth)),
    rg AS (SELECT * FROM lg WHERE (filename, ord) NOT IN (SELECT (filename, g) FROM same)), rp AS (SELECT * FROM lp WHERE (filename, ord) NOT IN (SELECT (filename, p) FROM same)),
    rest AS (SELECT filename, label, start_span, end_span FROM rg UNION ALL SELECT filename, label, start_span, end_span FROM rp), {_islands('ri', 'rest', '>=')}, rk AS (SELECT DISTINCT * FROM ri),
    cg AS (SELECT filename, label, island, list({{'ord': ord, 's': start_span, 'e': end_span}} ORDER BY ord) AS g FROM rg JOIN rk USING (filename, label, start_span, end_span) GROUP BY ALL),
    cp AS (SELECT filename, label, island, list({{'ord': ord, 's': start_span, 'e': end_span}} ORDER BY ord) AS p FROM rp JOIN rk USING (filename, label, start_span, end_span) GROUP BY ALL),
    st0 AS (SELECT {{'t': t, 'filename': filename, 'label': label, 'island': island}} AS key, coalesce(g, []) AS g, coalesce(p, []) AS p, {empty} AS units FROM cg FULL JOIN cp USING (filename, label, island), th),
    {_groups_sql('st1', 'st0', 'g', 'p', 'FRAGMENTED', 'key.t')}, {_groups_sql('st2', 'st1', 'p', 'g', 'MERGED', 'key.t')},
    el AS (SELECT key, gs.ord AS go, gs.s AS gs, gs.e AS ge, ps.ord AS po, ps.s AS ps, ps.e AS pe, 2.0::DOUBLE * greatest(0, least(gs.e, ps.e) - greatest(gs.s, ps.s)) / (gs.e - gs.s + ps.e - ps.s) AS dice
           FROM (SELECT key, gs, unnest(p) AS ps FROM (SELECT key, unnest(g) AS gs, p FROM st2))),
    ok AS (SELECT key, list({{'go': go, 'po': po, 'dice': dice, 'ds': ps - gs, 'de': pe - ge}} ORDER BY go, po) AS edges FROM el WHERE dice >= key.t GROUP BY key),
    tries AS (SELECT key, edges, 0 AS i, 0.0::DOUBLE AS total, []::INTEGER[] AS taken FROM (SELECT key, edges::STRUCT(go BIGINT, po BIGINT, dice DOUBLE, ds BIGINT, de BIGINT)[] AS edges FROM ok)
        UNION ALL SELECT key, edges, i + 1, total + CASE WHEN take THEN edges[i + 1].dice ELSE 0 END, CASE WHEN take THEN list_append(taken, i + 1) ELSE taken END FROM tries, (VALUES (true), (false)) v(take)
        WHERE i < len(edges) AND (NOT take OR len(list_filter(taken, lambda k: edges[k].go = edges[i + 1].go OR edges[k].po = edges[i + 1].po)) = 0)),
    chosen AS (SELECT key, unnest(list_transform(pick, lambda k: edges[k])) AS u FROM (SELECT key, any_value(edges) AS edges, arg_max(taken, total) AS pick FROM tries WHERE i = len(edges) GROUP BY key)),
    gone AS (SELECT key, u.go AS g, u.po AS p FROM chosen),
    units0 AS (
        SELECT t, filename, label, 'CORRECT' AS error_type, NULL AS boundary_kind, [gold_at] AS g, [pred_at] AS p, 1.0::DOUBLE AS dice, 0 AS ds, 0 AS de FROM events, th WHERE kind = 'correct'
        UNION ALL SELECT t, filename, label, 'UNCREDITED_EXACT', NULL, [g], [p], 1.0, 0, 0 FROM same, th
        UNION ALL SELECT key.t, key.filename, key.label, 'BOUNDARY_ERROR', u.kind, u.g, u.p, u.dice, u.ds, u.de FROM (SELECT key, unnest(units) AS u FROM st2)
        UNION ALL SELECT key.t, key.filename, key.label, 'BOUNDARY_ERROR', CASE WHEN u.ds <= 0 AND u.de >= 0 THEN 'TOO_LONG' WHEN u.ds >= 0 AND u.de <= 0 THEN 'TOO_SHORT' WHEN u.ds < 0 THEN 'SHIFTED_LEFT' ELSE 'SHIFTED_RIGHT' END, [u.go], [u.po], u.dice, u.ds, u.de FROM chosen
        UNION ALL SELECT key.t, key.filename, key.label, 'MISSED', NULL, [x.ord], [], NULL, NULL, NULL FROM (SELECT key, unnest(g) AS x FROM st2) WHERE (key, x.ord) NOT IN (SELECT (key, g) FROM gone)
        UNION ALL SELECT key.t, key.filename, key.label, 'SPURIOUS', NULL, [], [x.ord], NULL, NULL, NULL FROM (SELECT key, unnest(p) AS x FROM st2) WHERE (key, x.ord) NOT IN (SELECT (key, p) FROM gone)),
    units AS (SELECT *, CASE WHEN boundary_kind IS NULL OR boundary_kind IN ('FRAGMENTED', 'MERGED') THEN NULL WHEN ds = 0 THEN 'START' WHEN de = 0 THEN 'END' ELSE 'NEITHER' END AS matched_edge FROM units0)"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def character_scores(spark, sf):
    return scoring.character_scores(gold(spark, sf), predicted(spark, sf))


def document_character_scores(spark, sf):
    return scoring.character_scores(gold(spark, sf), predicted(spark, sf), ["filename"])


def merged_intervals(spark, sf):
    return intervals.union_intervals(gold(spark, sf), ["filename", "label"])


def overlap_clusters(spark, sf):
    found = intervals.overlap_clusters(gold(spark, sf).distinct(), ["filename", "label"])
    return found.groupBy("filename", "label", "island").agg(F.count(F.lit(1)).alias("n"), F.min("start_span").alias("start_span"), F.max("end_span").alias("end_span"))


def entity_character_scores(spark, sf):
    return scoring.entity_character_scores(gold(spark, sf), predicted(spark, sf)).select("n_gold", "n_pred", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


def strict_scores(spark, sf):
    return scoring.strict_scores(gold(spark, sf), predicted(spark, sf))


def span_dedupe(spark, sf):
    return spans.dedupe_spans(predicted(spark, sf).select("filename", "label", "start_span", "end_span", "score"))


def covered_characters(spark, sf):
    g = scoring.with_span_id(gold(spark, sf).distinct())
    found = intervals.covered(g, predicted(spark, sf).select("filename", "start_span", "end_span"), ["filename"], "span_id")
    return found.groupBy("covered").agg(F.count(F.lit(1)).alias("n"))


def span_relations(spark, sf):
    return spans.span_relations(gold(spark, sf))


def overlap_policy_longest(spark, sf):
    return spans.resolve_overlaps(gold(spark, sf), "keep_longest").select("filename", "label", "start_span", "end_span")


def overlap_policy_merge(spark, sf):
    return spans.resolve_overlaps(gold(spark, sf), "merge_same_label_then_keep_longest").select("filename", "label", "start_span", "end_span")


def merged_entities(spark, sf):
    """Merged spans with the texts that they cover now."""
    from ..session import table

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("filename"), F.col("text").alias("document"))
    found = spans.resolve_overlaps(gold(spark, sf), "merge_same_label_then_keep_longest", docs)
    return found.select("filename", "label", "start_span", "end_span", F.md5("text").alias("text"))


def inclusive_spans(spark, sf):
    return spans.inclusive(predicted(spark, sf))


def varying_scores(spark, sf):
    from ..operators.analysis import has_varying_scores

    p = predicted(spark, sf)
    one = p.withColumn("score", F.lit(0.5))
    return spark.createDataFrame([("rule", has_varying_scores(p)), ("constant", has_varying_scores(one)), ("none", has_varying_scores(p.drop("score")))], "name string, varies boolean")


def greedy_scores(spark, sf):
    return _rounded(scoring.greedy_scores(gold(spark, sf), predicted(spark, sf)))


def flat_metrics(spark, sf):
    """The long form, as the reports name the metrics."""
    return scoring.flatten(scoring.greedy_scores(gold(spark, sf), predicted(spark, sf))).withColumn("value", F.round("value", 3))


def head_scores(spark, sf):
    return _rounded(scoring.head_scores(gold(spark, sf), predicted(spark, sf), ["DET", "LONG", "PHRASE", "NONE"]))


def spans_with_text(spark, sf):
    from ..session import table

    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("filename"), F.col("text").alias("document"))
    return spans.with_text(gold(spark, sf).drop("doc_id"), docs).groupBy("label", F.lower("text").alias("surface")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (character_scores, document_character_scores, merged_intervals, overlap_clusters, entity_character_scores, strict_scores, span_dedupe, covered_characters, span_relations, overlap_policy_longest, overlap_policy_merge, greedy_scores, flat_metrics, head_scores, merged_entities, inclusive_spans, varying_scores, spans_with_text)}

ORACLES = {
    "greedy_scores": f"WITH RECURSIVE {greedy_sql('filename')}, sums AS (SELECT scenario, {_COUNTS} FROM events GROUP BY scenario), {_RATIOS} SELECT scenario, correct, incorrect, partial, spurious, missed, {_ROUNDED} FROM scored",
    "flat_metrics": f"""WITH RECURSIVE {greedy_sql('filename')}, sums AS (SELECT scenario, {_COUNTS} FROM events GROUP BY scenario), {_RATIOS}
        SELECT 'span_' || scenario || '_' || name AS metric, round(round(value, 4), 3) AS value FROM (UNPIVOT (SELECT scenario, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1, correct::DOUBLE AS correct, incorrect::DOUBLE AS incorrect, partial::DOUBLE AS partial, missed::DOUBLE AS missed, spurious::DOUBLE AS spurious FROM scored) ON precision, recall, f1, correct, incorrect, partial, missed, spurious INTO NAME name VALUE value)""",
    "head_scores": f"""WITH RECURSIVE {greedy_sql('filename, label')}, hs AS (SELECT l AS head, s AS scenario, coalesce(c.correct, 0) AS correct, coalesce(c.incorrect, 0) AS incorrect, coalesce(c.partial, 0) AS partial, coalesce(c.spurious, 0) AS spurious, coalesce(c.missed, 0) AS missed
            FROM (VALUES ('DET'), ('LONG'), ('PHRASE'), ('NONE')) a(l), (VALUES ('strict'), ('exact'), ('partial'), ('ent_type')) b(s) LEFT JOIN (SELECT label, scenario, {_COUNTS} FROM events GROUP BY label, scenario) c ON c.label = l AND c.scenario = s),
        sums AS (SELECT head, scenario, correct, incorrect, partial, spurious, missed FROM hs UNION ALL SELECT 'micro', scenario, sum(correct)::BIGINT, sum(incorrect)::BIGINT, sum(partial)::BIGINT, sum(spurious)::BIGINT, sum(missed)::BIGINT FROM hs GROUP BY scenario), {_RATIOS}
        SELECT head, scenario, correct, incorrect, partial, spurious, missed, {_ROUNDED} FROM scored
        UNION ALL SELECT 'macro', scenario, NULL, NULL, NULL, NULL, NULL, round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM scored WHERE head <> 'micro' GROUP BY scenario""",
    "character_scores": f"{_CHARS}, s AS (SELECT label, sum(tp)::BIGINT AS tp, sum(p - tp)::BIGINT AS fp, sum(g - tp)::BIGINT AS fn FROM j GROUP BY label) SELECT *, {_PRF} FROM s",
    "document_character_scores": f"{_CHARS}, s AS (SELECT filename, sum(tp)::BIGINT AS tp, sum(p - tp)::BIGINT AS fp, sum(g - tp)::BIGINT AS fn FROM j GROUP BY filename) SELECT *, {_PRF} FROM s",
    "merged_intervals": f"WITH {GOLD_SQL}, {_islands('gi', 'gold', '>')} SELECT filename, label, min(start_span) AS start_span, max(end_span) AS end_span FROM gi GROUP BY filename, label, island",
    "overlap_clusters": f"WITH {GOLD_SQL}, d AS (SELECT DISTINCT * FROM gold), {_islands('gi', 'd', '>=')} SELECT filename, label, island, count(*) AS n, min(start_span) AS start_span, max(end_span) AS end_span FROM gi GROUP BY filename, label, island",
    "entity_character_scores": f"""WITH {SPANS_SQL}, dp AS (SELECT DISTINCT filename, label, start_span, end_span FROM pred),
        gn AS (SELECT *, row_number() OVER () AS i FROM gold), pn AS (SELECT *, row_number() OVER () AS i FROM dp),
        gc AS (SELECT g.i, max(2.0::DOUBLE * (least(g.end_span, p.end_span) - greatest(g.start_span, p.start_span)) / (g.end_span - g.start_span + p.end_span - p.start_span)) AS c FROM gn g JOIN dp p USING (filename, label) WHERE p.start_span < g.end_span AND g.start_span < p.end_span GROUP BY g.i),
        pc AS (SELECT p.i, max(2.0::DOUBLE * (least(g.end_span, p.end_span) - greatest(g.start_span, p.start_span)) / (g.end_span - g.start_span + p.end_span - p.start_span)) AS c FROM pn p JOIN gold g USING (filename, label) WHERE p.start_span < g.end_span AND g.start_span < p.end_span GROUP BY p.i),
        s AS (SELECT (SELECT count(*) FROM gold) AS n_gold, (SELECT count(*) FROM dp) AS n_pred, (SELECT sum(c) FROM pc) / (SELECT count(*) FROM dp) AS p, (SELECT sum(c) FROM gc) / (SELECT count(*) FROM gold) AS r)
        SELECT n_gold, n_pred, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s""",
    "strict_scores": f"""WITH {SPANS_SQL}, k AS (SELECT filename, label, start_span, end_span, 1 AS g, 0 AS p FROM gold UNION ALL SELECT filename, label, start_span, end_span, 0, 1 FROM pred),
        m AS (SELECT filename, label, start_span, end_span, sum(g) AS g, sum(p) AS p, least(sum(g), sum(p)) AS t FROM k GROUP BY ALL),
        s AS (SELECT label, sum(t)::BIGINT AS tp, (sum(p) - sum(t))::BIGINT AS fp, (sum(g) - sum(t))::BIGINT AS fn FROM m GROUP BY CUBE (label)) SELECT *, {_PRF} FROM s""",
    "span_dedupe": f"WITH {SPANS_SQL} SELECT filename, label, start_span, end_span, max(score) AS score FROM pred GROUP BY ALL",
    "covered_characters": f"""WITH {SPANS_SQL}, gd AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY filename, label, start_span, end_span) AS i FROM (SELECT DISTINCT * FROM gold)),
        p1 AS (SELECT filename, '' AS label, start_span, end_span FROM pred), {_islands('pi', 'p1', '>')}, pu AS (SELECT filename, min(start_span) AS s, max(end_span) AS e FROM pi GROUP BY filename, island),
        c AS (SELECT g.i, sum(least(g.end_span, u.e) - greatest(g.start_span, u.s)) AS c FROM gd g JOIN pu u USING (filename) WHERE u.s < g.end_span AND g.start_span < u.e GROUP BY g.i)
        SELECT coalesce(c, 0)::BIGINT AS covered, count(*) AS n FROM gd LEFT JOIN c USING (i) GROUP BY 1""",
    "span_relations": f"""WITH {GOLD_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY start_span, end_span, label) AS i FROM gold),
        pr AS (SELECT a.filename, a.i AS x, b.i AS y, CASE WHEN a.start_span = b.start_span AND a.end_span = b.end_span THEN 'identical'
                 WHEN (a.start_span <= b.start_span AND b.end_span <= a.end_span) OR (b.start_span <= a.start_span AND a.end_span <= b.end_span) THEN 'nested' ELSE 'crossing' END AS relation
               FROM n a JOIN n b ON a.filename = b.filename AND a.i < b.i AND a.start_span < b.end_span AND b.start_span < a.end_span),
        e AS (SELECT filename, x AS i, relation FROM pr UNION SELECT filename, y, relation FROM pr) SELECT relation, count(*) AS n FROM e GROUP BY relation""",
    "overlap_policy_longest": f"""WITH {GOLD_SQL}, g1 AS (SELECT filename, label AS lab, '' AS label, start_span, end_span FROM gold), {_islands('gi', 'g1', '>=')},
        r AS (SELECT *, row_number() OVER (PARTITION BY filename, island ORDER BY end_span - start_span DESC, start_span, lab) AS rn FROM gi) SELECT filename, lab AS label, start_span, end_span FROM r WHERE rn = 1""",
    "overlap_policy_merge": f"""WITH {GOLD_SQL}, {_islands('a', 'gold', '>=')}, h AS (SELECT filename, label AS lab, '' AS label, min(start_span) AS start_span, max(end_span) AS end_span FROM a GROUP BY filename, a.label, island), {_islands('gi', 'h', '>=')},
        r AS (SELECT *, row_number() OVER (PARTITION BY filename, island ORDER BY end_span - start_span DESC, start_span, lab) AS rn FROM gi) SELECT filename, lab AS label, start_span, end_span FROM r WHERE rn = 1""",
    "merged_entities": f"""WITH {GOLD_SQL}, {_islands('a', 'gold', '>=')}, h AS (SELECT filename, label AS lab, '' AS label, min(start_span) AS start_span, max(end_span) AS end_span FROM a GROUP BY filename, a.label, island), {_islands('gi', 'h', '>=')},
        r AS (SELECT *, row_number() OVER (PARTITION BY filename, island ORDER BY end_span - start_span DESC, start_span, lab) AS rn FROM gi) SELECT filename, lab AS label, start_span, end_span, md5(substring(text, start_span + 1, end_span - start_span)) AS text FROM r JOIN documents ON doc_id::VARCHAR = filename WHERE rn = 1""",
    "inclusive_spans": f'WITH {SPANS_SQL} SELECT filename, label, start_span AS start, end_span - 1 AS "end" FROM pred',
    "varying_scores": f"WITH {SPANS_SQL} SELECT 'rule' AS name, max(score) - min(score) >= 0.01 AS varies FROM pred UNION ALL SELECT unnest(['constant', 'none']), false",
    "spans_with_text": f"WITH {GOLD_SQL} SELECT label, lower(substring(text, start_span + 1, end_span - start_span)) AS surface, count(*) AS n FROM gold JOIN documents USING (doc_id) GROUP BY 1, 2",
}
