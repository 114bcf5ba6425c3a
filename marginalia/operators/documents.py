"""Scores and errors of whole documents in one pass: spans of both sides and texts meet once, by filename, and numpy works on
the documents of a batch together.

The results are those of `analysis.document_scores` and `analysis.describe_mentions` on the events and units of
`analysis.strict_events` and `analysis.pair_errors`, which remain for callers that want the events themselves.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOLD, PRED, TEXT = 0, 1, 2
#: Pairs of ranges that are looked at together.
BLOCK = 1 << 20
OUTCOMES = pa.array(["CORRECT", "BOUNDARY_ERROR", "MISSED", "SPURIOUS", "UNCREDITED_EXACT"])
CORRECT, BOUNDARY, MISSED, SPURIOUS, UNCREDITED = range(5)


def gathered(gold: DataFrame, predicted: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """filename, side, label, s, e, position, score, text: the rows of each filename next to one another."""
    def one(df: DataFrame, side: int) -> DataFrame:
        maybe = lambda c, t: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)
        return df.select("filename", F.lit(side).cast("tinyint").alias("side"), "label", F.col("start_span").cast("long").alias("s"), F.col("end_span").cast("long").alias("e"), maybe("position", "long").alias("position"), maybe("score", "double").alias("score"), F.lit(None).cast("string").alias("text"))

    rows = one(gold, GOLD).unionByName(one(predicted, PRED))
    if documents is not None:
        none = {"side": F.lit(TEXT).cast("tinyint"), "label": F.lit(None).cast("string"), **{c: F.lit(None).cast("long") for c in ("s", "e", "position")}, "score": F.lit(None).cast("double")}
        rows = rows.unionByName(documents.select("filename", *(v.alias(c) for c, v in none.items()), F.col("document").alias("text")))
    return rows.repartition("filename").sortWithinPartitions("filename")


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, cut between filenames only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0)
        last = names[-1]
        start = len(names) - 1
        while start and names[start - 1] == last:  # most filenames have few rows; a batch of one filename is held whole
            start -= 1
        if start == 0 and held and held[-1].column(0)[-1] == last:
            held.append(batch)
            continue
        if held and start == 0:
            yield pa.Table.from_batches(held)
            held = [batch]
            continue
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def met(key_a, start_a, end_a, key_b, start_b, end_b) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of every two ranges of one key that share a character or, if one is empty, where it lies inside."""
    if not len(key_a) or not len(key_b):
        return
    low = min(start_a.min(), start_b.min())
    wide = max(end_a.max(), end_b.max(), start_a.max(), start_b.max()) - low + 2
    order = np.lexsort((end_b, start_b, key_b))
    b_start, b_end = (key_b * wide + start_b - low)[order], (key_b * wide + end_b - low)[order]
    a_start, a_end = key_a * wide + start_a - low, key_a * wide + end_a - low
    first = np.searchsorted(np.maximum.accumulate(b_end), a_start, "right")
    n = np.maximum(np.searchsorted(b_start, a_end, "left") - first, 0)
    done = np.concatenate([[0], n.cumsum()])
    at = 0
    while at < len(n):
        to = max(int(np.searchsorted(done, done[at] + BLOCK, "right")) - 1, at + 1)
        a = np.repeat(np.arange(at, to), n[at:to])
        b = np.arange(len(a)) - np.repeat(done[at:to] - done[at], n[at:to]) + np.repeat(first[at:to], n[at:to])
        hit = (b_start[b] < a_end[a]) & (a_start[a] < b_end[b])
        yield a[hit], order[b[hit]]
        at = to


def islands(key: np.ndarray, start: np.ndarray, end: np.ndarray, touching: bool = False) -> np.ndarray:
    """The number of each range's island, see `intervals.with_islands`."""
    if not len(key):
        return np.zeros(0, np.int64)
    low = start.min()
    wide = max(end.max(), start.max()) - low + 2
    s, e = key * wide + start - low, key * wide + end - low
    order = np.lexsort((e, s))
    s, e = s[order], e[order]
    reach, k = np.maximum.accumulate(e)[:-1], key[order]
    opens = (s[1:] > reach if touching else s[1:] >= reach) | (k[1:] != k[:-1])
    out = np.empty(len(key), np.int64)
    out[order] = np.concatenate([[0], opens.cumsum()])
    return out


def dice(s1, e1, s2, e2) -> np.ndarray:
    size = (e1 - s1) + (e2 - s2)
    return np.where(size > 0, 2 * np.maximum(np.minimum(e1, e2) - np.maximum(s1, s2), 0) / np.where(size > 0, size, 1), 0.0)


class Side:
    """The spans of one side of a batch: document, label, key (both as one), start, end, place in the document's list."""

    def __init__(self, rows: np.ndarray, doc, label, start, end, position, score, n_labels: int):
        d = doc[rows]
        order = np.lexsort((score[rows], label[rows], end[rows], start[rows], d) if position is None else (position[rows], d))
        rows = rows[order]
        self.rows, self.doc, self.label, self.start, self.end = rows, doc[rows], label[rows], start[rows], end[rows]
        self.key = self.doc * n_labels + self.label
        self.at = np.arange(len(rows)) - np.searchsorted(self.doc, self.doc) + 1

    def __len__(self) -> int:
        return len(self.rows)

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.key, self.start, self.end

    def part(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.key[keep], self.start[keep], self.end[keep]


def mixed(g_island: np.ndarray, p_island: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[list[int], list[int]]]]:
    """(gold, predicted) places of the islands with one span of each side, and the places of the other islands of both."""
    n = int(max(g_island.max(initial=-1), p_island.max(initial=-1))) + 1
    n_g, n_p = np.bincount(g_island, minlength=n), np.bincount(p_island, minlength=n)
    g_order, p_order = np.argsort(g_island, kind="stable"), np.argsort(p_island, kind="stable")
    g_first, p_first = n_g.cumsum() - n_g, n_p.cumsum() - n_p
    one = (n_g == 1) & (n_p == 1)
    more = np.flatnonzero((n_g > 0) & (n_p > 0) & ~one)
    golds, preds, bounds = g_order.tolist(), p_order.tolist(), (x[more].tolist() for x in (g_first, g_first + n_g, p_first, p_first + n_p))
    return g_order[g_first[one]], p_order[p_first[one]], [(golds[i:j], preds[k:m]) for i, j, k, m in zip(*bounds, strict=True)]


def strict_hits(g: Side, p: Side) -> tuple[np.ndarray, np.ndarray]:
    """Whether each span of a side is a strict match, see `analysis.strict_events`."""
    g_hit, p_hit = np.zeros(len(g), bool), np.zeros(len(p), bool)
    found = islands(*(np.concatenate(x) for x in zip(g.ranges(), p.ranges(), strict=True)))
    a, b, others = mixed(found[: len(g)], found[len(g) :])
    same = (g.start[a] == p.start[b]) & (g.end[a] == p.end[b])
    g_hit[a[same]] = p_hit[b[same]] = True
    g_start, g_end, p_start, p_end = (x.tolist() for x in (g.start, g.end, p.start, p.end))
    hits: tuple[list[int], list[int]] = ([], [])
    for golds, preds in others:
        free = [(i, g_start[i], g_end[i]) for i in golds]
        for j in preds:
            t, f = p_start[j], p_end[j]
            for k, (i, s, e) in enumerate(free):
                if (e if e < f else f) > (s if s > t else t):
                    del free[k]
                    if s == t and e == f:
                        hits[0].append(i)
                        hits[1].append(j)
                    break
    g_hit[hits[0]] = p_hit[hits[1]] = True
    return g_hit, p_hit


def _union(spans: list[tuple[int, int, int]]) -> int:
    reach, total = -1, 0
    for s, e in sorted((s, e) for _, s, e in spans):
        total += max(0, e - max(s, reach))
        reach = max(reach, e)
    return total


def unit_types(gold: list[tuple[int, int, int]], predicted: list[tuple[int, int, int]], threshold: float) -> tuple[dict[int, int], dict[int, int]]:
    """The error type of every (id, start, end) of an island that isn't a strict match, see `analysis.pair_errors`."""
    from .analysis import best_pairs

    found: tuple[dict[int, int], dict[int, int]] = ({}, {})
    left, preds = [], list(predicted)
    for g in gold:
        if (p := next((p for p in preds if p[1:] == g[1:]), None)) is None:
            left.append(g)
        else:
            preds.remove(p)
            found[0][g[0]] = found[1][p[0]] = UNCREDITED
    sides = [left, preds]
    for outer in (0, 1):
        alone = []
        for c in sorted(sides[outer], key=lambda x: (x[2] - x[1], x[0])):
            inside = [x for x in sides[1 - outer] if x[1] >= c[1] and x[2] <= c[2]]
            if len(inside) >= 2 and (n := _union(inside)) + c[2] - c[1] > 0 and 2 * n / ((c[2] - c[1]) + n) >= threshold:
                found[outer][c[0]] = BOUNDARY
                for x in inside:
                    found[1 - outer][x[0]] = BOUNDARY
                sides[1 - outer] = [x for x in sides[1 - outer] if x not in inside]
            else:
                alone.append(c)
        sides[outer] = sorted(alone)
    left, preds = sides
    for i, j in best_pairs([x[1:] for x in left], [x[1:] for x in preds], threshold) if left and preds else ():
        found[0][left[i][0]] = found[1][preds[j][0]] = BOUNDARY
    for side, rest, kind in ((0, left, MISSED), (1, preds, SPURIOUS)):
        for x in rest:
            found[side].setdefault(x[0], kind)
    return found


def outcomes(g: Side, p: Side, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The place in OUTCOMES of every span of both sides."""
    g_hit, p_hit = strict_hits(g, p)
    g_out, p_out = np.where(g_hit, CORRECT, MISSED), np.where(p_hit, CORRECT, SPURIOUS)
    fn, fp = np.flatnonzero(~g_hit), np.flatnonzero(~p_hit)
    isle = islands(*(np.concatenate(x) for x in zip(g.part(fn), p.part(fp), strict=True)))
    a, b, others = mixed(isle[: len(fn)], isle[len(fn) :])
    a, b = fn[a], fp[b]
    same = (g.start[a] == p.start[b]) & (g.end[a] == p.end[b])
    d = dice(g.start[a], g.end[a], p.start[b], p.end[b])
    near = ~same & (d >= threshold) & (d > 0)
    for cond, kind in ((same, UNCREDITED), (near, BOUNDARY)):
        g_out[a[cond]] = p_out[b[cond]] = kind
    listed = lambda side, at: list(zip(at.tolist(), side.start[at].tolist(), side.end[at].tolist(), strict=True))
    left, right = listed(g, fn), listed(p, fp)
    types: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for golds, preds in others:
        for all_types, found in zip(types, unit_types([left[i] for i in golds], [right[j] for j in preds], threshold), strict=True):
            all_types.update(found)
    for out, all_types in zip((g_out, p_out), types, strict=True):
        out[list(all_types)] = list(all_types.values())
    return g_out, p_out


def credits(a: tuple, b: tuple) -> np.ndarray:
    """The best Dice of each range of `a` with the ranges of `b` of its key."""
    out = np.zeros(len(a[0]))
    for i, j in met(*a, *b):
        np.maximum.at(out, i, dice(a[1][i], a[2][i], b[1][j], b[2][j]))
    return out


def shared_characters(g: Side, p: Side, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: characters of the unions of gold, of predictions and of both, of each label."""
    sides = ((g, 1, 0), (p, 0, 1))
    key = np.concatenate([x for s, _, _ in sides for x in (s.key, s.key)])
    doc = np.concatenate([x for s, _, _ in sides for x in (s.doc, s.doc)])
    at = np.concatenate([x for s, _, _ in sides for x in (s.start, s.end)])
    dx, dy = (np.concatenate([np.full(len(s), sign * m[k]) for s, *m in sides for sign in (1, -1)]) for k in (0, 1))
    order = np.lexsort((at, key))
    x, y, at, key, doc = dx[order].cumsum() > 0, dy[order].cumsum() > 0, at[order], key[order], doc[order]
    step = np.where(key[1:] == key[:-1], at[1:] - at[:-1], 0)
    total = lambda cond: np.bincount(doc[:-1], step * cond[:-1], minlength=n).astype(np.int64)
    return total(x), total(y), total(x & y)


def distinct(side: Side) -> np.ndarray:
    """The places of one of each equal key, start and end."""
    order = np.lexsort((side.end, side.start, side.key))
    k, s, e = side.key[order], side.start[order], side.end[order]
    return order[np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])])[: len(order)]]


def covered(own: Side, other: Side) -> np.ndarray:
    """How many characters of each span lie in the union of the document's other spans, whatever their labels."""
    isle = islands(other.doc, other.start, other.end, True)
    out = np.zeros(len(own), np.int64)
    if not len(isle):
        return out
    n = int(isle.max()) + 1
    start, end, doc = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min), np.zeros(n, np.int64)
    np.minimum.at(start, isle, other.start)
    np.maximum.at(end, isle, other.end)
    doc[isle] = other.doc
    for i, j in met(own.doc, own.start, own.end, doc, start, end):
        np.add.at(out, i, np.minimum(own.end[i], end[j]) - np.maximum(own.start[i], start[j]))
    return out


def structure(own: Side) -> tuple[np.ndarray, np.ndarray]:
    """Whether each span overlaps another of its document, and whether one of the two holds the other."""
    overlapping, nested = np.zeros(len(own), bool), np.zeros(len(own), bool)
    for i, j in met(own.doc, own.start, own.end, own.doc, own.start, own.end):
        i, j = i[i != j], j[i != j]
        overlapping[i] = True
        inside = ((own.start[j] <= own.start[i]) & (own.end[i] <= own.end[j])) | ((own.start[i] <= own.start[j]) & (own.end[j] <= own.end[i]))
        nested[i[inside]] = True
    return overlapping, nested


def sides_of(table: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array, Side, Side]:
    """(filenames, document of each row, names of labels, gold, predicted) of the rows of whole documents."""
    table = table.combine_chunks()
    column = lambda name: table[name].chunk(0) if table[name].num_chunks == 1 else pa.concat_arrays(table[name].chunks)
    filename = column("filename").dictionary_encode("encode")
    doc = filename.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    labels = column("label").dictionary_encode("encode")
    names = labels.dictionary.to_pylist()
    ordered = sorted(names, key=lambda n: (n is not None, n or ""))
    rank = np.array([ordered.index(n) for n in names], np.int64)
    label = rank[labels.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(len(doc), np.int64)
    number = lambda c: pc.fill_null(column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    score = pc.fill_null(column("score"), -np.inf).to_numpy(zero_copy_only=False)
    side = column("side").to_numpy(zero_copy_only=False)
    made = []
    for k in (GOLD, PRED):
        rows = np.flatnonzero(side == k)
        placed = len(rows) and column("position").take(pa.array(rows)).null_count == 0
        made.append(Side(rows, doc, label, number("s"), number("e"), number("position") if placed else None, score, max(len(names), 1)))
    return filename.dictionary, doc, pa.array(ordered, pa.string()), *made


_SCORES = ("n_gold", "n_predicted", "strict_tp", "strict_fp", "strict_fn", "char_correct", "char_spurious", "char_missed", "entity_char_gold", "entity_char_predicted")
_CREDITS = ("entity_char_gold_credit", "entity_char_predicted_credit")


def document_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """The rows of `analysis.document_scores` on the strict events of the two sides, from one shuffle of the spans."""
    from .scoring import with_prf

    def run(batches):
        for table in whole_documents(batches):
            names, _, _, g, p = sides_of(table)
            n = len(names)
            count = lambda doc, m=n: np.bincount(doc, minlength=m)
            total = lambda doc, w, m=n: np.bincount(doc, w, minlength=m)
            tp = count(g.doc[strict_hits(g, p)[0]])
            left, right, shared = shared_characters(g, p, n)
            one = distinct(p)
            found = {
                "n_gold": count(g.doc), "n_predicted": count(p.doc), "strict_tp": tp, "strict_fp": count(p.doc) - tp, "strict_fn": count(g.doc) - tp,
                "char_correct": shared, "char_spurious": right - shared, "char_missed": left - shared, "entity_char_gold": count(g.doc), "entity_char_predicted": count(p.doc[one]),
                "entity_char_gold_credit": total(g.doc, credits(g.ranges(), p.part(one))), "entity_char_predicted_credit": total(p.doc[one], credits(p.part(one), g.ranges())),
            }
            yield pa.RecordBatch.from_arrays([names, *(pa.array(found[c].astype(np.int64)) for c in _SCORES), *(pa.array(found[c].astype(np.float64)) for c in _CREDITS)], ["filename", *_SCORES, *_CREDITS])

    schema = ", ".join(["filename string", *(f"{c} long" for c in _SCORES), *(f"{c} double" for c in _CREDITS)])
    return with_prf(gathered(gold, predicted).drop("text").mapInArrow(run, schema), "strict_tp", "strict_fp", "strict_fn").withColumnsRenamed({c: f"strict_{c}" for c in ("precision", "recall", "f1")})


def _described(table: pa.Table, side: str, threshold: float) -> pa.RecordBatch | None:
    """The mentions of a side in the rows of whole documents, see `described_mentions`."""
    names, doc, labels, g, p = sides_of(table)
    own, other = (g, p) if side == "gold" else (p, g)
    texts = table.filter(pc.equal(table["side"], TEXT))
    text = dict(zip(texts["filename"].to_pylist(), texts["text"].to_pylist(), strict=True))
    listed = [text.get(n) for n in names.to_pylist()]
    known = np.array([n in text for n in names.to_pylist()], bool)
    held = known[own.doc]
    if not held.any():
        return None
    cut = [None if t is None else t[s:e] for t, s, e in ((listed[d], s, e) for d, s, e in zip(own.doc.tolist(), own.start.tolist(), own.end.tolist(), strict=True))]
    out = outcomes(g, p, threshold)[0 if side == "gold" else 1]
    overlapping, nested = structure(own) if side == "gold" else (np.zeros(len(own), bool),) * 2
    columns = [
        names.take(pa.array(own.doc)), labels.take(pa.array(own.label)), pa.array(own.start), pa.array(own.end), table["score"].combine_chunks().take(pa.array(own.rows)), pa.array(cut, pa.string()), pa.array(own.at),
        OUTCOMES.take(pa.array(out)), pa.array(covered(own, other)), pa.array(credits(own.ranges(), other.ranges())), pa.array(overlapping), pa.array(nested),
    ]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _MENTION.split(", ")]).filter(pa.array(held))


_MENTION = "filename string, label string, start_span long, end_span long, score double, text string, at long, outcome string, covered_characters long, entity_char_credit double, overlapping boolean, nested boolean"


def _with_traits(found: DataFrame, side: str) -> DataFrame:
    from .analysis import mention_features

    found = found.withColumn("span_id", F.concat_ws("#", "filename", "at")).withColumn("characters", F.col("end_span") - F.col("start_span"))
    found = found.withColumns(mention_features(F.col("text")))
    return found if side == "gold" else found.drop("overlapping", "nested")


def described_mentions(gold: DataFrame, predicted: DataFrame, documents: DataFrame, side: str, threshold: float = 0.6) -> DataFrame:
    """filename, label, start_span, end_span, score, text, at, span_id, outcome, characters, covered_characters,
    entity_char_credit and features of every span of a side, `gold` or `pred`, and for gold overlapping and nested: the rows
    of `analysis.describe_mentions`. `documents` (filename, document) has each filename once; spans without one are left out.
    """

    def run(batches):
        for table in whole_documents(batches):
            if (found := _described(table, side, threshold)) is not None:
                yield found

    return _with_traits(gathered(gold, predicted, documents).mapInArrow(run, _MENTION), side)


def pieces(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch of (key, text) in runs of rows of about `size` bytes of text; a row is never cut."""
    done = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    at = 0
    while at < len(done):
        to = max(int(np.searchsorted(done, (done[at - 1] if at else 0) + size, "right")), at + 1)
        yield batch.slice(at, to - at)
        at = to


def described_in_rows(documents: DataFrame, spans_of: Callable, labels: pa.Array, side: str, threshold: float = 0.6) -> DataFrame:
    """The rows of `described_mentions` where the spans of a document are made from its own row, so that nothing is dealt.

    `documents` has key, text and filename (each once). `spans_of(keys, texts)` gives the spans of gold and of predictions as
    arrays (row, place in `labels`, start, end, score)."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole):
                key, text, name = batch.columns
                parts = [pa.table({"filename": name, "side": np.full(len(key), TEXT, np.int8), "label": pa.nulls(len(key), pa.string()), "s": pa.nulls(len(key), pa.int64()), "e": pa.nulls(len(key), pa.int64()), "position": pa.nulls(len(key), pa.int64()), "score": pa.nulls(len(key), pa.float64()), "text": text})]
                for k, (row, label, s, e, score) in enumerate(spans_of(key, text)):
                    parts.append(pa.table({"filename": name.take(pa.array(row)), "side": np.full(len(row), k, np.int8), "label": labels.take(pa.array(label)), "s": s, "e": e, "position": pa.nulls(len(row), pa.int64()), "score": score if k == PRED else pa.nulls(len(row), pa.float64()), "text": pa.nulls(len(row), text.type)}))
                if (found := _described(pa.concat_tables(parts), side, threshold)) is not None:
                    yield found

    return _with_traits(documents.select("key", "text", "filename").mapInArrow(run, _MENTION), side)


@functools.cache
def _decimal_digits() -> np.ndarray:
    """Whether each code point is a decimal digit (Nd)."""
    return np.array([unicodedata.category(chr(c)) == "Nd" for c in range(0x110000)])


def digits_within(texts: pa.Array, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the code points from `start` up to `end` of each row's text hold a decimal digit: `has_digit` of
    `analysis.mention_features`, without the texts of the mentions. Digits are those of Python's Unicode, as of the oracle's;
    Java 17 lacks 30 of them (Tangsa, Kawi and Nag Mundari)."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    edge = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data is not None else np.zeros(0, np.uint8)
    edge = edge - edge[0]
    found = np.flatnonzero((data - np.uint8(48)) < 10)
    if len(high := np.flatnonzero(data >= 0xD9)):  # the first digit beyond ASCII is U+0660
        b = [data[np.minimum(high + k, len(data) - 1)].astype(np.int64) & 63 for k in range(4)]
        lead = data[high].astype(np.int64)
        two, three, four = (lead & 31) << 6 | b[1], (lead & 15) << 12 | b[1] << 6 | b[2], (lead & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3]
        found = np.sort(np.concatenate([found, high[_decimal_digits()[np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))]]]))
    within = np.flatnonzero((data & 0xC0) == 0x80)
    point = lambda at: at - np.searchsorted(within, at)
    found, edge = point(found), point(edge)
    s, e = (np.minimum(edge[row] + x, edge[row + 1]) for x in (start, end))
    return np.searchsorted(found, e) > np.searchsorted(found, s)


_SUMS = ("support", "correct", "boundary_error", "missed", "spurious", "uncredited_exact", "_strict_num", "_strict_den", "_char_num", "_char_den", "_entity_char_num", "_entity_char_den")


def _cells(n: int, doc: np.ndarray, cell: np.ndarray, size: int, out: np.ndarray, covered: np.ndarray, characters: np.ndarray, credit: np.ndarray) -> np.ndarray:
    """By document and cell: mentions of each outcome, covered characters, characters, credit."""
    at = doc * size + cell
    counts = np.bincount(at * len(OUTCOMES) + out, minlength=n * size * len(OUTCOMES)).reshape(n, size, -1)
    return np.concatenate([counts, *(np.bincount(at, w, minlength=n * size).reshape(n, size, 1) for w in (covered, characters, credit))], axis=2)


def subgroup_sums(documents: DataFrame, spans_of: Callable, labels: pa.Array, side: str, traits: dict[str, Callable], weights_of: Callable, samples: list[int], threshold: float = 0.6) -> DataFrame:
    """What `analysis.subgroup_measures` takes: family (label, and the names of `traits`), value, sample, and the sums over the
    mentions of a side, each by the weight of its document in the sample; sample null is every document once.

    `documents`, `spans_of` and `labels` are those of `described_in_rows`. A trait is a function of (texts, row, start, end)
    that gives a boolean for each mention; `weights_of(keys)` gives whole weights, a row for each key and a column for each
    sample. Documents are dealt by their key, as a file may hold many in one row group, which a single task reads. A task
    returns a row for each value and sample, so neither mentions nor draws are shuffled. Sums of a batch of about 1 MB are
    exact below 2^53."""
    rank = np.argsort(np.argsort(np.array([n or "" for n in labels.to_pylist()], str), kind="stable"), kind="stable")
    values = [labels.to_pylist(), *(["absent", "present"] for _ in traits)]
    shape = tuple(len(v) for v in values)
    size = int(np.prod(shape))

    def run(batches):
        total = np.zeros((len(samples) + 1, size, len(OUTCOMES) + 2), np.int64)
        credit = np.zeros((len(samples) + 1, size))
        for whole in batches:
            for batch in pieces(whole):
                key, text = batch.columns
                n = len(key)
                made = [Side(np.arange(len(row)), row, rank[label], s, e, None, score if k == PRED else np.zeros(len(row)), len(labels)) for k, (row, label, s, e, score) in enumerate(spans_of(key, text))]
                own, other = made if side == "gold" else made[::-1]
                if not len(own):
                    continue
                flags = [trait(text, own.doc, own.start, own.end).astype(np.int64) for trait in traits.values()]
                cell = np.ravel_multi_index((np.argsort(rank)[own.label], *flags), shape)
                found = _cells(n, own.doc, cell, size, outcomes(*made, threshold)[0 if side == "gold" else 1], covered(own, other), own.end - own.start, credits(own.ranges(), other.ranges()))
                weights = np.column_stack([np.ones(n, np.int64), weights_of(key)]).astype(np.float64)
                summed = (weights.T @ found.reshape(n, -1)).reshape(len(samples) + 1, size, -1)
                total += np.rint(summed[..., :-1]).astype(np.int64)
                credit += summed[..., -1]
        total, credit = total.reshape(-1, *shape, total.shape[-1]), credit.reshape(-1, *shape)
        rows = []
        for k, (family, named) in enumerate(zip(["label", *traits], values, strict=True)):
            others = tuple(a for a in range(1, len(shape) + 1) if a != k + 1)
            sums, credited = total.sum(others), credit.sum(others)
            for v in np.flatnonzero(sums[0, :, : len(OUTCOMES)].sum(1)).tolist():
                for sample, (*kinds, hit, characters), c in zip([None, *samples], sums[:, v].tolist(), credited[:, v].tolist(), strict=True):
                    rows.append((family, named[v], sample, sum(kinds), *kinds, kinds[CORRECT], sum(kinds), hit, characters, c, sum(kinds)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names = ["family", "value", "sample", *_SUMS]
    types = [pa.string(), pa.string(), pa.int64(), *(pa.float64() if c == "_entity_char_num" else pa.int64() for c in _SUMS)]
    schema = "family string, value string, sample long, " + ", ".join(f"{c} {'double' if c == '_entity_char_num' else 'long'}" for c in _SUMS)
    return documents.select("key", "text").repartition("key").mapInArrow(run, schema)
