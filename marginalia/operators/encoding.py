"""Encoding: windows, tags and model rows of documents, and the way back from rows to spans.

A document is encoded in its own task, with no shuffle. Its tokens, sentences and entities are sorted offsets, so each
rule is a search in them: a token's sentence, word and entity, the places where a cut spares every entity, and the
farthest end that a budget reaches. The way back explodes the rows and is left to the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import overlap_join
from .spans import POLICIES, decode_bio, dedupe_spans
from .stats import sentence_spans, word_spans

#: The label of a position that no loss is computed on, and the ids of the tags. Fixed values.
IGNORED = -100
OUT, BEGIN, INSIDE = 0, 1, 2

Arrays = tuple[np.ndarray, ...]


def _ints(values) -> np.ndarray:
    return np.asarray(list(values), np.int64)


# tokens


def word_tokens(text: str) -> Arrays:
    """(ids, starts, ends) of the UAX #29 words; an id is 31 bits of a checksum of the word."""
    found = word_spans(text)
    return _ints(crc32(w["text"].encode()) & 0x7FFFFFFF for w in found), _ints(w["start"] for w in found), _ints(w["end"] for w in found)


def piece_tokens(size: int, words: Callable[[str], Arrays] = word_tokens) -> Callable[[str], Arrays]:
    """A tokenizer that cuts each word in pieces of `size` characters; an id is the code point of a piece's first character."""

    def tokens(text: str) -> Arrays:
        _, starts, ends = words(text)
        n = -(-(ends - starts) // size)
        first = np.repeat(starts, n) + (np.arange(n.sum()) - np.repeat(np.concatenate([[0], n.cumsum()])[:-1], n)) * size
        return _ints(ord(text[i]) for i in first), first, np.minimum(first + size, np.repeat(ends, n))

    return tokens


def space_words(text: str) -> Arrays:
    """(ids, starts, ends) of the runs between single spaces."""
    found, at = [], 0
    for part in text.split(" "):
        if part:
            found.append((at, at + len(part)))
        at += len(part) + 1
    return np.zeros(len(found), np.int64), _ints(a for a, _ in found), _ints(b for _, b in found)


def trimmed_starts(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts moved past white space; tokens of white space alone stay."""
    lost = _ints(len(text[a:b]) - len(text[a:b].lstrip()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return np.where(lost < ends - starts, starts + lost, starts)


def words_of_tokens(text: str, starts: np.ndarray, words: Callable[[str], Arrays] = word_tokens) -> np.ndarray:
    """The word in which each token starts, -1 for a token in none."""
    _, begins, ends = words(text)
    at = np.searchsorted(begins, starts, "right") - 1
    return np.where((at >= 0) & (starts < np.append(ends, 0)[at]), at, -1)


# sentences and entities


def sentence_starts(text: str) -> np.ndarray:
    return _ints(s["start"] for s in sentence_spans(text))


def inside(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which points stand strictly inside one of the ranges: one that starts before the point reaches beyond it."""
    order = np.argsort(starts, kind="stable")
    reach = np.maximum.accumulate(ends[order]) if len(ends) else ends
    before = np.searchsorted(starts[order], points, "left")
    return (before > 0) & (np.append(reach, -1)[before - 1] > points)


def joined_sentences(starts: np.ndarray, entity_starts: np.ndarray, entity_ends: np.ndarray) -> np.ndarray:
    """Starts of the sentences that are left when no entity may cross a border."""
    keep = ~inside(starts, entity_starts, entity_ends)
    keep[:1] = True
    return starts[keep]


def sentence_bounds(starts: np.ndarray, token_starts: np.ndarray) -> np.ndarray:
    """Token places where sentences begin, and the number of tokens; a token belongs where it starts."""
    return np.unique(np.concatenate([[0], np.searchsorted(token_starts, starts[1:], "left"), [len(token_starts)]]))


def lengthened(bounds: np.ndarray, least: int) -> np.ndarray:
    """Bounds of sentences of `least` tokens or more: a short one takes in those after it, a short rest joins the one before."""
    out = [int(bounds[0])]
    while (at := int(np.searchsorted(bounds, out[-1] + max(least, 1), "left"))) < len(bounds):
        out.append(int(bounds[at]))
    if out[-1] != bounds[-1]:
        out[len(out) - 1 if len(out) > 1 else 1 :] = [int(bounds[-1])]
    return _ints(out)


def free_places(token_starts: np.ndarray, entity_starts: np.ndarray, entity_ends: np.ndarray) -> np.ndarray:
    """Places between tokens where a cut spares every entity, the end among them."""
    return np.append(np.flatnonzero(~inside(token_starts, entity_starts, entity_ends)), len(token_starts))


def _cut(at: int, end: int, free: np.ndarray, budget: int) -> int:
    """The farthest place that `budget` tokens reach from `at`: the end, or a free place before it."""
    if end - at <= budget:
        return end
    place = int(np.searchsorted(free, at + budget, "right")) - 1
    cut = int(free[place]) if place >= 0 else at
    if cut <= at:
        raise ValueError(f"an entity is longer than {budget} tokens: there is no safe cut after token {at}")
    return cut


def _pieces(bounds: np.ndarray, free: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Each sentence by itself, cut where it is longer than the budget."""
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        while a < b:
            out.append((a, _cut(a, b, free, budget)))
            a = out[-1][1]
    return out


def greedy_windows(bounds: np.ndarray, free: np.ndarray, budget: int) -> Arrays:
    """(starts, ends, core starts, core ends) of windows that tile the tokens: as many whole sentences as the budget holds;
    a longer sentence is cut and shares no window with others."""
    out, edges = [], set(bounds.tolist())
    for a, b in _pieces(bounds, free, budget):
        whole = a in edges and b in edges
        if whole and out and out[-1][2] and b - out[-1][0] <= budget:
            out[-1] = (out[-1][0], b, True)
        else:
            out.append((a, b, whole))
    starts, ends = _ints(a for a, _, _ in out), _ints(b for _, b, _ in out)
    return starts, ends, starts, ends


def context_windows(bounds: np.ndarray, free: np.ndarray, budget: int, context: int, least: int = 4) -> Arrays:
    """(starts, ends, core starts, core ends): each sentence of `least` tokens with up to `context` tokens a side.

    What one side lacks the other gets; what is over the budget goes from behind first; a window's ends move inwards to the
    next place that spares the entities.
    """
    n = int(bounds[-1])
    cores = _pieces(lengthened(bounds, least), free, budget)
    a, b = _ints(x for x, _ in cores), _ints(y for _, y in cores)
    before, after = np.minimum(context + np.maximum(0, context - (n - b)), a), np.minimum(context + np.maximum(0, context - a), n - b)
    over = np.maximum(0, before + after - (budget - (b - a)))
    behind = np.minimum(after, over)
    first, last = a - (before - (over - behind)), b + (after - behind)
    starts = np.minimum(free[np.searchsorted(free, np.maximum(first, 0), "left")], a)
    place = np.searchsorted(free, np.minimum(last, n), "right") - 1
    ends = np.where(place < 0, b, np.maximum(free[place], b))
    return starts, ends, a, b


def window_strategy(strategy: str | Callable, context_tokens: int | None = None, min_sentence_tokens: int = 4) -> Callable[[np.ndarray, np.ndarray, int], Arrays]:
    """`greedy`, `context` or a function of (bounds, free places, budget); a setting without effect raises."""
    if callable(strategy):
        return strategy
    if strategy not in ("greedy", "context"):
        raise ValueError(f"unknown strategy {strategy!r}: greedy, context or a function")
    if (context_tokens is None) != (strategy == "greedy"):
        raise ValueError("context_tokens belongs to the strategy context, which needs it")
    return greedy_windows if strategy == "greedy" else lambda bounds, free, budget: context_windows(bounds, free, budget, context_tokens, min_sentence_tokens)


# tags and rows


def owners(token_starts: np.ndarray, token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The entity of each token, -1 if none: of the entities in the order of their starts, the first that reaches beyond the
    token's start, if it starts before the token's end."""
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    at = np.searchsorted(reach, token_starts, "right")
    return np.where(np.append(starts, np.iinfo(np.int64).max)[at] < token_ends, at, -1)


def iob(owner: np.ndarray) -> np.ndarray:
    """Tag ids: inside where the token before has the same entity, else begin."""
    last = np.concatenate([[-1], owner[:-1]])
    return np.where(owner < 0, OUT, np.where(owner == last, INSIDE, BEGIN))


def label_ids(tags: np.ndarray, word_ids: np.ndarray) -> np.ndarray:
    """Tags of the first token of each word; everything else is ignored."""
    first = np.concatenate([[True], word_ids[1:] != word_ids[:-1]])[: len(word_ids)]
    return np.where(first & (word_ids >= 0), tags, IGNORED)


def label_names(label: str) -> dict[int, str]:
    if not isinstance(label, str) or not label.strip():
        raise ValueError(f"a label is a text that isn't blank, not {label!r}")
    return {OUT: "O", BEGIN: f"B-{label}", INSIDE: f"I-{label}"}


def special_template(encode: Callable[[str, bool], list[int]]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(prefix, suffix) that a tokenizer puts around a text, from a probe encoded without and with them."""
    probe, dressed = encode("a", False), encode("a", True)
    for at in range(len(dressed) - len(probe) + 1):
        if dressed[at : at + len(probe)] == probe:
            return tuple(dressed[:at]), tuple(dressed[at + len(probe) :])
    raise ValueError("the probe isn't in its own encoding")


def resolved(starts: np.ndarray, ends: np.ndarray, policy: str) -> Arrays:
    """(starts, ends) of one type's entities by an overlap policy (see `spans.POLICIES`), in order."""
    if policy not in POLICIES:
        raise ValueError(f"unknown overlap policy {policy!r}")
    order = np.lexsort((ends, starts))
    s, e = starts[order], ends[order]
    if policy == "none" or len(s) < 2:
        return s, e
    reach = np.maximum.accumulate(e)
    cluster = np.concatenate([[0], (s[1:] >= reach[:-1]).cumsum()])
    if policy == "error":
        if cluster[-1] + 1 < len(s):
            raise ValueError("overlapping entities")
        return s, e
    first = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
    if policy == "merge_same_label_then_keep_longest":
        return s[first], np.maximum.reduceat(e, first)
    size = e - s
    best = np.lexsort((s, -size if policy == "keep_longest" else size, cluster))
    pick = np.sort(best[np.concatenate([[True], cluster[best][1:] != cluster[best][:-1]])])
    return s[pick], e[pick]


_ROW = "doc_id {id}, window int, token_start int, token_end int, input_ids array<int>, attention_mask array<int>, labels {labels}, token_offsets array<struct<start:int,end:int>>, word_ids array<int>"


@dataclass(frozen=True)
class Encoder:
    """Settings of an encoding: `labels` are the heads, one for a model of a single type."""

    labels: tuple[str, ...]
    prefix: tuple[int, ...] = ()
    suffix: tuple[int, ...] = ()
    max_length: int = 256
    strategy: str | Callable = "greedy"
    context_tokens: int | None = None
    min_sentence_tokens: int = 4
    policy: str = "merge_same_label_then_keep_longest"
    tokenizer: Callable[[str], Arrays] = field(default=word_tokens, compare=False)
    words: Callable[[str], Arrays] = field(default=word_tokens, compare=False)
    segmenter: Callable[[str], np.ndarray] = field(default=sentence_starts, compare=False)

    def __post_init__(self):
        if not self.labels or len(set(self.labels)) < len(self.labels):
            raise ValueError("labels are one or more, each once")
        for label in self.labels:
            label_names(label)
        if self.budget < 1:
            raise ValueError("the special tokens leave no room")

    @property
    def budget(self) -> int:
        """Tokens of a window beside the special ones."""
        return self.max_length - len(self.prefix) - len(self.suffix)

    def describe(self) -> dict:
        """The settings that can be written down; functions by name."""
        return {k: getattr(v, "__name__", v) if callable(v) else list(v) if isinstance(v, tuple) else v for k, v in {**asdict(self), "strategy": self.strategy, "tokenizer": self.tokenizer, "words": self.words, "segmenter": self.segmenter}.items()}

    @classmethod
    def from_description(cls, description: dict, **functions) -> Encoder:
        """The encoder of `describe`; functions that aren't the default ones are given again."""
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in description.items() if k not in ("tokenizer", "words", "segmenter")}
        return cls(**known, **functions)

    def document(self, text: str, entities: list[tuple[str, int, int]]) -> tuple[Arrays, Arrays, list[Arrays]]:
        """((ids, starts, ends, word ids), windows, entities of each head) of a text; entities are (label, start, end)."""
        ids, starts, ends = self.tokenizer(text)
        kept = ends > starts
        ids, starts, ends = ids[kept], starts[kept], ends[kept]
        starts = trimmed_starts(text, starts, ends)
        heads = [resolved(_ints(s for x, s, _ in entities if x == label), _ints(e for x, _, e in entities if x == label), self.policy) for label in self.labels]
        all_starts, all_ends = (np.concatenate([h[k] for h in heads]) for k in (0, 1))
        windows: Arrays = (np.zeros(0, np.int64),) * 4
        if len(starts):
            sentences = joined_sentences(self.segmenter(text), all_starts, all_ends)
            choose = window_strategy(self.strategy, self.context_tokens, self.min_sentence_tokens)
            windows = choose(sentence_bounds(sentences, starts), free_places(starts, all_starts, all_ends), self.budget)
        return (ids, starts, ends, words_of_tokens(text, starts, self.words)), windows, heads

    def encode(self, corpus: DataFrame) -> DataFrame:
        """One row for each window of a corpus (doc_id, text, entities): doc_id, window, token_start, token_end, input_ids,
        attention_mask, labels (of the first head: a list), token_offsets, word_ids (null: in no word)."""
        return self._encode(corpus, False)

    def encode_heads(self, corpus: DataFrame) -> DataFrame:
        """The same with the labels of every head at each position."""
        return self._encode(corpus, True)

    def encode_parquet(self, spark: SparkSession, *paths: str) -> DataFrame:
        """The rows of stored corpora (doc_id, text, entities_json), of which only these columns are read."""
        from .corpus import ENTITIES

        return self.encode(spark.read.parquet(*paths).select("doc_id", "text", F.from_json("entities_json", ENTITIES).alias("entities")))

    def _encode(self, corpus: DataFrame, many: bool) -> DataFrame:
        id_type = corpus.schema["doc_id"].dataType.simpleString()
        pad = lambda x: np.concatenate([np.full(len(self.prefix), IGNORED), x, np.full(len(self.suffix), IGNORED)])

        def rows(text: str, entities: list[dict]):
            (ids, starts, ends, word_ids), windows, heads = self.document(text, [(e["label"], e["start"], e["end"]) for e in entities])
            for n, (a, b, core_a, core_b) in enumerate(zip(*(w.tolist() for w in windows), strict=True)):
                flank = (np.arange(a, b) < core_a) | (np.arange(a, b) >= core_b)
                labels = []
                for head in heads:
                    tags = np.full(b - a, IGNORED)
                    tags[core_a - a : core_b - a] = iob(owners(starts[core_a:core_b], ends[core_a:core_b], *head))
                    labels.append(pad(np.where(flank, IGNORED, label_ids(tags, word_ids[a:b]))))
                tokens = np.concatenate([self.prefix, ids[a:b], self.suffix]).astype(np.int64)
                yield {
                    "window": n, "token_start": a, "token_end": b, "input_ids": tokens.tolist(), "attention_mask": [1] * len(tokens), "labels": np.column_stack(labels).tolist() if many else labels[0].tolist(),
                    "token_offsets": [{"start": s, "end": e} for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)], "word_ids": [None if w < 0 else w for w in word_ids[a:b].tolist()],
                }

        ints, offsets = pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = {"window": pa.int32(), "token_start": pa.int32(), "token_end": pa.int32(), "input_ids": ints, "attention_mask": ints, "labels": pa.list_(ints) if many else ints, "token_offsets": offsets, "word_ids": ints}

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    found = list(rows(batch.column(1)[i].as_py() or "", batch.column(2)[i].as_py() or []))
                    if found:
                        columns = [pa.array([r[c] for r in found], t) for c, t in kinds.items()]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found))), *columns], ["doc_id", *kinds])

        return corpus.select("doc_id", "text", "entities").mapInArrow(run, _ROW.format(id=id_type, labels="array<array<int>>" if many else "array<int>"))


def entity_labels(corpora: list[DataFrame]) -> list[str]:
    """The sorted labels of corpora (entities): the heads of a model of many types."""
    found = None
    for c in corpora:
        one = c.select(F.explode("entities").alias("e")).select("e.label").distinct()
        found = one if found is None else found.unionByName(one)
    return sorted(r["label"] for r in found.distinct().collect())


# from rows back to spans


def head_rows(rows: DataFrame, head: int) -> DataFrame:
    """Rows of many heads with the labels of one."""
    return rows.withColumn("labels", F.transform("labels", lambda p: p[head]))


def softmax(logits: Column) -> Column:
    """Of an array, shifted by its largest so that it can't overflow."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def _flat(lists: pa.Array, null=None) -> tuple[np.ndarray, np.ndarray]:
    """(items, row of each) of an array of lists; with `null`, in the place of null items."""
    rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    items = lists.flatten()
    return (items if null is None else pc.fill_null(items, null).to_numpy(zero_copy_only=False)), rows


def _grown(offsets: pa.Array, word_ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of each token, ends grown to the ends of their words in the row."""
    items, row = _flat(offsets)
    start, end = (items.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "end"))
    word = _flat(word_ids, -1)[0].astype(np.int64)
    if not len(word):
        return row, start, end
    key = row * (int(word.max()) + 2) + word + 1
    _, place = np.unique(key, return_inverse=True)
    reach = np.full(int(place.max()) + 1, np.iinfo(np.int64).min)
    np.maximum.at(reach, place, end)
    return row, start, np.where(word < 0, end, reach[place])


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _grown_ends(offsets: pa.Array, word_ids: pa.Array) -> pa.Array:
    _, _, end = _grown(offsets, word_ids)
    return _listed(pa.array(end.astype(np.int32)), pc.fill_null(pc.list_value_length(offsets), 0).to_numpy(zero_copy_only=False))


def _listed(items: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]).astype(np.int32)), items)


def _likely(logits: pa.Array, given: bool) -> tuple[np.ndarray, np.ndarray]:
    """(tag, its probability) of each position: the first of the most likely tags, from three logits, or from probabilities
    that are `given` beside them."""
    x = _flat(_flat(logits)[0])[0].to_numpy(zero_copy_only=False).reshape(-1, 3)
    tag = x.argmax(1)
    if given:
        return tag, np.full(len(tag), np.nan)
    p = np.exp(x - x.max(1, keepdims=True))
    return tag, (p / p.sum(1, keepdims=True))[np.arange(len(tag)), tag]


def _runs(row: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray, score: np.ndarray, n: int) -> pa.Array:
    """The spans of each of `n` rows by its labelled tokens' tags, as `spans.decode_bio` has them."""
    tag = np.where((tag == BEGIN) | (tag == INSIDE), tag, OUT)
    last = np.concatenate([[OUT], np.where(row[1:] == row[:-1], tag[:-1], OUT)])[: len(tag)]
    opens = (tag == BEGIN) | ((tag == INSIDE) & (last == OUT))
    inside = tag != OUT
    row, start, end, score, first = row[inside], start[inside], end[inside], score[inside], np.flatnonzero(opens[inside])
    if not len(first):
        spans = pa.array([], _RUN)
    else:
        size = np.diff(np.append(first, len(row)))
        spans = pa.StructArray.from_arrays([pa.array(np.minimum.reduceat(start, first).astype(np.int32)), pa.array(np.maximum.reduceat(end, first).astype(np.int32)), pa.array(np.add.reduceat(score, first) / size)], fields=list(_RUN))
    return _listed(spans, np.bincount(row[first], minlength=n))


_RUN = pa.struct([("start_span", pa.int32()), ("end_span", pa.int32()), ("score", pa.float64())])
_RUNS = T.ArrayType(T.StructType([T.StructField("start_span", T.IntegerType()), T.StructField("end_span", T.IntegerType()), T.StructField("score", T.DoubleType())]))


@F.arrow_udf(_RUNS)
def _gold_runs(labels: pa.Array, offsets: pa.Array, word_ids: pa.Array) -> pa.Array:
    row, start, end = _grown(offsets, word_ids)
    tag = _flat(labels, IGNORED)[0]
    held = tag != IGNORED
    return _runs(row[held], tag[held], start[held], end[held], np.ones(int(held.sum())), len(labels))


@F.arrow_udf(_RUNS)
def _predicted_runs(labels: pa.Array, offsets: pa.Array, word_ids: pa.Array, logits: pa.Array) -> pa.Array:
    row, start, end = _grown(offsets, word_ids)
    held = _flat(labels, IGNORED)[0] != IGNORED
    tag, p = _likely(logits, False)
    return _runs(row[held], tag[held], start[held], end[held], p[held], len(labels))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _pair_counts(labels: pa.Array, logits: pa.Array) -> pa.Array:
    """How often each pair of a label and the most likely tag is at a row's labelled positions: 3 x 3 numbers."""
    label, row = _flat(labels, IGNORED)
    held = label != IGNORED
    tag = _likely(logits, True)[0]
    label = np.where((label == BEGIN) | (label == INSIDE), label, OUT)
    found = np.bincount((row * 9 + label * 3 + tag)[held].astype(np.int64), minlength=9 * len(labels))
    return _listed(pa.array(found), np.full(len(labels), 9))


def _contents(rows: DataFrame, encoder: Encoder, *columns: str) -> DataFrame:
    """doc_id, window, token_offsets, word_ids, labels and further arrays of rows, of the positions of content alone.

    Rows whose input_ids don't begin and end as the encoder's special tokens do raise.
    """
    before, behind = len(encoder.prefix), len(encoder.suffix)
    n = F.size("input_ids") - before - behind
    fits = (F.slice("input_ids", 1, before) == F.array(*map(F.lit, encoder.prefix)).cast("array<int>")) & (F.slice("input_ids", n + before + 1, F.lit(behind)) == F.array(*map(F.lit, encoder.suffix)).cast("array<int>"))
    bad = F.raise_error(F.concat(F.lit("rows of another tokenizer in "), F.col("doc_id").cast("string"))).cast("array<struct<start:int,end:int>>")
    content = lambda c: F.slice(c, before + 1, F.greatest(n, F.lit(0)))
    offsets = F.when(fits & (n == F.size("token_offsets")), F.col("token_offsets")).otherwise(bad)
    # what is raised must be looked at, whichever columns are read
    checked = lambda c: F.when(F.size(offsets) >= 0, c)
    return rows.select("doc_id", "window", offsets.alias("token_offsets"), "word_ids", *(checked(content(c)).alias(c) for c in ("labels", *columns)))


def positions(rows: DataFrame, encoder: Encoder, *columns: str) -> DataFrame:
    """doc_id, window, place, label_id, start_span, end_span, word_id of the labelled positions of rows (one for each doc_id
    and window), ends grown to the ends of their words; `columns` are further arrays with an item for each position of
    input_ids. Nothing leaves its row, so nothing is shuffled.

    Rows whose input_ids don't begin and end as the encoder's special tokens do raise.
    """
    found = _contents(rows, encoder, *columns).withColumn("_end", _grown_ends("token_offsets", "word_ids"))
    zipped = F.arrays_zip("token_offsets", "_end", "word_ids", F.col("labels").alias("label_id"), *columns)
    each = found.select("doc_id", "window", F.posexplode(zipped).alias("place", "z"))
    each = each.select("doc_id", "window", "place", "z.label_id", F.col("z.token_offsets.start").alias("start_span"), F.col("z._end").alias("end_span"), F.col("z.word_ids").alias("word_id"), *(F.col(f"z.{c}").alias(c) for c in columns))
    return each.filter(F.col("label_id") != IGNORED)


def _tag(ids: Column, label: str) -> Column:
    names = label_names(label)
    return F.when(ids == BEGIN, names[BEGIN]).when(ids == INSIDE, names[INSIDE]).otherwise(names[OUT])


def gold_spans(rows: DataFrame, encoder: Encoder, label: str | None = None) -> DataFrame:
    """filename, label, start_span, end_span that rows of one head encode, each once."""
    label = label or encoder.labels[0]
    spans = _contents(rows, encoder).select(F.col("doc_id").cast("string").alias("filename"), F.lit(label).alias("label"), F.inline(_gold_runs("labels", "token_offsets", "word_ids")))
    return dedupe_spans(spans.drop("score"))


def tag_probabilities(rows: DataFrame, encoder: Encoder, logits: str = "logits", probabilities: str | None = None) -> DataFrame:
    """`positions` with tag_id, the most likely tag (the first of equal ones), and p, the probabilities of the three tags."""
    found = positions(rows, encoder, logits, *([probabilities] if probabilities else []))
    x = F.col(logits)
    return found.withColumns({"tag_id": (F.array_position(x, F.array_max(x)) - 1).cast("int"), "p": F.col(probabilities) if probabilities else softmax(x)})


def predicted_spans(rows: DataFrame, encoder: Encoder, logits: str = "logits", label: str | None = None, min_score: float = 0.0, probabilities: str | None = None) -> DataFrame:
    """filename, label, start_span, end_span, score of the spans that logits (an array of three for each position) say.

    A span's score is the mean probability of its tokens' tags; the same span of several windows has the highest.
    """
    label = label or encoder.labels[0]
    if probabilities is None:
        found = _contents(rows, encoder, logits)
        spans = found.select(F.col("doc_id").cast("string").alias("filename"), F.lit(label).alias("label"), F.inline(_predicted_runs("labels", "token_offsets", "word_ids", logits)))
        return dedupe_spans(spans).filter(F.col("score") >= min_score)
    tokens = tag_probabilities(rows, encoder, logits, probabilities)
    tokens = tokens.select(F.col("doc_id").cast("string").alias("filename"), "window", F.col("place").alias("position"), _tag(F.col("tag_id"), label).alias("tag"), "start_span", "end_span", F.get("p", F.col("tag_id")).alias("score"))
    spans = decode_bio(tokens, key=["filename", "window"]).select("filename", "label", "start_span", "end_span", "score")
    return dedupe_spans(spans).filter(F.col("score") >= min_score)


def head_spans(rows: DataFrame, encoder: Encoder, logits: str | None = None) -> DataFrame:
    """Gold spans of every head of `encode_heads` rows, or with `logits` (heads x three for each position) predicted ones."""
    found = _contents(rows, encoder, *([logits] if logits else []))
    of = lambda c, i: F.transform(c, lambda p: p[i])
    heads = []
    for i, label in enumerate(encoder.labels):
        runs = _predicted_runs(of("labels", i), "token_offsets", "word_ids", of(logits, i)) if logits else _gold_runs(of("labels", i), "token_offsets", "word_ids")
        heads.append(F.transform(runs, lambda x: F.struct(F.lit(label).alias("label"), x["start_span"].alias("start_span"), x["end_span"].alias("end_span"), x["score"].alias("score"))))  # noqa: B023
    spans = found.select(F.col("doc_id").cast("string").alias("filename"), F.inline(F.flatten(F.array(*heads))))
    return dedupe_spans(spans if logits else spans.drop("score"))


def token_pairs(rows: DataFrame, encoder: Encoder, logits: str = "logits", label: str | None = None) -> DataFrame:
    """gold, predicted tags of the labelled positions: what `scoring.token_metrics` takes."""
    label = label or encoder.labels[0]
    return tag_probabilities(rows, encoder, logits).select("doc_id", _tag(F.col("label_id"), label).alias("gold"), _tag(F.col("tag_id"), label).alias("predicted"))


def pair_counts(rows: DataFrame, encoder: Encoder, logits: str = "logits", label: str | None = None) -> DataFrame:
    """gold, predicted, n: how often each pair of `token_pairs` occurs, counted row by row before rows meet."""
    names = label_names(label or encoder.labels[0])
    found = _contents(rows, encoder, logits).select(F.posexplode(_pair_counts("labels", logits)).alias("place", "n"))
    sums = found.groupBy("place").agg(F.sum("n").alias("n")).filter("n > 0")
    name = lambda i: F.element_at(F.array(*(F.lit(names[k]) for k in range(3))), i.cast("int") + 1)
    return sums.select(name(F.floor(F.col("place") / 3)).alias("gold"), name(F.col("place") % 3).alias("predicted"), "n")


def word_table(rows: DataFrame, encoder: Encoder, logits: str = "logits") -> DataFrame:
    """doc_id, word_id, tag (O, B, I), p_O, p_B, p_I of each labelled word, from the first window that has it."""
    found = tag_probabilities(rows, encoder, logits).filter("word_id IS NOT NULL")
    tag = F.element_at(F.array(*map(F.lit, "OBI")), F.col("tag_id") + 1)
    item = F.struct("window", "place", tag.alias("tag"), *(F.col("p")[i].alias(f"p_{t}") for i, t in enumerate("OBI")))
    return found.groupBy("doc_id", "word_id").agg(F.min(item).alias("w")).select("doc_id", "word_id", "w.tag", "w.p_O", "w.p_B", "w.p_I")


def invalid_transitions(tags: DataFrame) -> DataFrame:
    """filename, position, tag of tags (filename, position, tag) that no tagger may give: an inside tag at the start, after
    outside, or after another label."""
    last = F.coalesce(F.lag("tag").over(W.partitionBy("filename").orderBy("position")), F.lit("O"))
    plain = lambda c: F.regexp_replace(c, "^[BI]-", "")
    return tags.withColumn("_last", last).filter(F.col("tag").startswith("I-") & ((F.col("_last") == "O") | (plain(F.col("_last")) != plain(F.col("tag"))))).drop("_last")


def tag_words(words: DataFrame, spans: DataFrame) -> DataFrame:
    """filename, word_no, tag of words (filename, word_no, start_span, end_span) by the first span that each touches."""
    s = spans.select("filename", F.col("start_span").alias("_s"), F.col("end_span").alias("_e"))
    hit = overlap_join(words, s, ["filename"]).groupBy("filename", "word_no").agg(F.min(F.struct("_s", "_e")).alias("owner"))
    tagged = words.join(hit, ["filename", "word_no"], "left")
    last = F.lag("owner").over(W.partitionBy("filename").orderBy("word_no"))
    return tagged.select("filename", "word_no", F.when(F.col("owner").isNull(), "O").when(F.col("owner").eqNullSafe(last), "I").otherwise("B").alias("tag"))


def token_lengths(words: DataFrame, spans: DataFrame) -> DataFrame:
    """filename, start_span, end_span, n_tokens: how many words each distinct span touches, 0 too."""
    distinct = spans.select("filename", "start_span", "end_span").distinct()
    w = words.select("filename", F.col("start_span").alias("_s"), F.col("end_span").alias("_e"))
    counts = overlap_join(distinct, w, ["filename"]).groupBy("filename", "start_span", "end_span").agg(F.count(F.lit(1)).alias("n_tokens"))
    return distinct.join(counts, ["filename", "start_span", "end_span"], "left").na.fill(0, ["n_tokens"])
