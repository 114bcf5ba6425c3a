"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

A text becomes the bytes of " " + text, with the meta space of the vocabulary as the byte 0x20. Its lattice has an edge
for every piece that matches, and one for each byte of a character that is no piece by itself (byte fallback), so any
bytes can be encoded. No piece holds a space after another character, so the lattice falls into segments that start at
a run of spaces; equal segments of a batch share one forward pass. The backward draws of a segment are seeded by the
row key, the place of the segment in its text and the byte reached: batches, partitions and reruns give equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, map_arrow, mix64, slices, span_hashes, text_buffers

#: Vocabulary file; a parameter of every entry point.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: The weight of the piece of rank r is (r + 10) ** -SMOOTHING; of a fallback byte, BYTE_WEIGHT.
SMOOTHING, BYTE_WEIGHT = 1.0, 1e-5
SPACE = 32
#: Bytes of text encoded at once: so few that the lattice of the distinct segments stays near the CPU.
PIECE_SLICE = 1 << 18
#: Positions between two rescalings of the forward weights: they stay inside the range of a double.
RESCALE = 24


@dataclass
class Pieces:
    """A vocabulary as a double-array trie over bytes: state s has the child base[s] + byte if check there is s."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    weight: np.ndarray
    byte_piece: np.ndarray
    spelling: np.ndarray
    spelling_at: np.ndarray
    longest: int


def load(path: str = VOCABULARY, smoothing: float = SMOOTHING) -> Pieces:
    """Reads a SentencePiece model on the driver; what executors need travels as a few arrays (about 2 MB)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    spellings, byte_piece, scores = [b""] * size, np.full(256, -1), np.full(size, -np.inf)
    for i in range(size):
        if model.is_byte(i):
            value = int(model.id_to_piece(i)[3:5], 16)
            byte_piece[value], spellings[i] = i, bytes([value])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            spellings[i], scores[i] = model.id_to_piece(i).replace("▁", " ").encode(), model.get_score(i)
    return build(spellings, byte_piece, scores, smoothing)


def build(spellings: list[bytes], byte_piece: np.ndarray, scores: np.ndarray, smoothing: float = SMOOTHING) -> Pieces:
    if (byte_piece < 0).any():
        raise ValueError("the vocabulary has no byte fallback")
    usable = [i for i, s in enumerate(spellings) if s and np.isfinite(scores[i]) and b" " not in s.lstrip(b" ")]
    ranks = np.empty(len(spellings))
    ranks[np.argsort(-scores, kind="stable")] = np.arange(len(spellings))
    weight = np.where(np.isfinite(scores), (ranks + 10.0) ** -smoothing, BYTE_WEIGHT)
    children: list[dict[int, int]] = [{}]
    owner = [-1]
    for i in usable:
        at = 0
        for b in spellings[i]:
            if b not in children[at]:
                children[at][b] = len(children)
                children.append({})
                owner.append(-1)
            at = children[at][b]
        if owner[at] < 0:
            owner[at] = i
    # states with several children are placed side by side from a moving front, the others fill the holes
    cells = len(children) * 4 + 4096
    used, base, check = np.zeros(cells, bool), np.zeros(cells, np.int32), np.full(cells, -1, np.int32)
    used[0] = True
    hole, front = 1, 1
    placed, offsets = {}, {}
    for s in sorted(range(len(children)), key=lambda s: -len(children[s])):
        keys = sorted(children[s])
        if len(keys) > 1:
            at = max(front, 1)
            while any(used[at + k] for k in keys):
                at += 1
            front = max(front, at - 64)
        elif keys:
            while used[hole] or hole < keys[0] + 1:
                hole += 1
            at = hole - keys[0]
        else:
            break
        for k in keys:
            used[at + k] = True
            placed[children[s][k]] = at + k
        offsets[s] = at
    placed[0] = 0
    piece = np.full(cells, -1, np.int32)
    for s, p in placed.items():
        piece[p] = owner[s]
        if s in offsets:
            base[p] = offsets[s]
            for k in children[s]:
                check[offsets[s] + k] = p
    top = int(np.flatnonzero(used).max()) + 257
    flat = b"".join(spellings)
    return Pieces(base[:top], check[:top], piece[:top], weight, byte_piece.astype(np.int64), np.frombuffer(flat, np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in spellings])]), max(map(len, spellings)))


def _lattice(v: Pieces, raw: np.ndarray, at: np.ndarray):
    """Edges (source node, target node, piece, weight) of the segments raw[at[i]:at[i+1]]; node at[i] + i + p is place p."""
    n, length = len(raw), np.diff(at)
    kind = np.int32 if n + len(length) < 1 << 30 else np.int64
    of = np.repeat(np.arange(len(length), dtype=kind), length)
    every = np.arange(n, dtype=kind)
    node, end = every + of, at[1:].astype(kind)[of]
    # characters: a start byte, and the continuation bytes that belong to it
    follows = ((raw & 0xC0) == 0x80) & (every > at[:-1][of])
    char_start = np.maximum.accumulate(np.where(follows, kind(0), every)) if n else every
    char_end = np.append(np.flatnonzero(~follows), n).astype(kind)[np.cumsum(~follows)] if n else every
    whole = np.zeros(n, bool)
    where, state = every, np.zeros(n, np.int32)
    sources, targets, pieces = [], [], []
    step = 0
    while len(where):
        child = v.base[state] + raw[where + step]
        ok = v.check[child] == state
        where, state = where[ok], child[ok]
        step += 1
        found = v.piece[state]
        hit = found >= 0
        start = where[hit]
        sources.append(node[start])
        targets.append(node[start] + step)
        pieces.append(found[hit])
        whole[start[start + step == char_end[start]]] = True
        more = where + step < end[where]
        where, state = where[more], state[more]
    alone = np.flatnonzero(~whole[char_start]).astype(kind)
    sources.append(node[alone])
    targets.append(node[alone] + 1)
    pieces.append(v.byte_piece[raw[alone]].astype(np.int32))
    source, target, piece = np.concatenate(sources), np.concatenate(targets), np.concatenate(pieces)
    return source, target, piece, v.weight[piece]


def _forward(v: Pieces, raw: np.ndarray, at: np.ndarray):
    """Forward filtering: for each node, in the order of `rank`, its edges' probabilities of being the last one."""
    length = np.diff(at)
    nodes = len(raw) + len(length)
    first = at[:-1] + np.arange(len(length))
    seg = np.repeat(np.arange(len(length)), length + 1)
    place = np.arange(nodes) - first[seg]
    source, target, piece, weight = _lattice(v, raw, at)
    # longest edges of a target first; no two have one length, so their order doesn't depend on the batch
    order = np.argsort((place[target] * np.int64(len(length) + 1) + seg[target]) * np.int64(v.longest + 1) + v.longest - (target - source))
    source, target, piece, weight = source[order], target[order], piece[order], weight[order]
    del order
    new = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
    rank = np.full(nodes, -1)
    rank[target[new]] = np.arange(len(new))
    group_end = np.append(new[1:], len(target))
    alpha, share = np.zeros(nodes), np.zeros(len(target))
    alpha[first] = 1.0
    deep = place[target[new]]
    for p, (lo, hi) in enumerate(zip(*(np.searchsorted(deep, np.arange(1, int(length.max(initial=0)) + 1), side) for side in ("left", "right")), strict=True), 1):
        if lo == hi:
            continue
        a, b = new[lo], group_end[hi - 1]
        c = alpha[source[a:b]] * weight[a:b]
        total = np.add.reduceat(c, new[lo:hi] - a)
        alpha[target[new[lo:hi]]] = total
        share[a:b] = c / np.repeat(total, group_end[lo:hi] - new[lo:hi])
        if p % RESCALE == 0:
            back = target[new[lo:hi]][:, None] - np.arange(min(v.longest, p) + 1)[None, :]
            alpha[back] = alpha[back] / total[:, None]
    return rank, new, group_end, share, source, piece


def encode(v: Pieces, raw: np.ndarray, bounds: np.ndarray, keys: np.ndarray, seed: int, share: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, row bounds) of a sampled segmentation of each text; `keys` are the rows' 64-bit keys."""
    rows = len(bounds) - 1
    data = np.insert(raw, bounds[:-1], SPACE)
    edge = bounds + np.arange(rows + 1)
    space = data == SPACE
    cut = space & np.concatenate([[True], ~space[:-1]])[: len(data)]
    cut[edge[:-1]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(data))
    row = np.searchsorted(edge, starts, "right") - 1
    if share:
        hashes = span_hashes(data, starts, ends)
        order = np.argsort(hashes)
        fresh = np.ones(len(order), bool)
        fresh[1:] = hashes[order[1:]] != hashes[order[:-1]]
        example, kind = order[fresh], np.cumsum(fresh) - 1
    else:
        order = np.arange(len(starts))
        example, kind = order, order
    size = (ends - starts)[example]
    at = np.concatenate([[0], size.cumsum()])
    if len(example):
        distinct = data[np.repeat(starts[example] - at[:-1], size) + np.arange(at[-1])]
    else:
        distinct = data[:0]
    rank, begin, end, odds, source, piece = _forward(v, distinct, at)
    # backward sampling, segments in the order of their kinds so that neighbours read neighbouring edges
    with np.errstate(over="ignore"):
        salt = mix64(keys[row[order]] + np.uint64(seed) * GOLDEN) + (starts - edge[row])[order].astype(np.uint64) * GOLDEN
    root = (at[:-1] + np.arange(len(size)))[kind]
    here = root + size[kind]
    who, drawn_by, drawn, drawn_at = np.arange(len(order)), [], [], []
    count = np.zeros(len(order), np.int64)
    step = 0
    while len(who):
        with np.errstate(over="ignore"):
            u = (mix64(salt[who] ^ ((here - root[who]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) >> np.uint64(11)).astype(float) * 2.0**-53
        # the draw is spent on the node's own edges in turn: nothing beside them has a say
        g = rank[here]
        e, last_ = begin[g], end[g] - 1
        open_ = np.flatnonzero((odds[e] <= u) & (e < last_))
        while len(open_):
            u[open_] -= odds[e[open_]]
            e[open_] += 1
            open_ = open_[(odds[e[open_]] <= u[open_]) & (e[open_] < last_[open_])]
        drawn_by.append(who)
        drawn.append(piece[e])
        drawn_at.append(np.full(len(who), step))
        count[who] += 1
        here = source[e]
        go = here > root[who]
        who, here = who[go], here[go]
        step += 1
    per_segment = np.zeros(len(order), np.int64)
    per_segment[order] = count
    last = per_segment.cumsum() - 1
    out = np.zeros(int(per_segment.sum()), np.int32)
    for w, p, s in zip(drawn_by, drawn, drawn_at, strict=True):
        out[last[order[w]] - s] = p
    per_row = np.bincount(row, weights=per_segment, minlength=rows).astype(np.int64)
    return out, np.concatenate([[0], per_row.cumsum()])


def decode(v: Pieces, pieces: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the texts: the spellings in a row, without the space that encoding put first."""
    size = np.diff(v.spelling_at)[pieces]
    to = np.concatenate([[0], size.cumsum()])
    data = v.spelling[np.repeat(v.spelling_at[:-1][pieces] - to[:-1], size) + np.arange(to[-1])] if len(pieces) else np.zeros(0, np.uint8)
    edge = to[at]
    rows = np.flatnonzero(np.diff(edge) > 0)
    return np.delete(data, edge[rows]), np.concatenate([[0], (np.diff(edge) - (np.diff(edge) > 0)).cumsum()])


def _encoded(v: Pieces, raw: np.ndarray, bounds: np.ndarray, keys: np.ndarray, seed: int):
    """Pieces of a slice, proved lossless: if two segments' hashes ever collide, the slice is encoded without sharing."""
    for share in (True, False):
        pieces, at = encode(v, raw, bounds, keys, seed, share)
        data, edge = decode(v, pieces, at)
        if len(data) == len(raw) and (data == raw).all() and (edge == bounds).all():
            return pieces, at, np.diff(np.concatenate([[0], ((data & 0xC0) != 0x80).cumsum()])[edge])
    raise AssertionError("decoding doesn't give the text back")


def encode_documents(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, seed: int = 1) -> DataFrame:
    """One row per row of `documents`: doc_id, n_pieces, decoded_chars, pieces (ids of a sampled segmentation).

    decoded_chars counts the code points of the text that decoding the pieces gives back.
    A null text has null pieces and n_pieces 0; an empty text has the pieces of the leading space. Rows that repeat id
    and text have equal pieces. Every slice is decoded again and compared before it is returned. Other columns are
    ignored; an empty table gives an empty result. A single text must fit in memory some hundred times over.
    """
    v = load(vocabulary)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col)).alias("key"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make(batch):
        keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        missing = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        raw, bounds = text_buffers(batch.column(2))
        for i, j in slices(bounds, PIECE_SLICE):
            pieces, at, chars = _encoded(v, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], keys[i:j], seed)
            gone = missing[i:j]
            if gone.any():  # of a null text, the pieces of the leading space go too
                n = np.diff(at)
                pieces, at = pieces[~np.repeat(gone, n)], np.concatenate([[0], np.where(gone, 0, n).cumsum()])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(pieces), mask=pa.array(gone))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(chars.astype(np.int64)), lists], ["doc_id", "n_pieces", "decoded_chars", "pieces"])

    return map_arrow(docs, make, f"doc_id {id_type}, n_pieces long, decoded_chars long, pieces array<int>")


def decode_documents(spark: SparkSession, encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of rows (doc_id, pieces); null pieces give a null text, no pieces an empty one."""
    v = load(vocabulary)
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def make(batch):
        lists = batch.column(1)
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        data, edge = decode(v, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], n.cumsum()]))
        gone = lists.is_null().to_numpy(zero_copy_only=False)
        raw = data.tobytes()
        texts = [None if g else raw[a:b].decode("utf-8", "replace") for g, a, b in zip(gone, edge[:-1], edge[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "pieces"), make, f"doc_id {id_type}, text string")
