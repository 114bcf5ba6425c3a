"""Near-duplicate documents: fast similarity sketching, banding, and exact verification on the full shingle sets.

Sketch (after Dahlgaard, Knudsen and Thorup): `BINS` coordinates; in round i < BINS every shingle is thrown into a
hashed bin, in round BINS + j all go to bin j, and a bin keeps its least (round, hash). Every bin fills, and a set of
any size gets a whole sketch with concentrated agreement.

Candidates never become all pairs of a bucket. Equal sets are one node. Then, round by round, a bucket whose nodes
aren't all in one component yet offers one pivot, and each outside node is verified against the likeliest pivot of
its buckets. At last each outsider that is left is compared with every node of its bucket in another component, so
no pair that shares a bucket and isn't connected otherwise goes untested: in small buckets as rows, in large ones in
blocks of sets that emit only the links found. Before a text is read for a pair of rows, it must agree in
length (exact bound) and in 128 one-bit coordinates (`MOST_BITS`, over five standard deviations below 0.75).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, Workspace, drop_ids, keep_ids, lower_ascii, map_arrow, mix64, slices, span_hashes, text_buffers, words
from .components import connected_components

SHINGLE = 5
#: Coordinates of a sketch and of a band: a pair of similarity 0.75 shares one of 32 bands but for odds of 5e-6.
BINS, BAND = 128, 4
#: Similarity in hundredths.
LEAST = 75
#: One-bit coordinates that may differ: 16 are expected at 0.75, with a standard deviation of 3.7.
MOST_BITS = 36
#: Rounds of pivots at most, and the comparisons for each bucket member from which a further round is worth it.
PIVOT_ROUNDS, WORK = 3, 64
#: Nodes of a bucket up to which its open pairs are rows, and shingles and nodes of a block in larger ones.
SMALL, BLOCK, BLOCK_NODES = 64, 1 << 19, 512
#: Partners of a text that are compared with it in one task, about; a pivot with more is copied to several.
PARTNERS = 128

#: A word of a text's bytes.
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_PLACE = mix64(np.arange(11, 11 + SHINGLE, dtype=np.uint64) * GOLDEN) | np.uint64(1)


def shingles(raw: np.ndarray, bounds: np.ndarray, again: bool = False) -> tuple[np.ndarray, ...]:
    """(hashes, row bounds) of the distinct shingles of each text, sorted within a row.

    A text of one to four words has its whole sequence as its only shingle, a text without words none. With `again`,
    a third array has independent second hashes of the same shingles.
    """
    rows = len(bounds) - 1
    raw = lower_ascii(raw)
    starts, ends, row = words(raw, bounds)
    if again:
        first_hashes, second_hashes = span_hashes(raw, starts, ends, 1, 2)
        found, of = _of_words(first_hashes, row, rows)
        second, _ = _of_words(second_hashes, row, rows)
    else:
        found, of = _of_words(span_hashes(raw, starts, ends, 1), row, rows)
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[fresh], of[fresh]
    at = np.concatenate([[0], np.bincount(of, minlength=rows).cumsum()])
    return (found, at, second[order][fresh]) if again else (found, at)


def _of_words(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of five words, and of the whole of a shorter text."""
    per_row = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], per_row.cumsum()])
    with np.errstate(over="ignore"):
        whole = np.flatnonzero(np.arange(len(row)) + SHINGLE <= first[row + 1])
        found, of = mix64(sum((hashes[whole + k] * _PLACE[k] for k in range(SHINGLE)), np.zeros(len(whole), np.uint64))), row[whole]
        short = np.flatnonzero((per_row > 0) & (per_row < SHINGLE))
        total = per_row[short].astype(np.uint64) * GOLDEN
        for k in range(SHINGLE - 1):
            has = per_row[short] > k
            total[has] += hashes[first[short[has]] + k] * _PLACE[k]
        return np.concatenate([found, mix64(total ^ GOLDEN)]), np.concatenate([of, short])


def word_shingles(text: bytes) -> set[tuple[bytes, ...]]:
    """The shingles of a text as the words themselves."""
    found = WORD.findall(text.lower())
    if len(found) < SHINGLE:
        return {tuple(found)} if found else set()
    return set(zip(*(found[k:] for k in range(SHINGLE)), strict=False))


def alike(common: int, n: int, m: int) -> bool:
    return common > 0 and 100 * common >= LEAST * (n + m - common)


def sketches(hashes: np.ndarray, at: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(rows, bins) of uint64: the fast similarity sketch of each row's set; an empty set has only the largest word."""
    rows = len(at) - 1
    sketch = np.full(rows * bins, _NONE)
    size = np.diff(at)
    x, base = hashes, np.repeat(np.arange(rows), size) * bins
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    for i in range(2 * bins):
        with np.errstate(over="ignore"):
            v = mix64(x ^ (np.uint64(i + 1) * GOLDEN))
        where = base + ((v >> shift).astype(np.int64) if i < bins else i - bins)
        np.minimum.at(sketch, where, (np.uint64(i) << np.uint64(54)) | (v & np.uint64((1 << 54) - 1)))
        open_rows = (sketch.reshape(rows, bins) == _NONE).any(1)
        more = open_rows[base // bins]
        if not more.any():
            break
        x, base = x[more], base[more]
    return sketch.reshape(rows, bins)


def _signatures(df: DataFrame, id_type: str) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprints of the set), b1, b2 (one-bit coordinates), bands."""

    def make(batch):
        raw, bounds = text_buffers(batch.column(1))
        for i, j in slices(bounds):
            hashes, at, second = shingles(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], again=True)
            n = np.diff(at)
            with np.errstate(over="ignore"):
                prints = [_fingerprints(h, at) for h in (hashes, second)]
                sketch = mix64(sketches(hashes, at))
                bits = np.packbits((sketch & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                bands = sketch.reshape(len(n), BINS // BAND, BAND)
                keys = np.broadcast_to(mix64(np.arange(1, BINS // BAND + 1, dtype=np.uint64)), bands.shape[:2])
                for k in range(BAND):
                    keys = mix64(keys * GOLDEN + bands[:, :, k])
            flat = pa.array(np.ascontiguousarray(keys).view(np.int64).ravel())
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * (BINS // BAND))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *(pa.array(p) for p in prints), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), pa.ListArray.from_arrays(offsets, flat)],
                ["doc_id", "n", "f1", "f2", "b1", "b2", "bands"],
            )

    return map_arrow(df, make, f"doc_id {id_type}, n long, f1 long, f2 long, b1 long, b2 long, bands array<long>")


def _texts(ws: Workspace, docs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, f1, text) of the nodes in `rows` (row): each text moves once. An id that several rows share brings all their texts."""
    known = ws.put(nodes.select("row", "rep", "f1").join(rows, "row", "left_semi"), "known")
    texts = keep_ids(docs, "doc_id", known.select("rep").distinct())
    return texts.join(known, texts["doc_id"].eqNullSafe(known["rep"])).select("row", "f1", "text")


def _verified(ws: Workspace, docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts are similar enough: by hashes of all shingles, and where those agree by
    the words themselves. A text with many partners, as a pivot has, is copied to one task for every PARTNERS of them."""
    pairs = ws.put(pairs.select("a", "b"), "pairs")
    texts = ws.put(_texts(ws, docs, nodes, pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct()), "texts")
    fan = ws.put(pairs.groupBy(F.col("b").alias("row")).agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts")), "fan")
    dealt = pairs.join(fan.withColumnRenamed("row", "b"), "b").withColumn("part", F.pmod(F.xxhash64("a"), "parts")).select("a", "b", "part")
    x, y = (texts.select(F.col("row").alias(side), F.col("f1").alias(f"f_{side}"), F.col("text").alias(f"text_{side}")) for side in ("a", "b"))
    copies = y.join(fan.withColumnRenamed("row", "b"), "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = dealt.join(x, "a").join(copies.drop("parts"), ["b", "part"])

    def make(batch):
        a, b, f_a, f_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        sides = [text_buffers(batch.column(k)) for k in (4, 5)]
        for i, j in slices(sides[0][1] + sides[1][1]):
            sets = []
            for (raw, bounds), f in zip(sides, (f_a, f_b), strict=True):
                hashes, at = shingles(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
                sets.append((hashes, at, _fingerprints(hashes, at) == f[i:j]))
            (p, p_at, p_own), (q, q_at, q_own) = sets
            linked = np.zeros(j - i, bool)
            for k in np.flatnonzero(p_own & q_own):
                one, other = p[p_at[k] : p_at[k + 1]], q[q_at[k] : q_at[k + 1]]
                if alike(len(np.intersect1d(one, other, assume_unique=True)), len(one), len(other)):
                    one, other = (word_shingles(raw[bounds[i + k] : bounds[i + k + 1]].tobytes()) for raw, bounds in sides)
                    linked[k] = alike(len(one & other), len(one), len(other))
            yield pa.RecordBatch.from_arrays([pa.array(a[i:j][linked]), pa.array(b[i:j][linked])], ["a", "b"])

    links = ws.put(map_arrow(met.select("a", "b", "f_a", "f_b", "text_a", "text_b"), make, "a long, b long").distinct(), "links")
    ws.drop(texts)
    return links


def _fingerprints(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each row's set."""
    with np.errstate(over="ignore"):
        s = np.concatenate([np.zeros(1, np.uint64), mix64(hashes + np.uint64(1)).cumsum(dtype=np.uint64)])
        return (s[at[1:]] - s[at[:-1]]).view(np.int64)


def _sets(ws: Workspace, docs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, set) of the nodes in `rows`, from their whole texts."""
    texts = _texts(ws, docs, nodes, rows)

    def make(batch):
        raw, bounds = text_buffers(batch.column(2))
        f1 = batch.column(1).to_numpy(zero_copy_only=False)
        for i, j in slices(bounds):
            hashes, at = shingles(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
            own = pa.array(_fingerprints(hashes, at) == f1[i:j])
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).filter(own), lists.filter(own)], ["row", "set"])

    return ws.put(map_arrow(texts, make, "row long, set array<long>").dropDuplicates(["row"]), "sets")


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links of the outsiders on the left with the nodes on the right, one for each other component, from full sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    rows, comps, sets, sizes = [], [], [], []
    for side, mark in ((left, "x_"), (right, "")):
        lists = side[f"{mark}set"].combine_chunks()
        rows.append(side[f"{mark}row"].to_numpy())
        comps.append(side[f"{mark}comp"].to_numpy())
        sets.append(lists.flatten().to_numpy())
        sizes.append(lists.value_lengths().to_numpy().astype(np.int64))
    known, place = np.unique(sets[1], return_inverse=True)
    first = np.concatenate([[0], sizes[1].cumsum()[:-1]])
    a, b, at = [], [], 0
    for row, comp, n in zip(rows[0], comps[0], sizes[0], strict=True):
        own = sets[0][at : at + n]
        at += n
        found = np.minimum(np.searchsorted(known, own), len(known) - 1)
        mark = np.zeros(len(known), np.int64)
        mark[found[known[found] == own]] = 1
        common = np.add.reduceat(mark[place], first)
        linked = np.flatnonzero((common > 0) & (100 * common >= LEAST * (n + sizes[1] - common)) & (comps[1] != comp))
        # one link to a component connects it
        linked = linked[np.unique(comps[1][linked], return_index=True)[1]]
        a += [row] * len(linked)
        b += rows[1][linked].tolist()
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)


def _large_links(ws: Workspace, docs: DataFrame, nodes: DataFrame, large: DataFrame) -> DataFrame:
    """Links of the outsiders of large buckets (key, row, comp, mode, m, top, total). Hashed blocks of nodes meet hashed
    blocks of outsiders: a group of any size is spread over tasks, and only links come out."""
    large = large.withColumn("blocks", F.greatest(F.ceil(F.col("total") / BLOCK), F.ceil(F.col("m") / BLOCK_NODES))).withColumn("parts", F.ceil(F.col("blocks") * (F.col("m") - F.col("top")) / F.col("m")))
    large = ws.put(large, "large")
    sets = _sets(ws, docs, nodes, large.select("row").distinct())
    own = large.join(sets, "row").withColumns({"i": F.pmod(F.xxhash64("row", F.lit(1)), "parts"), "j": F.pmod(F.xxhash64("row", F.lit(2)), "blocks")})
    targets = own.select("key", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("i"), "j", "row", "comp", "set")
    outsiders = own.filter("comp != mode").select("key", "i", F.explode(F.expr("sequence(0L, blocks - 1L)")).alias("j"), "row", "comp", "set")
    outsiders = outsiders.toDF("x_key", "x_i", "x_j", "x_row", "x_comp", "x_set")
    found = outsiders.groupBy("x_key", "x_i", "x_j").cogroup(targets.groupBy("key", "i", "j")).applyInArrow(_block_links, "a long, b long")
    return ws.put(found.distinct(), "links")


def _near(n: str, m: str, x1: str, y1: str, x2: str, y2: str) -> str:
    """Pairs that length and one-bit coordinates don't rule out."""
    return f"100 * least({n}, {m}) >= {LEAST} * greatest({n}, {m}) AND bit_count({x1} ^ {y1}) + bit_count({x2} ^ {y2}) <= {MOST_BITS}"


def near_dedup(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Links are pairs of documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more; words
    are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. component_id is the smallest id reachable. A text that is null or
    has no words has an empty set and is linked with nothing. Equal sets are always linked, rows that repeat
    included; a row without an id joins its component but never names it. An empty table gives an empty result.
    Other columns are ignored. One text must fit in memory some sixty times over; nothing else grows with a group.
    """
    ws = Workspace(spark, "near")
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = ws.put(_signatures(docs, id_type).select(F.monotonically_increasing_id().alias("row"), "*"), "signed")
    reps = signed.filter("n > 0").groupBy("f1", "f2").agg(F.min("row").alias("row"), F.min("doc_id").alias("rep"))
    nodes = ws.put(signed.select("row", "n", "b1", "b2", "bands").join(reps, "row"), "nodes")
    buckets = nodes.select("row", "n", "b1", "b2", F.explode("bands").alias("key"))
    shared = ws.put(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "shared")
    members = ws.put(buckets.join(shared, "key"), "members")
    ws.drop(shared)
    total = members.count()
    comps = ws.put(members.select("row").distinct().select("row", F.col("row").alias("comp")), "comps")
    for round_no in range(PIVOT_ROUNDS + 1):
        placed = ws.put(members.join(comps, "row"), "placed")
        order = F.xxhash64("row", F.lit(round_no))
        parts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles"), *(F.min_by(x, order).alias(f"p_{x}") for x in ("row", "n", "b1", "b2")))
        rank = F.struct("c", "comp")
        split = parts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("m"), F.max("c").alias("top"), F.sum("shingles").alias("total"), *(F.max_by(x, rank).alias(x) for x in ("comp", "p_row", "p_n", "p_b1", "p_b2")))
        split = ws.put(split.filter("k > 1").withColumnRenamed("comp", "mode"), "split")
        work = split.agg(F.sum(F.expr("double(m - top) * m"))).first()[0] or 0
        if not work:
            break
        last = round_no == PIVOT_ROUNDS or (round_no > 0 and work <= WORK * total)
        outside = placed.join(split, "key")
        if not last:
            near = outside.filter("comp != mode").filter(_near("n", "p_n", "b1", "p_b1", "b2", "p_b2"))
            pairs = near.groupBy(F.col("row").alias("a")).agg(F.min_by("p_row", F.expr("bit_count(b1 ^ p_b1) + bit_count(b2 ^ p_b2)")).alias("b"))
        else:
            open_rows = ws.put(outside.filter(F.col("m") <= SMALL).select("key", "row", "comp", "n", "b1", "b2", "mode"), "open")
            x = open_rows.filter("comp != mode").select("key", *(F.col(c).alias(f"x_{c}") for c in ("row", "comp", "n", "b1", "b2")))
            near = (F.col("x_comp") != F.col("comp")) & ((F.col("comp") == F.col("mode")) | (F.col("x_row") < F.col("row"))) & F.expr(_near("x_n", "n", "x_b1", "b1", "x_b2", "b2"))
            pairs = x.join(open_rows, (x["key"] == open_rows["key"]) & near).select(F.col("x_row").alias("a"), F.col("row").alias("b")).distinct()
            pairs = pairs.unionByName(_large_links(ws, docs, nodes, outside.filter(F.col("m") > SMALL).select("key", "row", "comp", "mode", "m", "top", "total"))).distinct()
        links = _verified(ws, docs, nodes, pairs)
        known = comps.select("row", "comp")
        edges = links.join(known.toDF("a", "ca"), "a").join(known.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = connected_components(ws, edges)
        moved = ws.put(comps.join(joined.toDF("comp", "to"), "comp", "left").select("row", F.coalesce("to", "comp").alias("comp")), "comps")
        ws.drop(placed, split, links, comps)
        comps = moved
        if last:
            break
    placed = nodes.select("row", "rep", "f1", "f2").join(comps, "row", "left").withColumn("comp", F.coalesce("comp", "row"))
    # written, so that the join has plain exchanges on both sides and a large component can be split
    named = ws.put(placed.groupBy("comp").agg(F.min("rep").alias("component_id")), "named")
    classes = ws.put(placed.join(named, "comp").select("f1", "f2", "component_id"), "classes")
    out = signed.select("doc_id", "n", "f1", "f2").join(classes, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(spark: SparkSession, documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `documents`, all columns, of which one document stays for each component.

    An id goes when none of its rows is kept; ids are expected to name one document each.
    """
    ws = Workspace(spark, "near-keep")
    found = near_dedup(spark, documents, id_col, text_col)
    gone = ws.put(found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("NOT kept").select("doc_id"), "gone")
    return drop_ids(documents, id_col, gone)
