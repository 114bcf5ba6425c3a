"""What the operators share: the shared work folder, Arrow batches of bounded bytes, id filters and byte hashing."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles at once; a single longer text is handled alone.
SLICE_BYTES = 1 << 18
#: Rows and bytes of an Arrow batch at most: a Python worker never holds more texts at once, but for a single longer one.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Words of 64 bits in an id filter: a bit for each FILTER_SHARE-th of an id, between the least (512 KB) and the most (16 MB).
FILTER_WORDS, MOST_FILTER_WORDS, FILTER_SHARE = 1 << 16, 1 << 21, 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a session of one process that has none gets a temporary one; on a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="marginalia-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Workspace:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor.

    `put` writes a frame as Parquet and rereads it; `drop` deletes tables that nothing reads any more. What is left goes when
    the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/marginalia-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.paths: dict[int, str] = {}
        target = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(target)
        fs.deleteOnExit(target)

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self.paths[id(out)] = path
        out._marginalia_workspace = self
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if path := self.paths.pop(id(df), None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


@dataclass
class IdFilter:
    """A bitmap over hashed ids: rows (_word, _bits), of `words` words of 64 bits at most."""

    table: DataFrame
    words: int

    def slot(self, column: Column) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.words * 64))


def id_filter(ids: DataFrame) -> IdFilter:
    """The bitmap of the ids in the only column of `ids`, sized by their number, up to MOST_FILTER_WORDS."""
    words = FILTER_WORDS
    wanted = min(ids.count() * FILTER_SHARE // 64, MOST_FILTER_WORDS)
    while words < wanted:
        words *= 2
    found = IdFilter(ids, words)
    key = found.slot(F.col(ids.columns[0]))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (key % 64).cast("int"))
    found.table = ids.select((key / 64).cast("int").alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return found


def maybe_in(df: DataFrame, key: str, bitmap: IdFilter, negate: bool = False) -> DataFrame:
    """Rows whose key may be among the filtered ids (or surely isn't), without a shuffle of `df`.

    The bitmap has at most MOST_FILTER_WORDS rows of 12 bytes, whatever the input: its broadcast is bounded.
    """
    slot = bitmap.slot(df[key])
    hit = ((slot / 64).cast("int") == F.col("_word")) & (F.call_function("shiftright", F.col("_bits"), (slot % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return df.join(F.broadcast(bitmap.table), hit, "left_anti" if negate else "left_semi")


def keep_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of `df` whose key is in `ids` (one column, no repeats needed); only likely rows are shuffled."""
    other = ids.toDF("_id")
    near = maybe_in(df, key, id_filter(other))
    return near.join(other, near[key].eqNullSafe(other["_id"]), "left_semi")


def drop_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows of `df` whose key isn't in `ids`; only rows that the bitmap can't clear are shuffled."""
    other = ids.toDF("_id")
    bitmap = id_filter(other)
    near = maybe_in(df, key, bitmap)
    return maybe_in(df, key, bitmap, negate=True).unionByName(near.join(other, near[key].eqNullSafe(other["_id"]), "left_anti"))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array, null as empty, without a copy where there are no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each (one row at least)."""
    at, rows = 0, len(bounds) - 1
    while at < rows:
        end = int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1
        end = min(max(end, at + 1), rows)
        yield at, end
        at = end


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes where they are higher."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Returns a worker's free memory to the system: workers are used again, and would keep their peaks between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over single batches."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            yield from make(batch)
            del batch
        give_back()

    return df.mapInArrow(run, schema)


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words with good avalanche."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is (UTF-8 stays valid)."""
    return np.frombuffer(raw.tobytes().lower(), np.uint8)

#: White space that ends a word: [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True

#: Bytes from which a span is hashed on its own instead of by eights beside the others.
LONG_SPAN = 64


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words [^\\x20\\x09-\\x0D]+ of the texts raw[bounds[i]:bounds[i+1]]."""
    if not len(raw):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inner = ~IS_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inner & (cut[:-1] | np.concatenate([[True], ~inner[:-1]])))
    ends = np.flatnonzero(inner & (cut[1:] | np.concatenate([~inner[1:], [True]]))) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, *seeds: int) -> np.ndarray:
    """64-bit hashes of the byte spans: equal bytes give equal hashes wherever they stand.

    A span is taken eight bytes at a time, each eight mixed into the state in full, so that no sum over places is left
    that could cancel out; spans of over LONG_SPAN bytes go through a cryptographic hash. With several seeds the result
    has a row of independent hashes for each.
    """
    seeds = seeds or (0,)
    size = ends - starts
    eights = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        eights = eights[:-k] | (eights[k:] << np.uint64(8 * k))
    found = np.empty((len(seeds), len(size)), np.uint64)
    with np.errstate(over="ignore"):
        for state, seed in zip(found, seeds, strict=True):
            state[:] = mix64(size.astype(np.uint64) * GOLDEN + np.uint64(seed + 1))
        live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
        at, left = starts[live], size[live]
        while len(live):
            part = eights[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
            for state, seed in zip(found, seeds, strict=True):
                state[live] = mix64((state[live] ^ part) * GOLDEN + np.uint64(seed + 1))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        data = raw[starts[k] : ends[k]].tobytes()
        for state, seed in zip(found, seeds, strict=True):
            state[k] = int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return found if len(seeds) > 1 else found[0]
