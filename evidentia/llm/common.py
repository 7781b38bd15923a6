"""Helpers that the operators of this subpackage share: session settings, materialising, fixed-size bitmaps and word hashing.

Words are `[^\\x20\\x09-\\x0D]+` over the UTF-8 bytes of a whole text. They are hashed in bulk straight from Arrow's buffers, so no text is
turned into Python strings. A word's hash depends on its bytes alone, so it is the same in every task.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: texts can be long, and two Python workers share an executor's memory.
BATCH_ROWS = 1000
#: Bytes of text that are hashed at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19
#: log2 of the bits in a broadcast bitmap: 2 MB, whatever the size of the data.
BITMAP_LOG2 = 24

U = np.uint64


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches of this session, so that a batch of long texts fits a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow whose workers give memory back after each partition: idle ones stay beside those of the next stage."""

    def frugal(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return df.mapInArrow(frugal, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset a local one serves a local master; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = held.get() if held.isDefined() else "file:///tmp/evidentia-checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Tables that materialise() made and release() did not delete, in order.
_MADE: list[str] = []


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder: a lost executor costs no recomputation, and Parquet keeps it small.

    The table goes with release(), or else when the driver ends; results that were not written by then go with it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/evidentia-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).deleteOnExit(place)
    _MADE.append(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._made = path
    return made


def mark() -> int:
    """A point in time, for release()."""
    return len(_MADE)


def release(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Delete the tables that were made since a mark, but for those given. Nothing that is still to be computed may read them."""
    held = {df._made for df in kept}
    for path in _MADE[since:]:
        if path not in held:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(place, True)
    _MADE[since:] = [p for p in _MADE[since:] if p in held]


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2 ** BITMAP_LOG2 bits in which the bit of every value of a long column is set.

    It is or-ed together by the executors; at most 2 ** (BITMAP_LOG2 - 6) words reach the driver. Several values can share a bit.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << BITMAP_LOG2) - 1))
    words = df.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (BITMAP_LOG2 - 6), np.int64)
    out[words["w"].to_numpy()] = words["b"].to_numpy()
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of some int64 values have their bit set."""
    slot = values & ((1 << BITMAP_LOG2) - 1)
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


_BASE = 0x9D2C5680B5026F4D  # odd, so that it has an inverse modulo 2 ** 64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@functools.cache
def _byte_values(fold: bool) -> np.ndarray:
    values = mix((np.arange(256, dtype=U) + U(1)) * U(0xD6E8FEB86659FD93))
    return values[_FOLD] if fold else values


@functools.lru_cache(maxsize=1)
def _powers(log2: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << log2
    return tuple(np.cumprod(np.concatenate([[U(1)], np.full(n - 1, U(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of an Arrow column, null being empty, and where each begins (one entry more than strings)."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8)), at - at[0]


def word_slices(column: pa.Array, fold: bool):
    """Yield (first row, word hashes, place of each row's first word) for runs of rows of at most SLICE_BYTES, or of one row.

    The places have one entry more than the run has rows. fold: A-Z count as a-z.
    """
    data, at = string_buffers(column)
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        yield first, *_words(data[at[first] : at[last]], at[first : last + 1] - at[first], fold)
        first = last


def _words(data: np.ndarray, at: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(at), np.int64)
    space = _SPACE[data]
    breaks = np.zeros(n + 1, bool)
    breaks[at] = True
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | breaks[:-1]))
    ends = np.flatnonzero(~space & (after | breaks[1:]))
    up, down = _powers(max(20, int(n).bit_length()))
    sums = np.cumsum(_byte_values(fold)[data] * up[:n])
    value = sums[ends] - np.where(starts > 0, sums[starts - 1], U(0))
    hashes = mix(value * down[starts] + (ends - starts).astype(U))
    return hashes, np.searchsorted(starts, at)


class Generations:
    """A cache of bytes by bytes, bounded by its size in bytes: what was used least recently goes, a generation at a time."""

    #: Bytes of an entry beside its key and value.
    ENTRY = 200

    def __init__(self, limit: int):
        self.limit, self.size = limit // 2, 0
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def fetch(self, keys: list[bytes], make) -> list[bytes]:
        """The value of each key, in order; make(list of keys) gives those that are not known."""
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        young, old = self.young, self.old
        missing = [k for k in keys if k not in young]
        for k in missing:
            if (v := old.pop(k, None)) is not None:
                young[k] = v
        new = [k for k in missing if k not in young]
        if new:
            young.update(zip(new, make(new), strict=True))
        self.size += sum(map(len, missing)) + sum(len(young[k]) for k in missing) + self.ENTRY * len(missing)
        return list(map(young.__getitem__, keys))


def objects(column: pa.Array) -> list:
    """The strings of a column without nulls; several times as fast as to_pylist()."""
    return column.to_numpy(zero_copy_only=False).tolist()


def chunks_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of the texts of a binary column without nulls, and the place of each text's first chunk (one entry more than texts).

    A chunk is white space ([\\x20\\x09-\\x0D]) and the word after it; the last one of a text may be white space alone. They share the texts' bytes.
    """
    data, at = string_buffers(column)
    n = len(data)
    if not n:
        return pa.array([], pa.binary()), np.zeros(len(at), np.int64)
    space = _SPACE[data]
    first = np.empty(n, bool)
    first[0], first[1:] = True, space[1:] & ~space[:-1]
    first[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(first)
    offsets = np.append(starts, n).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return chunks, np.searchsorted(starts, at)


def expand(chunks: pa.Array, of_text: np.ndarray, cache: Generations, make) -> pa.Array:
    """The values of each text's chunks one after another, as a binary column: only distinct chunks become Python objects."""
    held = chunks.dictionary_encode()
    values = pa.array(cache.fetch(objects(held.dictionary), make), pa.binary())
    whole = values.take(held.indices)
    if not len(whole):
        return pa.array([b""] * (len(of_text) - 1), pa.binary())
    _, offsets, data = whole.buffers()
    ends = np.frombuffer(offsets, np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return pa.Array.from_buffers(pa.binary(), len(of_text) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[of_text])), data if data is not None else pa.py_buffer(b"")])
