"""Shared pieces of the corpus operators: stage tables, words, batches."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pelorus.session import shared_folder

#: Bytes of text that a Python worker handles at once, and of an Arrow batch.
BLOCK_BYTES, BATCH_BYTES = 3_000_000, 4 << 20


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: later jobs read files which outlive any executor.
    Parquet rather than ``checkpoint()`` because it is compressed and later
    reads can prune columns. The files stay until the folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pelorus-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over batches of ``BATCH_BYTES`` at most (one row at least); gives freed memory back when a task ends.

    The bound on batches is a setting of the session, put there unless it has
    its own, and left there, as the frame may be run at any later time.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system; workers live on after a task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def drop(*stages: DataFrame) -> None:
    """Delete the files of stages that nothing will read any more, and let the cleaner run."""
    for df in stages:
        spark, folder = df.sparkSession, df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stage_path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if stages:
        release(stages[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of jobs that are over."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_bucket(key: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; null for a null id."""
    col = F.col(key) if isinstance(key, str) else key
    return F.crc32(col.cast("string").cast("binary")) % modulus


def blocks(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows 0..n into runs whose sizes sum to ``limit`` at most (one row at least)."""
    start, n = 0, len(sizes)
    ends = np.cumsum(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def portions(batches: Iterator[pa.RecordBatch], column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text in ``column``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        for start, stop in blocks(sizes, limit):
            yield batch.slice(start, stop - start)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(s, s + n)`` for each start and length."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    offsets = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.arange(total, dtype=np.int64) - offsets + np.repeat(starts, lengths)


def array_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Arrow list column out of flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def arrow_batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema], schema=schema
    )


class WordHashes(dict):
    """Word -> 64-bit hash, remembered."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class KeyFilter:
    """Bloom filter of 64-bit keys: says "perhaps" or "surely not".

    32 bits a key and four slots each pass two other keys in ten thousand. The
    size follows the number of keys up to ``MOST_BITS`` (32 MB), so that it may
    be sent to every worker. A fuller table passes more, which costs work
    further on but loses nothing.
    """

    MOST_BITS, SLOTS, SHIFT = 1 << 28, 4, 12

    def __init__(self, bits: np.ndarray, size: int):
        self.bits, self.size = bits, size

    @classmethod
    def build(cls, keys: DataFrame) -> KeyFilter:
        """``keys``: a stored table with one long column, ``key``, of well-mixed numbers."""
        n = keys.count()
        size = 1 << 20
        while size < 32 * n and size < cls.MOST_BITS:
            size *= 2
        each = ", ".join(f"shiftrightunsigned(key, {i * cls.SHIFT}) & {size - 1}L" for i in range(cls.SLOTS))
        slots = keys.select(F.explode(F.expr(f"array({each})")).alias("slot"))
        words = slots.groupBy(F.expr("cast(slot >> 6 AS int)").alias("w")).agg(F.expr("bit_or(1L << cast(slot & 63 AS int))").alias("b"))
        bits = np.zeros(size // 64, dtype=np.uint64)
        for part in words.toArrow().to_batches() if n else []:
            bits[part.column(0).to_numpy()] = part.column(1).to_numpy().view(np.uint64)
        return cls(bits, size)

    def has(self, keys: np.ndarray) -> np.ndarray:
        keys, out = keys.view(np.uint64), np.ones(len(keys), dtype=bool)
        for i in range(self.SLOTS):
            slot = (keys >> np.uint64(i * self.SHIFT)) & np.uint64(self.size - 1)
            out &= (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        return out
