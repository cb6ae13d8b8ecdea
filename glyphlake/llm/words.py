"""Words, Arrow batches and hashes that the text operators share; all of it runs inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space, which is what bytes.split() gives.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch handled at once, so that a task holds a few MB of words whatever the batch size is.
SLICE = 256
#: Entries after which a cache of word hashes starts anew; workers are reused, so caches of all operators add up in one process.
CACHE = 150_000


def text_bytes(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns `keep` and the text as bytes, so that Python reads UTF-8 without decoding it."""
    return df.select(*keep, F.col(text).cast("binary").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    trim()


def trim() -> None:
    """Gives freed memory back to the machine: worker processes are reused, and idle ones count, too."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class WordHashes(dict):
    """64-bit hash of a word, remembered for the words seen lately."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


HASHES: dict[int, WordHashes] = {}


#: Caches of other operators that go when hashes of words are asked for.
OTHERS: list[dict] = []


def forget() -> None:
    """Empties the caches of words in this process, before an operator that needs much memory of its own."""
    HASHES.clear()
    trim()


def word_hashes(seed: int = 0) -> WordHashes:
    """One cache for each seed and worker process; it outlives a task, until an operator with another kind of cache runs in the process."""
    if any(OTHERS):
        for other in OTHERS:
            other.clear()
        trim()
    return HASHES.setdefault(seed, WordHashes(seed))


#: Odd multipliers, fixed values.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    a = a ^ (a >> np.uint64(32))
    a = a * np.uint64(0xD6E8FEB86659FD93)
    return a ^ (a >> np.uint64(32))


def window_hashes(words: np.ndarray, length: int, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
    """Hash of each run of `length` consecutive words, by doubling: the cost grows with log(length)."""
    if len(words) < length:
        return np.empty(0, np.uint64)
    m, out, start, power, done = np.uint64(multiplier), None, words, 1, 0
    while power <= length:
        n = len(words) - length + 1
        if length & power:
            part = start[done : done + n]
            out = part.copy() if out is None else mix(out * m) + part
            done += power
        if power * 2 <= length:
            start = mix(start[:-power] * m) + start[power:]
        power *= 2
    return mix(out)


def distinct_shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a lower-cased (A-Z) text; a shorter text is one shingle, one without words none."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes().of(words)
    return np.unique(window_hashes(h, min(size, len(h))))


def as_long(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


# A bitmap of fixed size that stands for a set of keys: safe to broadcast whatever the set's size, with false positives but no false negatives.


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("long")


def bitmap(keys: DataFrame, key: str, bits: int = 23) -> DataFrame:
    """At most 2**bits / 32768 rows of 4 KB: which slots the keys fall in."""
    slot = _slot(F.col(key), bits)
    return keys.groupBy(F.floor(slot / 32768).alias("_bucket")).agg(F.expr(f"bitmap_construct_agg(pmod(pmod(xxhash64(`{key}`), {1 << bits}), 32768))").alias("_bits"))


def in_bitmap(df: DataFrame, key: str, bitmap_df: DataFrame, bits: int = 23, keep: bool = True) -> DataFrame:
    """Rows whose key may be in the set (keep), or is surely not; the broadcast side has 2**bits / 8 bytes at most."""
    slot = _slot(F.col(key), bits)
    joined = df.withColumn("_bucket", F.floor(slot / 32768)).withColumn("_at", F.pmod(slot, F.lit(32768)).cast("int")).join(F.broadcast(bitmap_df), "_bucket", "left")
    hit = F.coalesce(F.expr("getbit(cast(conv(hex(substring(_bits, cast(floor(_at / 8) as int) + 1, 1)), 16, 10) as int), _at % 8)") == 1, F.lit(False))
    return joined.filter(hit if keep else ~hit).drop("_bucket", "_at", "_bits")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine only where Spark is local and none is named, as in tests."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Written to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Rows and bytes of an Arrow batch unless the session sets its own: whole texts travel in them, so the default of 10,000 rows takes much memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where they share the driver's files, and bounds Arrow batches.

    On a cluster the package is installed or sent with --py-files.
    """
    from pathlib import Path

    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    for key, value in BATCH.items():  # "1" stands for unset
        if spark.conf.get(key, "1") == "1":
            spark.conf.set(key, value)
