"""What the training-data operators share: scratch tables, words, hashes and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.shared import checkpoint_dir

#: Rows of output that a Python task gathers before it hands them on.
FLUSH_ROWS = 20_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def delete_path(spark: SparkSession, path: str) -> None:
    fs, jpath = _filesystem(spark, path)
    fs.delete(jpath, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder to cut lineage. drop() removes those no longer read; what a returned frame still reads goes when the driver ends.

    A table is all there or not at all, and is written again from what it was made of if a task is lost on the way. While one is written,
    the session lets go of shuffles once they are read, of other threads' queries too: these would compute them again, with the same rows.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/corvane-{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.n = 0
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            delete_path(self.spark, self.root)
        except Exception:  # the session may be gone
            pass

    def path(self, label: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{label}"

    def keep(self, df: DataFrame, label: str = "t", compression: str = "zstd") -> DataFrame:
        path = self.path(label)
        conf = self.spark.conf
        before = conf.get(SHUFFLE_CLEANUP, None)
        conf.set(SHUFFLE_CLEANUP, "true")  # what the write shuffled is of no use once the table is there
        try:
            df.write.option("compression", compression).parquet(path)
        finally:
            conf.unset(SHUFFLE_CLEANUP) if before is None else conf.set(SHUFFLE_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._corvane_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_corvane_path", None)
            if path:
                delete_path(self.spark, path)


#: Rows and bytes of an Arrow batch, where the session has Spark's defaults: whole texts are long rows.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets them for the session, as frames run after they are returned; a session that has settings of its own keeps them."""
    for key, default, own in (("maxRecordsPerBatch", ("10000",), BATCH_ROWS), ("maxBytesPerBatch", ("67108864b", "64MB", "67108864"), BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) in default:
            spark.conf.set(key, str(own))


def trim() -> None:
    """Gives a Python worker's free memory back to the machine: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, with small batches, and memory given back at the end of each task."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that are read, under names of our own, so that no other column can clash; text as UTF-8 bytes."""
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def words_of(text: bytes | None) -> list[bytes]:
    """The runs of [^\\x20\\x09-\\x0D]: bytes.split() splits at just those six."""
    return text.split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.fromiter([h(w) for w in words], dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n consecutive values."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix(out * _STEP + h[i : len(h) - n + 1 + i])
    return out


class Rows:
    """Collects rows as columns and turns them into record batches."""

    def __init__(self, schema: pa.Schema, limit: int = FLUSH_ROWS):
        self.schema, self.limit = schema, limit
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *values) -> None:
        for c, v in zip(self.columns, values, strict=True):
            c.append(v)

    def __len__(self) -> int:
        return len(self.columns[0])

    @property
    def full(self) -> bool:
        return len(self) >= self.limit

    def take(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.columns = [[] for _ in self.schema]
        return out
