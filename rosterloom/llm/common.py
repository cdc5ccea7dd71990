"""Helpers shared by the corpus operators: scratch tables, Arrow blocks, digests."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of text that one Arrow batch sent to a Python worker should hold.
ARROW_BATCH_BYTES = 2 << 20
#: Most bytes of text that a worker handles at once.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, limit: int = ARROW_BATCH_BYTES) -> None:
    """Prepare a session for Arrow functions.

    Batches are bounded by bytes, so that many long texts never share one, and
    Python workers look for this package where the driver found it (a cluster
    that ships it with ``--py-files`` has it already).
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))


# ---------------------------------------------------------------- scratch tables

_local_scratch: dict[str, tempfile.TemporaryDirectory] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.TemporaryDirectory(prefix="rosterloom-")
    return _local_scratch[app].name


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A written table survives the loss of any executor.  ``drop`` removes tables
    that no returned DataFrame reads; what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """The table as written; the shuffle files of the job that wrote it go at once."""
        cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(cleanup, None)
        self.spark.conf.set(cleanup, "true")
        try:
            df.write.parquet(path := self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(cleanup)
            else:
                self.spark.conf.set(cleanup, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if path := getattr(df, "_scratch_path", None):
                self._delete(path)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may be gone already when the driver ends
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: A key counts as heavy with more than this share of a table's rows, so that at most so many are heavy.
HEAVY_KEYS = 10_000
#: Keys of fewer rows are never heavy.
HEAVY_ROWS = 100


def join_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with a table that has one row a key; keys with very many rows on the left don't shuffle.

    Heavy keys are at most ``HEAVY_KEYS`` by what a heavy key is, so that their rows of
    ``right`` are broadcast; all other keys are joined by a shuffle.  ``left`` is read
    three times, so it should be a written table.  Keys are not null.
    """
    total = left.count()
    heavy = left.groupBy(key).count().filter(F.col("count") > max(HEAVY_ROWS, total / HEAVY_KEYS)).select(key)
    known = F.broadcast(heavy.join(right, key, "left"))
    return left.join(known, key).unionByName(left.join(F.broadcast(heavy), key, "left_anti").join(right, key, "left"))


# ---------------------------------------------------------------- Arrow blocks


def text_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each text; null counts as empty."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of about ``limit`` bytes of text.

    Cuts are placed by accumulated bytes, so a slice with long texts has few
    rows; a single text longer than the limit is a slice of its own.
    """
    pa.set_memory_pool(pa.system_memory_pool())  # so that what is freed can go back
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_bytes(batch.column(batch.schema.get_field_index(column))))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])
    give_back()


@cache
def _trim():
    """The C library's call that returns freed memory to the system, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda _: 0


def give_back() -> None:
    """Returns freed memory at the end of a task, as a worker lives on for other tasks."""
    _trim()(0)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


# ---------------------------------------------------------------- expressions


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Whether a row's label is kept for evaluation: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class SegmentCache:
    """Results for recently seen text segments, in two generations.

    Everything used since the last turn-over stays; memory is bounded by twice
    ``capacity`` entries.  ``compute`` maps a list of segments to their results.
    """

    def __init__(self, compute, capacity: int = 150_000) -> None:
        self.compute, self.capacity = compute, capacity
        self.young: dict = {}
        self.old: dict = {}

    def lookup(self, keys: set) -> dict:
        """Results of all keys, as a dictionary that holds at least these."""
        young, old = self.young, self.old
        unseen = keys.difference(young)
        if unseen and old:
            again = {key for key in unseen if key in old}
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            unseen -= again
        if unseen:
            missing = list(unseen)
            young.update(zip(missing, self.compute(missing), strict=True))
        if len(young) > self.capacity:
            self.young, self.old = {}, young
        return young
