"""Plumbing for mapInArrow functions: bounded slices of batches, and files by URI."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession

SLICE_BYTES = 4 << 20
#: Both a JVM and a Python worker hold some batches at a time, for each core.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold BATCH_BYTES at most, or a single row."""
    spark.conf.set(_BATCH, str(BATCH_BYTES))


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Returns freed memory to the system: an executor's workers share its limit with the JVM."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def bounded(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``size`` bytes of text or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        column = batch.column(text).cast(pa.large_string()).fill_null("")
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        i = 0
        while i < batch.num_rows:
            j = min(batch.num_rows, max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j
        give_back()


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def attempt_name(prefix: str, suffix: str) -> str:
    """A file name of this attempt alone: a rerun task never writes into another's file."""
    return f"{prefix}-{partition_id():06d}-{uuid.uuid4().hex[:12]}{suffix}"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def create(uri: str):
    """An output stream for ``uri``, its folder made first."""
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def open_input(uri: str):
    store, path = open_store(uri)
    return store.open_input_file(path)
