"""Shared folders, stored intermediate tables and bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlens.session import shared_dir, ship_package

#: Text bytes handled at once in a Python task; one longer text is a slice of its own.
SLICE_BYTES = 1_000_000
#: Bytes of an Arrow batch that Spark hands to a Python task, unless the session has fewer.
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh folder that the driver and all executors reach."""
    return shared_dir(spark, purpose)


def store(df: DataFrame, folder: str) -> DataFrame:
    """Write a table and go on from the files, so that a lost executor costs no recomputation."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Make a session fit for Python tasks: they find this package, and their Arrow batches are
    small, as 10 000 long texts at once would fill a worker's memory."""
    ship_package(spark)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(setting).rstrip("bB")
    if not size.isdigit() or int(size) > BATCH_BYTES or int(size) <= 0:
        spark.conf.set(setting, str(BATCH_BYTES))
    return spark


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and its stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_key(text: str = "text") -> Column:
    """Content key of a row's text; with ``doc_id`` it names a document."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into ``(first row, row after, bytes, offsets)`` of about ``limit`` bytes.

    A null text is empty. Offsets are relative to the bytes of the slice.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        after = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        after = min(max(after, row + 1), len(texts))
        yield row, after, data[offsets[row] : offsets[after]], offsets[row : after + 1] - offsets[row]
        row = after
