"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an operator holds at once in a Python task; one longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(key: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % divisor


#: Rows that Spark hands to a Python task at once; texts may be long, so far fewer than its default of 10,000.
ROWS_AT_ONCE = 1000


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)


def texts(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id`` and ``text`` with NULL as an empty text; other columns stay away, whatever their names."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also where the body is used for every element of an array."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text whose digests make one range.
RANGE_BYTES = 16 << 20


def range_parts(texts: DataFrame) -> int:
    """Number of digest ranges: as many as shuffle partitions, and more where a range would get more than its share."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(shuffle_parts(texts.sparkSession), -(-size // RANGE_BYTES))


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in blocks of about ``most`` bytes of text, so that memory follows the block and not the batch."""
    held, size = [], 0
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        first = 0
        for i, length in enumerate(lengths):
            if size and size + length > most:
                held.append(batch.slice(first, i - first))
                yield pa.concat_batches(held)
                held, size, first = [], 0, i
            size += length
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held and sum(b.num_rows for b in held):
        yield pa.concat_batches(held)
    held = []
    give_back()


def give_back() -> None:
    """Return freed memory to the system: an idle Python worker stays beside later stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def row_key_of(text: Column) -> Column:
    """Digest of id and text; rows that share it are copies of one another and get the same result."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), text)


def row_key() -> Column:
    return row_key_of(F.coalesce(F.col("text"), F.lit("")))


def pack(values: np.ndarray) -> bytes:
    """Sorted digests as differences, or counts; equal bytes side by side, so that zeros vanish."""
    wide = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.compress(np.ascontiguousarray(wide.T).tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def ends(parts: int) -> np.ndarray:
    """First digest of each range."""
    return np.array([(k << 64) // parts for k in range(parts)], np.uint64)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows that come sorted by ``keys``, one list for each value."""
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != last:
                yield held
                held = []
            held.append(row)
            last = key
    if held:
        yield held


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows that come sorted by ``key`` in batches of ``least`` rows or more that no run of a key crosses."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        keys = batch.column(key)
        if size < least or (keys[0].equals(keys[batch.num_rows - 1]) and len(held) > 1):
            continue
        whole = pa.concat_batches(held)
        values = whole.column(key).to_numpy()
        cut = int(np.searchsorted(values, values[-1], "left"))
        if cut:
            yield whole.slice(0, cut)
        held, size = [whole.slice(cut)], whole.num_rows - cut
    if held:
        yield pa.concat_batches(held)


#: Most bytes of strings that are sent to every executor; larger tables are joined by a shuffle.
BROADCAST_BYTES = 4 << 20


def broadcast_if_small(table: DataFrame, width: Column, rows: int = 100_000) -> DataFrame:
    """Hint a broadcast if the (stored) table was found to be within both bounds.

    ``width`` is the number of bytes of a row's strings.
    """
    n, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(table) if n <= rows and size <= BROADCAST_BYTES else table
