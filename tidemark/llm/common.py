"""Helpers the text operators share: shared storage, Arrow buffers, row keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_folder


def text_session(spark: SparkSession, rows: int = 500) -> None:
    """Send texts to Python in small batches: rows may be long, and a batch is held twice."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lost executors cost no recomputation of it."""
    path = scratch_folder(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit columns that name a row by its id and text, whatever the id's type; equal rows share them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.xxhash64(F.col(id_col), text).alias("row_a"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("row_b")]


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary Arrow array laid end to end, and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(buffer: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a buffer of documents into runs of whole documents of about ``size`` bytes: (from, to, bytes, offsets)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        stop = min(max(stop, at + 1), n)
        yield at, stop, buffer[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at]
        at = stop


def sliced(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """Split a batch so that each part holds about ``size`` bytes of text (one row at least)."""
    column = batch.column(batch.schema.names.index(text))
    lengths = _offsets(column)
    at, n = 0, batch.num_rows
    while at < n:
        stop = int(np.searchsorted(lengths, lengths[at] + size, "right")) - 1
        stop = min(max(stop, at + 1), n)
        yield batch.slice(at, stop - at)
        at = stop


def _offsets(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate(([0], np.cumsum(sizes)))


def membership(df: DataFrame, key: str, bits: int = 24) -> np.ndarray:
    """Bitmap of 2**bits cells, of fixed size whatever the table: which low bits of the long ``key`` occur in it."""
    cell = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    words = df.groupBy(F.shiftright(cell, 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast({key} & 63 as int))")).alias("word")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words.column("at").to_numpy()] = words.column("word").to_numpy().view(np.uint64)
    return bitmap


def only_members(bitmap: np.ndarray, column: int):
    """Row filter for ``mapInArrow``: lets through what may occur in the table of a ``membership`` bitmap, before a join on it."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.uint64(len(bitmap) * 64 - 1)
        for batch in batches:
            at = batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64) & cells
            hit = (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    return keep


def unsigned_hex(column: Column, digits: int = 16) -> Column:
    return F.lpad(F.lower(F.hex(column)), digits, "0")
