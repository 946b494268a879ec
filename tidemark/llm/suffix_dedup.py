"""Exact removal of long repeated byte strings by counts of sampled suffixes in levels of growing size.

A suffix array lists the suffixes of a text in an order that puts suffixes with the same beginning
next to each other.  Listing every byte position of 100 TB is out of reach, so the arrays here are
sampled: a position is listed where some ``span``-byte window picks it as its anchor
(``rolling.Windows``).  Equal windows pick the same place, so no repeat of ``span`` bytes is missed.
Entries are ordered by the fingerprint of their first ``GRAM`` bytes instead of byte by byte: suffixes
that begin alike are neighbours all the same.  Entries of one beginning are kept once with their count.

``SuffixFamily`` holds levels of geometrically growing size.  A new batch gets an array of its own, and
adding its counts to the level of equal rank finds shared beginnings and gives the level of the next rank.

The beginnings found in that way are then judged at three grains, each only where the one before left
doubt: all windows of an anchor together, blocks of ``BLOCK`` windows, single windows.  At each grain
a unit has a *core* (bytes in all of its windows) and a *whole* (bytes in any of them).  A core that
occurs once clears the unit; a whole that occurs twice condemns all its windows; what is left goes to
the next grain, together with one weighted representative of each condemned whole that shares its
core with other wholes.  Counting is by partial aggregation, so a passage that a third of all rows
share is never gathered anywhere, and no pairs are built.

Strings are compared by 64-bit hashes; two different windows are taken for equal with probability
2**-64 per pair of equal-hash candidates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_buffer, membership, only_members, pieces, row_key, sliced, stored, text_session
from tidemark.llm.rolling import Hashes, Windows, mix

GRAM = 64
BLOCK = 32
_PIECE = 400_000
_LONG = 4_000_000

_ANCHORS = "row_a long, row_b long, batch int, core long, whole long, first long, last long, anchor long"


def _segments(buffer: np.ndarray, offsets: np.ndarray, span: int):
    """Runs of documents, and overlapping parts of a document that is too long for one run: (docs, bytes, offsets, shift)."""
    for start, stop, part, at in pieces(buffer, offsets, _PIECE):
        if stop - start > 1 or len(part) <= _LONG:
            yield np.arange(start, stop), part, at, 0
            continue
        for cut in range(0, len(part) - span + 1, _LONG):
            piece = part[cut:cut + _LONG + span - 1]
            yield np.array([start]), piece, np.array([0, len(piece)]), cut


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def sampled_suffixes(docs: DataFrame, span: int, batches: int) -> DataFrame:
    """One row per anchor of ``docs`` (row_a, row_b, text): its batch, fingerprints and run of windows."""

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            buffer, offsets = byte_buffer(batch.column(2))
            for docs_of, part, at, shift in _segments(buffer, offsets, span):
                w = Windows(part, at, span, GRAM)
                if not len(w.first):
                    continue
                doc = docs_of[w.doc]
                base = at[w.doc] - shift
                whole = w.hashes.of(w.first, w.last + span) ^ mix((w.anchor - w.first + 1).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(a[doc]), pa.array(b[doc]), pa.array((b[doc] % batches).astype(np.int32)),
                    _signed(w.gram_hash), _signed(whole), _signed(w.first - base), _signed(w.last - base), _signed(w.anchor - base),
                ], names=["row_a", "row_b", "batch", "core", "whole", "first", "last", "anchor"])

    return docs.mapInArrow(scan, _ANCHORS)


@dataclass
class SuffixFamily:
    """Levels of sampled suffix arrays, at most one of each rank; a level of rank r holds 2**r batches.

    An entry is the fingerprint of a beginning (``core``) and the number of suffixes that have it.
    """

    levels: dict[int, DataFrame] = field(default_factory=dict)

    @staticmethod
    def array(anchors: DataFrame) -> DataFrame:
        """The sorted array of one batch."""
        return anchors.groupBy("core").agg(F.count("*").alias("n")).sortWithinPartitions("core")

    @staticmethod
    def merge(one: DataFrame, other: DataFrame) -> DataFrame:
        """Counts of two arrays together: beginnings of both get a count of two or more."""
        return one.unionByName(other).groupBy("core").agg(F.sum("n").alias("n")).sortWithinPartitions("core")

    def matches(self, anchors: DataFrame) -> DataFrame:
        """Beginnings of a batch that some level lists already: where a match with earlier batches can start."""
        array = self.array(anchors)
        found = [array.join(level.select("core"), "core", "left_semi") for level in self.levels.values()]
        return reduce(DataFrame.unionByName, found, array.limit(0)).select("core").distinct()

    def add(self, anchors: DataFrame) -> None:
        """Index a batch: merge its array with the levels of equal rank, one after the other."""
        array, rank = self.array(anchors), 0
        while rank in self.levels:
            array = self.merge(array, self.levels.pop(rank))
            rank += 1
        self.levels[rank] = stored(array, "suffix-array")

    def repeated(self) -> DataFrame:
        """Beginnings that occur at least twice in all batches together."""
        return reduce(self.merge, self.levels.values()).where("n > 1").select("core")


_UNIT = ["row_a", "row_b", "first", "last", "anchor"]


def _judge(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split units (core, whole, weight, ...) into condemned ones and those the next grain has to look at."""
    name = F.xxhash64("row_a", "row_b", "first")
    # Both tables are stored, so that the joins read plain rows by key and a crowded core can be split.
    wholes = stored(units.groupBy("core", "whole").agg(F.sum("weight").alias("n"), F.min(name).alias("chosen")), "wholes")
    cores = stored(wholes.groupBy("core").agg(F.sum("n").alias("n_core"), F.count("*").alias("n_wholes")).where("n_core > 1"), "cores")
    # A whole needs looking at again if its core has other wholes, and condemns its units if it occurs twice.
    classes = wholes.join(cores, "core").where("n > 1 OR n_wholes > 1").select("core", "whole", "n", "n_wholes", "chosen")
    rated = stored(units.join(classes, ["core", "whole"]).select(
        *_UNIT, (F.col("n") > 1).alias("twice"), ((F.col("n_wholes") > 1) & ((F.col("n") == 1) | (name == F.col("chosen")))).alias("open")), "units")
    condemned = rated.where("twice").select("row_a", "row_b", "first", "last")
    doubtful = rated.where("open").select(*_UNIT, F.when(F.col("twice"), 2).otherwise(1).alias("weight"))
    return condemned, doubtful


def _finer(docs: DataFrame, units: DataFrame, span: int, block: int) -> DataFrame:
    """Cut doubtful units into blocks of ``block`` windows, aligned to the anchor, and fingerprint them.

    Equal rows share their key and units: each unit and each text is taken once, the weight speaks for the others.
    """
    asked = units.groupBy("row_a", "row_b").agg(F.collect_set(F.struct("first", "last", "anchor", "weight")).alias("units"))
    asked = stored(asked, "asked")
    near = docs.mapInArrow(only_members(membership(asked, "row_a"), 0), docs.schema)
    texts = near.groupBy("row_a", "row_b").agg(F.first("text").alias("text")).join(asked, ["row_a", "row_b"]).select("row_a", "row_b", "text", "units")
    schema = "row_a long, row_b long, core long, whole long, first long, last long, anchor long, weight int"

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            buffer, offsets = byte_buffer(batch.column(2))
            lists = batch.column(3)
            cells = lists.flatten()
            first, last, anchor, weight = (cells.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            for row in range(batch.num_rows):
                text = buffer[offsets[row]:offsets[row + 1]]
                own = np.arange(bounds[row], bounds[row + 1])
                own = own[np.argsort(first[own], kind="stable")]
                while len(own):
                    # As many units as lie within one stretch of a long text.
                    low = max(int(first[own[0]]) - block, 0)
                    take = max(int(np.searchsorted(first[own], low + _LONG)), 1)
                    some, own = own[:take], own[take:]
                    high = min(int(last[some].max()) + span + block, len(text))
                    yield _blocks(Hashes(text[low:high]), low, first[some], last[some], anchor[some], weight[some],
                                  a[row], b[row], span, block)

    return texts.mapInArrow(cut, schema)


def _blocks(hashes: Hashes, low: int, first, last, anchor, weight, a: int, b: int, span: int, block: int) -> pa.RecordBatch:
    near, far = (anchor - last) // block, (anchor - first) // block  # blocks count backwards from the anchor
    counts = far - near + 1
    unit = np.repeat(np.arange(len(first)), counts)
    index = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts) + near[unit]
    newest = anchor[unit] - index * block  # latest window start of the aligned block
    oldest = newest - block + 1
    start, stop = np.maximum(oldest, first[unit]), np.minimum(newest, last[unit])
    distance = (anchor[unit] - start + 1).astype(np.uint64)
    core = hashes.of(newest - low, oldest + span - low) ^ mix(index.astype(np.uint64))
    whole = hashes.of(start - low, stop + span - low) ^ mix(distance)
    n = len(unit)
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(n, a, np.int64)), pa.array(np.full(n, b, np.int64)), _signed(core), _signed(whole), _signed(start),
        _signed(stop), _signed(anchor[unit]), pa.array(weight[unit].astype(np.int32)),
    ], names=["row_a", "row_b", "core", "whole", "first", "last", "anchor", "weight"])


def repeated_spans(docs: DataFrame, span: int = 400, batches: int = 4) -> DataFrame:
    """Runs of repeated windows: (row_a, row_b, first, last), window starts inclusive, in bytes.

    ``docs`` has (row_a, row_b, text); ``batches`` parts of it are indexed one after the other.
    """
    anchors = stored(sampled_suffixes(docs, span, batches), "anchors")
    family = SuffixFamily()
    for number in range(batches):
        family.add(anchors.where(F.col("batch") == number))
    units = stored(anchors.drop("batch").join(family.repeated(), "core"), "repeats").withColumn("weight", F.lit(1))
    whole_anchor, doubtful = _judge(units)
    whole_block, doubtful = _judge(_finer(docs, doubtful, span, BLOCK))
    single, _ = _judge(_finer(docs, doubtful, span, 1))
    return whole_anchor.unionByName(whole_block).unionByName(single)


def _marks(runs: DataFrame) -> DataFrame:
    """(row_a, row_b, runs): each run once, however many equal rows have it."""
    # Stored, so that the join reads plain rows by key and very many equal rows can be split.
    return stored(runs.groupBy("row_a", "row_b").agg(F.collect_set(F.struct("first", "last")).alias("runs")), "marks")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400, batches: int = 4) -> DataFrame:
    """Cut every byte covered by a ``span``-byte string that also starts anywhere else in ``docs``.

    Texts are UTF-8 bytes, a null is empty, strings never cross documents and are judged on the input;
    all copies go, the first one included.  A text shorter than ``span`` keeps everything.  Rows that
    are equal in id and text count as two documents.  An empty table gives an empty table; other
    columns of ``docs`` are not looked at.  Returns the id, ``n_bytes``, ``n_removed``, ``n_spans``
    (maximal removed runs), ``kept`` (the remaining bytes, which need not be valid UTF-8 at the cuts)
    and ``kept_sha256``.
    """
    text_session(docs.sparkSession)
    if span <= GRAM + BLOCK:
        raise ValueError(f"strings of more than {GRAM + BLOCK} bytes are needed, not {span}")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *row_key(id_col, text_col))
    keyed = rows.select("row_a", "row_b", "text")
    runs = repeated_spans(keyed, span, batches)
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    joined = rows.join(_marks(runs), ["row_a", "row_b"], "left").select("id", "text", "runs")

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in parts:
            for batch in sliced(whole_batch, "text", 8_000_000):
                yield _cut(batch, span)

    return joined.mapInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
                             ).withColumnRenamed("id", id_col)


def _cut(batch: pa.RecordBatch, span: int) -> pa.RecordBatch:
    buffer, offsets = byte_buffer(batch.column(1))
    removed, spans, kept, digests = [], [], [], []
    lists = batch.column(2)
    for row in range(batch.num_rows):
        text = buffer[offsets[row]:offsets[row + 1]]
        runs = lists[row].values if lists[row].is_valid else None
        if runs is None or not len(runs):
            rest = text.tobytes()
            removed.append(0)
            spans.append(0)
        else:
            first = runs.field(0).to_numpy(zero_copy_only=False)
            stop = runs.field(1).to_numpy(zero_copy_only=False) + span
            order = np.argsort(first, kind="stable")
            first, stop = first[order], np.maximum.accumulate(stop[order])
            opens = np.concatenate(([True], first[1:] > stop[:-1]))
            begin, end = first[opens], stop[np.concatenate((opens[1:], [True]))]
            removed.append(int((end - begin).sum()))
            spans.append(len(begin))
            edges = zip(np.concatenate(([0], end)), np.concatenate((begin, [len(text)])))
            rest = b"".join(text[i:j].tobytes() for i, j in edges)
        kept.append(rest)
        digests.append(hashlib.sha256(rest).hexdigest())
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
         pa.array(kept, pa.binary()), pa.array(digests, pa.string())],
        names=["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
