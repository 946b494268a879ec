"""SimHash near-duplicates with covering locality-sensitive hashing.

Bit ``i`` of a fingerprint gets a vector of ``radius + 1`` bits, ``i mod (2**(radius + 1) - 1) + 1``.
Every nonzero vector ``v`` makes one table, whose mask keeps the bits with an odd product with ``v``.
The vectors of up to ``radius`` differing bits leave some ``v`` at right angles to all of them; in its
table both fingerprints agree on the whole mask.  So every pair within the radius meets in a table,
without chance.  Equal fingerprints are one node; a bucket of many different fingerprints is cut into
blocks, and every pair of blocks is compared in a task of its own, so none grows with a bucket.  Such
a comparison hands on a spanning forest of the links it found, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import row_key, stored, text_session, unsigned_hex
from tidemark.llm.components import components

SEED = 42
SHINGLE = 4
BLOCK = 512


def masks(radius: int) -> list[int]:
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << bit for bit in range(64) if ((bit % vectors + 1) & v).bit_count() % 2) for v in range(1, vectors + 1)]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, and white space is 09-0D and 20
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    digest, seed = xxhash.xxh64_digest, SEED
    raw = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(raw), 65536):
        counts += np.unpackbits(raw[at:at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row_a, row_b, fingerprint as a signed long) per row."""
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or b"") for t in batch.column(3)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints.view(np.int64))], names=["id", "row_a", "row_b", "fingerprint"])

    return rows.mapInArrow(scan, f"id {kind}, row_a long, row_b long, fingerprint long")


def _forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its part) that connect what lies within the radius."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    label = np.arange(len(prints))
    while True:
        smaller = np.where(near, label[None, :], len(prints)).min(axis=1)
        smaller = smaller[smaller]
        if np.array_equal(smaller, label):
            break
        label = smaller
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            prints = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            bounds = np.concatenate(([0], cuts, [len(prints)]))
            left, right = [], []
            if cell is not None and not np.array_equal(cell, keys[0]):
                u, v = _forest(kept, radius)
                left.append(u)
                right.append(v)
                kept = kept[:0]
            sizes = np.diff(bounds)
            inner = np.arange(len(sizes))[(0 if not len(kept) else 1):-1]
            pairs = bounds[inner[sizes[inner] == 2]]  # the usual bucket, all at once
            close = pairs[np.bitwise_count(prints[pairs] ^ prints[pairs + 1]) <= radius]
            left.append(prints[close])
            right.append(prints[close + 1])
            for k in [*([0] if len(kept) and len(sizes) > 1 else []), *inner[sizes[inner] > 2]]:
                members = prints[bounds[k]:bounds[k + 1]]
                u, v = _forest(np.concatenate((kept, members)) if k == 0 else members, radius)
                left.append(u)
                right.append(v)
            tail = prints[bounds[-2]:]
            kept = np.concatenate((kept, tail)) if len(sizes) == 1 else tail
            cell = keys[-1]
            yield _edges(left, right)
        if len(kept):
            u, v = _forest(kept, radius)
            yield _edges([u], [v])

    return run


def _edges(left: list[np.ndarray], right: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["u", "v"])


def links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints (one column) within the radius; not every pair is listed."""
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key"))
                       for k, m in enumerate(masks(radius))])
    placed = prints.select("fingerprint", F.inline(tables))
    crowded = placed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    # Sizes are not known after an explode: without the hint, a table of this many rows can be taken for one to broadcast.
    met = placed.join(crowded.hint("merge"), ["table", "key"]).withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "table", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fingerprint")
    cells = met.repartition("table", "key", "i", "j").sortWithinPartitions("table", "key", "i", "j")
    return cells.mapInArrow(_compare(radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """Fingerprint and component of every row: (id, ``fingerprint`` as 16 hex digits, ``component_id``).

    Fingerprints that differ in ``radius`` bits or fewer are linked; ``component_id`` is the smallest id
    that can be reached.  Null and empty texts have fingerprint zero and are linked like any other; null
    ids never become a ``component_id`` unless no other id is in the component.  Repeated rows come out
    as often as they went in; an empty table gives an empty result.
    """
    seen = _classed(docs, id_col, text_col, radius)
    return seen.select(F.col("id").alias(id_col), unsigned_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """The rows of ``docs`` of the smallest id in each component, one of them where several rows have it."""
    a, b = row_key(id_col, text_col)
    names = ["row_a", "row_b"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    chosen = _classed(docs, id_col, text_col, radius).groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row_a", "row_b")).alias("row"))
    chosen = chosen.select(F.col("row.row_a").alias(names[0]), F.col("row.row_b").alias(names[1]))
    rows = docs.withColumns({names[0]: a, names[1]: b}).join(stored(chosen, "kept"), names, "left_semi")
    return rows.dropDuplicates(names).select(*docs.columns)


def _classed(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(id, row_a, row_b, fingerprint, component, component_id) per row."""
    text_session(docs.sparkSession)
    seen = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = seen.groupBy("fingerprint").agg(F.min("id").alias("least"))
    parts = components(links(nodes.select("fingerprint"), radius))
    # Both are stored, so that the join reads plain rows and a component of many fingerprints can be split.
    named = stored(nodes.join(parts.hint("merge"), F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")), "nodes")
    smallest = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    classes = stored(named.join(smallest.hint("merge"), "component").select("fingerprint", "component", "component_id"), "classes")
    return seen.join(classes.hint("merge"), "fingerprint")
