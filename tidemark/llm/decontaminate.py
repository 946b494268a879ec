"""Benchmark decontamination with a distributed positional inverted index.

The training texts are cut into shards of a bounded number of bytes.  A shard's index lists, for every
term in it, the positions where the term stands, term by term in the order of the term's 64-bit hash;
all shards together are one stored table, written once to the shared folder.  A search takes the test
phrases in slices of bounded size and looks each phrase up in every shard: the phrase's rarest term in
that shard gives the candidate starts, and the lists of the other terms, moved by their offsets in the
phrase, thin them out from the rarest to the commonest.  What is left are exact phrase matches, with
the words themselves compared by hash.  The shards name only classes of phrases that have the same
items; the items are joined afterwards.  ``proximity`` finds places where all terms of a phrase stand
within a given distance, in any order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, stored, text_session

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHARD_BYTES = 4_000_000
SLICE_PHRASES = 200_000

def words(text: bytes) -> list[bytes]:
    """Lower-cased words: digits, letters and everything beyond ASCII."""
    return WORD.findall(text.lower())


def term_hashes(found: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in found]), ">u8").astype(np.uint64) if found else np.zeros(0, np.uint64)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store the postings of all of ``docs``: one row per shard.

    ``ids`` (an array) and ``starts`` name the shard's rows and their first position; the postings of the
    k-th smallest term hash are ``places[bounds[k]:bounds[k + 1]]``.  Positions run over the shard, with
    a gap of one between documents.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in sliced(whole, "text", shard_bytes):
                yield _shard(batch, f"{part}-{number}")
                number += 1

    schema = (f"shard string, ids array<{kind}>, starts array<int>, counts array<int>, "
              "terms binary, bounds binary, places binary")
    return stored(rows.mapInArrow(scan, schema), "postings")


def _shard(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    hashes, counts = [], []
    for text in batch.column(1):
        own = term_hashes(words(text.as_py() or b""))
        hashes.append(own)
        counts.append(len(own))
    counts = np.array(counts, np.int64)
    starts = np.cumsum(counts + 1) - counts - 1
    place = np.arange(int(counts.sum())) + np.repeat(np.arange(len(counts)), counts)
    terms = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    order = np.argsort(terms, kind="stable")
    terms, place = terms[order], place[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.zeros(0, np.int64)
    bounds = np.append(first, len(terms)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
    numbers = [pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(x.astype(np.int32))) for x in (starts, counts)]
    packed = [pa.array([x.tobytes()], pa.binary()) for x in (terms[first], bounds, place)]
    return pa.RecordBatch.from_arrays([pa.array([name]), lists, *numbers, *packed],
                                      names=["shard", "ids", "starts", "counts", "terms", "bounds", "places"])


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """(item, terms) for every run of ``window`` words of an item; an item of fewer words, but not none, is one phrase."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, terms = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = term_hashes(words(text or b"")).view(np.int64)
                for at in range(max(len(own) - window + 1, min(len(own), 1))):
                    names.append(item)
                    terms.append(own[at:at + window])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(terms, pa.list_(pa.int64()))], names=["item", "terms"])

    return rows.mapInArrow(scan, "item string, terms array<long>")


class Shard:
    """Postings of one shard, as stored."""

    def __init__(self, terms, bounds, places):
        self.terms = np.frombuffer(terms, np.uint64)
        self.bounds = np.frombuffer(bounds, np.int32)
        self.places = np.frombuffer(places, np.int32)

    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def slots(self, asked: np.ndarray) -> np.ndarray:
        """Index of each term hash in this shard, -1 where it is absent."""
        if not len(self.terms):
            return np.full(len(asked), -1)
        at = np.minimum(np.searchsorted(self.terms, asked), len(self.terms) - 1)
        return np.where(self.terms[at] == asked, at, -1)

    def postings(self, slot: int) -> np.ndarray:
        return self.places[self.bounds[slot]:self.bounds[slot + 1]]


def _contains(sorted_list: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_list, asked)
    return sorted_list[np.minimum(at, len(sorted_list) - 1)] == asked


def exact_starts(shard: Shard, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions where the phrase of these term slots starts, thinned from the rarest term on."""
    order = np.argsort(sizes, kind="stable")
    starts = shard.postings(slots[order[0]]) - order[0]
    for k in order[1:]:
        if not len(starts):
            break
        starts = starts[_contains(shard.postings(slots[k]), starts + k)]
    return starts


def near_runs(shard: Shard, slots: np.ndarray, totals: np.ndarray, doc_starts: np.ndarray, counts: np.ndarray,
              within: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs [begin, end] around each place of the term with the least total that hold the nearest place of every other term.

    Only places of the same document count; of two equally near ones the later is taken, of terms with equal
    totals the first in the phrase.
    """
    order = np.argsort(totals, kind="stable")
    begin = end = middle = shard.postings(slots[order[0]]).astype(np.int64)
    doc = np.searchsorted(doc_starts, middle, "right") - 1
    low, high = doc_starts[doc], doc_starts[doc] + counts[doc]
    for k in order[1:]:
        listed = shard.postings(slots[k]).astype(np.int64)
        right = np.searchsorted(listed, middle)
        after, before = listed[np.minimum(right, len(listed) - 1)], listed[np.maximum(right - 1, 0)]
        far = within + 1
        ahead = np.where((after >= middle) & (after < high), after - middle, far)
        behind = np.where((before < middle) & (before >= low), middle - before, far)
        place = np.where(ahead <= behind, after, before)
        good = np.minimum(ahead, behind) <= within
        begin, end, middle = np.minimum(begin, place)[good], np.maximum(end, place)[good], middle[good]
        low, high = low[good], high[good]
    return begin, end


def _totals(index: DataFrame, flat: np.ndarray) -> np.ndarray:
    """How often each of these terms stands in all shards together."""
    asked, back = np.unique(flat, return_inverse=True)
    sent = index.sparkSession.sparkContext.broadcast(asked)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = Shard(*(batch.column(k)[row].as_buffer() for k in range(2)), b"")
                slots = shard.slots(sent.value)
                at = np.flatnonzero(slots >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(shard.sizes()[slots[at]].astype(np.int64))], names=["at", "n"])

    found = index.select("terms", "bounds").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros(len(asked), np.int64)
    totals[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return totals[back]


def _phrase_table(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct phrases (terms, phrase, class), and the items (class, item) of every class.

    Phrases with the same items are one class, so items that share a long passage are listed once for all
    of its windows.  The items of a phrase are never gathered: a digest of them names its class, and one
    phrase of each class stands for it.  ``phrase`` and ``class`` are 64-bit hashes.
    """
    named = asked.select("terms", "item").distinct()
    one, other = F.xxhash64("item"), F.xxhash64(F.lit(1), F.col("item"))
    held = named.groupBy("terms").agg(F.count("item").alias("n"), F.bit_xor(F.when(F.col("item").isNotNull(), one)).alias("x"),
                                      F.bit_xor(F.when(F.col("item").isNotNull(), other)).alias("y"))
    table = stored(held.select("terms", F.xxhash64("terms").alias("phrase"), F.xxhash64("n", "x", "y").alias("class")), "phrases")
    chosen = table.groupBy("class").agg(F.min("phrase").alias("phrase"))
    owners = asked.where("item IS NOT NULL").select(F.xxhash64("terms").alias("phrase"), "item")
    return table, owners.join(chosen, "phrase").select("class", "item").distinct()


def _phrase_slices(table: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct phrases in driver-sized slices: flat term hashes, bounds, class of each phrase."""
    slices = max(1, -(-table.count() // size))
    if slices > 1:
        table = stored(table.withColumn("slice", F.pmod("phrase", F.lit(slices))).repartition("slice"), "slices", "slice")
    for k in range(slices):
        rows = (table.where(F.col("slice") == k) if slices > 1 else table).select("terms", "class").toArrow()
        terms = rows.column("terms").combine_chunks()
        lengths = np.asarray(terms.value_lengths())
        yield (terms.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.append(0, np.cumsum(lengths)),
               rows.column("class").to_numpy())


def search(index: DataFrame, asked: DataFrame, within: int | None = None, slice_phrases: int = SLICE_PHRASES) -> DataFrame:
    """Per indexed row: (id, n_words, n_hit, items): its words, those inside a match, the items that match (sorted).

    A match is the exact phrase, or with ``within`` a place where each of its terms stands at most that
    many words from its rarest one (the rarest in the whole index), in the same row.
    """
    spark = index.sparkSession
    kind = index.schema["ids"].dataType.elementType.simpleString()
    table, listed = _phrase_table(asked)
    parts = []
    for flat, bounds, classes in _phrase_slices(table, slice_phrases):
        totals = None if within is None else _totals(index, flat)
        sent = spark.sparkContext.broadcast((flat, bounds, classes, totals))  # at most slice_phrases phrases of window terms, without their items

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    yield _match(batch.slice(row, 1), *sent.value, within)

        schema = f"shard string, at int, id {kind}, n_words long, first array<int>, last array<int>, classes array<long>"
        found = index.mapInArrow(look, schema)
        parts.append(found.where(F.size("first") > 0) if parts else found)  # the first slice names all rows
    rows = parts[0]
    if len(parts) > 1:
        for more in parts[1:]:
            rows = rows.unionByName(more)
        rows = rows.groupBy("shard", "at").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("first")).alias("first"),
            F.flatten(F.collect_list("last")).alias("last"), F.flatten(F.collect_list("classes")).alias("classes"))
    return _with_items(stored(_merged(rows), "matches"), listed)


def _with_items(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Items in place of classes: listed once for each set of classes, however many rows have that set."""
    hit = rows.where(F.size("classes") > 0)
    sets = hit.select("classes").distinct().select("classes", F.explode("classes").alias("class"))
    # The sets are listed by an explode, so their size is not known: neither side is broadcast.
    lists = sets.hint("merge").join(listed, "class").groupBy("classes").agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    named = hit.join(lists, "classes", "left").select("id", "n_words", "n_hit", F.coalesce("items", none).alias("items"))
    return named.unionByName(rows.where(F.size("classes") == 0).select("id", "n_words", "n_hit", none.alias("items")))


def _merged(rows: DataFrame) -> DataFrame:
    """Count the words in the union of the runs [first, last] and settle the sets of classes."""
    run = F.sort_array(F.arrays_zip("first", "last"))
    start = F.struct(F.lit(-1).cast("int").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def add(state, x):
        fresh = F.greatest(x["last"] - F.greatest(x["first"], state["end"] + 1) + 1, F.lit(0))
        return F.struct(F.greatest(state["end"], x["last"]).alias("end"), (state["n"] + fresh).alias("n"))

    return rows.select("id", "n_words", F.aggregate(run, start, add, lambda s: s["n"]).alias("n_hit"),
                       F.sort_array(F.array_distinct("classes")).alias("classes"))


def _match(row: pa.RecordBatch, flat: np.ndarray, bounds: np.ndarray, classes: np.ndarray,
           totals: np.ndarray | None, within: int | None) -> pa.RecordBatch:
    name, ids, starts, counts, *packed = (column[0] for column in row.columns)
    shard = Shard(*(x.as_buffer() for x in packed))
    ids, counts = ids.values, counts.values.to_numpy(zero_copy_only=False)
    starts = starts.values.to_numpy(zero_copy_only=False).astype(np.int64)
    slots = shard.slots(flat)
    sizes = np.where(slots >= 0, shard.sizes()[slots], 0) if len(shard.terms) else np.zeros(len(flat), np.int64)
    present = np.minimum.reduceat(sizes, bounds[:-1]) > 0 if len(bounds) > 1 else np.zeros(0, bool)
    found: list[list[tuple[int, int]]] = [[] for _ in counts]
    matched: list[set[int]] = [set() for _ in counts]
    for phrase in np.flatnonzero(present):
        own = slice(bounds[phrase], bounds[phrase + 1])
        if within is None:
            begin = exact_starts(shard, slots[own], sizes[own])
            end = begin + (own.stop - own.start - 1)
        else:
            begin, end = near_runs(shard, slots[own], totals[own], starts, counts, within)
        for doc, x, y in zip((np.searchsorted(starts, begin, "right") - 1).tolist(), begin.tolist(), end.tolist()):
            found[doc].append((x - int(starts[doc]), y - int(starts[doc])))
            matched[doc].add(int(classes[phrase]))
    first, last = [], []
    for runs in found:
        joined: list[list[int]] = []
        for begin, end in sorted(runs):
            if joined and begin <= joined[-1][1] + 1:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([begin, end])
        first.append([x for x, _ in joined])
        last.append([y for _, y in joined])
    n, ints = len(counts), pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([name.as_py()] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(counts.astype(np.int64)),
         pa.array(first, ints), pa.array(last, ints), pa.array([sorted(m) for m in matched], pa.list_(pa.int64()))],
        names=["shard", "at", "id", "n_words", "first", "last", "classes"])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = 10, within: int | None = None) -> DataFrame:
    """Per row of ``docs``: (id, ``n_words``, ``n_hit``, ``items``), the words inside a match and the items that match.

    Phrases are the runs of ``window`` words of an item (the whole item if it has fewer).  Null and
    empty texts have no words and match nothing; an item without words asks nothing; an item given
    twice counts once; repeated documents come out as often as they went in; a null item id never
    matches by name but its phrases still count as hits.  Empty tables give empty results or no hits.
    """
    text_session(docs.sparkSession)
    index = build_index(docs, id_col, text_col)
    return search(index, phrases(items, item_col, item_text_col, window), within).withColumnRenamed("id", id_col)


ORACLE = """
WITH plain AS (SELECT doc_id AS id, false AS test, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT item_id, true, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
split AS (SELECT id, test, regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM plain),
places AS (SELECT id, words, least(len(words), 10) AS m, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM split WHERE test AND len(words) > 0),
asked AS (SELECT DISTINCT id AS item_id, m, array_to_string(words[i:i + m - 1], ' ') AS phrase FROM places),
spots AS (SELECT id, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM split, (SELECT DISTINCT m FROM asked) WHERE NOT test AND len(words) >= m),
hits AS (SELECT s.id, s.m, s.i, item_id FROM (SELECT id, m, i, array_to_string(words[i:i + m - 1], ' ') AS phrase FROM spots) s
  JOIN asked a ON s.m = a.m AND s.phrase = a.phrase),
hit_words AS (SELECT id, count(DISTINCT i + k) AS n_hit FROM hits, range(10) AS t(k) WHERE k < m GROUP BY id),
hit_items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM hits) GROUP BY id)
SELECT s.id AS doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN hit_words w ON s.id = w.id LEFT JOIN hit_items h ON s.id = h.id WHERE NOT test"""
