"""Periodic runs of words: maximal stretches that repeat a period of words.

Per text the words become numbers, and Ukkonen's algorithm builds the suffix tree of the sequence and of its
reversal.  Euler tours of both trees answer, in constant time per question, how far two positions agree to the
right and to the left: the depth of the lowest common ancestor is the least depth on the tour between them.
For the usual order of words and for the opposite one, the longest Lyndon word at each position ends where the
next smaller suffix starts; these Lyndon words contain a root of every run.  Each is extended in both
directions, and what holds its period long enough is a run.

Trees are built only over stretches that can hold a run: each three words in a row of a run occur three times
in it, so a stretch is cut wherever three words in a row occur less often in it, until nothing changes.  No run
crosses such a cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_session

LEAST_LENGTH = 6
LEAST_PERIODS = 4
_CELL = 32  # tour entries per block of the range minima
_ASK = 1 << 16  # questions answered at once


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of positive numbers, closed by 0, with an Euler tour for ancestors.

    Node 0 is the root.  Leaves are made in the order of their suffixes.
    """

    def __init__(self, sequence: list[int]):
        text = [*sequence, 0]
        self.size, width = len(text), max(text) + 1
        begin, end, parent, link, go, leaves = [0], [0], [0], [0], {}, []
        node = edge = length = waiting = 0
        for at, symbol in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = at
                slot = node * width + text[edge]
                child = go.get(slot)
                if child is None:
                    go[slot] = len(begin)
                    leaves.append(len(begin))
                    begin.append(at)
                    end.append(self.size)
                    parent.append(node)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    span = min(end[child], at + 1) - begin[child]
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    middle = begin[child] + length
                    if text[middle] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    split = len(begin)
                    go[slot] = split
                    begin += [begin[child], at]
                    end += [middle, self.size]
                    parent += [node, split]
                    link += [0, 0]
                    leaves.append(split + 1)
                    begin[child], parent[child] = middle, split
                    go[split * width + text[middle]] = child
                    go[split * width + symbol] = split + 1
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - waiting + 1
        self.leaves = np.array(leaves)
        self.parent = np.array(parent)
        self._first = np.array(text)[np.array(begin)]
        self._spans = np.array(end) - np.array(begin)
        tour = self._tour(self._first)
        depth = np.zeros(len(begin), np.int64)
        seen = np.full(len(begin), -1, np.int64)
        order = np.unique(tour, return_index=True)[1]
        seen[:] = order
        for node in tour[np.sort(order)][1:].tolist():  # parents before children
            depth[node] = depth[parent[node]] + self._spans[node]
        self._place = seen[self.leaves]
        self._minima(depth[tour])

    def _tour(self, key: np.ndarray) -> np.ndarray:
        """Nodes in the order of an Euler tour that visits children by ``key``."""
        count = len(key)
        order = np.lexsort((key[1:], self.parent[1:])) + 1
        starts = np.searchsorted(self.parent[order], np.arange(count + 1)).tolist()
        children, tour, path, at = order.tolist(), [0], [0], starts[:-1]
        while path:
            node = path[-1]
            if at[node] < starts[node + 1]:
                child = children[at[node]]
                at[node] += 1
                path.append(child)
                tour.append(child)
            else:
                path.pop()
                if path:
                    tour.append(path[-1])
        return np.array(tour)

    def ranks(self, opposite: bool = False) -> np.ndarray:
        """Rank of every suffix, by the order of words or its opposite; a suffix that begins another is smaller."""
        key = np.where(self._first == 0, np.iinfo(np.int64).min, -self._first) if opposite else self._first
        tour = self._tour(key)
        first = np.unique(tour, return_index=True)[1][self.leaves]
        ranks = np.empty(len(first), np.int64)
        ranks[np.argsort(first)] = np.arange(len(first))
        return ranks

    def _minima(self, depths: np.ndarray) -> None:
        blocks = -(-len(depths) // _CELL)
        self._depths = np.full(blocks * _CELL, np.iinfo(np.int32).max, np.int32)
        self._depths[:len(depths)] = depths
        cells = self._depths.reshape(blocks, _CELL)
        self._ahead = np.minimum.accumulate(cells, axis=1).ravel()
        self._behind = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
        self._table = [cells.min(axis=1)]
        while (step := 1 << len(self._table)) <= blocks:
            last = self._table[-1]
            self._table.append(np.minimum(last[:len(last) - step // 2], last[step // 2:]))

    def agree(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of equal words from the positions ``left`` and ``right`` on (different positions)."""
        out = np.empty(len(left), np.int64)
        for k in range(0, len(left), _ASK):
            a, b = self._place[left[k:k + _ASK]], self._place[right[k:k + _ASK]]
            a, b = np.minimum(a, b), np.maximum(a, b)
            i, j = a // _CELL, b // _CELL
            low = np.minimum(self._behind[a], self._ahead[b])
            between = np.flatnonzero(j - i > 1)
            if len(between):
                count = (j - i - 1)[between]
                level = np.frexp(count)[1] - 1
                for step in np.unique(level):
                    mine = between[level == step]
                    row = self._table[step]
                    low[mine] = np.minimum(low[mine], np.minimum(row[i[mine] + 1], row[j[mine] - (1 << step)]))
            same = np.flatnonzero(i == j)
            if len(same):
                spread = a[same][:, None] + np.arange(_CELL)
                values = self._depths[np.minimum(spread, len(self._depths) - 1)]
                low[same] = np.where(spread <= b[same][:, None], values, np.iinfo(np.int32).max).min(axis=1)
            out[k:k + _ASK] = low
        return out


def _lyndon_ends(ranks: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word at each position ends: at the next position of a smaller rank."""
    rank = ranks.tolist()
    ends, open_ = [0] * (len(rank) - 1), []
    for at in range(len(rank) - 1, -1, -1):
        while open_ and rank[open_[-1]] > rank[at]:
            open_.pop()
        if open_:
            ends[at] = open_[-1]
        open_.append(at)
    return np.array(ends)


def tree_runs(sequence: list[int], least: int = LEAST_LENGTH, periods: int = LEAST_PERIODS) -> set[tuple[int, int, int]]:
    """Runs (start, length, period) of a sequence of positive numbers with ``periods`` (two at least) periods and ``least`` numbers."""
    n = len(sequence)
    ahead, back = SuffixTree(sequence), SuffixTree(sequence[::-1])
    at, found = np.arange(n), set()
    for opposite in (False, True):
        ends = _lyndon_ends(ahead.ranks(opposite))
        left = at - back.agree(n - at, n - ends)
        right = ends + ahead.agree(at, ends)
        period, length = ends - at, right - left
        good = np.flatnonzero((length >= least) & (length >= periods * period))
        found.update(zip(left[good].tolist(), length[good].tolist(), period[good].tolist()))
    return found


def _stretches(words: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches that can hold runs of four periods."""
    todo = [(0, len(words))]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        part = words[low:high]
        names = np.unique(part, return_inverse=True)[1].astype(np.int64)
        pairs = np.unique(names[:-1] * (names.max() + 1) + names[1:], return_inverse=True)[1]
        threes, place, often = np.unique(pairs[:-1] * (names.max() + 1) + names[2:], return_inverse=True, return_counts=True)
        good = np.concatenate(([False], often[place] >= 3, [False]))
        if good[1:-1].all():
            yield low, high
            continue
        cuts = np.flatnonzero(good[1:] != good[:-1])
        todo += [(low + int(a), low + int(b) + 2) for a, b in zip(cuts[::2], cuts[1::2])]


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """Sorted runs (start, length, period) of a text's words that are six words and four periods long or longer."""
    table: dict[bytes, int] = {}
    numbers = np.array([table.setdefault(w, len(table) + 1) for w in words], np.int64)
    found = set()
    for low, high in _stretches(numbers, LEAST_LENGTH):
        names = np.unique(numbers[low:high], return_inverse=True)[1] + 1
        found.update((low + start, length, period) for start, length, period in tree_runs(names.tolist()))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside of runs, and the first period of each run that no other run drops, joined by spaces."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of every text: (id, ``n_words``, ``runs`` as (start, length, period) by start and period, ``collapsed``).

    Words are parted by spaces and the characters 9 to 13.  A run is a stretch of words with smallest period
    ``period``, at least six words and four periods long, that no neighbouring word extends; starts count
    words from 0.  ``collapsed`` is the text without the words of runs beyond their first period, its words
    joined by one space.  Null and empty texts have no words, no runs and an empty collapsed text.  Equal rows
    and null ids come out as they went in; other columns are not looked at; an empty table gives an empty
    result.  Memory grows with the longest text, in proportion.
    """
    text_session(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    cell = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, kept = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()
                found = word_runs(words)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                kept.append(collapsed(words, found).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(cell)), pa.array(kept, pa.string())],
                names=["id", "n_words", "runs", "collapsed"])

    schema = f"id {kind}, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"
    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def plant_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) where one text in ten, by the hash of its id, repeats a stretch of its words to its end.

    Texts without words and rows of null id stay as they are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(bound: Column) -> Column:
        own, a = bound["words"], bound["a"]
        p = 1 + F.floor((F.size(own) - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(own, lambda w, i: F.when(i < a, w).otherwise(F.get(own, (a + (i - a) % p).cast("int")))), " ")

    # Arrays of one element bind what the inner steps read for every word.
    bound = F.transform(F.array(words), lambda w: F.struct(w.alias("words"), F.when(F.size(w) > 0, g % F.size(w)).otherwise(0).alias("a")))
    planted = F.when(h % 10 == 0, F.transform(bound, repeated)[0]).otherwise(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col), planted.alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of counts and digests per row of ``periodic_runs``; the run of the greatest exponent is named."""
    # Exact comparison of length / period by products; the runs come by start and period, so ties keep the first.
    better = F.aggregate("runs", F.expr("cast(null as struct<start: bigint, length: bigint, period: bigint>)"),
                         lambda best, run: F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = found.withColumn("best", better)
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
