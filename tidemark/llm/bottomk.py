"""Near-duplicates by word shingles with bottom-k sketches of one hash function.

A document's sketch keeps the ``K`` smallest 64-bit hashes of its distinct shingles.  Documents with the same
set are one node.  Inverted lists name the nodes of every *run* of three retained values that follow each
other in hash order: two sets within the similarity share such a run (see ``runs``), while one value alone,
a pair of frequent words, is shared by strangers.  Pairs from a list pass three steps: overlaps of the lists,
the estimate from the union of both sketches, and the exact comparison of the full sets.

A list may hold a third of all nodes, so its pairs are never listed.  First every member meets the list's
smallest node only; what the estimate lets through is a *kinship*, what the exact comparison confirms a link.
Lists whose members are still of different kin are compared inside tasks, block against block of sketches, and
hand on a spanning forest of kinships.  Then a family (all that kinships connect) holds both ends of every
link; where links do not connect it yet, its full sets are compared in the same way, block against block, and
hand on a spanning forest of links.  No step makes a row per pair of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import membership, only_members, row_key, stored, text_session
from tidemark.llm.components import components

K = 64
BLOCK = 256  # nodes per side of a comparison
COLUMNS = 16384  # values per step of a comparison
SHARE = 80  # percent of the union
#: Values of the union's K smallest that both sets have, at least, when 80 percent of the union are shared:
#: a binomial number of 64 draws falls below 26 with a chance under 1e-11.
LEAST = 26


def shingle_hashes(text: bytes, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of the whole sequence where there are fewer words."""
    words = text.lower().split()  # bytes: A-Z only, and white space is 09-0D and 20
    if not words:
        return np.zeros(0, np.int64)
    shingles = set(map(b" ".join, zip(*(words[k:] for k in range(size))))) or {b" ".join(words)}
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles)), np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int = 2) -> DataFrame:
    """(id, row_a, row_b, node, n_shingles, sketch) per row; ``node`` names the set, null for an empty one."""
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts, kept = [], [], []
            for text in batch.column(3):
                hashes = shingle_hashes(text.as_py() or b"", size)
                names.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                counts.append(len(hashes))
                kept.append(hashes[:K])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(names, pa.binary()), pa.array(counts, pa.int64()), _lists(kept)],
                names=["id", "row_a", "row_b", "node", "n_shingles", "sketch"])

    return rows.mapInArrow(scan, f"id {kind}, row_a long, row_b long, node binary, n_shingles long, sketch array<long>")


def runs(nodes: DataFrame) -> DataFrame:
    """Inverted lists (key, name): a key stands for three retained values that follow each other.

    Two different sets that share 80 percent of a union of ``u`` differ in ``d <= u / 5`` values.  These cut
    the union, in hash order, into ``d + 1`` gaps with ``u - d`` shared values, so one gap holds three of them
    in a row, from ``u = 6`` on; with ``u = 5`` two, which is why sets of four and five also list pairs.  For
    sketches the same holds for the union's first ``K`` values, but for a chance below 1e-9 that far more
    than a fifth of them differ.  ``name`` is a hash of the node: two nodes of one name are both compared.
    """
    three = F.expr("transform(sequence(0, size(sketch) - 3), i -> xxhash64(sketch[i], sketch[i + 1], sketch[i + 2]))")
    two = F.expr("transform(sequence(0, size(sketch) - 2), i -> xxhash64(sketch[i], sketch[i + 1]))")
    usual = nodes.where("size(sketch) >= 3").select(F.explode(three).alias("key"), "name")
    small = nodes.where("size(sketch) between 4 and 5").select(F.explode(two).alias("key"), "name")
    return usual.unionByName(small)


def _kin(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of nodes (u, v) whose names are paired and that the union sketch does not rule out."""
    for side in "uv":
        own = nodes.select(F.col("name").alias(f"name_{side}"), F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = pairs.withColumnRenamed(side, f"name_{side}").join(own, f"name_{side}")
    pairs = pairs.where(f"100 * least(n_u, n_v) >= {SHARE} * greatest(n_u, n_v)")
    shared, union = F.array_intersect("sketch_u", "sketch_v"), F.sort_array(F.array_union("sketch_u", "sketch_v"))
    # Sketches that are whole sets are compared as such; else the shared ones among the union's K smallest count.
    whole = (F.col("n_u") <= K) & (F.col("n_v") <= K)
    counted = F.size(F.array_intersect(F.slice(union, 1, K), shared))
    return pairs.where(F.when(whole, 100 * F.size(shared) >= SHARE * F.size(union)).otherwise(counted >= LEAST)).select("u", "v")


def _full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, hashes): the full sets of the nodes in ``wanted`` (node, row_a, row_b), made anew from one text each."""
    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("string").cast("binary").alias("text"))
    wanted = stored(wanted, "wanted")
    sieve = only_members(membership(wanted, "row_a"), 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sieve(batches):
            sets = [shingle_hashes(t.as_py() or b"", size) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _lists(sets)], names=["row_a", "row_b", "hashes"])

    hashed = rows.mapInArrow(scan, "row_a long, row_b long, hashes array<long>")
    return stored(hashed.join(wanted, ["row_a", "row_b"]).select("node", "hashes").dropDuplicates(["node"]), "sets")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) whose full sets share enough."""
    for side in "uv":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("hashes").alias(f"set_{side}")), side)
    shared = F.size(F.array_intersect("set_u", "set_v"))
    met = pairs.select("u", "v", shared.alias("shared"), (F.size("set_u") + F.size("set_v")).alias("total"))
    return met.where(f"100 * shared >= {SHARE} * (total - shared)").select("u", "v")


def _overlaps(kept: list[np.ndarray]) -> np.ndarray:
    """How many values each two of some lists of distinct values share, some thousand values at a time."""
    values, place = np.unique(np.concatenate(kept), return_inverse=True)
    who = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
    often = np.bincount(place, minlength=len(values)) > 1
    column = (np.cumsum(often) - 1)[place]
    mine = often[place]
    who, column = who[mine], column[mine]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    out = np.zeros((len(kept), len(kept)), np.float32)
    for low in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(kept), min(COLUMNS, int(often.sum()) - low)), np.float32)
        has[who[a:b], column[a:b] - low] = 1
        out += has @ has.T
    return out


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (place, smallest place of its part) that connect what a symmetric table of neighbours connects."""
    n = len(near)
    label = np.arange(n)
    near = near | np.eye(n, dtype=bool)
    while True:
        smaller = np.where(near, label[None, :], n).min(axis=1)
        smaller = smaller[smaller]
        if np.array_equal(smaller, label):
            break
        label = smaller
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _compared(enough: str, kind: str):
    """Compare rows (group, i, j, block, name, part, n, values) sorted by their cell (group, i, j) of two blocks at most.

    Hands on a spanning forest (u, v) of the names whose values overlap ``enough``: for a kinship or for a link.
    What is of one part already is neighbours.
    """

    def close(rows: list[tuple]) -> tuple[list, list]:
        names, parts, counts, kept = zip(*rows)
        numbers = {p: k for k, p in enumerate(dict.fromkeys(parts))}
        if len(numbers) == 1:
            return [], []
        part, n = np.array([numbers[p] for p in parts]), np.array(counts, np.float64)
        shared = _overlaps(list(kept))
        if enough == "kinship":
            sizes = np.array([len(k) for k in kept])
            need = np.minimum(np.ceil(SHARE * np.maximum(sizes[:, None], sizes[None]) / 100), LEAST)
            near = (shared >= need) & (100 * np.minimum(n[:, None], n[None]) >= SHARE * np.maximum(n[:, None], n[None]))
        else:
            near = 100.0 * shared >= SHARE * (n[:, None] + n[None] - shared)
        if not (near & (part[:, None] != part[None])).any():
            return [], []
        u, v = spanning(near | (part[:, None] == part[None]))
        return [names[k] for k in u], [names[k] for k in v]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, u, v = None, [], [], []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6)]
            values, ends = batch.column(7).flatten().to_numpy(zero_copy_only=False), batch.column(7).offsets.to_numpy()
            ends = ends - ends[0]
            for at, (group, i, j, name, part, n) in enumerate(zip(*columns)):
                if (group, i, j) != cell:
                    if len(held) > 1:
                        more = close(held)
                        u += more[0]
                        v += more[1]
                    cell, held = (group, i, j), []
                held.append((name, part, n, values[ends[at]:ends[at + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(side, arrow) for side in (u, v)], names=["u", "v"])
            u, v = [], []
        if len(held) > 1:
            more = close(held)
            yield pa.RecordBatch.from_arrays([pa.array(side, arrow) for side in more], names=["u", "v"])

    arrow = {"long": pa.int64(), "binary": pa.binary()}[kind]
    return run


def _cells(members: DataFrame, values: DataFrame, group: str, name: str, enough: str, kind: str) -> DataFrame:
    """Forest edges (u, v) over the members (``group``, ``name``, part, n_group) of each group with several parts."""
    crowd = members.groupBy(group, "part").agg(F.count("*").alias("n_part"))
    # Members of a part go to the same blocks, so that few cells hold several parts.
    blocks, halls = F.ceil(F.col("n_group") / BLOCK).cast("int"), F.ceil(F.col("n_part") / BLOCK)
    dealt = members.join(stored(crowd, "crowd"), [group, "part"]).withColumn("blocks", blocks)
    place = F.xxhash64("part") % 1_000_000 + F.pmod(F.xxhash64(name), halls.cast("long"))
    dealt = dealt.withColumn("block", F.pmod(place, F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = dealt.join(values, name).select(
        F.col(group).alias("group"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col(name).alias("name"), "part", "n", "values")
    cells = cells.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return cells.mapInArrow(_compared(enough, kind), f"u {kind}, v {kind}").distinct()


def _several(members: DataFrame, group: str) -> DataFrame:
    """The members of groups with more than one part, with the size of their group; stored for the comparisons."""
    open_groups = members.groupBy(group).agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("n_group")).where("a <> b").select(group, "n_group")
    return stored(members.join(stored(open_groups, "open"), group), "members")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2) -> DataFrame:
    """Class of every row by shingles of ``size`` words: (id, ``n_shingles``, ``component_id``, ``kept``).

    Rows are linked when their sets share 80 percent of their union or more; ``component_id`` is the smallest
    id that can be reached and ``kept`` marks the rows that have it.  Null and empty texts have no shingles and
    are linked with nothing.  A null id is a ``component_id`` only where the class has no other, and such a
    row is kept.  Repeated rows come out as often as they went in, all with the same class.  Other columns are
    not looked at; an empty table gives an empty result.
    """
    text_session(docs.sparkSession)
    seen = stored(sketches(docs, id_col, text_col, size), "sketches")
    nodes = stored(seen.where("node is not null").groupBy("node").agg(
        F.min("id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
        F.min(F.struct("row_a", "row_b")).alias("row")).withColumn("name", F.xxhash64("node")), "nodes")
    entries = runs(nodes)
    lists = stored(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    met = stored(entries.mapInArrow(only_members(membership(lists, "key"), 0), "key long, name long").join(lists, "key"), "met")
    pivots = met.groupBy("key").agg(F.min("name").alias("pivot"))
    listed = stored(met.join(pivots, "key"), "listed")
    star = listed.where("name <> pivot").select(F.col("name").alias("u"), F.col("pivot").alias("v")).distinct()
    kin = stored(_kin(star, nodes), "kin")
    ends = kin.select(F.col("u").alias("node")).union(kin.select("v")).distinct()
    sets = _full_sets(docs, nodes.join(ends, "node").select("node", "row.row_a", "row.row_b"), id_col, text_col, size)
    links = stored(_links(kin, sets), "links")

    # Kinships that the pivots did not show.
    named = nodes.join(components(kin), "node", "left").select("name", F.coalesce("component", "node").alias("part"))
    members = _several(listed.where("n > 2").select("key", "name").join(stored(named, "families"), "name"), "key")
    sketched = nodes.select("name", F.col("n_shingles").alias("n"), F.col("sketch").alias("values"))
    more = stored(_cells(members, sketched, "key", "name", "kinship", "long"), "more")
    for side in "uv":
        more = more.withColumnRenamed(side, "name").join(nodes.select("name", F.col("node").alias(side)), "name").drop("name")

    # Links inside of families that the links to the pivots do not connect.
    family = components(kin.unionByName(more)).select("node", F.col("component").alias("family"))
    members = family.join(components(links), "node", "left").select("family", "node", F.coalesce("component", "node").alias("part"))
    members = _several(members, "family")
    sets = _full_sets(docs, nodes.join(members.select("node").distinct(), "node").select("node", "row.row_a", "row.row_b"), id_col, text_col, size)
    full = sets.select("node", F.size("hashes").cast("long").alias("n"), F.col("hashes").alias("values"))
    rest = stored(_cells(members, full, "family", "node", "link", "binary"), "rest")
    parts = components(links.unionByName(rest))
    classes = stored(nodes.join(parts, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "classes")
    smallest = stored(classes.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    named = stored(classes.join(smallest, "component").select("node", "component_id"), "named")
    out = seen.select("id", "node", "n_shingles").join(named, "node", "left")
    found = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", found.alias("component_id"), F.col("id").eqNullSafe(found).alias("kept"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM words),
shingles AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n + b.n) AS total, count(*) AS shared FROM shingles a JOIN shingles b
  ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS MATERIALIZED (
  SELECT u, v FROM pairs WHERE 100 * shared >= 80 * (total - shared) UNION ALL SELECT v, u FROM pairs WHERE 100 * shared >= 80 * (total - shared)),
reached AS (SELECT doc_id AS u, doc_id AS v FROM sets UNION SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v),
least_ids AS (SELECT u, min(v) AS component_id FROM reached GROUP BY u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least_ids ON u = doc_id"""
