"""Exact and near-duplicate removal against brute force on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash, suffix_dedup
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, row_a string, kept string"


def brute_repeats(rows, span):
    counts = Counter()
    for _, text in rows:
        data = (text or "").encode()
        counts.update(data[i:i + span] for i in range(len(data) - span + 1))
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - span + 1):
            if counts[data[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts_with_passages(seed, n=60):
    rng = random.Random(seed)

    def prose(size):
        return "".join(rng.choice("abcdé ß\n") for _ in range(size))

    passages = [prose(rng.randint(90, 700)) for _ in range(6)]
    rows = []
    for doc in range(n):
        text = prose(rng.randint(0, 400))
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            at = rng.randint(0, len(passage) // 2)
            text += passage[at:at + rng.randint(50, 700)] + prose(rng.randint(0, 200))
        rows.append((doc, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats_match_brute_force(spark, seed):
    rows = texts_with_passages(seed)
    rows += [(100, None), (101, ""), (102, "x" * 1000), (103, "ab" * 900), (104, rows[3][1]), (None, rows[4][1]), (105, "short")]
    rows += [rows[7]] * 2  # repeated rows
    found = suffix_dedup.remove_repeats(spark.createDataFrame([(d, t, "a", "b") for d, t in rows], SCHEMA), span=150, batches=3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()), key=repr)
    assert got == brute_repeats(rows, 150)


def test_many_equal_rows_are_looked_at_once(spark):
    rows = texts_with_passages(4, 20)
    passage = max((t for _, t in rows), key=len)
    rows += [(500, passage[:600] + "#" + passage[300:])] * 150 + [(None, "yz" * 200 + passage)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = suffix_dedup.remove_repeats(docs, span=150)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()), key=repr)
    assert got == brute_repeats(rows, 150)

    one = [(1, 2, passage)]
    unit = [(1, 2, k, k + 40, k + 90, 2) for k in range(0, 200, 50)]
    cells = "row_a long, row_b long, first long, last long, anchor long, weight int"
    once, often = (sorted(tuple(r) for r in suffix_dedup._finer(
        spark.createDataFrame(one * k, "row_a long, row_b long, text string"), spark.createDataFrame(unit * k, cells), 150, 32).collect()) for k in (1, 30))
    assert once == often
    marks = suffix_dedup._marks(spark.createDataFrame([u[:4] for u in unit] * 30, "row_a long, row_b long, first long, last long")).collect()
    assert [len(r.runs) for r in marks] == [len(unit)]


def test_repeats_in_long_texts_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PIECE", 500)
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = [(1, "q" + passage), (2, passage[:2500] + "#" + passage[2500:]), (3, "".join(rng.choice("abcdefgh") for _ in range(9000)))]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), span=200, batches=1)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()), key=repr)
    assert got == brute_repeats(rows, 200)


def test_long_text_is_cut_into_overlapping_segments(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "_PIECE", 500)
    monkeypatch.setattr(suffix_dedup, "_LONG", 1000)
    data = np.frombuffer(bytes(range(97, 123)) * 200, np.uint8)
    parts = list(suffix_dedup._segments(data, np.array([0, len(data)]), 150))
    starts = [shift + i for _, part, _, shift in parts for i in range(len(part) - 149)]
    assert starts == list(range(len(data) - 149))


def test_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(empty).collect() == []
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []


def test_family_levels_grow_geometrically(spark):
    family = suffix_dedup.SuffixFamily()
    ranks = []
    for number in range(6):
        rows = spark.createDataFrame([(number,), (100 + number // 2,)], "core long")
        if number == 3:
            assert sorted(r.core for r in family.matches(rows).collect()) == [101]
        family.add(rows)
        ranks.append(sorted(family.levels))
    assert ranks == [[0], [1], [0, 1], [2], [0, 2], [1, 2]]
    assert sorted(r.core for r in family.repeated().collect()) == [100, 101, 102]


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def near_copies(seed):
    rng = random.Random(seed)
    rows = []
    for group in range(12):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(1, 6)):
            changed = [w if rng.random() > 0.01 else "X" + w for w in words]
            rows.append((len(rows), " ".join(changed)))
    return rows + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, rows[0][1].upper()), (1004, "Éa B"), (None, rows[1][1]), rows[2], rows[2]]


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_near_duplicates_match_brute_force(spark, radius):
    rows = near_copies(9)
    prints = [brute_print(t) for _, t in rows]
    classes = brute_classes(prints, radius)
    least = {}
    for (doc, _), c in zip(rows, classes):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    expected = sorted(((d, f"{p:016x}", least.get(c)) for (d, _), p, c in zip(rows, prints, classes)), key=repr)
    docs = spark.createDataFrame([(d, t, "a", "b") for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, radius=radius).collect()), key=repr)
    assert got == expected
    kept = simhash.keep_one(docs, radius=radius)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_every_close_pair_meets_in_a_table():
    rng = random.Random(3)
    for radius in (1, 3, 4, 5):
        tables = simhash.masks(radius)
        for _ in range(300):
            flipped = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(flipped & m == 0 for m in tables)


def test_crowded_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(2)
    centre = rng.getrandbits(63)
    prints = list({centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 9))) for _ in range(150)})
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), 4)
    found = {r.node: r.component for r in components(links).collect()}
    classes = brute_classes(prints, 4)
    smallest = {c: min(p for p, d in zip(prints, classes) if d == c) for c in classes}
    assert [found.get(p, p) for p in prints] == [smallest[c] for c in classes]


def test_what_an_explode_lists_is_not_broadcast(spark):
    prints = spark.createDataFrame([(i * 7,) for i in range(100)], "fingerprint long")
    assert "Broadcast" not in simhash.links(prints, 4)._jdf.queryExecution().executedPlan().toString()


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, x) for x in range(1001, 1400)] + [(5000, 5000)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(201)) and all(found[i] == 1000 for i in range(1000, 1400))
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_fingerprint_is_the_jvm_hash(spark):
    row = spark.createDataFrame([("a b c dé",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert simhash.fingerprint("a b c dé".encode()) == row.h % (1 << 64)
