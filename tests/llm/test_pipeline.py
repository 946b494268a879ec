"""The pipeline against a brute-force version, and the registration of all text queries."""

import hashlib
import math
import os
import random
import sys
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import queries, token_output

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_dedup import brute_classes, brute_print  # noqa: E402
from test_text_operators import brute_hits, brute_statistics  # noqa: E402


def fixture(spark, folder):
    rng = random.Random(12)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for doc in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if doc % 11 == 0:
            words = words[:3] * 20
        rows.append((doc, " ".join(words), "en", rng.choice(["a", "a", "a", "b", "c", None]), len(words), "own"))
    items = [(1, rows[5][1][:120]), (2, "word1 word2 word3 word4 word5 word6 word7 word8 word9 word10 word11")]
    rows += [(200, rows[7][1], "de", "b", 1, "own"), (201, rows[8][1].upper(), None, "b", 1, None), (202, None, "en", "a", 0, None),
             (203, "x " + items[1][1] + " " + rows[9][1], "en", "b", 9, None), rows[20], rows[20], (204, "", "en", "a", 0, None)]
    # "kept", "copy" and "row_a" are columns of the documents that the stages use as names of their own elsewhere.
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").selectExpr(
        "*", "kept AS copy", "doc_id AS row_a").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (11, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return [r[:4] for r in rows], items


def brute_pipeline(rows, items, tokenizer):
    kept = []
    for row in rows:  # too few labels for a cutoff, so the base rules alone
        n, _, _, _, repeated, _ = brute_statistics(row[1])
        if n >= 10 and 100 * repeated <= 20 * n:
            kept.append(row)
    classes = brute_classes([brute_print(r[1]) for r in kept], 4)
    first = {}
    for row, c in zip(kept, classes):
        if c not in first or row[0] < first[c][0]:
            first[c] = row
    kept = list(first.values())
    hit = {doc for doc, _, n, _ in brute_hits([r[:2] for r in kept], items) if n}
    kept = [r for r in kept if r[0] not in hit]
    sizes = {}
    for _, text, _, source in kept:
        sizes[source or ""] = sizes.get(source or "", 0) + len(text)
    total, weight = sum(sizes.values()), sum(math.sqrt(s) for s in sizes.values())
    mixed = []
    for doc, text, _, source in kept:
        size = sizes[source or ""]
        rate = total * math.sqrt(size) / weight / size
        assert rate <= 16
        u = int(hashlib.md5(f"mix:draw:{doc}:1".encode()).hexdigest()[:13], 16) / 2**52
        copies, term, below = 0, math.exp(-rate), math.exp(-rate)
        while below <= u:
            copies += 1
            term *= rate / copies
            below += term
        mixed += [(doc, text)] * copies
    out, at = [], 0
    for doc, text in sorted(mixed):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_run_matches_brute_force(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    rows, items = fixture(spark, str(tmp_path))
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    want = brute_pipeline(rows, items, tokenizers.Tokenizer.from_file(token_output.default_tokenizer()))
    assert got == want and len(want) > 60


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert {n.split("_")[0] for n in queries.oracle_sql()} == {"op2", "op4", "op6", "op8"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(folder):
        pytest.skip("test data not present")
    from tools.check import TABLES, compare

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    message, good = compare(name, queries.queries()[name](spark, folder), queries.oracle_sql()[name], connection)
    assert good, message
