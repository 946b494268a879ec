"""Files, versioned tables, reports and streams."""

import datetime as dt
import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import catalog
from tidemark.operators import temporal
from tidemark.session import stored
from tidemark.sources import files, sinks
from tidemark.streaming import revisions as streams
from tidemark.streaming.levels import LevelLog


def test_union_by_name_and_profile(spark, tmp_path):
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    spark.sql("SELECT 1 AS g, DATE '2023-05-01' AS d UNION ALL SELECT 1, DATE '2023-06-01'").coalesce(1).write.parquet(a)
    spark.sql("SELECT 2 AS g, DATE '2024-01-01' AS d, 'x' AS extra").coalesce(1).write.parquet(b)
    scan = files.scan_union(spark, [a, b])
    assert sorted((r["g"], r["extra"]) for r in scan.collect()) == [(1, None), (1, None), (2, "x")]
    assert files.missing_columns(spark, [a, b], ["g", "extra"]) == {a: ["extra"]}
    profile = files.profile_files(scan, "g", F.col("d"))
    assert sorted((r["rows"], r["groups"], r["years"]) for r in profile.collect()) == [(1, 1, 1), (2, 1, 1)]
    names = {r["rows"]: r["file"] for r in profile.collect()}
    declared = spark.createDataFrame([(names[2], 2023), (names[1], 2022), ("none.parquet", 2022)], "file string, season int")
    assert sorted(r["code"] for r in files.profile_violations(profile, declared).collect()) == ["empty_file", "outside_season", "repeated_season", "repeated_season"]


def test_hashes_are_of_whole_files(spark, tmp_path):
    data = b"x" * 3_000_001
    (tmp_path / "one.bin").write_bytes(data)
    (tmp_path / "two.bin").write_bytes(b"")
    hashes = files.content_hashes(spark, [str(tmp_path / "one.bin"), str(tmp_path / "two.bin")], block_bytes=1 << 20)
    found = {r["file"]: (r["length"], r["content_sha256"]) for r in hashes.collect()}
    # The file listing leaves empty files out, so a pinned empty file counts as not found.
    one = f"file:{tmp_path}/one.bin"
    assert found == {one: (len(data), hashlib.sha256(data).hexdigest())}
    pinned = spark.createDataFrame([(one, hashlib.sha256(data).hexdigest().upper()), ("two.bin", "0" * 64), ("three.bin", "1" * 64)], "file string, expected string")
    assert sorted(r["file"] for r in files.hash_mismatches(hashes, pinned).collect()) == ["three.bin", "two.bin"]


def test_files_of_one_name_in_two_folders_stay_apart(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "part-0").write_bytes(b"x" * k)
        spark.range(k).selectExpr("id AS g", "DATE '2023-05-01' AS d").coalesce(1).write.parquet(str(tmp_path / f"t{k}"))
        next((tmp_path / f"t{k}").glob("part-*.parquet")).rename(tmp_path / f"d{k}" / "x.parquet")
    hashes = files.content_hashes(spark, [str(tmp_path / f"d{k}" / "part-0") for k in (1, 2)]).collect()
    assert sorted((r["file"][-9:], r["length"]) for r in hashes) == [("d1/part-0", 1), ("d2/part-0", 2)]
    scan = spark.read.parquet(*[str(tmp_path / f"d{k}" / "x.parquet") for k in (1, 2)])
    assert sorted(r["rows"] for r in files.profile_files(scan, "g", F.col("d")).collect()) == [1, 2]


def test_a_document_too_large_to_parse_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(files, "LARGEST_DOCUMENT", 30)
    documents = spark.createDataFrame([("a", '{"k": {"v": 1}}'), ("b", '{"k": {"v": "' + "x" * 40 + '"}}')], "file string, text string")
    with pytest.raises(Exception, match="too large"):
        files.archive_records(documents).collect()
    records = files.archive_records(documents.where("file = 'a'"))
    assert [tuple(r) for r in files.archive_violations(documents, records).collect()] == [("b", "too_large")]


def test_nested_values_have_digests_of_their_own(spark):
    from tidemark.functions.digests import row_digest, schema_digest, table_digest

    values = ["array('a, b')", "array('a', 'b')", "array('ab')", "array('a', NULL)", "array('a', 'null')", "array('a')", "CAST(NULL AS ARRAY<STRING>)", "CAST(array() AS ARRAY<STRING>)"]
    rows = spark.sql(" UNION ALL ".join(f"SELECT {v} AS x, map('k', {v}) AS m, named_struct('p', {v}, 'q', 1) AS s, X'00FF' AS b" for v in values))
    for column in ("x", "m", "s"):
        assert rows.select(schema_digest(rows, [column]).alias("d")).distinct().count() == len(values)
    one, other = (spark.sql(f"SELECT map_from_arrays(array{k}, array{v}) AS m") for k, v in (("('a', 'b')", "(1, 2)"), ("('b', 'a')", "(2, 1)")))
    assert table_digest(one, ["m"]).first() == table_digest(other, ["m"]).first()
    plain = spark.sql("SELECT 1 AS a, 'x' AS b, CAST(NULL AS DATE) AS c")
    assert plain.select(row_digest([F.col(c) for c in "abc"]) == schema_digest(plain, ["a", "b", "c"])).first()[0]


def test_archive_layouts_and_duplicates(spark, tmp_path):
    texts = {"map.json": '﻿{"a": {"v": 1}, "b": {"v": [1, 2]}}', "list.json": '[{"id": "a", "contents": {"v": 1}}, {"id": "a", "contents": {"v": 2}}]',
             "twice.json": '{"a": {"v": 1}, "a": {"v": 2}}', "broken.json": "{", "odd.json": '[{"id": "z", "contents": 5}]'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    documents = files.read_documents(spark, [str(tmp_path / n) for n in texts])
    documents = documents.withColumn("file", F.element_at(F.split("file", "/"), -1))
    records = files.archive_records(documents)
    assert sorted((r["file"], r["record_id"], r["contents"]) for r in records.where("file IN ('map.json', 'list.json')").collect()) == [
        ("list.json", "a", '{"v":1}'), ("list.json", "a", '{"v":2}'), ("map.json", "a", '{"v":1}'), ("map.json", "b", '{"v":[1,2]}')]
    expected = spark.createDataFrame([("map.json", 3), ("list.json", 2)], "file string, records int")
    found = sorted(tuple(r) for r in files.archive_violations(documents, records, expected).collect())
    assert found == [("broken.json", "unreadable_or_repeated_key"), ("list.json", "repeated_id"), ("map.json", "record_count"), ("odd.json", "malformed_record"),
                     ("twice.json", "unreadable_or_repeated_key")]


def test_large_archives_are_read_in_ranges(spark, tmp_path):
    tricky = ['plain', 'brace } in { a string ]', 'quote \\" and \\\\', 'ends with \\\\', '}}', 'ü\n{"x": 1}', ""]
    ids = [f"r{k}" for k in range(400)]
    contents = [{"v": k, "text": tricky[k % len(tricky)], "deep": {"a": [1, {"b": [{}]}]}} for k in range(400)]
    texts = {
        "map.json": json.dumps(dict(zip(ids, contents)), ensure_ascii=False), "list.json": json.dumps([{"id": i, "contents": c} for i, c in zip(ids, contents)], indent=1) + "\n",
        "marked.json": "\ufeff" + json.dumps({"a": {"v": 1}, "n": 5, "b": {}, "m": [2]}), "twice.json": json.dumps({"a": {}})[:-1] + ', "b": {"v": 1}, "a": {"v": 2}}',
        "inner.json": '{"a": {"v": 1, "v": 2}, "b": {}}', "cut.json": '{"a": {"v": "x', "empty.json": "{}", "none.json": "[]"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        pieces = files.archive_pieces(spark, [str(tmp_path / n) for n in texts]).withColumn("file", F.element_at(F.split("file", "/"), -1)).checkpoint()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert pieces.where("file = 'map.json'").select("block").distinct().count() > 10
    records = files.large_archive_records(pieces)
    found = {}
    for r in records.orderBy("file", "pos").collect():
        found.setdefault(r["file"], []).append((r["record_id"], None if r["contents"] is None else json.loads(r["contents"])))
    for name in ("map.json", "list.json"):
        assert sorted(found.pop(name)) == sorted(zip(ids, contents), key=lambda x: x[0])
    assert sorted(found.pop("marked.json"), key=repr) == [("a", {"v": 1}), ("b", {}), ("m", [2]), ("n", 5)]
    assert sorted(found.pop("twice.json"), key=repr) == [("a", {"v": 2}), ("a", {}), ("b", {"v": 1})]
    violations = sorted(tuple(r) for r in files.large_archive_violations(pieces, records).distinct().collect())
    assert violations == [("cut.json", "malformed_record"), ("cut.json", "unreadable"), ("inner.json", "malformed_record"), ("marked.json", "malformed_record"), ("twice.json", "repeated_id")]


def test_append_is_idempotent_and_all_or_nothing(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("w", T.StringType())])
    table = sinks.VersionedTable(spark, str(tmp_path / "t"), ["k"], schema, required=["k", "v"])
    assert table.read() is None
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    assert table.append(rows) == 1
    assert table.append(rows) == 2
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "a", None), (2, "b", None)]
    # Data of an append that never reached its manifest stays invisible.
    spark.createDataFrame([(9, "lost", None)], schema).write.parquet(str(tmp_path / "t" / "data" / "attempt=gone" / "bucket=0"))
    assert table.read().count() == 2
    assert table.append(spark.createDataFrame([(3, "c")], "k int, v string")) == 3
    assert sorted(r["k"] for r in table.read().collect()) == [1, 2, 3]
    assert sorted(r["k"] for r in table.read(1).collect()) == [1, 2]
    # Another writer took version 4 first: its rows count, and this append goes on to version 5.
    other = sinks.VersionedTable(spark, table.root, ["k"], schema)
    seen, calls = table._attempts, []

    def late(version=None):
        calls.append(1)
        before = seen(version)
        if len(calls) == 1:
            spark.createDataFrame([(7, "first", None, 0)], "k int, v string, w string, bucket int").write.partitionBy("bucket").parquet(f"{table.root}/data/attempt=0")
            spark.sql("SELECT 4 AS version, '0' AS attempt").write.mode("append").parquet(f"{table.root}/manifest")
        return before

    table._attempts = late
    assert table.append(spark.createDataFrame([(8, "second")], "k int, v string")) == 5
    assert sorted(r["k"] for r in other.read().collect()) == [1, 2, 3, 7, 8]
    with pytest.raises(sinks.AppendError):
        table.append(rows.withColumn("x", F.lit(1)))
    with pytest.raises(sinks.AppendError):
        table.append(rows.drop("v"))


def test_rewriting_a_season_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.write_season_shards(spark.sql("SELECT 1 AS v, 2023 AS season UNION ALL SELECT 2, 2024"), path)
    sinks.write_season_shards(spark.sql("SELECT 5 AS v, 2024 AS season"), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, 2023), (5, 2024)]


def test_sealed_seasons_are_pruned(spark, tmp_path):
    path = str(tmp_path / "d")
    sinks.write_season_shards(spark.sql("SELECT DATE '2023-05-05' AS day, 2023 AS season UNION ALL SELECT DATE '2024-05-05', 2024"), path)
    df = files.read_days(spark, path, first_day="2023-01-01", season_ceiling=2023)
    assert [str(r["day"]) for r in df.collect()] == ["2023-05-05"]
    assert "PartitionFilters: [isnotnull(season" in df._jdf.queryExecution().executedPlan().toString()


def test_report_keys_are_sorted(spark):
    text = sinks.report_text(spark.sql("SELECT 2 AS b, named_struct('z', 1, 'y', CAST(NULL AS INT)) AS a")).first()["value"]
    assert text == '{"a":{"y":null,"z":1},"b":2}'
    assert list(json.loads(text)) == ["a", "b"]


def test_snapshot_is_published_once(spark, tmp_path):
    spec = [temporal.SnapshotSpec("t", ("entity",), "row_id", ("entity", "row_id"))]
    folder = str(tmp_path / "snap")
    rows = spark.createDataFrame([revision("a", 1, 1), revision("b", 2, 1), revision("a", 3, 3)], SCHEMA)
    run = lambda df, day: sinks.publish_snapshot(spark, {"t": df}, spec, f"2024-01-{day:02d} 00:00:00", f"2024-01-{day:02d} 00:00:00", folder)
    assert run(rows, 2) is True
    assert run(rows, 2) is False
    assert run(rows.where("row_id <> 3"), 2) is False  # what was not known then does not matter
    with pytest.raises(sinks.SnapshotConflict):
        run(rows.where("row_id <> 2"), 2)
    assert sinks.verify_snapshot(spark, folder, spec).isEmpty()
    spark.createDataFrame([("a", 9)], "entity string, row_id int").write.mode("append").parquet(f"{folder}/tables/t")
    assert [tuple(r) for r in sinks.verify_snapshot(spark, folder, spec).collect()] == [("t", 2, 3)]


SCHEMA = "entity string, row_id int, event_at timestamp, available_at timestamp, ingested_at timestamp, valid_from timestamp, valid_to timestamp"


def revision(entity, row_id, day, valid_from=None, valid_to=None):
    at = dt.datetime(2024, 1, day)
    return (entity, row_id, at, at, at, dt.datetime(2024, 1, valid_from or day), None if valid_to is None else dt.datetime(2024, 1, valid_to))


@pytest.fixture()
def arriving(spark, tmp_path):
    batches = [[revision("a", 1, 1), revision("b", 2, 1), revision("b", 2, 1)], [revision("a", 3, 3, 1, 5), revision("a", 1, 1)], [revision("b", 4, 4, 1), revision("c", 5, 4, 4, 6), revision("a", 1, 1)]]
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"part={i}"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    return batches, stream


def test_stream_append_matches_a_batch_append(spark, arriving, tmp_path):
    batches, stream = arriving
    folder = str(tmp_path / "out")
    streams.append_stream(stream(), folder, f"{folder}-checkpoint", "row_id", late="1 hour").awaitTermination()
    log = streams.read_log(spark, folder, T._parse_datatype_string(SCHEMA)).collect()
    assert sorted(r["row_id"] for r in log) == [1, 2, 3, 4, 5]
    # Starting again finds nothing new; replaying everything writes the same folders again.
    streams.append_stream(stream(), folder, f"{folder}-checkpoint", "row_id", late="1 hour").awaitTermination()
    streams.append_stream(stream(), folder, f"{folder}-again", "row_id", late="1 hour").awaitTermination()
    assert sorted(r["row_id"] for r in streams.read_log(spark, folder, T._parse_datatype_string(SCHEMA)).collect()) == [1, 2, 3, 4, 5]


def test_late_and_repeated_revisions_are_stored_once_and_counted(spark, tmp_path):
    batches = [
        [revision("a", 1, 20), revision("b", 2, 21)],
        [revision("c", 3, 2), revision("a", 1, 25), revision("a", 1, 20)],  # 3 is new and weeks late, 1 comes again with another clock
        [revision("d", 4, 22), revision("d", 4, 22), revision("e", 5, 1)],
        [revision("c", 3, 28), revision("f", 6, 27), revision("b", 2, 3)],
    ]
    source, folder = tmp_path / "in", str(tmp_path / "out")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"part={i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    streams.append_stream(stream, folder, f"{folder}-checkpoint", "row_id").awaitTermination()
    schema = T._parse_datatype_string(SCHEMA)
    log = {r["row_id"]: r["available_at"].day for r in streams.read_log(spark, folder, schema).collect()}
    assert log == {1: 20, 2: 21, 3: 2, 4: 22, 5: 1, 6: 27} and streams.read_log(spark, folder, schema).count() == 6
    counts = {(r["batch"], r["code"]): r["rows"] for r in streams.read_quality(spark, folder).collect()}
    assert [counts[b, "received"] for b in range(4)] == [2, 3, 3, 3]
    assert [counts[b, "repeated"] for b in range(4)] == [0, 2, 1, 2]
    assert [counts[b, "late"] for b in range(4)] == [0, 1, 2, 0]


def stored_folders(folder, kind):
    return sorted(p.name for p in (folder / kind).iterdir() if p.name.startswith("part="))


def test_the_log_is_merged_while_the_stream_runs(spark, tmp_path):
    source, folder = tmp_path / "in", tmp_path / "out"
    schema = T._parse_datatype_string(SCHEMA)
    for i in range(11):
        spark.createDataFrame([revision("a", i, 1 + i), revision("b", i // 2, 1 + i)], SCHEMA).coalesce(1).write.parquet(str(source / f"part={i:02d}"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    streams.append_stream(stream(), str(folder), f"{folder}-checkpoint", "row_id", fan=2).awaitTermination()
    entries = LevelLog(spark, str(folder)).entries()
    assert sorted(e[1] for e in entries if e[0] == "log") == [0, 1, 3]  # 11 = 8 + 2 + 1 batches
    assert sorted(r["row_id"] for r in streams.read_log(spark, str(folder), schema).collect()) == list(range(11))
    assert len(stored_folders(folder, "log")) <= 5  # those of the last two manifests
    # The last batch again, as after a restart between the manifest and the checkpoint: nothing is stored twice.
    (tmp_path / "out-checkpoint" / "commits" / "10").unlink()
    for crc in (tmp_path / "out-checkpoint" / "commits").glob(".10.crc"):
        crc.unlink()
    streams.append_stream(stream(), str(folder), f"{folder}-checkpoint", "row_id", fan=2).awaitTermination()
    assert sorted(r["row_id"] for r in streams.read_log(spark, str(folder), schema).collect()) == list(range(11))
    assert sum(r["rows"] for r in streams.read_quality(spark, str(folder)).where("code = 'received'").collect()) == 22


def test_stream_state_matches_the_batch_read(spark, arriving, tmp_path):
    batches, stream = arriving
    folder, schema = str(tmp_path / "state"), T._parse_datatype_string(SCHEMA)
    streams.state_stream(stream(), folder, f"{folder}-checkpoint", ["entity"], "row_id", "2024-01-10 00:00:00", fan=2).awaitTermination()
    everything = spark.createDataFrame([r for b in batches for r in b], SCHEMA).dropDuplicates(["row_id"])
    for day in (4, 5, 6, 9):
        at = f"2024-01-{day:02d} 12:00:00"
        expected = sorted(r["row_id"] for r in temporal.as_of_current(everything, ["entity"], "row_id", at, "2024-01-10 00:00:00").collect())
        assert sorted(r["row_id"] for r in streams.current_state(spark, folder, schema, ["entity"], "row_id", at).collect()) == expected


def test_expiry_is_a_change_to_no_row(spark, tmp_path):
    batches = [
        [revision("a", 1, 1, 1, 4), revision("b", 2, 2, 1, 9), revision("c", 3, 2, 3)],
        [revision("d", 4, 5)],  # a has expired by now, c has begun
        [revision("b", 5, 6, 1, 6), revision("a", 6, 6, 6)],  # a correction lets b expire earlier
        [revision("d", 7, 7, 7)],
    ]
    source, folder = tmp_path / "in", str(tmp_path / "state")
    schema = T._parse_datatype_string(SCHEMA)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(source / f"part={i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
    streams.state_stream(stream, folder, f"{folder}-checkpoint", ["entity"], "row_id", "2024-01-10 00:00:00", fan=2).awaitTermination()
    found = sorted((r["batch"], r["entity"], r["was"], r["becomes"]) for r in streams.state_changes(spark, folder, schema, ["entity"], "row_id").collect())
    assert found == [(0, "a", None, 1), (0, "b", None, 2), (1, "a", 1, None), (1, "c", None, 3), (1, "d", None, 4),
                     (2, "a", None, 6), (2, "b", 2, None), (3, "d", 4, 7)]
    # Applying the changes batch by batch gives what a batch read would give at that clock.
    state, clocks = {}, (2, 5, 6, 7)
    for number, day in enumerate(clocks):
        state |= {e: after for b, e, _, after in found if b == number}
        seen = spark.createDataFrame([r for b in batches[:number + 1] for r in b], SCHEMA)
        at = f"2024-01-{day:02d} 00:00:00"
        expected = {r["entity"]: r["row_id"] for r in temporal.as_of_current(seen, ["entity"], "row_id", at, at).collect()}
        assert {e: x for e, x in state.items() if x is not None} == expected


def test_revisions_stream_from_a_folder_of_files(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), i % 3, "view", float(i)) for i in range(20)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.queries()["t1_stream_append"](spark, str(tmp_path)).collect()
    assert sorted(r["row_id"] for r in found) == list(range(20))


def test_shuffles_of_a_written_step_are_removed(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    assert stored(spark.range(1000).groupBy(F.col("id") % 7).count(), "step").count() == 7
    until = time.time() + 20
    while (left := {f for f in shuffled() - before if f.endswith(".data")}) and time.time() < until:
        time.sleep(0.2)
    assert not left
