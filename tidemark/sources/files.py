"""Reading and checking source files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.digests import table_digest
from tidemark.plans.ordered import running
from tidemark.session import cut_lineage


def scan_union(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet files read as one table, columns matched by name; a column missing in a file is NULL there."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", True)
    return reader.parquet(*paths)


def missing_columns(spark: SparkSession, paths: Sequence[str], required: Sequence[str]) -> dict[str, list[str]]:
    """Required columns each file lacks, from the file schemas alone."""
    found = {}
    for path in paths:  # one metadata read per source file
        absent = sorted(set(required) - set(spark.read.parquet(path).columns))
        if absent:
            found[path] = absent
    return found


def profile_files(df: DataFrame, group: str, day: Column) -> DataFrame:
    """Rows, groups, first and last day and distinct years of every file (by its full path) of a scan.

    Rows are reduced to one per file, group and day first, so the distinct
    counts work on the reduced table.
    """
    rows = df.select(F.col("_metadata.file_path").alias("file"), F.col(group).alias("g"), day.alias("d"))
    slim = rows.groupBy("file", "g", "d").agg(F.count("*").alias("n"))
    per_group = slim.groupBy("file", "g").agg(F.sum("n").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    years = slim.select("file", F.year("d").alias("y")).distinct().groupBy("file").agg(F.count("y").alias("years"))
    profile = per_group.groupBy("file").agg(F.sum("n").alias("rows"), F.count("g").alias("groups"), F.min("lo").alias("first_day"), F.max("hi").alias("last_day"))
    return profile.join(years, "file")


def profile_violations(profile: DataFrame, declared: DataFrame) -> DataFrame:
    """Files without rows, with days outside their declared season, or sharing a season (``declared``: file, season)."""
    joined = declared.join(profile, "file", "left")
    shared = declared.groupBy("season").agg(F.count("*").alias("n")).where("n > 1").select("season")
    again = declared.join(shared, "season", "left_semi").select("file", "season", F.lit("repeated_season").alias("code"))
    outside = (F.col("years") != 1) | (F.year("first_day") != F.col("season")) | (F.year("last_day") != F.col("season"))
    code = F.when(F.col("rows").isNull() | F.col("first_day").isNull(), "empty_file").when(outside, "outside_season")
    return joined.select("file", "season", code.alias("code")).where("code IS NOT NULL").unionByName(again)


def content_hashes(spark: SparkSession, paths: Sequence[str], block_bytes: int = 8 << 20) -> DataFrame:
    """SHA-256 of whole files, read block by block inside the tasks.

    Files go by their full path.  Spark lists them (their content column is pruned, empty files are left out);
    each task streams its files, so a file of any size needs one block of memory.
    """
    listed = spark.read.format("binaryFile").load(list(paths)).select("path", "length")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            found = []
            for path in batch["path"]:
                uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
                system, name = fs.FileSystem.from_uri(uri)
                value = hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while block := stream.read(block_bytes):
                        value.update(block)
                found.append(value.hexdigest())
            yield batch.assign(content_sha256=found)

    hashed = listed.mapInPandas(digest, "path string, length bigint, content_sha256 string")
    return hashed.select(F.col("path").alias("file"), "length", "content_sha256")


def hash_mismatches(hashes: DataFrame, pinned: DataFrame) -> DataFrame:
    """Files whose hash differs from the pinned one, and pinned files that were not found (``pinned``: file, expected)."""
    joined = pinned.join(hashes, "file", "left")
    same = F.lower("expected") == F.col("content_sha256")
    return joined.where(~F.coalesce(same, F.lit(False))).select("file", "expected", F.col("content_sha256").alias("actual"))


def read_documents(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per file: its path and whole text."""
    rows = spark.read.option("wholetext", True).text(list(paths))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("text"))


#: Bytes of text above which Spark's parser takes no document.
LARGEST_DOCUMENT = 128 << 20


def archive_records(documents: DataFrame) -> DataFrame:
    """Records of JSON archives: an object ``{id: contents}`` or a list of ``{id, contents}``.

    Text that does not parse, or repeats a key inside one object, gives no record
    and is listed by ``archive_violations``.  A document above ``LARGEST_DOCUMENT`` bytes
    is an error: ``archive_pieces`` and ``large_archive_records`` read files of any size.
    """
    too_large = F.raise_error(F.concat(F.col("file").cast("string"), F.lit(" is too large to be parsed as one document"))).cast("string")
    text = F.when(F.octet_length("text") > LARGEST_DOCUMENT, too_large).otherwise(F.col("text"))
    parsed = documents.select("file", F.try_parse_json(text).alias("v")).where("v IS NOT NULL")
    rows = parsed.sparkSession.sql("SELECT file, e.pos, e.key, e.value FROM {parsed}, LATERAL variant_explode(v) AS e", parsed=parsed)
    record_id = F.coalesce("key", F.try_variant_get("value", "$.id", "string"))
    contents = F.when(F.col("key").isNotNull(), F.to_json("value")).otherwise(F.to_json(F.try_variant_get("value", "$.contents", "variant")))
    return rows.select("file", "pos", record_id.alias("record_id"), contents.alias("contents"))


def archive_pieces(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Archives of any size cut after every closing brace, read in byte ranges by many tasks, with the state of each piece.

    A piece has its ``file``, range (``block``), number in it (``seq``) and ``text`` without the brace.  Braces in
    strings cut as well; whether a piece starts inside of a string follows from the quotes before it, and its depth
    from the brackets outside of strings: both are running sums, carried from range to range.  ``closed`` tells
    whether the brace is one of the structure, ``depth`` the depth behind it, ``record`` how many records (objects
    that are closed at depth one) ended before.
    """
    rows = spark.read.option("lineSep", "}").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.regexp_replace("value", "^\ufeff", "").alias("text"), F.octet_length("value").alias("bytes"))
    rows = cut_lineage(rows)
    # The last piece of a file has no brace if the file does not end with one (three bytes may be a byte order mark).
    ends = rows.groupBy("file").agg(F.sum(F.col("bytes") + 1).alias("read"), F.max("size").alias("whole"), F.max(F.struct("block", "seq")).alias("last"))
    ends = ends.select("file", "last", F.col("read").isin(F.col("whole"), F.col("whole") - 3).alias("ends_closed"))
    plain = F.regexp_replace("text", "(?s)\\\\.", "")  # without escaped characters
    outside = F.array_join(F.filter(F.split(plain, '"', -1), lambda _, i: i % 2 == 0), "")
    inside = F.array_join(F.filter(F.split(plain, '"', -1), lambda _, i: i % 2 == 1), "")

    def opened(text: Column) -> Column:
        return F.length(F.regexp_replace(text, "[^\\[{]", "")) - F.length(F.regexp_replace(text, "[^\\]]", ""))

    quotes = F.length(F.regexp_replace(plain, '[^"]', ""))
    rows = rows.join(ends, "file").select(
        "file", "block", "seq", "text", quotes.alias("quotes"), opened(outside).alias("if_out"), opened(inside).alias("if_in"),
        ((F.struct("block", "seq") != F.col("last")) | F.col("ends_closed")).alias("brace"))
    order, bucket = ["block", "seq"], F.col("block")
    rows = running(rows, ["file"], order, bucket, {"upto": F.col("quotes")})
    within, after = (F.col("upto") - F.col("quotes")) % 2 == 1, F.col("upto") % 2 == 1
    rows = rows.withColumn("closed", F.col("brace") & ~after)
    rows = running(rows, ["file"], order, bucket, {"depth": F.when(within, F.col("if_in")).otherwise(F.col("if_out")) - F.col("closed").cast("int")})
    rows = rows.withColumns({"open_string": after, "ends": F.col("closed") & (F.col("depth") == 1)})
    rows = running(rows, ["file"], order, bucket, {"upto": F.col("ends").cast("int")})
    return rows.select("file", "block", "seq", F.when(F.col("brace"), F.concat("text", F.lit("}"))).otherwise(F.col("text")).alias("text"),
                       "closed", "depth", "open_string", (F.col("upto") - F.col("ends").cast("int")).alias("record"))


def large_archive_records(pieces: DataFrame) -> DataFrame:
    """Records of archives in the layouts of ``archive_records``, put together from ``archive_pieces`` record by record.

    ``record_id`` is null where the text does not parse, or repeats a key inside one record's object.  Memory
    grows with the largest record, not with the archive.
    """
    part = F.struct("block", "seq", "text")
    groups = pieces.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "").alias("text"))  # one record's pieces
    first = groups.where("record = 0").select("file", F.regexp_extract("text", "^\\s*([\\[{])", 1).alias("opener"))
    last = groups.groupBy("file").agg(F.max("record").alias("last"))
    rows = groups.join(first, "file").join(last, "file")
    closer = F.when(F.col("opener") == "{", "}").otherwise("]")
    body = F.when(F.col("record") == 0, F.regexp_replace("text", "^\\s*[\\[{]", "")).otherwise(F.regexp_replace("text", "^\\s*,", ""))
    rows = rows.withColumn("body", body)
    # What follows the last record ends with the archive's own bracket.
    tail = F.regexp_replace("body", "\\s*[\\]}]\\s*$", "")
    rows = rows.withColumn("body", F.when(F.col("record") == F.col("last"), tail).otherwise(F.col("body"))).where(F.trim("body") != "")
    parsed = rows.select("file", "record", F.try_parse_json(F.concat("opener", "body", closer)).alias("v"))
    listed = parsed.sparkSession.sql("SELECT file, record, e.pos, e.key, e.value FROM {parsed}, LATERAL variant_explode_outer(v) AS e", parsed=parsed)
    record_id = F.coalesce("key", F.try_variant_get("value", "$.id", "string"))
    contents = F.when(F.col("key").isNotNull(), F.to_json("value")).otherwise(F.to_json(F.try_variant_get("value", "$.contents", "variant")))
    return listed.select("file", (F.col("record") + F.coalesce("pos", F.lit(0))).alias("pos"), record_id.alias("record_id"), contents.alias("contents"))


def large_archive_violations(pieces: DataFrame, records: DataFrame) -> DataFrame:
    """Archives that do not end at depth zero outside of strings, malformed records, and ids that occur again."""
    last = pieces.groupBy("file").agg(F.max_by(F.struct("depth", "open_string"), F.struct("block", "seq")).alias("end"), F.min("depth").alias("least"))
    broken = last.where((F.col("end.depth") != 0) | F.col("end.open_string") | (F.col("least") < 0)).select("file", F.lit("unreadable").alias("code"))
    malformed = records.where(F.col("record_id").isNull() | ~F.coalesce(F.col("contents").startswith("{"), F.lit(False))).select("file", F.lit("malformed_record").alias("code"))
    again = records.where("record_id IS NOT NULL").groupBy("file", "record_id").agg(F.count("*").alias("n")).where("n > 1").select("file", F.lit("repeated_id").alias("code"))
    return broken.unionByName(malformed).unionByName(again)


def archive_violations(documents: DataFrame, records: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Unreadable files, malformed records, repeated ids and wrong record counts (``expected``: file, records)."""
    large = F.octet_length("text") > LARGEST_DOCUMENT
    broken = documents.where(large | F.try_parse_json("text").isNull()).select(
        "file", F.when(large, "too_large").otherwise("unreadable_or_repeated_key").alias("code"))
    malformed = records.where(F.col("record_id").isNull() | ~F.coalesce(F.col("contents").startswith("{"), F.lit(False))).select("file", F.lit("malformed_record").alias("code"))
    again = records.groupBy("file", "record_id").agg(F.count("*").alias("n")).where("n > 1").select("file", F.lit("repeated_id").alias("code"))
    found = broken.unionByName(malformed).unionByName(again)
    if expected is not None:
        counts = records.groupBy("file").agg(F.count("*").alias("n"))
        wrong = expected.join(counts, "file", "left").where(F.coalesce("n", F.lit(0)) != F.col("records")).select("file", F.lit("record_count").alias("code"))
        found = found.unionByName(wrong)
    return found


def day_manifest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and digest of every day of a table, to be stored with it."""
    return table_digest(df, columns, by=["day"])


def day_violations(df: DataFrame, manifest: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Days that a table has and its manifest does not name, the other way round, or with other content: (day, code)."""
    now = day_manifest(df, columns).select("day", F.col("row_count").alias("n"), F.col("content_sha256").alias("actual"))
    joined = manifest.join(now, "day", "full_outer")
    code = (F.when(F.col("actual").isNull(), "missing_day").when(F.col("content_sha256").isNull(), "unlisted_day")
            .when((F.col("actual") != F.col("content_sha256")) | (F.col("n") != F.col("row_count")), "altered_day"))
    return joined.select("day", code.alias("code")).where("code IS NOT NULL")


def read_verified_days(spark: SparkSession, folder: str, columns: Sequence[str], **chosen) -> DataFrame:
    """``read_days`` of a folder with a ``_manifest``; a missing, unlisted or altered day among those chosen is an error."""
    df = read_days(spark, folder, **chosen)
    manifest = spark.read.parquet(f"{folder}/_manifest")
    first, last, ceiling = (chosen.get(k) for k in ("first_day", "last_day", "season_ceiling"))
    for limit, keep in ((first, F.col("day") >= F.to_date(F.lit(first))), (last, F.col("day") <= F.to_date(F.lit(last))),
                        (ceiling, F.year("day") <= F.lit(ceiling))):
        manifest = manifest if limit is None else manifest.where(keep)
    found = day_violations(df, manifest, columns).orderBy("day").limit(5).collect()
    if found:
        raise ValueError("days differ from their manifest: " + ", ".join(f"{r['day']} {r['code']}" for r in found))
    return df


def read_days(spark: SparkSession, folder: str, first_day: str | None = None, last_day: str | None = None, season_ceiling: int | None = None) -> DataFrame:
    """Chosen days of a table partitioned by season; partitions above the ceiling are pruned, not read."""
    df = spark.read.parquet(folder)
    if season_ceiling is not None:
        df = df.where(F.col("season") <= season_ceiling)
    if first_day is not None:
        df = df.where((F.col("season") >= int(first_day[:4])) & (F.col("day") >= F.to_date(F.lit(first_day))))
    if last_day is not None:
        df = df.where((F.col("season") <= int(last_day[:4])) & (F.col("day") <= F.to_date(F.lit(last_day))))
    return df
