"""Writing tables and reports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.temporal import SnapshotSpec, manifest_fingerprint, snapshot_manifest, snapshot_tables
from tidemark.session import cut_lineage, exists, scratch_folder  # noqa: F401


class AppendError(ValueError):
    """Rows that may not be appended."""


def rows_to_append(existing: DataFrame | None, new: DataFrame, row_key: Sequence[str], columns: Sequence[str], required: Sequence[str]) -> DataFrame:
    """New rows not stored yet, each key once; unknown or missing columns are an error."""
    unknown = sorted(set(new.columns) - set(columns))
    if unknown:
        raise AppendError(f"unknown columns: {', '.join(unknown)}")
    missing = sorted(set(required) - set(new.columns))
    if missing:
        raise AppendError(f"missing required columns: {', '.join(missing)}")
    once = new.dropDuplicates(list(row_key))
    return once if existing is None else once.join(existing.select(*row_key), list(row_key), "left_anti")


class VersionedTable:
    """Append-only folder: the rows of an append become visible with its manifest row, so it is all or nothing.

    Every attempt writes a folder of its own, and the manifest row names the folder that counts.  Rows are
    bucketed by a hash of their key, so an append reads back only the buckets it touches.  When two writers
    take the same version, the smaller attempt name wins and the other one appends again.
    """

    def __init__(self, spark: SparkSession, root: str, row_key: Sequence[str], schema: T.StructType, required: Sequence[str] = (), buckets: int = 64):
        self.spark, self.root, self.row_key, self.schema, self.required = spark, root.rstrip("/"), list(row_key), schema, list(required)
        self.buckets = buckets

    def _attempts(self, version: int | None = None) -> dict[int, str]:
        """Attempt that counts per version: one manifest row per append."""
        if not exists(self.spark, f"{self.root}/manifest"):
            return {}
        rows = self.spark.read.schema("version int, attempt string").parquet(f"{self.root}/manifest").groupBy("version").agg(F.min("attempt").alias("attempt")).collect()
        return {r["version"]: r["attempt"] for r in rows if version is None or r["version"] <= version}

    def version(self) -> int:
        return max(self._attempts(), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        stored = self._stored(self._attempts(version).values())
        return None if stored is None else stored.drop("bucket")

    def _stored(self, attempts) -> DataFrame | None:
        folders = [f"{self.root}/data/attempt={a}" for a in attempts]
        if not folders:
            return None
        full = T.StructType([*self.schema.fields, T.StructField("attempt", T.StringType()), T.StructField("bucket", T.IntegerType())])
        # Every folder is named, so what an attempt that failed left behind is not listed.
        return self.spark.read.schema(full).option("basePath", f"{self.root}/data").parquet(*folders).drop("attempt")

    def append(self, rows: DataFrame, tries: int = 20) -> int:
        """Store the rows not there yet and return the new version."""
        bucket = F.pmod(F.xxhash64(*self.row_key), F.lit(self.buckets)).cast("int")
        for _ in range(tries):
            attempts = self._attempts()
            at = max(attempts, default=0)
            stored = self._stored(attempts.values())
            if stored is not None and set(self.row_key) <= set(rows.columns):
                touched = [r[0] for r in rows.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
                stored = stored.where(F.col("bucket").isin(touched))
            fresh = rows_to_append(stored, rows, self.row_key, self.schema.names, self.required)
            for field in self.schema.fields:
                if field.name not in fresh.columns:
                    fresh = fresh.withColumn(field.name, F.lit(None).cast(field.dataType))
            attempt = uuid.uuid4().hex
            fresh = fresh.select(*self.schema.names, bucket.alias("bucket"))
            fresh.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/data/attempt={attempt}")
            row = self.spark.range(1).select(F.lit(at + 1).cast("int").alias("version"), F.lit(attempt).alias("attempt"))
            row.write.mode("append").parquet(f"{self.root}/manifest")
            if self._attempts()[at + 1] == attempt:
                return at + 1
        raise AppendError(f"other writers took the version {tries} times")


def write_zstd(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_season_shards(df: DataFrame, path: str, season: str = "season", mode: str = "overwrite") -> None:
    """One folder per season; rewriting replaces only the seasons present in ``df``.

    Spark rebalances the rows by season and size, so a large season is written by as many tasks as it needs.
    """
    spread = df.hint("rebalance", F.col(season))
    spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(season).parquet(path)


def write_predictions(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Predictions of one task with exactly the declared columns and types."""
    absent = sorted(set(schema.names) - set(df.columns))
    if absent:
        raise AppendError(f"missing prediction columns: {', '.join(absent)}")
    write_zstd(df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]), path)


def _sorted(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
    return value


def report_text(report: DataFrame) -> DataFrame:
    """A one-row report as JSON with sorted keys on every level."""
    row = F.struct(*[_sorted(F.col(f.name), f.dataType).alias(f.name) for f in sorted(report.schema.fields, key=lambda f: f.name)])
    return report.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    report_text(report).write.mode("overwrite").text(path)


class SnapshotConflict(RuntimeError):
    """A snapshot folder already holds other content."""


def stored_fingerprint(spark: SparkSession, folder: str) -> str | None:
    return spark.read.text(f"{folder}/fingerprint").first()[0] if exists(spark, f"{folder}/fingerprint") else None


def publish_snapshot(spark: SparkSession, tables: Mapping[str, DataFrame], specs: Sequence[SnapshotSpec], cutoff: Any, knowledge: Any,
                     folder: str, superseded: DataFrame | None = None) -> bool:
    """Write a point-in-time snapshot; equal content is reused (``False``), other content in the folder is an error.

    Each table is stored for the two passes over it, digest and write.  The fingerprint is
    written last, so a reader never sees half a snapshot.
    """
    snapshot = {name: cut_lineage(df) for name, df in snapshot_tables(tables, specs, cutoff, knowledge, superseded).items()}
    manifest = cut_lineage(snapshot_manifest(snapshot, specs).coalesce(1))
    fingerprint = manifest_fingerprint(manifest, cutoff, knowledge).first()["fingerprint"]
    stored = stored_fingerprint(spark, folder)
    if stored == fingerprint:
        return False
    if stored is not None:
        raise SnapshotConflict(f"{folder} holds a snapshot with other content")
    for name, df in snapshot.items():
        write_zstd(df, f"{folder}/tables/{name}", "overwrite")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    spark.range(1).select(F.lit(fingerprint).alias("value")).write.mode("overwrite").text(f"{folder}/fingerprint")
    return True


def verify_snapshot(spark: SparkSession, folder: str, specs: Sequence[SnapshotSpec]) -> DataFrame:
    """Tables whose stored files no longer give the row count and digest of the manifest."""
    stored = spark.read.parquet(f"{folder}/manifest")
    again = snapshot_manifest({s.name: spark.read.parquet(f"{folder}/tables/{s.name}") for s in specs}, specs)
    actual = again.select("table_name", F.col("row_count").alias("actual_rows"), F.col("content_sha256").alias("actual_sha256"))
    joined = stored.join(actual, "table_name", "full_outer")
    same = F.col("content_sha256").eqNullSafe(F.col("actual_sha256")) & F.col("row_count").eqNullSafe(F.col("actual_rows"))
    return joined.where(~same).select("table_name", "row_count", "actual_rows")
