"""Fingerprints and incremental publication of the daily tables; the season-sharded fact archive."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.digests import framed, segment_digest, table_digest
from tidemark.operators.audits import combine, repeated, violations
from tidemark.plans.segments import segment_days, write_segments
from tidemark.session import cut_lineage, exists


def day_fingerprints(prints: Mapping[str, DataFrame], settings: str) -> DataFrame:
    """Per day: rows per table and one digest over all tables' digests (day, row_count, content_sha256) and the settings."""
    days, parts = None, []
    for name, digest in prints.items():
        named = digest.select("day", F.col("row_count").alias(f"{name}_rows"), F.col("content_sha256").alias(f"__{name}"))
        days = named if days is None else days.join(named, "day", "full_outer")
        parts.append(F.col(f"__{name}"))
    whole = F.sha2(framed([F.lit(settings), *parts]), 256).alias("fingerprint")
    return days.select("day", *[F.coalesce(f"{n}_rows", F.lit(0)).alias(f"{n}_rows") for n in prints], whole)


@dataclass(frozen=True)
class DayTables:
    """Tables with a ``day`` column each; one job covers all days."""

    tables: Mapping[str, DataFrame]

    def fingerprints(self, columns: Mapping[str, Sequence[str]], settings: str) -> DataFrame:
        return day_fingerprints({name: table_digest(df, columns[name], by=["day"]) for name, df in self.tables.items()}, settings)


def input_fingerprints(inputs: Mapping[str, tuple[DataFrame, Sequence[str]]], settings: str, last_day: Column | None = None) -> DataFrame:
    """Per day: one digest over the input rows that are live on it, made before anything is built.

    Each input is a table with ``active_from`` and ``active_to`` and the columns that count.  Rows enter and
    leave running sums of digests, so nothing is expanded to days.
    """
    return day_fingerprints({name: segment_digest(df.withColumnsRenamed({"active_from": "from_day", "active_to": "to_day"}), columns, None, last_day)
                             for name, (df, columns) in inputs.items()}, settings)


def changed_days(current: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Days whose fingerprint is new or different."""
    if stored is None:
        return current.select("day")
    old = stored.select("day", F.col("fingerprint").alias("__old"))
    return current.join(old, "day", "left").where(~F.col("fingerprint").eqNullSafe(F.col("__old"))).select("day")


def vanished_days(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Days that were stored and are no longer built."""
    return stored.select("day").join(current.select("day"), "day", "left_anti")


def live_on(intervals: DataFrame, days: DataFrame, start: str = "active_from", stop: str = "active_to") -> DataFrame:
    """Rows live on one of ``days`` at least, found by the next of these days after a row's start.

    The calendar between the first and the last day is the only table made; rows meet it by equality.
    """
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    calendar = span.select(F.explode(F.sequence("a", "b")).alias("__at"))
    marked = calendar.join(days.select(F.col("day").alias("__at"), F.col("day").alias("__next")).distinct(), "__at", "left")
    ahead = Window.partitionBy(F.lit(1)).orderBy(F.col("__at").desc()).rowsBetween(Window.unboundedPreceding, 0)  # one row per calendar day
    following = marked.select("__at", F.min("__next").over(ahead).alias("__next"))
    first = span.select(F.col("a").alias("__first"))
    # A row that began before the calendar starts to count with its first day.
    rows = intervals.crossJoin(F.broadcast(first)).withColumn("__at", F.greatest(start, "__first")).drop("__first")  # one row
    met = rows.join(following, "__at")
    return met.where(F.col(stop).isNull() | (F.col("__next") < F.col(stop))).drop("__at", "__next")


class DayStore:
    """Daily tables in a folder, published as a whole: a reader sees the last publication or the one before.

    Every publication writes the days it rebuilt into folders of its own, then a manifest that names for each day
    its fingerprint and the publication that holds it, then one row that makes the manifest count.  When two
    writers take the same number, the smaller name wins.

    A table may be built as segments (``from_day``, ``to_day``) instead of days: it is stored as such, so a row that
    stays the same for many days is written once, and is read as the same days.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _latest(self) -> tuple[int, str | None]:
        if not exists(self.spark, f"{self.root}/published"):
            return 0, None
        rows = self.spark.read.schema("number int, publication string").parquet(f"{self.root}/published")
        newest = rows.groupBy("number").agg(F.min("publication").alias("publication")).orderBy(F.desc("number")).first()
        return (newest["number"], newest["publication"]) if newest else (0, None)

    def manifest(self) -> DataFrame | None:
        """(day, fingerprint, publication) of every day that counts."""
        name = self._latest()[1]
        return None if name is None else self.spark.read.parquet(f"{self.root}/manifest/{name}")

    def publish(self, fingerprints: DataFrame, builders: Mapping[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
        """Build and publish the days whose fingerprint changed, and return them; days without a fingerprint drop out.

        A builder gets the days (one column) and returns its table for these days only, or segments that hold on
        them: days of a segment that were not rebuilt do not count, as the manifest names another publication.
        """
        number, name = self._latest()[0] + 1, uuid.uuid4().hex
        fingerprints, old = cut_lineage(fingerprints.select("day", "fingerprint")), self.manifest()
        days = cut_lineage(changed_days(fingerprints, old))
        for table, build in builders.items():
            rows = build(days)
            if "from_day" in rows.columns:
                write_segments(live_on(rows, days, "from_day", "to_day"), f"{self.root}/{table}/publication={name}")
                continue
            rows = rows.hint("rebalance", F.col("day"))
            rows.write.option("compression", "zstd").partitionBy("day").parquet(f"{self.root}/{table}/publication={name}")
        entries = fingerprints.join(days.withColumn("publication", F.lit(name)), "day", "left")
        if old is not None:
            kept = old.select("day", F.col("publication").alias("__kept"))
            entries = entries.join(kept, "day", "left").withColumn("publication", F.coalesce("publication", "__kept")).drop("__kept")
        entries.coalesce(1).write.parquet(f"{self.root}/manifest/{name}")
        row = self.spark.range(1).select(F.lit(number).cast("int").alias("number"), F.lit(name).alias("publication"))
        row.write.mode("append").parquet(f"{self.root}/published")
        return days

    def read(self, table: str) -> DataFrame:
        """A table's days that count; only the folders of publications that hold one are listed."""
        manifest = self.manifest()
        names = [r[0] for r in manifest.select("publication").distinct().collect()]  # one per publication still in use
        folders = [f"{self.root}/{table}/publication={n}" for n in names]
        rows = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*folders)
        if "from_day" in rows.columns:
            last = manifest.agg(F.max("day")).first()[0]  # of segments without an end
            rows = segment_days(rows.drop("enters", "leaves"), None, F.lit(last))
        return rows.join(manifest.select("day", "publication"), ["day", "publication"], "left_semi").drop("publication")


def query_descriptors(games: DataFrame) -> DataFrame:
    """What may be known of a game beforehand: no score column survives."""
    return games.select(F.year("day").alias("season"), "day", "group_id", "home_id", "away_id")


def archive_violations(labels: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Labels without a descriptor, with other sides than their descriptor, and repeated descriptors.

    ``labels``: group_id, entity_id, side_id, other_side_id.
    """
    known = descriptors.groupBy("group_id").agg(F.min(F.struct("home_id", "away_id")).alias("d"))
    joined = labels.join(known, "group_id", "left")
    fits = F.array_contains(F.array(F.col("d.home_id"), F.col("d.away_id")), F.col("side_id")) & F.array_contains(
        F.array(F.col("d.home_id"), F.col("d.away_id")), F.col("other_side_id")) & (F.col("side_id") != F.col("other_side_id"))
    return combine(
        violations(joined, [
            ("descriptor_missing", F.col("d").isNull(), "label has no descriptor"),
            ("sides_conflict", F.col("d").isNotNull() & ~fits, "label sides differ from the descriptor"),
        ], F.col("group_id"), F.col("entity_id")),
        repeated(descriptors, ["group_id"], "duplicate_descriptor", "descriptor occurs", F.col("group_id")))


def archive_shards(facts: DataFrame, descriptors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and digests of the season shards an archive consists of."""
    labels = table_digest(facts.withColumn("season", F.year("day")), columns, by=["season"]).select("season", F.lit("labels").alias("shard"), "row_count", "content_sha256")
    asked = table_digest(descriptors, ["group_id", "home_id", "away_id"], by=["season"]).select("season", F.lit("descriptors").alias("shard"), "row_count", "content_sha256")
    return labels.unionByName(asked)


def unsealed(df: DataFrame, year_ceiling: int, season: Column | None = None) -> DataFrame:
    """Rows up to a season; on a season-partitioned table later partitions are not read."""
    return df.where((F.col("season") if season is None else season) <= year_ceiling)
