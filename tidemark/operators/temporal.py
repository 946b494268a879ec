"""Bitemporal selection over append-only revisions.

A revision carries ``event_at``, ``available_at``, ``ingested_at`` and
``[valid_from, valid_to)``.  A read names a cutoff and a knowledge time; what a
reader at that moment could not have known stays invisible, and a correction
hides what it replaced even when the correction itself is not shown.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digests import table_digest
from tidemark.plans.ordered import top_k

PUBLICATION_ORDER = ("available_at", "ingested_at", "valid_from")
VALIDITY_ORDER = ("valid_from", "available_at", "ingested_at")


def moment(value: Any) -> Column:
    return value if isinstance(value, Column) else F.to_timestamp(F.lit(str(value)))


def _latest_first(order: Sequence[str], row_id: str) -> list[Column]:
    return [F.col(name).desc() for name in (*order, row_id)]


def known_at(cutoff: Any, knowledge: Any) -> Column:
    return (F.col("available_at") <= moment(cutoff)) & (F.col("ingested_at") <= moment(knowledge))


def valid_at(at: Any) -> Column:
    at = moment(at)
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def without_superseded(df: DataFrame, superseded: DataFrame | None, source: str = "source_id") -> DataFrame:
    """Drop rows of replaced sources; rows without a source stay (an anti join keeps NULL keys)."""
    if superseded is None:
        return df
    return df.join(superseded.select(source), source, "left_anti")


def matching(df: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Equality, membership and NULL filters; an empty list matches nothing."""
    for name, wanted in filters.items():
        if name not in df.columns:
            raise ValueError(f"unknown filter column: {name}")
        if wanted is None:
            df = df.where(F.col(name).isNull())
        elif isinstance(wanted, (list, tuple, set, frozenset)):
            df = df.where(F.col(name).isin(list(wanted)) if wanted else F.lit(False))
        else:
            df = df.where(F.col(name) == F.lit(wanted))
    return df


def _finish(df: DataFrame, cutoff: Any, observed_before_cutoff: bool, filters: Mapping[str, Any] | None) -> DataFrame:
    # After the ranking on purpose: a correction that moves an event past the
    # cutoff must not let the row it replaced come back.
    if observed_before_cutoff:
        df = df.where(F.col("event_at") < moment(cutoff))
    return matching(df, filters or {})


def as_of_latest(df: DataFrame, keys: Sequence[str], row_id: str, cutoff: Any, knowledge: Any = None, *,
                 superseded: DataFrame | None = None, source: str = "source_id",
                 observed_before_cutoff: bool = False, filters: Mapping[str, Any] | None = None,
                 order: Sequence[str] = PUBLICATION_ORDER) -> DataFrame:
    """Latest known revision of each key."""
    known = without_superseded(df.where(known_at(cutoff, knowledge or cutoff)), superseded, source)
    latest = top_k(known, keys, _latest_first(order, row_id))
    return _finish(latest, cutoff, observed_before_cutoff, filters)


def as_of_current(df: DataFrame, keys: Sequence[str], row_id: str, cutoff: Any, knowledge: Any = None, *,
                  superseded: DataFrame | None = None, source: str = "source_id",
                  observed_before_cutoff: bool = False, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """Version of each key in force at the cutoff, after folding corrections of the same ``valid_from``."""
    known = without_superseded(df.where(known_at(cutoff, knowledge or cutoff)), superseded, source)
    corrected = top_k(known, [*keys, "valid_from"], _latest_first(("available_at", "ingested_at"), row_id))
    current = top_k(corrected.where(valid_at(cutoff)), keys, _latest_first(VALIDITY_ORDER, row_id))
    return _finish(current, cutoff, observed_before_cutoff, filters)


def annual_snapshots(sources: DataFrame, *, policy: str = "annual_snapshot", expected_id: Column | None = None,
                     metadata: str = "metadata_json", source: str = "source_id") -> DataFrame:
    """Sources whose metadata says that they replace a whole season of their provider."""
    meta = F.when(F.try_parse_json(metadata).isNotNull(), F.col(metadata))

    def field(name: str) -> Column:
        return F.get_json_object(meta, f"$.{name}")

    typed = sources.withColumns({
        "season": field("season").try_cast("int"),
        "adapter_version": field("adapter_version").try_cast("int"),
        "snapshot_policy": F.coalesce(field("snapshot_policy"), F.lit(policy)),
    })
    kept = typed.where(F.col("season").between(2000, 2099) & (F.col("adapter_version") >= 1)
                       & (F.col("snapshot_policy") == policy))
    return kept if expected_id is None else kept.where(F.col(source) == expected_id)


def superseded_sources(sources: DataFrame, knowledge: Any = None, *, provider: str = "provider",
                       source: str = "source_id", **contract: Any) -> DataFrame:
    """Snapshots replaced by a later one of the same provider and season."""
    annual = annual_snapshots(sources, source=source, **contract)
    if knowledge is not None:
        annual = annual.where(F.col("ingested_at") <= moment(knowledge))
    newest_first = [F.col(c).desc() for c in ("ingested_at", "adapter_version", source)]
    winners = top_k(annual, [provider, "season"], newest_first).select(source)
    return annual.join(winners, source, "left_anti")


def latest_run(runs: DataFrame, run_key: str, row_id: str, run_id: Any, knowledge: Any) -> DataFrame:
    """The revision of one run known at ``knowledge``; an unknown run is an error."""
    found = as_of_latest(runs, [run_key], row_id, knowledge, knowledge, filters={run_key: run_id})
    if found.isEmpty():
        raise KeyError(f"unknown run: {run_id}")
    return found


def label_snapshot(df: DataFrame, keys: Sequence[str], row_id: str, knowledge: Any, *,
                   groups: DataFrame | None = None, group: str = "group_id") -> DataFrame:
    """Latest version known, dropped when expired, kept only for groups with a final result."""
    at = moment(knowledge)
    seen = df.where((F.col("ingested_at") <= at) & (F.col("available_at") <= at) & (F.col("valid_from") <= at))
    latest = top_k(seen, keys, _latest_first(VALIDITY_ORDER, row_id))
    current = latest.where(F.col("valid_to").isNull() | (F.col("valid_to") > at))
    return current if groups is None else current.join(groups.select(group).distinct(), group, "left_semi")


def canonical_view(facts: DataFrame, groups: DataFrame, group_key: Sequence[str],
                   dimensions: Iterable[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Facts of known groups with their descriptions (each input already reduced to its latest rows)."""
    view = facts.join(groups, list(group_key), "inner")
    for dimension, on in dimensions:
        view = view.join(dimension, list(on), "left")
    return view


@dataclass(frozen=True)
class SnapshotSpec:
    """How one table enters a snapshot; run-scoped generated rows use the knowledge clock as cutoff."""

    name: str
    keys: tuple[str, ...]
    row_id: str
    columns: tuple[str, ...]
    current_only: bool = False
    observed_before_cutoff: bool = False
    generated: bool = False
    filters: tuple[tuple[str, Any], ...] = ()


def snapshot_tables(tables: Mapping[str, DataFrame], specs: Sequence[SnapshotSpec], cutoff: Any, knowledge: Any,
                    superseded: DataFrame | None = None) -> dict[str, DataFrame]:
    result = {}
    for spec in specs:
        read = as_of_current if spec.current_only else as_of_latest
        result[spec.name] = read(
            tables[spec.name], list(spec.keys), spec.row_id, knowledge if spec.generated else cutoff, knowledge,
            superseded=superseded if "source_id" in tables[spec.name].columns else None,
            observed_before_cutoff=spec.observed_before_cutoff, filters=dict(spec.filters),
        ).select(*spec.columns)
    return result


def snapshot_manifest(snapshot: Mapping[str, DataFrame], specs: Sequence[SnapshotSpec]) -> DataFrame:
    """One row per table: row count, content digest, read mode."""
    manifest = None
    for spec in specs:
        row = table_digest(snapshot[spec.name], spec.columns).select(
            F.lit(spec.name).alias("table_name"), "row_count", "content_sha256",
            F.lit(spec.current_only).alias("current_only"),
            F.lit(spec.observed_before_cutoff).alias("observed_before_cutoff"))
        manifest = row if manifest is None else manifest.unionByName(row)
    return manifest


def manifest_fingerprint(manifest: DataFrame, cutoff: Any, knowledge: Any) -> DataFrame:
    """One digest over the (small, one row per table) manifest and the two clocks."""
    line = F.concat_ws("|", "table_name", F.col("row_count").cast("string"), "content_sha256",
                       F.col("current_only").cast("string"), F.col("observed_before_cutoff").cast("string"))
    body = F.concat_ws("\n", F.lit(str(cutoff)), F.lit(str(knowledge)), F.concat_ws("\n", F.sort_array(F.collect_list(line))))
    return manifest.agg(F.sha2(body, 256).alias("fingerprint"), F.sum("row_count").alias("row_count"))


def validate_revisions(batch: DataFrame, row_id: str, history: DataFrame | None = None) -> DataFrame:
    """Violations of the clock rules and of id immutability as ``(row_id, code)`` rows."""
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing_{c}"))
               for c in ("event_at", "available_at", "ingested_at", "valid_from")]
    rules = [*missing,
             F.when(F.col("ingested_at") < F.col("available_at"), F.lit("ingested_before_available")),
             F.when(F.col("valid_to") <= F.col("valid_from"), F.lit("validity_not_positive"))]
    found = batch.select(row_id, F.explode(F.array_compact(F.array(*rules))).alias("code"))
    repeated = (batch.groupBy(row_id).agg(F.count("*").alias("n")).where("n > 1")
                .select(row_id, F.lit("duplicate_in_batch").alias("code")))
    found = found.unionByName(repeated)
    if history is not None:
        known = (batch.select(row_id).distinct().join(history.select(row_id), row_id, "left_semi")
                 .select(row_id, F.lit("already_stored").alias("code")))
        found = found.unionByName(known)
    return found
