"""Bitemporal selection on hand-written corrections."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, temporal

SCHEMA = ("entity string, row_id string, source_id string, event_at timestamp, available_at timestamp, "
          "ingested_at timestamp, valid_from timestamp, valid_to timestamp")


def at(day, hour=0):
    return datetime(2024, 1, day, hour)


def row(entity, row_id, event=1, available=2, ingested=2, valid_from=1, valid_to=None, source="s"):
    return (entity, row_id, source, at(event), at(available), at(ingested), at(valid_from), None if valid_to is None else at(valid_to))


def ids(df):
    return sorted(r["row_id"] for r in df.collect())


@pytest.fixture(scope="module")
def frame(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def test_correction_after_cutoff_or_knowledge_is_invisible(frame):
    df = frame(row("a", "a1"), row("a", "a2", available=12), row("b", "b1"), row("b", "b2", available=3, ingested=12))
    assert ids(temporal.as_of_latest(df, ["entity"], "row_id", at(10))) == ["a1", "b1"]
    assert ids(temporal.as_of_latest(df, ["entity"], "row_id", at(10), at(13))) == ["a1", "b2"]


def test_equal_clocks_end_in_the_row_id(frame):
    assert ids(temporal.as_of_latest(frame(row("a", "a1"), row("a", "a2")), ["entity"], "row_id", at(10))) == ["a2"]


def test_correction_that_closes_a_version_does_not_resurrect_the_older_one(frame):
    df = frame(row("a", "old", valid_from=1), row("a", "new", valid_from=3, available=3, ingested=3),
               row("a", "close", valid_from=3, available=4, ingested=4, valid_to=5))
    assert ids(temporal.as_of_current(df, ["entity"], "row_id", at(10))) == ["old"]
    assert ids(temporal.as_of_current(df, ["entity"], "row_id", at(4, 12))) == ["close"]


def test_version_valid_only_later_is_not_current(frame):
    df = frame(row("a", "now", valid_from=1), row("a", "later", valid_from=20, available=3, ingested=3))
    assert ids(temporal.as_of_current(df, ["entity"], "row_id", at(10))) == ["now"]


def test_event_moved_past_the_cutoff_hides_the_row_it_corrects(frame):
    df = frame(row("a", "first", event=1), row("a", "moved", event=20, available=3, ingested=3))
    assert ids(temporal.as_of_latest(df, ["entity"], "row_id", at(10), observed_before_cutoff=True)) == []


def test_filters_apply_after_the_ranking(frame):
    df = frame(row("a", "a1", source="x"), row("a", "a2", available=3, ingested=3, source=None), row("b", "b1", source="x"))
    latest = lambda **f: ids(temporal.as_of_latest(df, ["entity"], "row_id", at(10), filters=f))
    assert latest(source_id="x") == ["b1"]
    assert latest(source_id=None) == ["a2"]
    assert latest(source_id=[]) == []
    assert latest(source_id=["x", "y"]) == ["b1"]
    with pytest.raises(ValueError):
        latest(unknown=1)


def test_superseded_sources_need_a_complete_contract(spark, frame):
    meta = '{"season":"2024","adapter_version":"%s","dataset_revision":"%s"%s}'
    rows = [("p", "r1:1", meta % (1, "r1", ""), at(1)), ("p", "r2:1", meta % (1, "r2", ""), at(2)), ("p", "r2:2", meta % (2, "r2", ""), at(2)),
            ("p", "other", meta % (1, "r0", ""), at(1)), ("p", "r3:1", meta % (1, "r3", ',"snapshot_policy":"rolling"'), at(1)),
            ("p", "bad", "not json", at(1)), ("q", "r1:1q", meta % (1, "r1", ""), at(1))]
    sources = spark.createDataFrame(rows, "provider string, source_id string, metadata_json string, ingested_at timestamp")
    expected = F.concat_ws(":", F.get_json_object("metadata_json", "$.dataset_revision"), F.get_json_object("metadata_json", "$.adapter_version"))
    valid = sources.where("source_id <> 'bad'").unionByName(sources.where("source_id = 'bad'"))
    replaced = temporal.superseded_sources(valid, expected_id=F.when(F.try_parse_json("metadata_json").isNotNull(), expected))
    assert sorted(r["source_id"] for r in replaced.collect()) == ["r1:1", "r2:1"]
    early = temporal.superseded_sources(valid, at(1, 12), expected_id=F.when(F.try_parse_json("metadata_json").isNotNull(), expected))
    assert early.count() == 0
    df = frame(row("a", "a1", source="r1:1"), row("a", "a2", available=1, ingested=1, source=None), row("b", "b1", source="r2:2"))
    assert ids(temporal.as_of_latest(df, ["entity"], "row_id", at(10), superseded=replaced)) == ["a2", "b1"]


def test_label_snapshot_drops_expired_and_unscored(spark, frame):
    df = frame(row("a", "a1"), row("b", "b1", valid_to=4), row("c", "c1"))
    groups = spark.createDataFrame([("a",), ("b",)], "entity string")
    assert ids(temporal.label_snapshot(df, ["entity"], "row_id", at(10), groups=groups, group="entity")) == ["a1"]


def test_latest_run_must_exist(frame):
    df = frame(row("run", "r1"))
    assert ids(temporal.latest_run(df, "entity", "row_id", "run", at(10))) == ["r1"]
    with pytest.raises(KeyError):
        temporal.latest_run(df, "entity", "row_id", "other", at(10))


def test_revision_rules(spark, frame):
    df = frame(row("a", "a1", available=5, ingested=4), row("b", "b1", valid_from=3, valid_to=3), row("c", "dup"), row("d", "dup"))
    known = spark.createDataFrame([("b1",)], "row_id string")
    found = {(r["row_id"], r["code"]) for r in temporal.validate_revisions(df, "row_id", known).collect()}
    assert found == {("a1", "ingested_before_available"), ("b1", "validity_not_positive"), ("dup", "duplicate_in_batch"), ("b1", "already_stored")}


def test_snapshot_fingerprint_depends_on_content_only(frame):
    spec = [temporal.SnapshotSpec("t", ("entity",), "row_id", ("entity", "row_id"))]
    rows = [row("a", "a1"), row("b", "b1"), row("c", "c1")]

    def fingerprint(*data):
        tables = temporal.snapshot_tables({"t": frame(*data)}, spec, at(10), at(10))
        return temporal.manifest_fingerprint(temporal.snapshot_manifest(tables, spec), at(10), at(10)).first()["fingerprint"]

    assert fingerprint(*rows) == fingerprint(*reversed(rows))
    assert fingerprint(*rows) != fingerprint(*rows[:2])


def brute_force(rows, day, window):
    cutoff = at(day)
    best = {}
    for r in rows:
        entity, row_id, _, event, available, ingested, valid_from, valid_to = r
        if available <= cutoff and ingested <= cutoff and valid_from <= cutoff and event.date() < cutoff.date():
            rank = (valid_from, available, ingested, row_id)
            if entity not in best or rank > best[entity][0]:
                best[entity] = (rank, event, valid_to, row_id)
    return sorted(r for _, e, v, r in best.values() if (v is None or v > cutoff) and (cutoff.date() - e.date()).days <= window)


def test_intervals_match_a_day_by_day_selection(frame):
    rows = [row("a", "a1", 1, 2, 2, 1), row("a", "a2", 1, 5, 5, 1), row("a", "a3", 1, 7, 8, 2, 12), row("b", "b1", 3, 4, 4, 3, 6), row("b", "b2", 2, 9, 9, 2),
            row("c", "c1", 10, 3, 3, 3), row("d", "d1", 1, 2, 2, 6), row("d", "d2", 4, 3, 3, 4)]
    intervals = history.competition_intervals(frame(*rows), ["entity"], "row_id", window_days=9).cache()
    for day in range(1, 28):
        live = history.active_on_days(intervals, f"2024-01-{day:02d}", f"2024-01-{day:02d}")
        assert ids(live) == brute_force(rows, day, 9), day


def test_fingerprint_returns_when_the_state_returns(frame):
    rows = [row("a", "a1", 1, 2, 2, 1), row("b", "b1", 1, 4, 4, 1, 6)]
    intervals = history.competition_intervals(frame(*rows), ["entity"], "row_id")
    prints = {str(r["day"]): tuple(r)[1:] for r in history.xor_fingerprints(intervals, F.sha2("row_id", 256)).collect()}
    assert prints["2024-01-02"] == prints["2024-01-06"]
    assert prints["2024-01-04"][0] == 2


def test_marker_between_is_strict(spark):
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 3, "b"), ("g", 3, "c"), ("g", 5, "d"), ("h", 2, "e")], "g string, n int, id string")
    markers = spark.createDataFrame([("g", 3), ("g", 4), ("g", 4)], "g string, n int")
    found = history.marker_between(rows, markers, ["g"], ["n"], F.col("n"), tie=["id"])
    assert {r["id"]: r["marker_between"] for r in found.collect()} == {"a": False, "b": False, "c": False, "d": True, "e": False}


def test_band_edges(spark):
    bands = spark.createDataFrame([("a", 0.0, 0.5, 2.0), ("a", 0.5, 1.0, 1.0)], "position string, low double, high double, multiplier double")
    rates = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 0.2)], "position string, rate double")
    found = {(r["position"], r["rate"]): r["multiplier"] for r in history.band_lookup(rates, bands, "rate", ["position"]).collect()}
    assert found == {("a", 0.0): 2.0, ("a", 0.5): 1.0, ("a", 1.0): 1.0, ("b", 0.2): None}
