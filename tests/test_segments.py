"""Segments of days, and totals over them, against tables expanded day by day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph_audit
from tidemark.plans import segments

START = dt.date(2023, 11, 20)


def day(k):
    return START + dt.timedelta(days=k)


def intervals(seed, n, longest, open_share=0.0):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(0, 150)
        end = None if rng.random() < open_share else day(a + rng.randint(0, longest))
        rows.append((rng.choice("kkkklm"), day(a), end, rng.randint(0, 5), rng.choice([None, rng.randint(-50, 50)])))
    return rows


def brute_days(rows, last):
    found = {}
    for k in range(last + 1):
        for key in "klm":
            live = [r for r in rows if r[0] == key and r[1] <= day(k) and (r[2] is None or r[2] > day(k))]
            if live:
                found[key, day(k)] = (len(live), sum(r[3] for r in live), max((r[4] for r in live if r[4] is not None), default=None))
    return found


@pytest.mark.parametrize("block", [1, 7, 32])
@pytest.mark.parametrize("longest,open_share", [(3, 0.0), (40, 0.0), (90, 0.1)])
def test_state_matches_day_by_day(spark, block, longest, open_share):
    rows = intervals(block * longest, 120, longest, open_share)
    df = spark.createDataFrame(rows, "k string, active_from date, active_to date, v int, m int")
    state = segments.state_segments(df, ["k"], ["v"], ["m"], block_days=block)
    days = segments.segment_days(state, None, F.to_date(F.lit(str(day(300)))))
    found = {(r["k"], r["day"]): (r["versions"], r["v"], r["m"]) for r in days.collect()}
    assert found == brute_days(rows, 300)


def test_totals_need_no_days(spark):
    rows = [r for r in intervals(5, 200, 60) if r[2] is None or r[1] < r[2]]
    df = spark.createDataFrame(rows, "k string, from_day date, to_day date, v int, m int")
    until = {"early": F.date_add("from_day", 5)}
    totals = segments.day_totals(df, ["k"], {"n": F.lit(1), "third": F.col("v") / 3, "early": F.lit(1)}, until=until)
    found = {(r["k"], r["day"]): (int(r["n"]), float(r["third"]), int(r["early"])) for r in totals.collect()}
    expected = {}
    for k, a, b, v, _ in rows:
        for d in range((b - a).days):
            n, third, early = expected.get((k, a + dt.timedelta(days=d)), (0, 0.0, 0))
            expected[k, a + dt.timedelta(days=d)] = (n + 1, third + v / 3, early + (d < 5))
    assert found.keys() == expected.keys()
    assert all(found[key] == pytest.approx(expected[key]) for key in found)


def test_digest_of_segments_is_the_digest_of_their_days(spark):
    from tidemark.functions.digests import segment_digest, table_digest

    rows = [r for r in intervals(6, 60, 30) if r[1] < r[2]]
    df = spark.createDataFrame(rows, "k string, from_day date, to_day date, v int, m int")
    days = table_digest(segments.segment_days(df), ["k", "v", "m"], by=["day"])
    assert sorted(map(tuple, segment_digest(df, ["k", "v", "m"]).collect())) == sorted(map(tuple, days.collect()))


def test_route_coverage_counts_overlaps_and_seasons(spark):
    rows = [("r", "a", "b", day(0), day(60), 0.0), ("r", "a", "b", day(50), day(70), 0.0), ("r", "a", "c", day(0), day(5), 0.0)]
    df = spark.createDataFrame(rows, "route string, source string, destination string, from_day date, to_day date, count_log double")
    out = {r["season"]: r for r in graph_audit.route_coverage(df, {"r": 100}).collect()}
    assert [(out[y]["stored_edges"], out[y]["unique_edges"], out[y]["duplicate_edges"], out[y]["unique_pairs"]) for y in (2023, 2024)] == [(47, 47, 0, 2), (38, 28, 10, 1)]


def test_a_day_is_read_from_its_blocks(spark, tmp_path):
    rows = [r for r in intervals(7, 100, 80, 0.2) if r[2] is None or r[1] < r[2]]
    df = spark.createDataFrame(rows, "k string, from_day date, to_day date, v int, m int")
    segments.write_segments(df, str(tmp_path / "store"))
    stored = spark.read.parquet(str(tmp_path / "store"))
    for at in (0, 63, 150, 400):
        found = sorted((tuple(r) for r in segments.segments_on(stored, str(day(at))).select("k", "v", "m").collect()), key=repr)
        assert found == sorted(((r[0], r[3], r[4]) for r in rows if r[1] <= day(at) and (r[2] is None or r[2] > day(at))), key=repr)


@pytest.mark.parametrize("combine", [True, False])
def test_states_are_found_across_batches_without_cutting_intervals(spark, monkeypatch, combine):
    from decimal import Decimal

    monkeypatch.setattr(segments, "BATCH_ROWS", 3)
    rows = [(r[0] if r[0] != "m" else None, *r[1:], Decimal(r[3]) / 4, r[3] / 7) for r in intervals(11, 400, 90, 0.1)]
    df = spark.createDataFrame(rows, "k string, active_from date, active_to date, v int, m int, d decimal(9,2), f double")
    state = segments.state_segments(df, ["k"], ["v", "d", "f"], ["m"], combine=combine)
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1 + combine  # intervals are not listed by block or day
    days = segments.segment_days(state, None, F.to_date(F.lit(str(day(300))))).collect()
    assert {(r["k"] or "m", r["day"]): (r["versions"], r["v"], r["m"]) for r in days} == brute_days([(r[0] or "m", *r[1:]) for r in rows], 300)
    assert all(r["d"] * 4 == r["v"] and r["f"] == pytest.approx(r["v"] / 7) for r in days)


def test_totals_of_side_edges_are_those_of_the_listed_days(spark):
    from tidemark.operators import relations

    rng = random.Random(4)
    rows = [(k, day(rng.randint(0, 60)), rng.randint(0, 3), rng.randint(4, 6)) for k in range(40)]
    games = spark.createDataFrame(rows, "group_id bigint, day date, home_id int, away_id int").withColumns({
        "event_at": F.expr("timestampadd(SECOND, 86399, CAST(day AS TIMESTAMP))"), "available_at": F.expr("timestampadd(HOUR, 24 + group_id % 30, CAST(day AS TIMESTAMP))")})
    live = relations.live_intervals(games.drop("day"), 9)
    totals = relations.side_group_totals(live)
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 1 and plan.index("sequence(") < plan.index("Window")  # only totals are listed by day
    by = ["day", "source", "is_current", "is_home", "is_away", "is_historical"]
    listed = relations.side_group_edges(live, None, None).groupBy(*by).agg(
        F.count("*").alias("edges"), F.sum(F.col("destination").cast("bigint")).alias("destinations"), F.sum("event_age").alias("event_age"), F.sum("publication_delay").alias("publication_delay"))
    assert sorted(map(tuple, totals.select(*listed.columns).collect())) == sorted(map(tuple, listed.collect()))


def test_digests_are_added_up_as_plain_numbers(spark):
    from tidemark.functions.digests import segment_digest

    df = spark.createDataFrame([("k", day(0), day(9), 3), ("l", day(4), day(6), 1)], "k string, from_day date, to_day date, v int")
    found = segment_digest(df, ["k", "v"], counts={"ls": (F.col("k") == "l").cast("int")})
    assert {r["day"]: (r["row_count"], r["ls"]) for r in found.collect()} == {day(d): (2, 1) if 4 <= d < 6 else (1, 0) for d in range(9)}


def test_shuffle_partitions_grow_with_the_stored_tables(spark, tmp_path):
    from tidemark.catalog.tables import Tables

    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    for megabytes in (1, 9):
        (tmp_path / f"{megabytes}.parquet").write_bytes(bytes(megabytes << 20))
        Tables(spark, str(tmp_path))
        assert [spark.conf.get(n) for n in names] == [str(max(4, megabytes + (megabytes > 1))), "16m", "4m"]
    for n in names:
        spark.conf.unset(n)


def test_shuffled_rows_are_not_put_together_beyond_a_few_stored_megabytes(spark, tmp_path):
    from tidemark.catalog.tables import Tables

    with open(tmp_path / "t.parquet", "wb") as stored:
        stored.truncate(200 << 20)
    Tables(spark, str(tmp_path))
    rows = spark.range(1_000_000).select("id", *[F.xxhash64("id", F.lit(i)).alias(f"v{i}") for i in range(3)]).repartition("id")  # some 30 MB
    found = rows.select(F.spark_partition_id().alias("p"), (F.col("v0") + F.col("v1") % 7 + F.col("v2") % 7).alias("v")).groupBy("p").agg(F.max("v"), F.count("*").alias("n")).collect()
    assert max(r["n"] for r in found) < 100_000 and sum(r["n"] for r in found) == 1_000_000
    for n in ("coalescePartitions.initialPartitionNum", "coalescePartitions.minPartitionNum", "advisoryPartitionSizeInBytes"):
        spark.conf.unset(f"spark.sql.adaptive.{n}")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
