"""Balanced ordered helpers against straightforward Python, with one key owning most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import stats, windows
from tidemark.plans.ordered import last_rows, neighbour, numbered, running, top_k


@pytest.fixture(scope="module")
def series(spark):
    random.seed(5)
    keys = ["hot"] * 300 + ["b"] * 20 + ["c"]
    rows, clock = [], {}
    for key in keys:
        clock[key] = clock.get(key, 0) + random.randint(1, 4)
        rows.append((key, clock[key], None if random.random() < 0.2 else float(random.randint(-5, 9))))
    return rows, spark.createDataFrame(rows, "k string, t int, v double").repartition(5)


def by_key(rows):
    result = {}
    for k, t, v in sorted(rows):
        result.setdefault(k, []).append((t, v))
    return result


def bucket():
    return F.floor(F.col("t") / 50)


def test_neighbours(series):
    rows, df = series
    back = {(r["k"], r["t"]): r["p"] and r["p"]["v"] for r in neighbour(df, ["k"], ["t"], bucket(), ["v"], "p").collect()}
    ahead = {(r["k"], r["t"]): r["n"] and r["n"]["t"] for r in neighbour(df, ["k"], ["t"], bucket(), ["t"], "n", ahead=True).collect()}
    for k, items in by_key(rows).items():
        for i, (t, _) in enumerate(items):
            assert back[k, t] == (items[i - 1][1] if i else None)
            assert ahead[k, t] == (items[i + 1][0] if i + 1 < len(items) else None)


def test_running_sums_and_maxima(series):
    rows, df = series
    found = {(r["k"], r["t"]): (r["s"], r["m"]) for r in running(df, ["k"], ["t"], bucket(), {"s": F.col("v")}, {"m": F.col("v")}).collect()}
    for k, items in by_key(rows).items():
        for i, (t, _) in enumerate(items):
            seen = [v for _, v in items[: i + 1] if v is not None]
            assert found[k, t] == ((sum(seen), max(seen)) if seen else (None, None))


def test_positions_and_last_rows(series):
    rows, df = series
    places = {(r["k"], r["t"]): r["position"] for r in numbered(df, ["k"], ["t"], bucket()).collect()}
    found = {(r["k"], r["t"]): r["s"] for r in last_rows(df, ["k"], ["t"], bucket(), 7, {"s": F.sum("v")}, block=16).collect()}
    for k, items in by_key(rows).items():
        for i, (t, _) in enumerate(items):
            assert places[k, t] == i + 1
            seen = [v for _, v in items[max(0, i - 6): i + 1] if v is not None]
            assert found[k, t] == (sum(seen) if seen else None)


def test_top_k_is_limited_before_the_shuffle(series):
    _, df = series
    plan = top_k(df, ["k"], [F.col("t").desc()], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert top_k(df, ["k"], [F.col("t").desc()], 2).count() == 5


def test_rolling_needs_enough_values(series):
    rows, df = series
    found = {(r["k"], r["t"]): (r["rolling_sum"], r["rolling_mean"]) for r in windows.rolling(df, ["k"], ["t"], bucket(), "v", 4, 3).collect()}
    for k, items in by_key(rows).items():
        for i, (t, _) in enumerate(items):
            seen = [v for _, v in items[max(0, i - 3): i + 1] if v is not None]
            if len(seen) < 3:
                assert found[k, t] == (None, None)
            else:
                assert found[k, t] == pytest.approx((sum(seen), sum(seen) / len(seen)))
    with pytest.raises(ValueError):
        windows.rolling(df, ["k"], ["t"], bucket(), "v", 2, 3)


@pytest.mark.parametrize("adjust", [False, True])
@pytest.mark.parametrize("alpha", [0.03, 0.4, 0.97, 1.0])
def test_ewma(series, adjust, alpha):
    rows, df = series
    found = {(r["k"], r["t"]): r["ewma"] for r in windows.ewma(df, ["k"], ["t"], bucket(), "v", adjust=adjust, min_periods=2, alpha=alpha).collect()}
    for k, items in by_key(rows).items():
        state, num, den, seen = None, 0.0, 0.0, 0
        for t, v in items:
            if v is not None:
                seen += 1
                num, den = v + (1 - alpha) * num, 1 + (1 - alpha) * den
                state = num / den if adjust else (v if state is None else alpha * v + (1 - alpha) * state)
            assert found[k, t] == (pytest.approx(state, abs=1e-9) if seen >= 2 else None)


def test_ewma_carries_over_many_small_blocks(series, monkeypatch):
    rows, df = series
    monkeypatch.setattr(windows, "LARGEST_BLOCK", 8)  # as if the decay of a block were weak
    alpha = 0.05
    found = {(r["k"], r["t"]): r["ewma"] for r in windows.ewma(df, ["k"], ["t"], bucket(), "v", alpha=alpha).collect()}
    for k, items in by_key(rows).items():
        state = None
        for t, v in items:
            if v is not None:
                state = v if state is None else alpha * v + (1 - alpha) * state
            assert found[k, t] == (None if state is None else pytest.approx(state, abs=1e-9))


def test_ewma_takes_exactly_one_smoothing():
    assert windows.resolve_alpha(span=9) == pytest.approx(0.2)
    assert windows.resolve_alpha(half_life=1.0) == pytest.approx(0.5)
    for bad in ({}, {"alpha": 0.5, "span": 3}, {"alpha": 0.0}):
        with pytest.raises(ValueError):
            windows.resolve_alpha(**bad)


def test_touching_intervals_merge(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 10), ("a", 1, 2), ("a", 3, 3), ("b", 4, 6)], "k string, lo int, hi int")
    found = windows.interval_union(df, ["k"], "lo", "hi", F.floor(F.col("lo") / 2))
    assert sorted(tuple(r) for r in found.collect()) == [("a", 0, 7), ("a", 9, 10), ("b", 4, 6)]


def test_time_decay_of_very_old_events(spark):
    df = spark.sql("SELECT 'k' AS k, TIMESTAMP '1950-01-01' AS t, 3.0D AS v UNION ALL SELECT 'k', TIMESTAMP '1950-01-02', 5.0D UNION ALL SELECT 'n', TIMESTAMP '2023-12-31', 7.0D")
    found = {r["k"]: r["v_ewma_1d"] for r in windows.time_decay_mean(df, ["k"], "t", {"v": F.col("v")}, "2024-01-01 00:00:00", [1]).collect()}
    assert found == {"k": pytest.approx((3 * 0.5 + 5) / 1.5), "n": pytest.approx(7.0)}


def test_before_day_excludes_the_same_day(spark):
    rows = [("a", "2024-01-01", 1, 1.0), ("a", "2024-01-01", 2, 2.0), ("a", "2024-01-03", 3, 4.0), ("a", "2024-01-03", 4, 8.0), ("a", "2024-02-09", 5, 16.0)]
    df = spark.createDataFrame(rows, "k string, d string, id int, v double").withColumn("d", F.to_date("d"))
    found = {str(r["d"]): (r["prior_rows"], r["prior_v"], r["recent_3_rows"], r["recent_3_v"])
             for r in windows.before_day(df, ["k"], "d", ["id"], {"v": F.col("v")}, recent=[3]).collect()}
    assert found == {"2024-01-01": (0, 0.0, 0, 0.0), "2024-01-03": (2, 3.0, 2, 3.0), "2024-02-09": (4, 15.0, 3, 14.0)}


def test_quantiles_and_percentiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 7.0)], "k string, v double")
    found = {r["k"]: (r["p25"], r["p50"], r["count"]) for r in stats.distribution(df, ["k"], "v", [0.25, 0.5], 2.0).collect()}
    assert found == {"a": (1.75, 2.5, 4), "b": (7.0, 7.0, 1)}
    picks = {r["k"]: (r["p50"], r["p90"]) for r in stats.weighted_percentiles(df, ["k"], "v", [0.5, 0.9], 2.0).collect()}
    assert picks == {"a": (2.0, 4.0), "b": (7.0, 7.0)}


def test_beta_prior_fallbacks(spark):
    df = spark.createDataFrame([("one", 3.0, 10.0), ("same", 2.0, 10.0), ("same", 4.0, 20.0), ("none", 0.0, 0.0), ("wide", 1.0, 100.0), ("wide", 90.0, 100.0)],
                               "c string, numerator double, denominator double")
    found = {r["c"]: (r["prior_mean"], r["prior_strength"]) for r in stats.fit_beta_prior(df, ["c"]).collect()}
    assert found["one"] == pytest.approx((0.3, 2.0))
    assert found["same"] == pytest.approx((0.2, 10000.0))
    assert found["none"] == pytest.approx((0.5, 2.0))
    assert found["wide"] == pytest.approx((0.455, 2.0))


def test_rate_of_nothing_is_null(spark):
    df = spark.createDataFrame([("a", 0, 0)], "k string, n int, d int")
    assert stats.count_rates(df, ["k"], F.col("n"), F.col("d")).first()["rate"] is None


def test_conditional_split_reports_ties(spark):
    df = spark.sql("""SELECT 'f' AS fact_id, 'x' AS outcome, TIMESTAMP '2024-01-01' AS event_at, TIMESTAMP '2024-01-02' AS available_at
                      UNION ALL SELECT 'f', 'y', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02' UNION ALL SELECT 'g', 'x', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-02'
                      UNION ALL SELECT 'g', 'x', TIMESTAMP '2024-03-01', TIMESTAMP '2024-01-03'""")
    split, ambiguous = stats.conditional_split(df, "2024-02-01 00:00:00", ["x", "y"], F.lit("b"))
    assert [r["fact_id"] for r in ambiguous.collect()] == ["f"]
    assert split.first()["rows"] == 1  # the moved event of g is gone and does not come back


def test_model_may_not_know_the_future():
    stats.check_model_cutoff("2024-01-01", "2024-01-01")
    with pytest.raises(ValueError):
        stats.check_model_cutoff("2024-01-02", "2024-01-01")


def test_spread_cuts_a_hot_key_into_steps(spark):
    from tidemark.plans.ordered import spread

    df = spark.range(3000).withColumn("k", F.lit("hot"))
    sizes = [r["count"] for r in df.groupBy(spread(F.col("id"), 100).alias("b")).count().collect()]
    assert len(sizes) == 30 and set(sizes) == {100}
    placed = numbered(df, ["k"], ["id"], spread(F.col("id"), 100))
    assert placed.where(F.col("position") != F.col("id") + 1).isEmpty()


def test_large_k_is_ranked_in_parts_first(spark):
    df = spark.range(5000).selectExpr("'hot' AS k", "id")
    found = top_k(df, ["k"], [F.col("id").desc()], 1500, rank_name="r").collect()
    assert sorted((r["id"], r["r"]) for r in found) == [(4999 - i, i + 1) for i in reversed(range(1500))]


def test_cutoffs_are_compared_as_moments():
    stats.check_model_cutoff("2024-01-02T00:00:00+09:00", "2024-01-01T20:00:00Z")
    with pytest.raises(ValueError):
        stats.check_model_cutoff("2024-01-01T20:00:01+00:00", "2024-01-02T05:00:00+09:00")


def test_buckets_are_carried_over_without_a_join(spark):
    df = spark.createDataFrame([("k", t, t * 10) for t in range(1, 8)] + [(None, 3, 5), (None, 9, None)], "k string, t int, v int")
    bucket = F.floor(F.col("t") / 2)
    summed = running(df, ["k"], ["t"], bucket, {"s": F.col("v")}, {"m": F.col("v")})
    near = neighbour(df, ["k"], ["t"], bucket, ["v"], "p")
    for plan in (summed, near):
        assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()  # a join shuffles all rows once more
    assert {(r["k"], r["t"]): (r["s"], r["m"]) for r in summed.collect()} == {
        **{("k", t): (5 * t * (t + 1), t * 10) for t in range(1, 8)}, (None, 3): (5, 5), (None, 9): (5, 5)}
    assert {(r["k"], r["t"]): r["p"] and r["p"]["v"] for r in near.collect()} == {
        ("k", 1): None, **{("k", t): (t - 1) * 10 for t in range(2, 8)}, (None, 3): None, (None, 9): 5}
