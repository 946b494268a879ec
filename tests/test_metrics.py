"""Metrics and calibrators against direct formulas."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calibration, metrics, scenarios

SCHEMA = "query_id int, label int, probabilities array<double>, weight double"


def frame(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def test_direct_formulas(spark):
    df = frame(spark, (0, [0.7, 0.2, 0.1], 1.0), (2, [0.3, 0.3, 0.4], 2.0))
    out = metrics.evaluate(df, [], 3).first()
    assert out["log_loss"] == pytest.approx(-(math.log(0.7) + 2 * math.log(0.4)) / 3)
    assert out["brier"] == pytest.approx((0.09 + 0.04 + 0.01 + 2 * (0.09 + 0.09 + 0.36)) / 3)
    assert out["calibration_error"] == pytest.approx((0.3 + 2 * 0.6) / 3)
    assert (out["samples"], out["accuracy"]) == (2, 1.0)


def test_certain_and_wrong_is_clipped(spark):
    out = metrics.log_loss(frame(spark, (0, [0.0, 1.0], 1.0), (1, [0.0, 1.0], 1.0)), []).first()
    assert out["log_loss"] == pytest.approx(-math.log(1e-15) / 2)


def test_weight_scale_does_not_matter(spark):
    rows = [(0, [0.7, 0.3], 1.0), (1, [0.6, 0.4], 3.0), (1, [0.2, 0.8], 2.0)]
    plain = metrics.evaluate(metrics.checked(frame(spark, *rows)), [], 2).first()
    huge = metrics.evaluate(metrics.checked(frame(spark, *[(a, p, w * 1e300) for a, p, w in rows])), [], 2).first()
    assert tuple(plain) == pytest.approx(tuple(huge))


def test_bin_edges_belong_to_the_upper_bin(spark):
    df = frame(spark, (0, [0.5, 0.5], 1.0), (0, [0.75, 0.25], 1.0))
    out = metrics.calibration_error(df, [], 2, bins=2).first()["calibration_error"]
    assert out == pytest.approx(abs(2 - 1.25) / 2)


def test_bad_rows_are_named(spark):
    df = frame(spark, (0, [0.5, 0.6], 1.0), (5, [0.5, 0.5], 1.0), (0, [float("nan"), 1.0], 1.0), (0, [1.0], 1.0), (0, [0.5, 0.5], -1.0), (1, [0.5, 0.5 + 1e-8], 1.0))
    found = sorted((r["query_id"], r["code"]) for r in metrics.probability_violations(df, 2).collect())
    assert found == [(0, "sum_not_one"), (1, "unknown_label"), (2, "value_out_of_range"), (3, "class_count"), (4, "weight_invalid")]


def test_populations_must_agree(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 1)], "query_id int, label int")
    b = spark.createDataFrame([(2, 0), (3, 1), (4, 1)], "query_id int, label int")
    found = sorted(tuple(r) for r in metrics.population_differences(a, b, "query_id").collect())
    assert found == [(1, "missing"), (2, "label_changed"), (3, "duplicate"), (4, "extra")]


def test_only_shared_numeric_leaves(spark):
    left = spark.sql("SELECT 1 AS a, named_struct('x', 2.0D, 'y', 'text', 'z', 5) AS b")
    right = spark.sql("SELECT 4 AS a, named_struct('x', CAST(NULL AS DOUBLE), 'w', 1) AS b")
    assert {r["path"]: r["delta"] for r in metrics.metric_deltas(left, right).collect()} == {"a": 3.0, "b.x": None}


def test_partial_metric_is_reported(spark):
    runs = spark.createDataFrame([(1, "a", "m", 1.0), (2, "a", "m", None), (1, "a", "k", 1.0), (2, "a", "k", 2.0)], "seed int, variant string, metric string, value double")
    assert [tuple(r) for r in metrics.partial_metrics(runs).collect()] == [("a", "m")]


def test_history_gap(spark):
    rows = [("r", e, l) for e, l in ((1, 5.0), (2, 3.0), (3, 3.0), (4, 4.0))] + [("gap", 1, 1.0), ("gap", 3, 2.0)]
    out = {r["run"]: r for r in metrics.history_summary(spark.createDataFrame(rows, "run string, epoch int, loss double"), "run", "epoch", "loss").collect()}
    assert (out["r"]["best_epoch"], out["r"]["final_minus_best"], out["r"]["last_five_mean"], out["r"]["contiguous"]) == (2, 1.0, 3.75, True)
    assert out["gap"]["contiguous"] is False


def test_temperature_recovers_overconfidence(spark):
    true = [0.9, 0.8, 0.7, 0.6]
    rows = []
    for p in true:
        hot = p ** 3 / (p ** 3 + (1 - p) ** 3)
        rows += [(1, [1 - hot, hot], p), (0, [1 - hot, hot], 1 - p)]
    fitted = calibration.fit_temperatures(frame(spark, *rows))
    assert fitted.overall == pytest.approx(3.0, rel=1e-6)
    out = fitted.apply(frame(spark, *rows)).orderBy("query_id").collect()
    assert out[0]["probabilities"][1] == pytest.approx(0.9, rel=1e-6)


def test_small_stages_fall_back(spark):
    rows = [(i % 2, [0.4, 0.6], 1.0) for i in range(6)]
    df = frame(spark, *rows).withColumn("stage", F.when(F.col("query_id") < 4, "big").otherwise("small"))
    fitted = calibration.fit_temperatures(df, "stage", minimum_rows=3)
    assert set(fitted.by_stage) == {"big"}


def test_isotonic_steps_and_lookup(spark):
    rows = [(0.1, 0, 1.0), (0.2, 1, 1.0), (0.3, 0, 1.0), (0.6, 1, 2.0), (0.6, 0, 1.0), (0.9, 1, 1.0)]
    df = spark.createDataFrame(rows, "score double, label int, weight double")
    steps = calibration.isotonic_steps(df)
    asked = spark.createDataFrame([(0.0,), (0.1,), (0.11,), (0.3,), (0.31,), (0.6,), (0.95,), (1.0,)], "score double")
    found = {r["score"]: r["calibrated"] for r in calibration.apply_steps(asked, steps).collect()}
    assert found == pytest.approx({0.0: 0.0, 0.1: 0.0, 0.11: 0.5, 0.3: 0.5, 0.31: 2 / 3, 0.6: 2 / 3, 0.95: 1.0, 1.0: 1.0})


def test_count_models(spark):
    df = spark.createDataFrame([(3, 2.5, 1.5), (0, 0.5, 0.7)], "k int, m double, r double").withColumns({
        "nb": metrics.negative_binomial_log_prob(F.col("k"), F.col("m"), F.col("r")), "po": metrics.poisson_nll(F.col("m"), F.col("k"))})
    for row in df.collect():
        k, m, r = row["k"], row["m"], row["r"]
        exact = math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * (math.log(r) - math.log(r + m)) + k * (math.log(m) - math.log(r + m))
        assert row["nb"] == pytest.approx(exact)
        assert row["po"] == pytest.approx(m - k * math.log(m) + math.lgamma(k + 1))


def test_points_beyond_the_table(spark):
    df = spark.createDataFrame([(h,) for h in range(5)], "h int").select("h", scenarios.hit_points(F.col("h"), [0.0, 2.0, 5.0], 4.0).alias("p"))
    assert {r["h"]: r["p"] for r in df.collect()} == {0: 0.0, 1: 2.0, 2: 5.0, 3: 9.0, 4: 13.0}


def test_selection_scores_count_absent_members(spark):
    chosen = spark.createDataFrame([("s", 1, "a", 2.0), ("s", 2, "b", 1.0)], "selection_id string, slot int, member_id string, multiplier double")
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "a", 1), (3, "z", 4)], "scenario_id int, member_id string, hits int")
    weights = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 1.0)], "scenario_id int, weight double")
    out = scenarios.score_selections(chosen, hits, weights, [0.5, 2.0, 5.0], 4.0, risk_aversion=0.1, all_hit_utility=8.0).first()
    values = [(2 * 2 + 5, 0.25), (2 * 2 + 0.5, 0.5), (2 * 0.5 + 0.5, 0.25)]
    mean = sum(v * w for v, w in values)
    variance = sum(w * v * v for v, w in values) - mean ** 2
    assert (out["expected_points"], out["variance"], out["all_hit_probability"]) == pytest.approx((mean, variance, 0.25))
    assert out["utility"] == pytest.approx(mean - 0.1 * variance + 2.0)


def test_selection_scores_against_all_scenarios(spark):
    rng = random.Random(3)
    names = [f"m{k}" for k in range(30)]
    hits = {(s, m): rng.randint(0, 4) for s in range(700) for m in names if rng.random() < 0.3}
    weights = {s: rng.choice([0.0, 1.0, 2.5]) for s in range(700)}
    # One member is in every selection; one selection is empty-handed, one names a member twice.
    chosen = [(k, slot, m, rng.choice([1.0, 2.0])) for k in range(40) for slot, m in enumerate(["m0", *rng.sample(names[1:], k % 4)])]
    chosen += [(90, 0, "nobody", 1.0), (91, 0, "m1", 1.0), (91, 1, "m1", 2.0)]
    out = scenarios.score_selections(
        spark.createDataFrame(chosen, "selection_id long, slot int, member_id string, multiplier double"),
        spark.createDataFrame([(*k, h) for k, h in hits.items()], "scenario_id int, member_id string, hits int"),
        spark.createDataFrame(list(weights.items()), "scenario_id int, weight double"), [0.5, 2.0, 5.0], 4.0).collect()
    points, total = (lambda h: [0.5, 2.0, 5.0][h] if h < 3 else 5.0 + 4.0 * (h - 2)), sum(weights.values())
    for row in out:
        own = [(m, x) for k, _, m, x in chosen if k == row["selection_id"]]
        values = [(sum(x * points(hits.get((s, m), 0)) for m, x in own), all(hits.get((s, m), 0) >= 1 for m, _ in own), w / total) for s, w in weights.items()]
        mean = sum(v * w for v, _, w in values)
        assert row["expected_points"] == pytest.approx(mean) and row["all_hit_probability"] == pytest.approx(sum(w for _, ok, w in values if ok))
        assert row["variance"] == pytest.approx(sum(w * (v - mean) ** 2 for v, _, w in values), abs=1e-9)
    assert len(out) == 42


@pytest.mark.parametrize("bonus,risk", [(0.0, 0.0), (3.0, 0.05), (-2.0, 0.1), (4.0, -0.1)])
def test_best_picks_match_full_enumeration(spark, bonus, risk):
    from itertools import product

    rng = random.Random(int(bonus * 10 + risk * 100))
    slates = {k: [[(f"o{j}", rng.random() + 0.01, rng.choice([-2.0, 1.0, 3.0, 7.5])) for j in range(rng.randint(2, 4))] for _ in range(rng.randint(1, 5))] for k in range(25)}
    options = spark.createDataFrame([(k, m, *o) for k, markets in slates.items() for m, os in enumerate(markets) for o in os],
                                    "slate_id int, market int, option_id string, probability double, reward double")
    out = scenarios.best_picks(options, 4, bonus=bonus, risk_aversion=risk, minimum_probability=0.01).collect()
    for k, markets in slates.items():
        share = [[(o, p / sum(q for _, q, _ in os), r) for o, p, r in os] for os in markets]
        found = []
        for pick in product(*share):
            chance, mean = math.prod(p for _, p, _ in pick), sum(p * r for _, p, r in pick)
            spread = sum(p * (1 - p) * r * r for _, p, r in pick) + bonus ** 2 * chance * (1 - chance) + 2 * bonus * chance * sum(r * (1 - p) for _, p, r in pick)
            if chance >= 0.01:
                found.append(mean + bonus * chance - risk * spread)
        expected = sorted(found, reverse=True)[:4]
        got = [r["utility"] for r in sorted((r for r in out if r["slate_id"] == k), key=lambda r: r["place"])]
        assert got == pytest.approx(expected)


def test_picks_of_many_markets_stay_few(spark):
    rng = random.Random(9)
    rows = [("s", m, f"{j}", rng.random() + 0.05, 1.0 + 5 * rng.random()) for m in range(12) for j in range(5)]  # 244 million combinations
    options = spark.createDataFrame(rows, "slate_id string, market int, option_id string, probability double, reward double")
    best = scenarios.best_picks(options, 3, bonus=2.0, risk_aversion=0.02).orderBy("place").collect()
    shares = {m: [(p / sum(q for _, k, _, q, _ in rows if k == m), r) for _, k, _, p, r in rows if k == m] for m in range(12)}
    plain = sum(max(p * r - 0.02 * p * (1 - p) * r * r for p, r in options) for options in shares.values())
    assert len(best) == 3 and plain - 0.1 <= best[0]["utility"] <= plain + 2.0 * math.prod(max(p for p, _ in o) for o in shares.values())
    assert best[0]["utility"] >= best[1]["utility"] >= best[2]["utility"]


def test_isotonic_fit_in_many_ranges(spark):
    rng = random.Random(5)
    rows = [(round(rng.random(), 4), int(rng.random() < 0.2 + 0.5 * k / 6000), float(rng.randint(1, 3))) for k in range(6000)]
    rows += [(0.5 + k / 4000, int(k % 3 == 0), 1.0) for k in range(1500)] + [(0.9, 0, 400.0), (None, 1, 1.0), (0.1, 1, 0.0)]
    df = spark.createDataFrame(rows, "score double, label int, weight double")
    merged = {}
    for s, y, w in rows:
        if s is not None and w > 0:
            a, b = merged.get(s, (0.0, 0.0))
            merged[s] = (a + w, b + w * y)
    pools = []
    for s in sorted(merged):
        pools.append([[s], *merged[s]])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            names, w, t = pools.pop()
            pools[-1] = [pools[-1][0] + names, pools[-1][1] + w, pools[-1][2] + t]
    expected = {s: t / w for names, w, t in pools for s in names}
    for size in (50, 700, 10**6):
        steps = calibration.isotonic_steps(df, block_rows=size)
        assert sorted(r["high"] for r in steps.collect()) == [p[0][-1] for p in pools]
        found = {r["score"]: r["calibrated"] for r in calibration.apply_steps(df, steps).collect()}
        assert found.pop(None) is None and {s: found[s] for s in expected} == pytest.approx(expected)


def test_picks_against_all_joint_outcomes(spark):
    from itertools import product

    markets = {1: [("a", 0.5, 2.0), ("b", 0.25, 5.0), ("c", 0.25, 1.0)], 2: [("x", 3.0, 1.0), ("y", 1.0, 4.0)]}
    options = spark.createDataFrame([("s", m, o, p, r) for m, os in markets.items() for o, p, r in os], "slate_id string, market int, option_id string, probability double, reward double")
    out = scenarios.best_picks(options, 10, bonus=3.0, risk_aversion=0.2, minimum_probability=0.1).collect()
    expected = []
    share = {m: {o: p / sum(q for _, q, _ in os) for o, p, _ in os} for m, os in markets.items()}
    for pick in product(*markets.values()):
        chance = math.prod(share[m][o[0]] for m, o in zip(markets, pick))
        if chance < 0.1:
            continue
        first = second = 0.0
        for real in product(*markets.values()):
            p = math.prod(share[m][o[0]] for m, o in zip(markets, real))
            right = [a[0] == b[0] for a, b in zip(pick, real)]
            points = sum(o[2] for o, ok in zip(pick, right) if ok) + (3.0 if all(right) else 0.0)
            first, second = first + p * points, second + p * points * points
        expected.append((first - 0.2 * (second - first * first), first, chance, [o[0] for o in pick]))
    expected.sort(reverse=True)
    assert [r["picks"] for r in out] == [e[3] for e in expected]
    assert [r["utility"] for r in out] == pytest.approx([e[0] for e in expected])


def test_joint_success_of_sets(spark):
    rows = spark.createDataFrame([("g", 1, "a", 1), ("g", 1, "b", 1), ("g", 2, "a", 2), ("g", 3, "b", 0)], "group_id string, scenario_id int, member_id string, hits int")
    sets = spark.createDataFrame([(1, "g", "a"), (1, "g", "b"), (2, "g", "a"), (3, "g", None)], "set_id int, group_id string, member_id string")
    found = {r["set_id"]: r["joint_success"] for r in scenarios.joint_success(rows, sets).collect()}
    assert found == pytest.approx({1: 1 / 3, 2: 2 / 3, 3: 1.0})


def test_log_gamma_at_every_size(spark):
    import math

    values = [1e-8, 0.3, 1.0, 2.5, 17.0, 1e3, 123456.5, 3e9, 1e15]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(metrics.log_gamma(F.col("x")).alias("g")).collect()
    for v, r in zip(values, got):
        assert r["g"] == pytest.approx(math.lgamma(v), rel=1e-12, abs=1e-12)
    row = spark.sql("SELECT 2.5e0 AS m, 3000000000 AS k, 0 AS z").select(metrics.poisson_nll(F.col("m"), F.col("k")).alias("p"), metrics.poisson_nll(F.col("m"), F.col("z")).alias("q")).first()
    assert row["p"] == pytest.approx(2.5 - 3e9 * math.log(2.5) + math.lgamma(3e9 + 1), rel=1e-12) and row["q"] == pytest.approx(2.5)


def test_weights_that_are_all_zero_are_named(spark):
    rows = spark.createDataFrame([(1, 0, [0.5, 0.5], 0.0)], "query_id int, label int, probabilities array<double>, weight double")
    with pytest.raises(Exception, match="all weights are zero"):
        metrics.checked(rows).collect()
