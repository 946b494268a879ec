"""Evaluation, calibration and run comparison (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.statistics import rounded
from tidemark.operators import calibration, metrics
from tidemark.plans.ordered import numbered, spread


def scored(t, model="a"):
    p = F.col(f"p1_{model}")
    return t.predictions.select("query_id", "label", F.array(1.0 - p, p).alias("probabilities"), F.col("weight").cast("double").alias("weight"),
                                "fold_id", "stage")


# One row per prediction and the pieces every metric needs.
def rows_sql(p="p1_a"):
    return f"""scored AS (SELECT *, 1 - {p} AS q0, {p} AS q1, CASE WHEN label = 1 THEN {p} ELSE 1 - {p} END AS chosen, greatest({p}, 1 - {p}) AS conf,
      CASE WHEN (CASE WHEN 1 - {p} >= {p} THEN 0 ELSE 1 END) = label THEN 1e0 ELSE 0e0 END AS correct FROM predictions)"""


EDGES = ", ".join(f"{i}e0 * (1e0 / 15e0)" for i in range(1, 15))
ECE_SQL = f"""binned AS (SELECT *, len(list_filter([{EDGES}], lambda e: e <= conf)) AS bin FROM scored),
    bins AS (SELECT stage, bin, abs(sum(weight * correct) - sum(weight * conf)) AS gap, sum(weight) AS w FROM binned GROUP BY 1, 2),
    ece AS (SELECT stage, sum(gap) / sum(w) AS calibration_error FROM bins GROUP BY 1)"""


@query("h1_probability_violations", """
    WITH v AS (SELECT query_id, label, p1_a, p1_b, weight FROM predictions)
    SELECT query_id, 'sum_not_one' AS code FROM v WHERE abs(p1_a + p1_b - 1) > 1e-9 + 1e-7
    UNION ALL SELECT query_id, 'unknown_label' FROM v WHERE weight - 1 NOT IN (0, 1)""", ("predictions",))
def _(t):
    rows = t.predictions.select("query_id", (F.col("weight") - 1).alias("label"), F.array("p1_a", "p1_b").alias("probabilities"),
                                F.col("weight").cast("double").alias("weight"))
    return metrics.probability_violations(rows, 2)


@query("h1_checked_probabilities", """
    SELECT query_id, CASE WHEN stage = 'de' THEN 0 WHEN stage = 'en' THEN 1 WHEN stage = 'es' THEN 2 WHEN stage = 'fr' THEN 3 END AS label,
      round(weight / 3e0, 12) AS weight, round(p1_a / (p1_a + p1_b), 12) AS p0, round(p1_b / (p1_a + p1_b), 12) AS p1 FROM predictions""", ("predictions",))
def _(t):
    rows = t.predictions.select("query_id", F.col("stage").alias("label"), F.array("p1_a", "p1_b").alias("probabilities"), "weight")
    out = metrics.checked(rows, labels=["de", "en", "es", "fr"])
    return out.select("query_id", "label", F.round("weight", 12).alias("weight"), F.round(F.get("probabilities", F.lit(0)), 12).alias("p0"),
                      F.round(F.get("probabilities", F.lit(1)), 12).alias("p1"))


@query("h2_log_loss", f"WITH {rows_sql()} SELECT stage, round(sum(-ln(greatest(least(chosen, 1), 1e-15)) * weight) / sum(weight), 9) AS log_loss FROM scored GROUP BY stage", ("predictions",))
def _(t):
    return rounded(metrics.log_loss(scored(t), ["stage"]), 9, "log_loss")


@query("h3_brier", f"WITH {rows_sql()} SELECT stage, round(sum((q0 * q0 + q1 * q1 - 2 * chosen + 1) * weight) / sum(weight), 9) AS brier FROM scored GROUP BY stage", ("predictions",))
def _(t):
    return rounded(metrics.brier(scored(t), ["stage"]), 9, "brier")


@query("h4_calibration_error", f"WITH {rows_sql()}, {ECE_SQL} SELECT stage, round(calibration_error, 9) AS calibration_error FROM ece", ("predictions",))
def _(t):
    return rounded(metrics.calibration_error(scored(t), ["stage"], 2), 9, "calibration_error")


@query("h4_calibration_error_quantile", f"""
    WITH {rows_sql()}, cuts AS (SELECT stage, quantile_cont(conf, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM scored GROUP BY stage),
    binned AS (SELECT s.stage, len(list_filter(edges, lambda e: e <= conf)) AS bin, weight, correct, conf FROM scored s JOIN cuts c ON c.stage = s.stage),
    bins AS (SELECT stage, bin, abs(sum(weight * correct) - sum(weight * conf)) AS gap, sum(weight) AS w FROM binned GROUP BY 1, 2)
    SELECT stage, round(sum(gap) / sum(w), 9) AS calibration_error FROM bins GROUP BY 1""", ("predictions",))
def _(t):
    return rounded(metrics.calibration_error(scored(t), ["stage"], 2, bins=10, strategy="quantile"), 9, "calibration_error")


@query("h5_evaluate", f"""
    WITH {rows_sql()}, {ECE_SQL} SELECT s.stage, count(*) AS samples, round(sum(-ln(chosen) * weight) / sum(weight), 9) AS log_loss,
      round(sum((q0 * q0 + q1 * q1 - 2 * chosen + 1) * weight) / sum(weight), 9) AS brier, round(avg(correct), 9) AS accuracy, round(any_value(calibration_error), 9) AS calibration_error
    FROM scored s JOIN ece ON ece.stage = s.stage GROUP BY s.stage""", ("predictions",))
def _(t):
    return rounded(metrics.evaluate(scored(t), ["stage"], 2), 9, "log_loss", "brier", "accuracy", "calibration_error")


@query("h6_absolute_errors", """
    SELECT l_linestatus, round(avg(abs(l_quantity - l_linenumber)), 9) AS count_mae, count(l_linenumber) AS count_rows,
      round(avg(abs(l_discount - CASE WHEN l_returnflag <> 'N' THEN l_tax END)), 9) AS rate_mae, count(CASE WHEN l_returnflag <> 'N' THEN l_tax END) AS rate_rows FROM lineitem GROUP BY l_linestatus""")
def _(t):
    rows = t.lineitem.withColumn("masked", F.expr("IF(l_returnflag <> 'N', l_tax, NULL)"))
    errors = metrics.absolute_errors(rows, ["l_linestatus"], {"count": ("l_quantity", "l_linenumber"), "rate": ("l_discount", "masked")})
    return rounded(errors, 9, "count_mae", "rate_mae")


# Joint table of 4 opportunity and 3 success buckets with logits from three columns.
CELL = "sin(l_quantity + {i}) + l_discount * {i}"


@query("h7_partial_observation_nll", f"""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [{', '.join(CELL.format(i=i) for i in range(12))}] AS x, CASE WHEN l_returnflag = 'N' THEN NULL ELSE 1 + l_partkey % 6 END AS opp,
      CASE WHEN l_linestatus = 'F' THEN l_suppkey % 5 END AS low, CAST(l_linenumber % 5 AS BIGINT) AS hits FROM lineitem),
    m AS (SELECT *, greatest(coalesce(low, 1), hits) AS bound FROM r),
    k AS (SELECT *, list_filter(range(12), lambda i: i % 3 = least(hits, 2) AND CASE WHEN opp >= 1 THEN i // 3 + 1 = least(opp, 4) ELSE i // 3 + 1 >= least(bound, 4) END) AS keep FROM m)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(ln(list_sum(list_transform(x, lambda v: exp(v)))) - ln(list_sum(list_transform(keep, lambda i: exp(x[i + 1])))), 8) AS nll FROM k""")
def _(t):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("array(" + ", ".join(CELL.format(i=i) for i in range(12)) + ")").alias("logits"),
        F.expr("IF(l_returnflag = 'N', NULL, 1 + l_partkey % 6)").alias("opportunities"), F.expr("IF(l_linestatus = 'F', l_suppkey % 5, NULL)").alias("minimum"),
        F.expr("CAST(l_linenumber % 5 AS BIGINT)").alias("successes"))
    out = metrics.partial_observation_nll(rows, 4, 3)
    return rounded(out, 8, "nll").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "nll")


@query("h8_poisson_nll", """
    WITH c AS (SELECT l_returnflag, l_quantity + 0.5e0 AS rate, CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS k FROM lineitem UNION ALL SELECT l_returnflag, l_linenumber + 0.25e0, CAST(l_quantity AS INTEGER) FROM lineitem)
    SELECT l_returnflag, round(sum(rate - k * ln(rate) + lgamma(k + 1)) / count(k), 8) AS poisson_nll, count(k) AS cells FROM c WHERE k IS NOT NULL GROUP BY 1""")
def _(t):
    rows = t.lineitem.selectExpr("l_returnflag", "l_quantity + 0.5e0 AS r1", "IF(l_linestatus = 'F', l_linenumber, NULL) AS k1",
                                 "l_linenumber + 0.25e0 AS r2", "CAST(l_quantity AS INT) AS k2")
    return rounded(metrics.count_model_nll(rows, ["l_returnflag"], {"a": ("r1", "k1"), "b": ("r2", "k2")}), 8, "poisson_nll")


@query("h8_negative_binomial", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * (ln(r) - ln(r + m)) + k * (ln(m) - ln(r + m)), 8) AS log_prob
    FROM (SELECT *, CAST(l_quantity AS INTEGER) AS k, l_linenumber + 0.5e0 AS m, l_tax * 10 + 0.5e0 AS r FROM lineitem)""")
def _(t):
    rows = t.lineitem.withColumns({"k": F.col("l_quantity").cast("int"), "m": F.col("l_linenumber") + 0.5, "r": F.col("l_tax") * 10 + 0.5})
    value = metrics.negative_binomial_log_prob(F.col("k"), F.col("m"), F.col("r"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(value, 8).alias("log_prob"))


@query("h8_multinomial_nll", """
    WITH r AS (SELECT *, ln(exp(l_discount) + exp(l_tax) + exp(l_linenumber / 10e0)) AS z FROM lineitem)
    SELECT l_returnflag, round(sum(-l_linenumber * (l_discount - z) - l_quantity * (l_tax - z) - 2 * (l_linenumber / 10e0 - z)) / sum(l_linenumber + l_quantity + 2), 9) AS multinomial_nll,
      sum(l_linenumber + l_quantity + 2) AS outcomes FROM r GROUP BY 1""")
def _(t):
    rows = t.lineitem.withColumns({"two": F.lit(2.0), "third": F.col("l_linenumber") / F.lit(10.0)})
    out = metrics.multinomial_nll(rows, ["l_returnflag"], ["l_linenumber", "l_quantity", "two"], ["l_discount", "l_tax", "third"])
    return rounded(out, 9, "multinomial_nll")


# Bisection on the slope of the log loss in 1 / temperature.
def bisect_sql(source: str, out: str, p: str = "p1_a") -> str:
    return f"""{out}(step, lo, hi) AS (SELECT 0, 0.05e0, 20e0 UNION ALL
      SELECT step + 1, CASE WHEN slope > 0 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN slope > 0 THEN (lo + hi) / 2 ELSE hi END FROM (
        SELECT step, lo, hi, sum(weight * ((ln(1 - {p}) * (1 - {p}) ** ((lo + hi) / 2) + ln({p}) * {p} ** ((lo + hi) / 2)) / ((1 - {p}) ** ((lo + hi) / 2) + {p} ** ((lo + hi) / 2))
          - ln(CASE WHEN label = 1 THEN {p} ELSE 1 - {p} END))) AS slope FROM {out}, {source} WHERE step < 60 GROUP BY step, lo, hi))"""


@query("h9_temperature_calibrate", f"""
    WITH RECURSIVE {bisect_sql('predictions', 'b')}, fit AS (SELECT 2 / (lo + hi) AS temperature FROM b WHERE step = 60)
    SELECT query_id, round(p1_a ** (1 / temperature) / (p1_a ** (1 / temperature) + (1 - p1_a) ** (1 / temperature)), 6) AS p1, round(temperature, 5) AS temperature FROM predictions CROSS JOIN fit""",
       ("predictions",))
def _(t):
    rows = scored(t)
    fitted = calibration.fit_temperatures(rows)
    return fitted.apply(rows).select("query_id", F.round(F.get("probabilities", F.lit(1)), 6).alias("p1"), F.lit(round(fitted.overall, 5)).alias("temperature"))


@query("h10_stagewise_calibrate", f"""
    WITH RECURSIVE {bisect_sql('predictions', 'g')}, {', '.join(bisect_sql(f"(SELECT * FROM predictions WHERE stage = '{s}')", f'b_{s}') for s in ('de', 'en', 'es', 'fr'))},
    sizes AS (SELECT stage, count(*) AS n, count(DISTINCT label) AS k FROM predictions GROUP BY stage),
    stages AS ({' UNION ALL '.join(f"SELECT '{s}' AS stage, 2 / (lo + hi) AS t FROM b_{s} WHERE step = 60" for s in ('de', 'en', 'es', 'fr'))}),
    fit AS (SELECT z.stage, CASE WHEN n >= 60 AND k > 1 THEN t ELSE (SELECT 2 / (lo + hi) FROM g WHERE step = 60) END AS temperature FROM sizes z JOIN stages s ON s.stage = z.stage)
    SELECT query_id, p.stage, round(p1_a ** (1 / temperature) / (p1_a ** (1 / temperature) + (1 - p1_a) ** (1 / temperature)), 6) AS p1 FROM predictions p JOIN fit f ON f.stage = p.stage""",
       ("predictions",))
def _(t):
    rows = scored(t)
    fitted = calibration.fit_temperatures(rows, "stage", minimum_rows=60)
    return fitted.apply(rows, "stage").select("query_id", "stage", F.round(F.get("probabilities", F.lit(1)), 6).alias("p1"))


@query("h11_isotonic_calibrate", """
    WITH u AS (SELECT p1_a AS score, sum(weight) AS w, sum(weight * label) AS s, row_number() OVER (ORDER BY p1_a) AS i FROM predictions GROUP BY p1_a),
    c AS (SELECT *, sum(w) OVER (ORDER BY i) AS cw, sum(s) OVER (ORDER BY i) AS cs FROM u),
    spans AS (SELECT a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / (b.cw - a.cw + a.w) AS mean FROM c a JOIN c b ON b.i >= a.i),
    low AS (SELECT a, u.i, min(mean) AS m FROM spans JOIN u ON a <= u.i AND b >= u.i GROUP BY a, u.i),
    fit AS (SELECT i, max(m) AS value FROM low GROUP BY i)
    SELECT query_id, round(value, 9) AS calibrated FROM predictions JOIN u ON u.score = p1_a JOIN fit ON fit.i = u.i""", ("predictions",))
def _(t):
    rows = t.predictions.select("query_id", F.col("p1_a").alias("score"), "label", "weight")
    return rounded(calibration.apply_steps(rows, calibration.isotonic_steps(rows)), 9, "calibrated").select("query_id", "calibrated")


@query("h12_out_of_fold_stack")
def _(t):
    base = t.predictions.select(
        "query_id", "label", F.array(1.0 - F.col("p1_a"), F.col("p1_a")).alias("a"), F.array(1.0 - F.col("p1_b"), F.col("p1_b")).alias("b"),
        F.col("weight").cast("double").alias("weight"), "fold_id", "stage")
    stacked = calibration.stack_out_of_fold(base, ["a", "b"], 2, [0, 1, 2, 3], minimum_rows=60)
    return calibration.apply_stack(stacked, base, ["a", "b"], 2).select(
        "query_id", "stage", F.round(F.get("probabilities", F.lit(1)), 4).alias("p1"))


@query("h13_paired_sensitivity", """
    WITH d AS (SELECT stage, abs(p1_b - p1_a) AS tv, (p1_b > 1 - p1_b) <> (p1_a > 1 - p1_a) AS flip, p1_a * 10 AS ea, p1_b * 12 AS eb FROM predictions)
    SELECT stage, count(*) AS queries, round(avg(tv), 9) AS mean_total_variation, round(max(tv), 9) AS max_total_variation, round(avg(tv), 9) AS mean_absolute_change, round(max(tv), 9) AS max_absolute_change,
      round(sqrt(avg(tv * tv)), 9) AS rms_change, count(*) FILTER (WHERE flip) AS argmax_flips, round(avg(CASE WHEN flip THEN 1 ELSE 0 END), 9) AS argmax_flip_rate,
      round(avg(abs(eb - ea)), 9) AS expected_mean_absolute_change, round(max(abs(eb - ea)), 9) AS expected_max_absolute_change, round(sqrt(avg((eb - ea) ** 2)), 9) AS expected_rms_change,
      round(quantile_cont(tv, 0.5), 9) AS median_total_variation, round(quantile_cont(tv, 0.95), 9) AS p95_total_variation FROM d GROUP BY stage""", ("predictions",))
def _(t):
    left = scored(t, "a").withColumn("expected", F.get("probabilities", F.lit(1)) * 10)
    right = scored(t, "b").withColumn("expected", F.get("probabilities", F.lit(1)) * 12)
    out = metrics.paired_sensitivity(left, right, scalars=["expected"], by=["stage"])
    return rounded(out, 9, *[c for c in out.columns if c not in ("stage", "queries", "argmax_flips")])


@query("h13_population_differences", """
    SELECT doc_id AS query_id, 'missing' AS code FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM conversations)
    UNION ALL SELECT conv_id, 'extra' FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) GROUP BY conv_id
    UNION ALL SELECT conv_id, CASE WHEN count(*) > 1 THEN 'duplicate' ELSE 'label_changed' END FROM conversations JOIN labels ON doc_id = conv_id GROUP BY conv_id, quality
      HAVING count(*) > 1 OR min(turn) <> quality""")
def _(t):
    left = t.labels.select(F.col("doc_id").alias("query_id"), F.col("quality").cast("bigint").alias("label"))
    right = t.conversations.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("label"))
    return metrics.population_differences(left, right, "query_id")


@query("h14_nested_metric_deltas", f"""
    WITH {rows_sql('p1_a')}, {rows_sql('p1_b').replace('scored AS', 'other AS')},
    m AS (SELECT stage, count(*) AS n, sum(-ln(chosen) * weight) / sum(weight) AS ll, avg(correct) AS acc FROM scored GROUP BY stage),
    o AS (SELECT stage, count(*) AS n, sum(-ln(chosen) * weight) / sum(weight) AS ll, avg(correct) AS acc FROM other GROUP BY stage)
    SELECT m.stage, unnest(['samples', 'loss.log_loss', 'loss.accuracy']) AS path, round(unnest([o.n - m.n, o.ll - m.ll, o.acc - m.acc]), 9) AS delta FROM m JOIN o ON o.stage = m.stage""", ("predictions",))
def _(t):
    def report(model):
        e = metrics.evaluate(scored(t, model), ["stage"], 2)
        return e.select("stage", "samples", F.struct("log_loss", "accuracy", F.lit("text").alias("note")).alias("loss"))
    return rounded(metrics.metric_deltas(report("a"), report("b"), ["stage"]), 9, "delta").select("stage", "path", "delta")


RUNS_SQL = f"""{rows_sql('p1_a')}, {rows_sql('p1_b').replace('scored AS', 'other AS')},
    runs AS (SELECT fold_id AS seed, 'a' AS variant, 'log_loss' AS metric, sum(-ln(chosen) * weight) / sum(weight) AS value FROM scored GROUP BY 1
      UNION ALL SELECT fold_id, 'b', 'log_loss', sum(-ln(chosen) * weight) / sum(weight) FROM other GROUP BY 1
      UNION ALL SELECT fold_id, 'a', 'accuracy', avg(correct) FROM scored GROUP BY 1 UNION ALL SELECT fold_id, 'b', 'accuracy', avg(correct) FROM other GROUP BY 1)"""


def runs(t):
    parts = []
    for model in ("a", "b"):
        e = metrics.evaluate(scored(t, model), ["fold_id"], 2).withColumnRenamed("fold_id", "seed").withColumn("variant", F.lit(model))
        parts += [e.select("seed", "variant", F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("log_loss", "accuracy")]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("h15_seed_aggregate", f"""
    WITH {RUNS_SQL}, d AS (SELECT r.*, r.value - b.value AS delta FROM runs r JOIN runs b ON b.variant = 'a' AND b.seed = r.seed AND b.metric = r.metric)
    SELECT variant, metric, count(*) AS seeds, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS population_sd, round(avg(delta), 9) AS delta_a_mean, round(stddev_pop(delta), 9) AS delta_a_sd
    FROM d GROUP BY 1, 2""", ("predictions",))
def _(t):
    return rounded(metrics.seed_aggregate(runs(t), ["a"]), 9, "mean", "population_sd", "delta_a_mean", "delta_a_sd")


@query("h15_contrasts", f"""
    WITH {RUNS_SQL}, d AS (SELECT a.metric, a.value - b.value AS delta FROM runs a JOIN runs b ON a.variant = 'b' AND b.variant = 'a' AND b.seed = a.seed AND b.metric = a.metric)
    SELECT 'b' AS candidate, 'a' AS reference, metric, count(*) AS seeds, round(avg(delta), 9) AS delta_mean, round(stddev_pop(delta), 9) AS population_sd, metric = 'log_loss' AS lower_is_better,
      round(CASE WHEN metric = 'log_loss' THEN -avg(delta) ELSE avg(delta) END, 9) AS improvement_mean FROM d GROUP BY metric""", ("predictions",))
def _(t):
    pairs = t.spark.createDataFrame([("b", "a")], "candidate string, reference string")
    return rounded(metrics.contrasts(runs(t), pairs, ["log_loss"]), 9, "delta_mean", "population_sd", "improvement_mean")


@query("h16_history_summary", """
    WITH h AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts) + CASE WHEN user_id % 10 = 3 THEN 1 ELSE 0 END AS epoch, value AS loss FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS k FROM h)
    SELECT run, count(*) AS epochs, arg_min(epoch, (loss, epoch)) AS best_epoch, min(loss) AS best_loss, max(epoch) AS final_epoch, arg_max(loss, epoch) AS final_loss,
      round(arg_max(loss, epoch) - min(loss), 9) AS final_minus_best, round(avg(loss) FILTER (WHERE k <= 5), 9) AS last_five_mean, min(epoch) = 1 AND max(epoch) = count(*) AS contiguous FROM r GROUP BY run""")
def _(t):
    placed = numbered(t.events.select(F.col("user_id").alias("run"), "ts", F.col("value").alias("loss")), ["run"], ["ts"], spread(F.col("ts"), 3600), "epoch")
    placed = placed.withColumn("epoch", F.expr("epoch + IF(run % 10 = 3, 1, 0)"))
    return rounded(metrics.history_summary(placed, "run", "epoch", "loss"), 9, "final_minus_best", "last_five_mean")
