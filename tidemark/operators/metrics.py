"""Probability metrics over rows ``(label, probabilities, weight)``.

``label`` is a zero-based class index, ``probabilities`` an array with one entry
per class.  Every metric is one pass of partial aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import stats
from tidemark.plans.ordered import top_k


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def probability_violations(df: DataFrame, classes: int, labels: Sequence[Any] | None = None, label: str = "label",
                           row_id: str = "query_id") -> DataFrame:
    """Why a row cannot be scored: shape, range, sum, label or weight."""
    p = F.col("probabilities")
    known = F.col(label).isin(list(labels)) if labels is not None else F.col(label).between(0, classes - 1)
    bad_value = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    w = F.col("weight")
    rules = [
        F.when(F.size(p) != classes, F.lit("class_count")), F.when(bad_value, F.lit("value_out_of_range")),
        F.when(~bad_value & (F.abs(_total(p) - 1.0) > 1e-9 + 1e-7), F.lit("sum_not_one")),
        F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown_label")),
        F.when(w.isNull() | F.isnan(w) | (w < 0) | (w == F.lit(float("inf"))), F.lit("weight_invalid"))]
    return df.select(row_id, F.explode(F.array_compact(F.array(*rules))).alias("code"))


def checked(df: DataFrame, labels: Sequence[Any] | None = None, label: str = "label") -> DataFrame:
    """Probabilities renormalised, labels as class indices, weights scaled by the largest one.

    Scaling by the maximum first keeps sums finite for very large weights.
    """
    index = F.col(label) if labels is None else (F.array_position(F.lit(list(labels)), F.col(label)) - 1).cast("int")
    heaviest = F.max(F.col("weight").cast("double"))
    refused = F.raise_error(F.lit("all weights are zero")).cast("double")
    top = df.agg(F.when(heaviest == 0, refused).otherwise(heaviest).alias("__top"))
    total = _total(F.col("probabilities"))
    return (df.crossJoin(F.broadcast(top))  # one-row maximum
            .withColumns({label: index, "weight": F.col("weight") / F.col("__top"),
                          "probabilities": F.transform("probabilities", lambda x: x / total)}).drop("__top"))


def row_scores(df: DataFrame, epsilon: float = 1e-15) -> DataFrame:
    p = F.col("probabilities")
    chosen = F.get(p, F.col("label"))
    best = F.array_max(p)
    squares = F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x * x)
    return df.withColumns({
        "log_loss": -F.log(F.least(F.greatest(chosen, F.lit(epsilon)), F.lit(1.0))),
        "brier": squares - 2.0 * chosen + 1.0, "confidence": best,
        "correct": (F.array_position(p, best) - 1 == F.col("label")).cast("double")})


def _edges_at_most(edges: Column, value: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= value))


def evaluate(df: DataFrame, by: Sequence[str], classes: int, *, bins: int = 15, strategy: str = "uniform") -> DataFrame:
    """Samples, log loss, Brier score, accuracy and top-label calibration error per group.

    Rows are summed per group and calibration bin first, so both levels are small.
    """
    scored = row_scores(df)
    if strategy == "uniform":
        edges = F.lit([i * (1.0 / bins) for i in range(1, bins)]) if bins > 1 else F.array().cast("array<double>")
    elif strategy == "quantile":
        marks = [i / bins for i in range(1, bins)]
        cuts = stats.distribution(scored, by, "confidence", marks, 0.01)
        cuts = cuts.select(*by, F.array(*[stats.percentile_name(m) for m in marks]).alias("__edges"))
        scored = scored.join(cuts, list(by)) if by else scored.crossJoin(F.broadcast(cuts))  # one row of edges
        edges = F.col("__edges")
    else:
        raise ValueError(f"no binning named {strategy!r}")
    scored = scored.withColumn("__bin", _edges_at_most(edges, F.col("confidence")))
    w = F.col("weight").cast("double")
    per_bin = scored.groupBy(*by, "__bin").agg(
        F.count("*").alias("n"), F.sum(w).alias("w"), F.sum("correct").alias("hits"),
        *[F.sum(w * F.col(c)).alias(c) for c in ("log_loss", "brier", "confidence", "correct")])
    gap = F.abs(F.col("correct") - F.col("confidence"))
    total = per_bin.groupBy(*by).agg(
        F.sum("n").alias("samples"), *[(F.sum(c) / F.sum("w")).alias(c) for c in ("log_loss", "brier")],
        (F.sum("hits") / F.sum("n")).alias("accuracy"), (F.sum(gap) / F.sum("w")).alias("calibration_error"))
    return total


def log_loss(df: DataFrame, by: Sequence[str], epsilon: float = 1e-15) -> DataFrame:
    w = F.col("weight").cast("double")
    return row_scores(df, epsilon).groupBy(*by).agg((F.sum(w * F.col("log_loss")) / F.sum(w)).alias("log_loss"))


def brier(df: DataFrame, by: Sequence[str]) -> DataFrame:
    w = F.col("weight").cast("double")
    return row_scores(df).groupBy(*by).agg((F.sum(w * F.col("brier")) / F.sum(w)).alias("brier"))


def calibration_error(df: DataFrame, by: Sequence[str], classes: int, **options: Any) -> DataFrame:
    return evaluate(df, by, classes, **options).select(*by, "calibration_error")


def absolute_errors(df: DataFrame, by: Sequence[str], pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Mean absolute error per field over the rows where it was observed, with the row counts."""
    aggregates = []
    for name, (expected, observed) in pairs.items():
        aggregates += [F.avg(F.abs(F.col(expected) - F.col(observed))).alias(f"{name}_mae"), F.count(observed).alias(f"{name}_rows")]
    return df.groupBy(*by).agg(*aggregates)


def _log_sum_exp(array: Column) -> Column:
    top = F.array_max(array)
    return top + F.log(F.aggregate(array, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def partial_observation_nll(df: DataFrame, rows: int, columns: int, *, logits: str = "logits", count: str = "opportunities",
                            minimum: str = "minimum", successes: str = "successes") -> DataFrame:
    """NLL of a joint (opportunities, successes) table given exact or lower-bound opportunities.

    ``logits`` holds the table row by row: ``rows`` opportunity buckets times ``columns`` success buckets, the
    last of each taking the overflow.  An unknown count admits every bucket from its lower bound on.
    """
    least_count = F.least(F.greatest(F.coalesce(F.col(minimum), F.lit(1)), F.col(successes)), F.lit(rows))
    success_bucket = F.least(F.col(successes), F.lit(columns - 1))

    def allowed(i: Column) -> Column:
        row = F.floor(i / columns) + 1
        fits = F.when(F.col(count) >= 1, row == F.least(F.col(count), F.lit(rows))).otherwise(row >= least_count)
        return fits & (i % columns == success_bucket)

    picked = F.filter(F.transform(F.col(logits), lambda x, i: F.when(allowed(i), x)), lambda x: x.isNotNull())
    return df.withColumn("nll", _log_sum_exp(F.col(logits)) - _log_sum_exp(picked))


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: shifted up by eight factors, then Stirling's series, so a row costs the same whatever x is."""
    y = x + 8.0
    square = y * y
    series = (1.0 / 12 - (1.0 / 360 - (1.0 / 1260 - (1.0 / 1680 - 1.0 / (1188 * square)) / square) / square) / square) / y
    factors = x
    for k in range(1, 8):
        factors = factors * (x + float(k))
    # Above 1e30 the eight factors would leave the range of a double, and the shift no longer matters.
    small = (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(factors)
    large = (x - 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi))
    return F.when(x < 1e30, small).otherwise(large)


def _log_rising(start: Column, count: Column) -> Column:
    """``log(start) + log(start + 1) + ...`` over ``count`` terms: a difference of log gammas, also for fractional counts."""
    start, count = start.cast("double"), count.cast("double")
    return F.when(count > 0, log_gamma(start + count) - log_gamma(start)).otherwise(F.when(count.isNotNull(), F.lit(0.0)))


def poisson_nll(rate: Column, observed: Column) -> Column:
    """Full Poisson NLL; NULL where nothing was observed."""
    return rate - observed * F.log(rate) + _log_rising(F.lit(1.0), observed)


def negative_binomial_log_prob(observed: Column, mean: Column, dispersion: Column) -> Column:
    """NB2 log probability of an integer count."""
    mean, r = F.greatest(mean, F.lit(1e-8)), F.greatest(dispersion, F.lit(1e-8))
    return (_log_rising(r, observed) - _log_rising(F.lit(1.0), observed) + r * (F.log(r) - F.log(r + mean))
            + observed * (F.log(mean) - F.log(r + mean)))


def count_model_nll(df: DataFrame, by: Sequence[str], fields: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Mean Poisson NLL over all observed cells of the given ``(rate, observed)`` fields."""
    cells = F.array_compact(F.array(*[poisson_nll(F.col(r), F.col(o)) for r, o in fields.values()]))
    rows = df.withColumns({"__nll": F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x), "__cells": F.size(cells)})
    return rows.groupBy(*by).agg((F.sum("__nll") / F.greatest(F.sum("__cells"), F.lit(1))).alias("poisson_nll"),
                                 F.sum("__cells").alias("cells"))


def multinomial_nll(df: DataFrame, by: Sequence[str], counts: Sequence[str], logits: Sequence[str]) -> DataFrame:
    """Mean NLL per counted outcome under a softmax over ``logits``."""
    norm = _log_sum_exp(F.array(*logits))
    row = sum((-F.col(c) * (F.col(x) - norm) for c, x in zip(counts, logits)), F.lit(0.0))
    n = sum((F.col(c) for c in counts[1:]), F.col(counts[0]))
    return df.groupBy(*by).agg((F.sum(row) / F.greatest(F.sum(n), F.lit(1))).alias("multinomial_nll"), F.sum(n).alias("outcomes"))


# --- comparisons of runs --------------------------------------------------------------------

def population_differences(left: DataFrame, right: DataFrame, key: str, labels: Sequence[str] = ("label",)) -> DataFrame:
    """Queries on one side only, listed twice, or with a changed label; empty when the runs can be paired."""
    a = left.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct(*labels)).alias("l"))
    b = right.groupBy(key).agg(F.count("*").alias("m"), F.min(F.struct(*labels)).alias("r"))
    joined = a.join(b, key, "full_outer")
    code = (F.when(F.col("m").isNull(), "missing").when(F.col("n").isNull(), "extra").when((F.col("n") > 1) | (F.col("m") > 1), "duplicate")
            .when(~F.col("l").eqNullSafe(F.col("r")), "label_changed"))
    return joined.select(key, code.alias("code")).where("code IS NOT NULL")


def paired_sensitivity(reference: DataFrame, candidate: DataFrame, key: str = "query_id", scalars: Sequence[str] = (),
                       by: Sequence[str] = ()) -> DataFrame:
    """How far predictions move between two runs over the same queries."""
    right = candidate.select(key, F.col("probabilities").alias("__p"), *[F.col(c).alias(f"__{c}") for c in scalars])
    joined = reference.join(right, key)
    change = F.zip_with("probabilities", "__p", lambda a, b: b - a)
    first = F.array_position("probabilities", F.array_max("probabilities"))
    second = F.array_position("__p", F.array_max("__p"))
    rows = joined.withColumn("__d", change).withColumns({
        "tv": F.aggregate("__d", F.lit(0.0), lambda acc, x: acc + F.abs(x)) * 0.5,
        "__abs": F.aggregate("__d", F.lit(0.0), lambda acc, x: acc + F.abs(x)),
        "__top": F.array_max(F.transform("__d", lambda x: F.abs(x))),
        "__sq": F.aggregate("__d", F.lit(0.0), lambda acc, x: acc + x * x), "__n": F.size("__d"), "__flip": (first != second).cast("int"),
        **{f"__delta_{c}": F.col(f"__{c}") - F.col(c) for c in scalars}})
    report = rows.groupBy(*by).agg(
        F.count("*").alias("queries"), F.avg("tv").alias("mean_total_variation"), F.max("tv").alias("max_total_variation"),
        (F.sum("__abs") / F.sum("__n")).alias("mean_absolute_change"), F.max("__top").alias("max_absolute_change"),
        F.sqrt(F.sum("__sq") / F.sum("__n")).alias("rms_change"), F.sum("__flip").alias("argmax_flips"), F.avg("__flip").alias("argmax_flip_rate"),
        *[a for c in scalars for a in (
            F.avg(F.abs(F.col(f"__delta_{c}"))).alias(f"{c}_mean_absolute_change"), F.max(F.abs(F.col(f"__delta_{c}"))).alias(f"{c}_max_absolute_change"),
            F.sqrt(F.avg(F.pow(F.col(f"__delta_{c}"), 2))).alias(f"{c}_rms_change"))])
    spread = stats.distribution(rows, by, "tv", [0.5, 0.95], 0.01).select(
        *by, F.col("p50").alias("median_total_variation"), F.col("p95").alias("p95_total_variation"))
    return report.join(spread, list(by)) if by else report.crossJoin(F.broadcast(spread))  # two one-row results


def numeric_leaves(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nested report columns as ``(path, value)`` rows; only numeric leaves are kept."""
    def walk(schema: T.StructType, prefix: str) -> list[tuple[str, Column]]:
        found = []
        for field in schema.fields:
            if not prefix and field.name in keys:
                continue
            path = f"{prefix}.{field.name}" if prefix else field.name
            if isinstance(field.dataType, T.StructType):
                found += walk(field.dataType, path)
            elif isinstance(field.dataType, T.NumericType):
                found.append((path, F.col(path).cast("double")))
        return found

    leaves = [F.struct(F.lit(path).alias("path"), value.alias("value")) for path, value in walk(df.schema, "")]
    return df.select(*keys, F.explode(F.array(*leaves)).alias("leaf")).select(*keys, "leaf.path", "leaf.value")


def metric_deltas(reference: DataFrame, candidate: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Candidate minus reference on the numeric leaves both reports have (NULL when one side is NULL)."""
    left = numeric_leaves(reference, keys)
    right = numeric_leaves(candidate, keys).withColumnRenamed("value", "candidate")
    return left.join(right, [*keys, "path"]).withColumn("delta", F.col("candidate") - F.col("value"))


def partial_metrics(runs: DataFrame) -> DataFrame:
    """Metrics that only some seeds of a variant report (``runs``: seed, variant, metric, value)."""
    seeds = runs.agg(F.count_distinct("seed").alias("seeds"))
    seen = runs.groupBy("variant", "metric").agg(F.count("value").alias("n"))
    return seen.crossJoin(F.broadcast(seeds)).where((F.col("n") > 0) & (F.col("n") < F.col("seeds"))).drop("n", "seeds")  # one-row total


def seed_aggregate(runs: DataFrame, references: Sequence[str]) -> DataFrame:
    """Mean and population deviation per variant and metric, and paired deltas to each reference variant."""
    result = runs.groupBy("variant", "metric").agg(
        F.count("value").alias("seeds"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("population_sd"))
    for reference in references:
        base = runs.where(F.col("variant") == reference).select("seed", "metric", F.col("value").alias("__base"))
        paired = runs.join(base, ["seed", "metric"]).withColumn("__delta", F.col("value") - F.col("__base"))
        deltas = paired.groupBy("variant", "metric").agg(
            F.avg("__delta").alias(f"delta_{reference}_mean"), F.stddev_pop("__delta").alias(f"delta_{reference}_sd"))
        result = result.join(deltas, ["variant", "metric"], "left")
    return result


def contrasts(runs: DataFrame, pairs: DataFrame, lower_is_better: Sequence[str]) -> DataFrame:
    """Named contrasts ``pairs(candidate, reference)``: mean paired delta and the improvement it means."""
    a = runs.select(F.col("variant").alias("candidate"), "seed", "metric", F.col("value").alias("__a"))
    b = runs.select(F.col("variant").alias("reference"), "seed", "metric", F.col("value").alias("__b"))
    joined = pairs.join(a, "candidate").join(b, ["reference", "seed", "metric"])  # a handful of named pairs
    delta = F.col("__a") - F.col("__b")
    low = F.col("metric").isin(list(lower_is_better))
    grouped = joined.groupBy("candidate", "reference", "metric").agg(
        F.count(delta).alias("seeds"), F.avg(delta).alias("delta_mean"), F.stddev_pop(delta).alias("__sd"))
    return grouped.select(
        "candidate", "reference", "metric", "seeds", "delta_mean", F.when(F.col("seeds") > 1, F.col("__sd")).alias("population_sd"),
        low.alias("lower_is_better"), F.when(low, -F.col("delta_mean")).otherwise(F.col("delta_mean")).alias("improvement_mean"))


def history_summary(history: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """Best and final epoch, their distance, mean of the last five, and whether epochs run 1..n without a gap."""
    base = history.groupBy(run).agg(
        F.count("*").alias("epochs"), F.min_by(epoch, F.struct(loss, epoch)).alias("best_epoch"), F.min(loss).alias("best_loss"),
        F.max(epoch).alias("final_epoch"), F.max_by(loss, epoch).alias("final_loss"), F.min(epoch).alias("__first"))
    repeats = history.groupBy(run, epoch).agg(F.count("*").alias("n")).groupBy(run).agg(F.max("n").alias("__repeats"))
    tail = top_k(history, [run], [F.col(epoch).desc()], 5).groupBy(run).agg(F.avg(loss).alias("last_five_mean"))
    contiguous = (F.col("__first") == 1) & (F.col("final_epoch") == F.col("epochs")) & (F.col("__repeats") == 1)
    return base.join(tail, run).join(repeats, run).select(
        run, "epochs", "best_epoch", "best_loss", "final_epoch", "final_loss",
        (F.col("final_loss") - F.col("best_loss")).alias("final_minus_best"), "last_five_mean", contiguous.alias("contiguous"))
