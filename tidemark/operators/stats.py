"""Aggregates and statistics over counted evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digests import framed
from tidemark.functions.rates import clamp, posterior, rate, smoothed
from tidemark.plans.ordered import running, top_k

EPSILON = 1e-9


def count_rates(df: DataFrame, by: Sequence[str], numerator: Column, denominator: Column) -> DataFrame:
    """Sums of both parts per group; rates are never averaged."""
    sums = df.groupBy(*by).agg(F.sum(numerator.cast("double")).alias("numerator"), F.sum(denominator.cast("double")).alias("denominator"))
    return sums.withColumn("rate", rate(F.col("numerator"), F.col("denominator")))


def fit_beta_prior(df: DataFrame, by: Sequence[str] = (), *, numerator: str = "numerator", denominator: str = "denominator",
                   minimum_strength: float = 2.0, maximum_strength: float = 10_000.0, fallback_mean: float = 0.5) -> DataFrame:
    """Method-of-moments beta prior per cohort: pooled mean, variance between members above sampling noise.

    The spread is summed in a second pass around the pooled mean of the cohort, so it does not
    cancel.  A member with more successes than trials, or fewer than none, is an error.
    """
    n, d = F.col(numerator).cast("double"), F.col(denominator).cast("double")
    refused = F.raise_error(F.lit("a member has more successes than trials, or fewer than none")).cast("double")
    members = df.select(*by, F.when((n < 0) | (n > d), refused).otherwise(n).alias("n"), d.alias("d")).where("d > 0")
    mean = clamp(F.col("sn") / F.col("w"), EPSILON, 1.0 - EPSILON)
    sums = members.groupBy(*by).agg(
        F.count("*").alias("members"), F.sum("n").alias("sn"), F.sum("d").alias("w"), F.sum(F.col("d") * F.col("d")).alias("w2")
    ).withColumn("m", mean)
    centre = sums.select(*by, "m")
    # One row per cohort on the right; Spark picks the join by its size.
    placed = members.join(centre, list(by)) if by else members.crossJoin(centre)
    spread = placed.groupBy(*by).agg(F.sum(F.col("d") * F.pow(F.col("n") / F.col("d") - F.col("m"), 2)).alias("spread"))
    moments = sums.join(spread, list(by)) if by else sums.crossJoin(spread)
    effective = F.col("w") - F.col("w2") / F.col("w")
    observed = F.when(effective > 0, F.col("spread") / effective).otherwise(0.0)
    noise = F.col("members") * F.col("m") * (1.0 - F.col("m")) / F.col("w")
    between = F.greatest(observed - noise, F.lit(0.0))
    moments = moments.withColumn("between", between)
    fitted = clamp(F.try_divide(F.col("m") * (1.0 - F.col("m")), F.col("between")) - 1.0, minimum_strength, maximum_strength)
    strength = (F.when(F.col("m").isNull(), F.lit(minimum_strength)).when(F.col("members") == 1, F.lit(minimum_strength))
                .when(F.col("between") <= EPSILON, F.lit(maximum_strength)).otherwise(fitted))
    cohorts = df.select(*by).distinct().join(moments, list(by), "left") if by else moments
    center = F.coalesce(F.col("m"), F.lit(fallback_mean))
    return cohorts.select(*by, center.alias("prior_mean"), strength.alias("prior_strength"),
                          (center * strength).alias("alpha"), ((1.0 - center) * strength).alias("beta"))


def empirical_bayes(df: DataFrame, prior: DataFrame, by: Sequence[str] = (), *, numerator: str = "numerator",
                    denominator: str = "denominator") -> DataFrame:
    """Beta posterior of every row under the prior of its cohort."""
    joined = df.join(prior, list(by)) if by else df.crossJoin(F.broadcast(prior))  # a single prior row
    values = posterior(F.col(numerator), F.col(denominator), F.col("alpha"), F.col("beta"))
    return joined.withColumns(values)


def shrink(df: DataFrame, by: Sequence[str] = (), **bounds: Any) -> DataFrame:
    return empirical_bayes(df, fit_beta_prior(df, by, **bounds), by)


def percentile_name(p: float) -> str:
    """``p50``, ``p05``; finer probabilities keep their digits: ``p12_5``."""
    whole = round(p * 100)
    return f"p{whole:02d}" if abs(p * 100 - whole) < 1e-9 else "p" + f"{p * 100:.10g}".replace(".", "_")


def _histogram(df: DataFrame, by: Sequence[str], value: str, width: float) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return running(counts, list(by), [value], F.floor(F.col(value) / F.lit(float(width))), {"upto": F.col("n")})


def distribution(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], width: float) -> DataFrame:
    """Exact count, min, mean, max and linearly interpolated quantiles per group.

    Values are counted first and the running count is cut by value ranges of
    ``width``, so neither a hot group nor a wide one is held in one buffer.
    """
    histogram = _histogram(df, by, value, width)
    totals = histogram.groupBy(*by).agg(
        F.sum("n").alias("count"), F.min(value).alias("minimum"), F.max(value).alias("maximum"),
        (F.sum(F.col("n") * F.col(value)) / F.sum("n")).alias("mean"))
    placed = histogram.join(totals.select(*by, F.col("count").alias("__total")), list(by))
    ends = []
    for i, p in enumerate(probabilities):
        at = (F.col("__total") - 1) * F.lit(float(p))
        ends.append(F.min(F.when(F.col("upto") >= F.floor(at) + 1, F.col(value))).alias(f"__lo{i}"))
        ends.append(F.min(F.when(F.col("upto") >= F.ceil(at) + 1, F.col(value))).alias(f"__hi{i}"))
    result = totals.join(placed.groupBy(*by).agg(*ends), list(by))
    for i, p in enumerate(probabilities):
        at = (F.col("count") - 1) * F.lit(float(p))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        result = result.withColumn(percentile_name(p), low + (high - low) * (at - F.floor(at)))
    return result.drop(*[f"__{e}{i}" for i in range(len(probabilities)) for e in ("lo", "hi")])


def weighted_percentiles(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[float], width: float) -> DataFrame:
    """Smallest value whose cumulative count reaches ``ceil(q * n)`` (at least one)."""
    histogram = _histogram(df, by, value, width)
    totals = histogram.groupBy(*by).agg(F.sum("n").alias("count"))
    placed = histogram.join(totals, list(by))
    picks = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("count") * F.lit(float(p)))), F.col(value)))
             .alias(percentile_name(p)) for p in probabilities]
    return placed.groupBy(*by, "count").agg(*picks)


def state_rows(features: DataFrame, entity: str, kind: str, run_id: str, cutoff: Any, fingerprint: str, *,
               maps: Mapping[str, Sequence[str]], role: str | None = None) -> DataFrame:
    """Feature rows as immutable state rows with a deterministic id and JSON maps (sorted keys)."""
    cutoff_text = str(cutoff)
    parts = [F.lit(kind), F.lit(run_id), F.col(entity), *([F.lit(role)] if role else []), F.lit(cutoff_text), F.lit(fingerprint)]
    documents = [F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias(name) for name, columns in maps.items()]
    clock = F.lit(cutoff_text).cast("timestamp")
    return features.select(
        F.sha2(framed(parts), 256).alias("state_id"), F.lit(run_id).alias("run_id"), F.col(entity).alias("entity_id"),
        *([F.lit(role).alias("role")] if role else []), F.lit(fingerprint).alias("source_fingerprint"), *documents,
        clock.alias("event_at"), clock.alias("available_at"), clock.alias("valid_from"))


def outcome_counts(df: DataFrame, by: Sequence[str], outcome: str, classes: Sequence[str], prefix: str = "n_") -> DataFrame:
    """One column per class in fixed order; outcomes outside the list are not counted."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(outcome) == c).alias(prefix + c) for c in classes])


def event_probabilities(df: DataFrame, contexts: DataFrame, prior: Mapping[str, float], *, member: str, other: str,
                        outcome: str = "outcome", league_strength: float = 200.0, member_strength: float = 80.0,
                        pair_strength: float = 30.0) -> DataFrame:
    """Hierarchically smoothed outcome probabilities for ``(member, other)`` contexts.

    Overall counts are smoothed towards the prior, both entities towards the
    overall rate, and the pair towards the even mix of its two entities.
    """
    classes = list(prior)
    weight = sum(prior.values())

    def counted(by: Sequence[str], tag: str) -> DataFrame:
        return outcome_counts(df, by, outcome, classes, tag)

    def total(tag: str) -> Column:
        return sum((F.coalesce(F.col(tag + c), F.lit(0)) for c in classes[1:]), F.coalesce(F.col(tag + classes[0]), F.lit(0)))

    rows = (contexts.select(member, other).distinct()
            .join(counted([member], "a_"), member, "left").join(counted([other], "b_"), other, "left")
            .join(counted([member, other], "c_"), [member, other], "left")
            .crossJoin(F.broadcast(counted([], "o_"))))  # one row of overall counts
    rows = rows.withColumns({f"__t{tag}": total(f"{tag}_") for tag in "oabc"})

    def level(tag: str, c: str, base: Column, strength: float) -> Column:
        return smoothed(F.coalesce(F.col(f"{tag}_{c}"), F.lit(0)), F.col(f"__t{tag}"), base, strength)

    result = []
    for c in classes:
        overall = level("o", c, F.lit(prior[c] / weight), league_strength)
        mixed = 0.5 * level("a", c, overall, member_strength) + 0.5 * level("b", c, overall, member_strength)
        result.append(level("c", c, mixed, pair_strength).alias(f"p_{c}"))
    return rows.select(member, other, *result)


def _moment(clock: Any) -> datetime:
    """A clock as a point in time; one without a zone is UTC."""
    value = datetime.fromisoformat(str(clock))
    return value if value.tzinfo is not None else value.replace(tzinfo=timezone.utc)


def check_model_cutoff(model_cutoff: Any, query_cutoff: Any) -> None:
    if _moment(model_cutoff) > _moment(query_cutoff):
        raise ValueError("the model saw facts after the query's cutoff")


def legalise(df: DataFrame, classes: Sequence[str], impossible: Mapping[str, Column], default: str) -> DataFrame:
    """Move the mass of impossible classes to the default one, then normalise (no mass gives NULL)."""
    moved = sum((F.when(rule, F.col(c)).otherwise(0.0) for c, rule in impossible.items()), F.lit(0.0))
    kept = {c: F.when(impossible[c], 0.0).otherwise(F.col(c)) if c in impossible else F.col(c) for c in classes}
    kept[default] = kept[default] + moved
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return df.withColumns({c: F.when(total > 0, kept[c] / total) for c in classes})


def conditional_split(df: DataFrame, cutoff: Any, classes: Sequence[str], bucket: Column, *, key: str = "fact_id",
                      outcome: str = "outcome", pseudocount: float = 0.5, strength: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """Shares of ``classes`` overall and per state bucket, each bucket shrunk to the overall shares.

    The latest revision of each fact is chosen first; event time is filtered
    afterwards.  The second result lists facts whose latest revisions tie.
    """
    at = F.lit(str(cutoff)).cast("timestamp")
    known = df.where(F.col("available_at") <= at)
    payload = F.struct(F.col("event_at"), F.col(outcome), bucket.alias("bucket"))
    latest = known.groupBy(key, "available_at").agg(
        F.min(payload).alias("row"), (F.min(payload) != F.max(payload)).alias("tied"))
    latest = top_k(latest, [key], [F.col("available_at").desc()])
    ambiguous = latest.where("tied").select(key, "available_at")
    usable = latest.select("row.*").where((F.col("event_at") < at) & F.col(outcome).isin(list(classes)))
    overall = outcome_counts(usable, [], outcome, classes, "g_")
    buckets = outcome_counts(usable.where("bucket IS NOT NULL"), ["bucket"], outcome, classes)
    joined = buckets.crossJoin(F.broadcast(overall))  # one row of overall counts
    all_count = sum((F.col(f"g_{c}") for c in classes[1:]), F.col(f"g_{classes[0]}"))
    here = sum((F.col(f"n_{c}") for c in classes[1:]), F.col(f"n_{classes[0]}"))
    shares = []
    for c in classes:
        base = (F.col(f"g_{c}") + pseudocount) / (all_count + len(classes) * pseudocount)
        shares += [base.alias(f"overall_{c}"), smoothed(F.col(f"n_{c}"), here, base, strength).alias(f"share_{c}")]
    return joined.select("bucket", here.alias("rows"), *shares), ambiguous
