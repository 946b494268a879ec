"""Rates, priors, distributions, smoothed probabilities (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.bitemporal import framed_sql
from tidemark.operators import stats

RATES_SQL = """rates AS (SELECT side_id, member_id, CAST(count(*) FILTER (WHERE is_success) AS DOUBLE) AS numerator,
    CAST(count(*) FILTER (WHERE is_opportunity) AS DOUBLE) AS denominator FROM facts GROUP BY side_id, member_id)"""


def rates(t):
    return stats.count_rates(t.facts, ["side_id", "member_id"], F.col("is_success").cast("int"), F.col("is_opportunity").cast("int"))


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("f1_count_rates", f"""
    WITH {RATES_SQL} SELECT side_id, sum(numerator) AS numerator, sum(denominator) AS denominator,
      round(sum(numerator) / nullif(sum(denominator), 0), 10) AS rate FROM rates GROUP BY side_id""", ("facts",))
def _(t):
    rows = rates(t)
    return rounded(stats.count_rates(rows, ["side_id"], F.col("numerator"), F.col("denominator")), 10, "rate")


def prior_sql(by: str, low: float, high: float) -> str:
    lead, on, group = (f"{by}, ", f"USING ({by})", f"GROUP BY {by}") if by else ("", "", "")
    join = f"JOIN pooled {on}" if by else "CROSS JOIN pooled"
    return f"""members AS (SELECT {lead}numerator AS n, denominator AS d FROM rates WHERE denominator > 0),
    pooled AS (SELECT {lead}least(greatest(sum(n) / sum(d), 1e-9), 1 - 1e-9) AS m FROM members {group}),
    moments AS (SELECT {lead}any_value(m) AS m, count(*) AS k, sum(d) AS w, sum(d * d) AS w2, sum(d * (n / d - m) ** 2) AS spread FROM members {join} {group}),
    spread AS (SELECT *, greatest(CASE WHEN w - w2 / w > 0 THEN spread / (w - w2 / w) ELSE 0 END - k * m * (1 - m) / w, 0) AS between_variance FROM moments),
    fitted AS (SELECT *, CASE WHEN k = 1 THEN {low}e0 WHEN between_variance <= 1e-9 THEN {high}e0
      ELSE least(greatest(m * (1 - m) / between_variance - 1, {low}), {high}) END AS strength FROM spread),
    prior AS (SELECT {lead}m AS prior_mean, strength AS prior_strength, m * strength AS alpha, (1 - m) * strength AS beta FROM fitted)"""


@query("f2_fit_beta_prior", f"""
    WITH {RATES_SQL}, {prior_sql('side_id', 2, 10000)} SELECT side_id, round(prior_mean, 9) AS prior_mean, round(prior_strength, 5) AS prior_strength,
      round(alpha, 5) AS alpha, round(beta, 5) AS beta FROM prior""", ("facts",))
def _(t):
    prior = stats.fit_beta_prior(rates(t), ["side_id"])
    return rounded(rounded(prior, 5, "prior_strength", "alpha", "beta"), 9, "prior_mean")


POSTERIOR_SQL = """SELECT side_id, member_id, round(alpha + numerator, 5) AS posterior_alpha, round(beta + denominator - numerator, 5) AS posterior_beta,
    round((alpha + numerator) / (alpha + beta + denominator), 9) AS posterior_mean,
    round(sqrt((alpha + numerator) * (beta + denominator - numerator) / ((alpha + beta + denominator) ** 2 * (alpha + beta + denominator + 1))), 9) AS posterior_sd,
    round(denominator / (denominator + alpha + beta), 9) AS data_weight"""


def shown_posterior(df):
    df = rounded(rounded(df, 5, "posterior_alpha", "posterior_beta"), 9, "posterior_mean", "posterior_sd", "data_weight")
    return df.select("side_id", "member_id", "posterior_alpha", "posterior_beta", "posterior_mean", "posterior_sd", "data_weight")


@query("f3_empirical_bayes_rate", f"WITH {RATES_SQL}, prior AS (SELECT 12e0 AS alpha, 30e0 AS beta) {POSTERIOR_SQL} FROM rates CROSS JOIN prior", ("facts",))
def _(t):
    prior = t.spark.createDataFrame([(12.0, 30.0)], "alpha double, beta double")
    return shown_posterior(stats.empirical_bayes(rates(t), prior))


@query("f4_empirical_bayes_shrinkage", f"WITH {RATES_SQL}, {prior_sql('', 25, 2000)} {POSTERIOR_SQL} FROM rates CROSS JOIN prior", ("facts",))
def _(t):
    return shown_posterior(stats.shrink(rates(t), minimum_strength=25.0, maximum_strength=2000.0))


@query("f5_numeric_distribution", """
    SELECT l_returnflag, count(*) AS count, min(l_extendedprice) AS minimum, max(l_extendedprice) AS maximum, round(avg(l_extendedprice), 3) AS mean,
      round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
      round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY l_returnflag""")
def _(t):
    result = stats.distribution(t.lineitem, ["l_returnflag"], "l_extendedprice", [0.1, 0.5, 0.95], 1000.0)
    return rounded(rounded(result, 6, "p10", "p50", "p95"), 3, "mean")


@query("f6_weighted_percentile", """
    WITH h AS (SELECT o_orderstatus, CAST(floor(o_totalprice / 100) AS BIGINT) AS v, count(*) AS n FROM orders GROUP BY 1, 2),
    r AS (SELECT *, sum(n) OVER (PARTITION BY o_orderstatus ORDER BY v) AS upto, sum(n) OVER (PARTITION BY o_orderstatus) AS total FROM h)
    SELECT o_orderstatus, CAST(any_value(total) AS BIGINT) AS count, min(v) FILTER (WHERE upto >= greatest(1, ceil(total * 0.5e0))) AS p50,
      min(v) FILTER (WHERE upto >= greatest(1, ceil(total * 0.9e0))) AS p90 FROM r GROUP BY o_orderstatus""")
def _(t):
    orders = t.orders.select("o_orderstatus", F.floor(F.col("o_totalprice") / 100).alias("v"))
    return stats.weighted_percentiles(orders, ["o_orderstatus"], "v", [0.5, 0.9], 500)


@query("f7_state_rows", f"""
    WITH f AS (SELECT member_id, count(*) FILTER (WHERE is_success) AS successes, count(*) FILTER (WHERE is_opportunity) AS attempts, sum(units)::BIGINT AS units,
      'member' AS kind, 'run-1' AS run, 'acting' AS role, '2000-01-01 00:00:00' AS cutoff, 'fp-0' AS fp FROM facts WHERE day < DATE '2000-01-01' GROUP BY member_id)
    SELECT sha256({framed_sql('kind', 'run', 'member_id', 'role', 'cutoff', 'fp')}) AS state_id, run AS run_id, member_id AS entity_id, role, fp AS source_fingerprint,
      CAST(json_object('successes', successes, 'units', units) AS VARCHAR) AS numerators, CAST(json_object('attempts', attempts) AS VARCHAR) AS denominators,
      epoch_us(TIMESTAMP '2000-01-01 00:00:00') AS event_at FROM f""", ("facts",))
def _(t):
    features = t.facts.where("day < DATE '2000-01-01'").groupBy("member_id").agg(
        F.count_if("is_success").alias("successes"), F.count_if("is_opportunity").alias("attempts"), F.sum("units").alias("units"))
    rows = stats.state_rows(features, "member_id", "member", "run-1", "2000-01-01 00:00:00", "fp-0", role="acting",
                            maps={"numerators": ["successes", "units"], "denominators": ["attempts"]})
    return rows.withColumn("event_at", F.unix_micros("event_at")).drop("available_at", "valid_from")


# Fixed prior of the test binding.
PRIOR = {"RF": 0.2, "RO": 0.15, "AF": 0.25, "AO": 0.1, "NF": 0.1, "NO": 0.2}


def counts_sql(name, by):
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"{name} AS (SELECT {lead}count(*) AS t, " + ", ".join(
        f"count(*) FILTER (WHERE outcome = '{c}') AS {c}" for c in PRIOR) + f" FROM seen {group})"


def probability_sql(c):
    overall = f"((o.{c} + 200 * {PRIOR[c]}e0 / 1e0) / (o.t + 200))"
    a, b = (f"((coalesce({x}.{c}, 0) + 80 * {overall}) / (coalesce({x}.t, 0) + 80))" for x in "ab")
    return f"round((coalesce(c.{c}, 0) + 30 * (0.5e0 * {a} + 0.5e0 * {b})) / (coalesce(c.t, 0) + 30), 9) AS p_{c}"


@query("f8_empirical_event_probabilities", f"""
    WITH seen AS (SELECT * FROM facts WHERE day < DATE '2000-01-01'), {counts_sql('o', '')}, {counts_sql('a', 'side_id')}, {counts_sql('b', 'other_side_id')},
    {counts_sql('c', 'side_id, other_side_id')}, x AS (SELECT DISTINCT home_id AS side_id, away_id AS other_side_id FROM games)
    SELECT x.side_id, x.other_side_id, {', '.join(probability_sql(c) for c in PRIOR)} FROM x CROSS JOIN o LEFT JOIN a ON a.side_id = x.side_id
    LEFT JOIN b ON b.other_side_id = x.other_side_id LEFT JOIN c ON c.side_id = x.side_id AND c.other_side_id = x.other_side_id""", ("facts", "games"))
def _(t):
    contexts = t.games.select(F.col("home_id").alias("side_id"), F.col("away_id").alias("other_side_id"))
    seen = t.facts.where("day < DATE '2000-01-01'")
    result = stats.event_probabilities(seen, contexts, PRIOR, member="side_id", other="other_side_id")
    return rounded(result, 9, *[f"p_{c}" for c in PRIOR])


@query("f9_legalise_and_normalise", """
    WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c, l_quantity >= 25 AS stop_a, l_linenumber = 1 AS stop_b FROM lineitem),
    m AS (SELECT *, CASE WHEN stop_a THEN a ELSE 0 END + CASE WHEN stop_b THEN b ELSE 0 END AS moved, a + b + c AS total FROM w)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN total > 0 THEN CASE WHEN stop_a THEN 0 ELSE a END / total END, 9) AS a,
      round(CASE WHEN total > 0 THEN CASE WHEN stop_b THEN 0 ELSE b END / total END, 9) AS b, round(CASE WHEN total > 0 THEN (c + moved) / total END, 9) AS c FROM m""")
def _(t):
    weights = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity AS a", "l_discount * 100 AS b", "l_tax * 100 AS c")
    legal = stats.legalise(weights, ["a", "b", "c"], {"a": F.col("a") >= 25, "b": F.col("l_linenumber") == 1}, "c")
    return rounded(legal, 9, "a", "b", "c")


@query("f10_conditional_split", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, source_id ORDER BY available_at DESC, event_at, event_type) AS rn FROM revisions WHERE available_at <= TIMESTAMP '2024-01-28 00:00:00'),
    u AS (SELECT event_type, 'b' || (row_id % 3) AS bucket FROM r WHERE rn = 1 AND event_at < TIMESTAMP '2024-01-28 00:00:00' AND event_type IN ('click', 'view', 'error')),
    g AS (SELECT count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'error') AS e FROM u),
    o AS (SELECT (c + 0.5e0) / (c + v + e + 1.5e0) AS oc, (v + 0.5e0) / (c + v + e + 1.5e0) AS ov, (e + 0.5e0) / (c + v + e + 1.5e0) AS oe FROM g),
    b AS (SELECT bucket, count(*) AS rows, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'error') AS e FROM u GROUP BY bucket)
    SELECT bucket, rows, round(oc, 9) AS overall_click, round((c + 20 * oc) / (rows + 20), 9) AS share_click, round(ov, 9) AS overall_view, round((v + 20 * ov) / (rows + 20), 9) AS share_view,
      round(oe, 9) AS overall_error, round((e + 20 * oe) / (rows + 20), 9) AS share_error FROM b CROSS JOIN o""", ("revisions",))
def _(t):
    keyed = t.revisions.withColumn("fact_id", F.concat_ws("/", "entity_id", "source_id"))
    split, _ = stats.conditional_split(keyed, "2024-01-28 00:00:00", ["click", "view", "error"], F.expr("concat('b', row_id % 3)"), outcome="event_type")
    return rounded(split, 9, *[c for c in split.columns if c.startswith(("overall", "share"))])


@query("f11_pivoted_outcome_counts", "SELECT group_id, side_id, " + ", ".join(
    f"count(*) FILTER (WHERE outcome = '{c}') AS n_{c}" for c in list(PRIOR)[:5]) + " FROM facts GROUP BY group_id, side_id", ("facts",))
def _(t):
    return stats.outcome_counts(t.facts, ["group_id", "side_id"], "outcome", list(PRIOR)[:5])
