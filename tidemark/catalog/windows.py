"""Windows (W), deterministic selection (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.bitemporal import framed_sql
from tidemark.catalog.statistics import rounded
from tidemark.operators import selection, windows
from tidemark.plans.ordered import spread, top_k
from tidemark.session import stored


@query("w1_row_number_top1", """
    SELECT event_type, row_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY available_at DESC, ingested_at DESC, valid_from DESC, row_id DESC) AS rn FROM revisions) WHERE rn = 1""",
       ("revisions",))
def _(t):
    order = [F.col(c).desc() for c in ("available_at", "ingested_at", "valid_from", "row_id")]
    return top_k(t.revisions, ["event_type"], order).select("event_type", "row_id")


@query("w2_lag_gaps", """
    SELECT group_id, ordinal, previous FROM (SELECT group_id, ordinal, lag(ordinal) OVER (PARTITION BY group_id ORDER BY ordinal) AS previous
      FROM (SELECT DISTINCT group_id, ordinal FROM raw_rows)) WHERE ordinal > previous + 1""", ("raw_rows",))
def _(t):
    rows = t.raw_rows.select("group_id", "ordinal").distinct()
    return windows.gaps(rows, ["group_id"], "ordinal", F.floor(F.col("ordinal") / 10000))


@query("w3_sample_with_total", """
    SELECT l_orderkey, n, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 8)) AS total
    FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 8) ORDER BY l_orderkey LIMIT 25""")
def _(t):
    found = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 8")
    return windows.sample_with_total(found, ["l_orderkey"], 25)


SERIES_SQL = "series AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)"


def series(t):
    return t.events.select("event_id", "user_id", "ts", F.expr("IF(event_type = 'error', NULL, value)").alias("value"))


@query("w4_rolling_sum_mean", f"""
    WITH {SERIES_SQL}, r AS (SELECT event_id, sum(value) OVER w AS s, count(value) OVER w AS n FROM series WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
    SELECT event_id, round(CASE WHEN n >= 3 THEN s END, 6) AS rolling_sum, round(CASE WHEN n >= 3 THEN s / n END, 6) AS rolling_mean FROM r""")
def _(t):
    rolled = windows.rolling(series(t), ["user_id"], ["ts"], spread(F.col("ts"), 3600), "value", 7, 3)
    return rounded(rolled, 6, "rolling_sum", "rolling_mean").select("event_id", "rolling_sum", "rolling_mean")


@query("w4_rolling_count_rate", """
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END AS num, l_quantity + l_linenumber AS den FROM lineitem),
    w AS (SELECT *, sum(CASE WHEN num IS NOT NULL THEN num END) OVER v AS n, sum(CASE WHEN num IS NOT NULL THEN den END) OVER v AS d, count(num) OVER v AS k FROM r
      WINDOW v AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN k >= 5 THEN n END AS rolling_numerator, CASE WHEN k >= 5 THEN d END AS rolling_denominator,
      round(CASE WHEN k >= 5 THEN n / d END, 9) AS rolling_rate FROM w""")
def _(t):
    rows = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "IF(l_returnflag = 'A', NULL, l_quantity) AS num", "l_quantity + l_linenumber AS den")
    rolled = windows.rolling_rate(rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], spread(F.col("l_orderkey"), 1000), "num", "den", 20, 5)
    return rounded(rolled, 9, "rolling_rate").drop("num", "den")


def ewma_sql(alpha, adjust):
    weight = f"(1 - {alpha}) ** (r.seen - p.seen)"
    if adjust:
        value = f"sum(p.value * {weight}) / sum({weight})"
    else:
        value = f"sum(p.value * {weight} * CASE WHEN p.seen = 1 THEN 1 ELSE {alpha} END)"
    return f"""WITH {SERIES_SQL}, r AS (SELECT *, count(value) OVER (PARTITION BY user_id ORDER BY ts) AS seen FROM series)
    SELECT r.event_id, round(CASE WHEN any_value(r.seen) >= 2 THEN {value} END, 6) AS ewma FROM r LEFT JOIN r p ON p.user_id = r.user_id AND p.value IS NOT NULL AND p.seen <= r.seen GROUP BY r.event_id"""


@query("w5_ewma_recursive", ewma_sql("0.2e0", False))
def _(t):
    result = windows.ewma(series(t), ["user_id"], ["ts"], spread(F.col("ts"), 3600), "value", min_periods=2, span=9)
    return rounded(result, 6, "ewma").select("event_id", "ewma")


@query("w5_ewma_adjusted", ewma_sql("0.3e0", True))
def _(t):
    result = windows.ewma(series(t), ["user_id"], ["ts"], spread(F.col("ts"), 3600), "value", min_periods=2, adjust=True, alpha=0.3)
    return rounded(result, 6, "ewma").select("event_id", "ewma")


@query("w6_time_decay_ewma", """
    SELECT user_id, """ + ", ".join(
    f"round(sum(2 ** (-(epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 86400e6 / {d}) * {v}) / sum(2 ** (-(epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts)) / 86400e6 / {d})), 8) AS {n}_ewma_{d}d"
    for d in (7, 14, 30) for n, v in (("value", "value"), ("error", "CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END"))) + """
    FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY user_id""")
def _(t):
    past = t.events.where(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp"))
    means = windows.time_decay_mean(past, ["user_id"], "ts", {
        "value": F.col("value"), "error": F.expr("IF(event_type = 'error', 1e0, 0e0)")}, "2024-01-20 00:00:00", [7, 14, 30])
    return rounded(means, 8, *[c for c in means.columns if c != "user_id"])


@query("w7_last_n_per_entity", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY day DESC, fact_id DESC) AS rn FROM facts)
    SELECT member_id, """ + ", ".join(f"CAST(count(*) FILTER (WHERE rn <= {n} AND {c}) AS DOUBLE) AS last_{n}_{a}"
                                      for n in (20, 50, 100) for a, c in (("successes", "is_success"), ("attempts", "is_opportunity"))) + " FROM r GROUP BY member_id",
       ("facts",))
def _(t):
    return windows.last_n_counts(t.facts, ["member_id"], [F.col("day").desc(), F.col("fact_id").desc()], [20, 50, 100], {
        "successes": F.col("is_success").cast("int"), "attempts": F.col("is_opportunity").cast("int")})


@query("w8_before_day_features", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY member_id ORDER BY day, fact_id) AS rn FROM facts),
    d AS (SELECT member_id, day, min(rn) - 1 AS prior_rows FROM r GROUP BY 1, 2)
    SELECT d.member_id, strftime(d.day, '%Y-%m-%d') AS day, any_value(d.prior_rows) AS prior_rows, CAST(coalesce(sum(units), 0) AS DOUBLE) AS prior_units,
      least(any_value(d.prior_rows), 10) AS recent_10_rows, CAST(coalesce(sum(units) FILTER (WHERE rn > d.prior_rows - 10), 0) AS DOUBLE) AS recent_10_units
    FROM d LEFT JOIN r ON r.member_id = d.member_id AND r.rn <= d.prior_rows GROUP BY d.member_id, d.day""", ("facts",))
def _(t):
    facts = stored(t.facts.select("member_id", "day", "fact_id", "units"), "facts")  # days and positions start from it
    result = windows.before_day(facts, ["member_id"], "day", ["fact_id"], {"units": F.col("units")}, recent=[10])
    return result.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("w9_evenly_spaced_sample", """
    WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS p, count(*) OVER () AS n FROM events),
    i AS (SELECT unnest(range(37)) AS i), w AS (SELECT CASE WHEN i = 36 THEN n - 1 ELSE CAST(floor(i * ((n - 1) / 36e0)) AS BIGINT) END AS spot FROM i, (SELECT count(*) AS n FROM events))
    SELECT event_id FROM r WHERE p IN (SELECT spot FROM w)""")
def _(t):
    return windows.evenly_spaced(t.events.select("event_id", "ts"), ["ts"], spread(F.col("ts"), 3600), 37).select("event_id")


@query("w10_mid_window", """
    WITH d AS (SELECT DISTINCT o_orderpriority, CAST(o_orderdate AS DATE) AS day FROM orders),
    l AS (SELECT * FROM (SELECT *, year(day) AS y, max(year(day)) OVER (PARTITION BY o_orderpriority) AS top FROM d) WHERE y = top),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY day) - 1 AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM l)
    SELECT o_orderpriority, strftime(day, '%Y-%m-%d') AS day FROM r WHERE rn >= floor((n - 14) / 2) AND rn < floor((n - 14) / 2) + 14 AND n >= 14""")
def _(t):
    days = t.orders.select("o_orderpriority", F.to_date("o_orderdate").alias("day"))
    return windows.middle_days(days, "o_orderpriority", "day", 14).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("w11_interval_union", """
    WITH v AS (SELECT user_id, epoch_us(ts) AS lo, epoch_us(ts) + CAST(round(value * 200) AS BIGINT) * 1000000 AS hi FROM events WHERE value > 0),
    o AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v WHERE hi > lo),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo) AS island FROM o)
    SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY user_id, island""")
def _(t):
    spans = t.events.selectExpr("user_id", "unix_micros(ts) AS lo", "unix_micros(ts) + CAST(round(value * 200) AS BIGINT) * 1000000 AS hi")
    return windows.interval_union(spans, ["user_id"], "lo", "hi", spread(F.col("lo"), 3600e6))


@query("s1_deterministic_order", "SELECT row_number() OVER (ORDER BY c_nationkey, c_custkey) AS place, c_nationkey, c_custkey FROM customer")
def _(t):
    from tidemark.plans.ordered import global_positions
    rows = t.customer.select("c_nationkey", "c_custkey")
    rank = F.col("c_nationkey") * 1e12 + F.col("c_custkey")  # grows with the order
    placed = global_positions(rows, ["c_nationkey", "c_custkey"], spread(rank, 100), "place")
    return selection.in_key_order(placed, ["c_nationkey", "c_custkey"])


@query("s2_sample_with_count", """
    WITH bad AS (SELECT group_id, ordinal, step FROM raw_rows WHERE post_state IS NULL AND outcome IS NOT NULL)
    SELECT group_id, ordinal, step, (SELECT count(*) FROM bad) AS total FROM bad ORDER BY group_id, ordinal, step LIMIT 10""", ("raw_rows",))
def _(t):
    bad = t.raw_rows.where("post_state IS NULL AND outcome IS NOT NULL").select("group_id", "ordinal", "step")
    return windows.sample_with_total(bad, ["group_id", "ordinal", "step"], 10)


@query("s3_cap_recent_edges", """
    WITH e AS (SELECT event_id AS edge_id, event_type AS route, CAST(ts AS DATE) AS day, epoch_us(date_trunc('day', ts) + to_hours(24)) - epoch_us(ts) AS event_age FROM events)
    SELECT edge_id, route, strftime(day, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY route, day ORDER BY event_age, edge_id) AS rn FROM e) WHERE rn <= 5""")
def _(t):
    edges = t.events.selectExpr("event_id AS edge_id", "event_type AS route", "CAST(ts AS DATE) AS day",
                                "unix_micros(timestampadd(HOUR, 24, date_trunc('day', ts))) - unix_micros(ts) AS event_age")
    return selection.cap_recent(edges, 5).select("edge_id", "route", F.date_format("day", "yyyy-MM-dd").alias("day"))


@query("s4_seeded_cap", f"""
    WITH e AS (SELECT event_id, CAST(ts AS DATE) AS day, 11 AS seed FROM events)
    SELECT event_id, strftime(day, '%Y-%m-%d') AS day FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY sha256({framed_sql('seed', 'day', 'event_id')}), event_id) AS rn FROM e) WHERE rn <= 20""")
def _(t):
    rows = t.events.select("event_id", F.to_date("ts").alias("day"))
    return selection.seeded_cap(rows, 20, 11, "event_id").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("s5_argmax_per_dimension", """
    WITH b AS (SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS batch, count(*) AS orders, CAST(floor(max(o_totalprice)) AS BIGINT) AS biggest, count(DISTINCT o_custkey) AS buyers FROM orders GROUP BY 1),
    l AS (SELECT batch, orders, buyers, unnest(['orders', 'biggest', 'buyers']) AS dimension, unnest([orders, biggest, buyers]) AS size FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY size DESC, orders DESC, buyers DESC, batch) AS rn FROM l)
    SELECT batch, array_to_string(list_sort(list(dimension)), ',') AS dimensions FROM r WHERE rn = 1 GROUP BY batch""")
def _(t):
    batches = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("batch")).agg(
        F.count("*").alias("orders"), F.floor(F.max("o_totalprice")).alias("biggest"), F.count_distinct("o_custkey").alias("buyers"))
    best = selection.argmax_per_dimension(batches, "batch", {c: F.col(c) for c in ("orders", "biggest", "buyers")}, ["orders", "buyers"])
    return best.withColumn("dimensions", F.array_join("dimensions", ","))


@query("s6_top_recommendations", """
    SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 15""")
def _(t):
    order = [F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey")]
    return selection.top_rows(t.orders, order, 15).select("o_orderkey", "o_custkey", "o_orderstatus")
