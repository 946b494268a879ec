"""Workload tables (P) and scenario scoring (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.bitemporal import framed_sql
from tidemark.catalog.statistics import rounded
from tidemark.operators import scenarios, workload

COUNTS_SQL = """counts AS (SELECT CAST(o_orderdate AS DATE) AS day, 'edge' AS kind, o_orderpriority AS name, count(*) AS n FROM orders GROUP BY 1, 3
      UNION ALL SELECT CAST(o_orderdate AS DATE), 'node', o_orderstatus, count(DISTINCT o_custkey) FROM orders GROUP BY 1, 3
      UNION ALL SELECT CAST(o_orderdate AS DATE), 'query', l_returnflag, count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 3),
    w AS (SELECT day, CAST(coalesce(sum(n) FILTER (WHERE kind = 'node'), 0) AS BIGINT) AS nodes, CAST(coalesce(sum(n) FILTER (WHERE kind = 'edge'), 0) AS BIGINT) AS edges, CAST(coalesce(sum(least(n, 3)) FILTER (WHERE kind = 'edge'), 0) AS BIGINT) AS effective_edges,
      CAST(coalesce(sum(n) FILTER (WHERE kind = 'query'), 0) AS BIGINT) AS queries, CAST(coalesce(sum(CASE WHEN name = 'N' THEN least(n, 10) ELSE n END) FILTER (WHERE kind = 'query'), 0) AS BIGINT) AS effective_queries FROM counts GROUP BY day),
    days AS (SELECT *, 64 * 2 * (nodes + effective_edges) AS state_work_units, 64 * effective_queries AS query_work_units, 64 * 2 * (nodes + effective_edges) + 64 * effective_queries AS work_units FROM w)"""
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in workload.SIZES)
BATCHES_SQL = f"{COUNTS_SQL}, placed AS (SELECT *, (row_number() OVER (ORDER BY day) - 1) // 8 AS batch FROM days), batches AS (SELECT batch, count(*) AS days, min(day) AS first_day, max(day) AS last_day, {SUMS} FROM placed GROUP BY batch)"


def days(t):
    o = t.orders.withColumn("day", F.to_date("o_orderdate"))
    edge = o.groupBy("day", F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge"))
    node = o.groupBy("day", F.col("o_orderstatus").alias("name")).agg(F.count_distinct("o_custkey").alias("n")).withColumn("kind", F.lit("node"))
    asked = t.lineitem.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("day", F.col("l_returnflag").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("query"))
    return workload.day_workload(edge.unionByName(node).unionByName(asked), hidden=64, layers=2, edge_cap=3, capped_task="N", task_cap=10)


def texts(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


@query("p1_day_workload", f"WITH {COUNTS_SQL} SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM days")
def _(t):
    return texts(days(t), "day")


@query("p2_fixed_batch_workload", f"WITH {BATCHES_SQL} SELECT * REPLACE (strftime(first_day, '%Y-%m-%d') AS first_day, strftime(last_day, '%Y-%m-%d') AS last_day) FROM batches")
def _(t):
    return texts(workload.fixed_batches(days(t), 8), "first_day", "last_day")


@query("p2_worst_batch", f"WITH {BATCHES_SQL} SELECT batch, days, work_units, effective_edges, nodes, effective_queries FROM batches ORDER BY work_units DESC, effective_edges DESC, nodes DESC, effective_queries DESC, batch LIMIT 1")
def _(t):
    return workload.worst_batch(workload.fixed_batches(days(t), 8)).select("batch", "days", "work_units", "effective_edges", "nodes", "effective_queries")


@query("p2_candidate_batches", f"""
    WITH {BATCHES_SQL}, l AS (SELECT *, unnest(['work_units', 'effective_edges', 'nodes', 'effective_queries']) AS dimension, unnest([work_units, effective_edges, nodes, effective_queries]) AS size FROM batches),
    r AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY size DESC, work_units DESC, effective_edges DESC, nodes DESC, effective_queries DESC, batch) AS rn FROM l)
    SELECT batch, array_to_string(list_sort(list(dimension)), ',') AS dimensions FROM r WHERE rn = 1 GROUP BY batch""")
def _(t):
    return workload.candidate_batches(workload.fixed_batches(days(t), 8)).withColumn("dimensions", F.array_join("dimensions", ","))


@query("p2_top_day_bound", f"WITH {COUNTS_SQL} SELECT count(*) AS days, {SUMS} FROM (SELECT * FROM days ORDER BY work_units DESC, effective_edges DESC, nodes DESC, effective_queries DESC, day DESC LIMIT 8)")
def _(t):
    return workload.top_day_bound(days(t), 8)


@query("j1_outcome_summary", """
    SELECT home_id, away_id, count(*) AS samples, round(avg(CASE WHEN home_score > away_score THEN 1 ELSE 0 END), 9) AS home_win, round(avg(CASE WHEN home_score < away_score THEN 1 ELSE 0 END), 9) AS away_win,
      round(avg(CASE WHEN home_score = away_score THEN 1 ELSE 0 END), 9) AS tie, round(avg(home_score), 9) AS expected_home, round(avg(away_score), 9) AS expected_away FROM games GROUP BY 1, 2""", ("games",))
def _(t):
    return rounded(scenarios.outcome_summary(t.games, ["home_id", "away_id"]), 9, "home_win", "away_win", "tie", "expected_home", "expected_away")


@query("j1_member_summary", """
    WITH n AS (SELECT group_id, count(DISTINCT scenario_id) AS n FROM scenarios GROUP BY 1)
    SELECT s.group_id, member_id, round(sum(hits) / any_value(n), 9) AS expected_hits, round(count(*) FILTER (WHERE hits >= 1) / any_value(n), 9) AS any_hit FROM scenarios s JOIN n ON n.group_id = s.group_id GROUP BY 1, 2""", ("scenarios",))
def _(t):
    return rounded(scenarios.member_summary(t.scenarios), 9, "expected_hits", "any_hit")


SETS_SQL = "sets AS (SELECT DISTINCT member_id % 50 AS set_id, group_id, member_id FROM scenarios)"


@query("j1_joint_success", f"""
    WITH {SETS_SQL}, n AS (SELECT group_id, count(DISTINCT scenario_id) AS n FROM scenarios GROUP BY 1), z AS (SELECT set_id, group_id, count(*) AS size FROM sets GROUP BY 1, 2),
    m AS (SELECT set_id, s.group_id, scenario_id, count(*) AS met FROM scenarios s JOIN sets ON sets.group_id = s.group_id AND sets.member_id = s.member_id WHERE hits >= 1 GROUP BY 1, 2, 3),
    g AS (SELECT m.set_id, m.group_id, count(*) AS good FROM m JOIN z ON z.set_id = m.set_id AND z.group_id = m.group_id WHERE met = size GROUP BY 1, 2)
    SELECT z.set_id, z.group_id, round(coalesce(good, 0) / n, 9) AS joint_success FROM z JOIN n ON n.group_id = z.group_id LEFT JOIN g ON g.set_id = z.set_id AND g.group_id = z.group_id""", ("scenarios",))
def _(t):
    sets = t.scenarios.select((F.col("member_id") % 50).alias("set_id"), "group_id", "member_id").distinct()
    return rounded(scenarios.joint_success(t.scenarios, sets), 9, "joint_success")


@query("j2_combine_scenarios", f"""
    WITH p AS (SELECT group_id, scenario_id, row_number() OVER (PARTITION BY group_id ORDER BY scenario_id) AS position, count(*) OVER (PARTITION BY group_id) AS n FROM (SELECT DISTINCT group_id, scenario_id FROM scenarios)),
    z AS (SELECT DISTINCT group_id, n, 5 AS seed FROM p), d AS (SELECT *, unnest(range(200)) AS draw FROM z),
    r AS (SELECT draw, group_id, CAST('0x' || substr(sha256({framed_sql('seed', 'draw', 'group_id')}), 1, 15) AS BIGINT) % n + 1 AS position FROM d)
    SELECT CAST(draw AS INTEGER) AS draw, member_id, CAST(sum(hits) AS BIGINT) AS hits, 1 / 200e0 AS weight FROM r JOIN p ON p.group_id = r.group_id AND p.position = r.position
    JOIN scenarios s ON s.group_id = p.group_id AND s.scenario_id = p.scenario_id GROUP BY 1, 2""", ("scenarios",))
def _(t):
    return scenarios.combine_scenarios(t.scenarios, 200, 5, F.floor(F.col("scenario_id") / 1000))


# Fixed bands and points of the test binding.
BANDS = [("a", 0.0, 0.25, 3.0), ("a", 0.25, 0.5, 2.0), ("a", 0.5, 1.0, 1.0), ("b", 0.0, 0.1, 5.0), ("b", 0.1, 1.0, 1.5)]
BANDS_SQL = "bands(position, low, high, multiplier) AS (VALUES " + ", ".join(f"('{p}', {a}e0, {b}e0, {m}e0)" for p, a, b, m in BANDS) + ")"
TABLE, EXTRA = [0.5, 2.0, 5.0], 4.0
POINTS_SQL = "CASE {h} WHEN 0 THEN 0.5e0 WHEN 1 THEN 2e0 WHEN 2 THEN 5e0 ELSE 5e0 + ({h} - 2) * 4e0 END"


def bands(t):
    return t.spark.createDataFrame(BANDS, "position string, low double, high double, multiplier double")


@query("j3_points_and_multiplier", f"""
    WITH {BANDS_SQL}, c AS (SELECT *, CASE WHEN member_id % 2 = 0 THEN 'a' ELSE 'b' END AS position, least(hits / 4e0, 1) AS rate, member_id % 3 = 0 AS owned, member_id % 25 AS side_id FROM scenarios)
    SELECT scenario_id, group_id, member_id, {POINTS_SQL.format(h='hits')} AS points, multiplier + CASE WHEN owned THEN 0.5e0 ELSE 0e0 END + CASE WHEN side_id = 7 THEN 0.25e0 ELSE 0e0 END AS multiplier
    FROM c LEFT JOIN bands b ON b.position = c.position AND rate >= low AND (rate < high OR (high = 1 AND rate <= 1))""", ("scenarios",))
def _(t):
    rows = t.scenarios.selectExpr("*", "IF(member_id % 2 = 0, 'a', 'b') AS position", "least(hits / 4e0, 1e0) AS rate", "member_id % 3 = 0 AS owned", "member_id % 25 AS side_id")
    out = scenarios.member_multipliers(rows, bands(t), owned_bonus=0.5, side_bonus=0.25, selected_side=7)
    return out.select("scenario_id", "group_id", "member_id", scenarios.hit_points(F.col("hits"), TABLE, EXTRA).alias("points"), "multiplier")


@query("j4_score_selections", f"""
    WITH h AS (SELECT scenario_id, member_id, CAST(sum(hits) AS BIGINT) AS hits FROM scenarios GROUP BY 1, 2), w AS (SELECT DISTINCT scenario_id, 1 + scenario_id % 3 AS weight FROM scenarios),
    s AS (SELECT DISTINCT c_custkey % 97 AS selection_id, c_custkey % 150 AS member_id, 1 + c_custkey % 150 % 4 AS multiplier FROM customer),
    x AS (SELECT s.selection_id, w.scenario_id, any_value(weight) / (SELECT sum(weight) FROM w) AS w, sum(multiplier * {POINTS_SQL.format(h='coalesce(hits, 0)')}) AS v, bool_and(coalesce(hits, 0) >= 1) AS ok
      FROM s CROSS JOIN w LEFT JOIN h ON h.scenario_id = w.scenario_id AND h.member_id = s.member_id GROUP BY 1, 2),
    m AS (SELECT selection_id, sum(w * v) AS mean, sum(w * v * v) AS second, sum(CASE WHEN ok THEN w ELSE 0 END) AS all_hit FROM x GROUP BY 1)
    SELECT selection_id, round(mean, 6) AS expected_points, round(greatest(second - mean * mean, 0), 5) AS variance, round(all_hit, 9) AS all_hit_probability, round(mean - 0.1e0 * greatest(second - mean * mean, 0) + 20 * all_hit, 5) AS utility FROM m""", ("scenarios",))
def _(t):
    hits = t.scenarios.groupBy("scenario_id", "member_id").agg(F.sum("hits").alias("hits"))
    weights = t.scenarios.select("scenario_id", F.expr("1 + scenario_id % 3").alias("weight")).distinct()
    chosen = t.customer.selectExpr("c_custkey % 97 AS selection_id", "c_custkey % 150 AS member_id", "1 + c_custkey % 150 % 4 AS multiplier").distinct()
    out = scenarios.score_selections(chosen, hits, weights, TABLE, EXTRA, risk_aversion=0.1, all_hit_utility=20.0)
    return rounded(rounded(rounded(out, 6, "expected_points"), 5, "variance", "utility"), 9, "all_hit_probability")


@query("j5_enumerate_picks", """
    WITH RECURSIVE o AS (SELECT l_orderkey AS slate, l_linenumber AS market, l_partkey || '-' || l_suppkey AS id, l_quantity AS p, round(l_discount * 100) AS r FROM lineitem),
    m AS (SELECT *, p / sum(p) OVER w AS q, count(*) OVER w AS n FROM o WINDOW w AS (PARTITION BY slate, market)),
    u AS (SELECT *, dense_rank() OVER (PARTITION BY slate ORDER BY market) AS k FROM m WHERE n >= 2), z AS (SELECT slate, max(k) AS k FROM u GROUP BY slate),
    c(slate, k, picks, pall, hits, s1, s2, s3, rw) AS (SELECT slate, CAST(0 AS BIGINT), CAST('' AS VARCHAR), 1e0, 0e0, 0e0, 0e0, 0e0, 0e0 FROM z UNION ALL
      SELECT c.slate, u.k, c.picks || '/' || u.id, pall * q, hits + q, s1 + q * r, s2 + q * r * q * r, s3 + q * r * r, rw + r FROM c JOIN u ON u.slate = c.slate AND u.k = c.k + 1),
    f AS (SELECT c.*, s1 + 3 * pall AS mean, s1 * s1 - s2 + s3 + 6 * pall * rw + 9 * pall AS second FROM c JOIN z ON z.slate = c.slate AND z.k = c.k WHERE pall >= 0.02e0),
    g AS (SELECT slate, round(mean - 0.05e0 * greatest(second - mean * mean, 0), 6) AS utility FROM f),
    r AS (SELECT *, row_number() OVER (PARTITION BY slate ORDER BY utility DESC) AS place FROM g)
    SELECT slate AS slate_id, CAST(place AS INTEGER) AS place, utility FROM r WHERE place <= 3""")
def _(t):
    options = t.lineitem.selectExpr("l_orderkey AS slate_id", "l_linenumber AS market", "concat_ws('-', l_partkey, l_suppkey) AS option_id", "l_quantity AS probability", "round(l_discount * 100) AS reward")
    picks = scenarios.best_picks(options, 3, bonus=3.0, risk_aversion=0.05, minimum_probability=0.02)
    return rounded(picks.select("slate_id", "place", "utility"), 6, "utility")
