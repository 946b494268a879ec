"""Invariance of feature tables: today's results never change today's features."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, history, labels, relations

GAMES = [(1, "2024-04-01", 1, 2, 5, 3), (2, "2024-04-01", 3, 1, 2, 2), (3, "2024-04-02", 2, 1, 1, 0), (4, "2024-04-04", 1, 3, 4, 4), (5, "2024-04-04", 2, 3, 0, 6)]


@pytest.fixture(scope="module")
def games(spark):
    def make(rows=GAMES):
        return spark.createDataFrame(rows, "group_id int, day string, home_id int, away_id int, home_score int, away_score int").withColumn("day", F.to_date("day"))
    return make


def table(df, drop=("home_score", "away_score", "target")):
    return {r["group_id"]: {k: v for k, v in r.asDict().items() if k not in drop} for r in df.collect()}


def side_features(df):
    return table(features.pregame_side_features(df, features.elo_ratings(df.withColumn("league", F.lit("l")), "league"), recent=2))


def test_results_of_a_day_stay_out_of_that_day(games):
    changed = [(*g[:4], 99, 0) if g[1] == "2024-04-04" else g for g in GAMES]
    assert side_features(games()) == side_features(games(changed))
    earlier = [(*g[:4], 9, 0) if g[0] == 1 else g for g in GAMES]
    before, after = side_features(games()), side_features(games(earlier))
    assert before[2] == after[2] and before[3] != after[3]


def test_first_game_defaults(games):
    first = side_features(games())[1]
    assert (first["home_games"], first["home_points_rate"], first["home_draw_rate"], first["home_recent_diff"]) == (0.0, 0.5, 0.0, 0.0)
    assert first["home_elo_before"] == first["away_elo_before"] == 1500.0


def test_ratings_do_not_depend_on_row_order_and_leagues_are_separate(spark, games):
    df = games().withColumn("league", F.lit("a"))
    two = df.unionByName(df.withColumn("league", F.lit("b")))
    rows = lambda d: sorted(map(tuple, features.elo_ratings(d, "league").collect()))
    one = rows(df)
    assert one == rows(df.orderBy(F.desc("group_id")))
    assert rows(two) == sorted(one + [("b", *r[1:]) for r in one])
    expected = 1 / (1 + 10 ** (-50 / 400))
    gain = {(str(r[1]), r[2]): r[3] for r in one}
    assert gain["2024-04-02", 2] == pytest.approx(1500 - 20 * (1 - expected))
    assert gain["2024-04-02", 1] == pytest.approx(1500 + 20 * (1 - expected) - 20 * (0.5 - expected))


def test_generated_ids_get_a_suffix(spark):
    raw = spark.createDataFrame([(1, None, "2024-04-01", "h", "a", 1, 0), (2, None, "2024-04-01", "h", "a", 0, 1), (3, "x", "2024-04-01", "h", "a", 2, 2)],
                                "n int, game_pk string, game_date string, home_team string, away_team string, home_score int, away_score int").withColumn("game_date", F.to_date("game_date"))
    aliases = {"game_id": ["game_id", "game_pk"], "day": ["game_date"], "home_id": ["home_team"], "away_id": ["away_team"], "home_score": ["home_score"], "away_score": ["away_score"]}
    found = {r["n"]: (r["game_id"], r["target"]) for r in features.canonical_games(raw, "n", aliases, F.col("n")).collect()}
    assert found == {1: ("2024-04-01:a@h", 2), 2: ("2024-04-01:a@h#2", 0), 3: ("x", 1)}


FACTS = [("f1", 1, "2024-04-01", 7, 8, 1, 2, True), ("f2", 1, "2024-04-01", 7, 8, 1, 2, False), ("f3", 2, "2024-04-01", 7, 9, 1, 3, True), ("f4", 3, "2024-04-02", 7, 8, 1, 2, False),
         ("f5", 3, "2024-04-02", 6, 8, 1, 2, True)]


def test_member_features_see_earlier_days_only(spark):
    df = spark.createDataFrame(FACTS, "fact_id string, group_id int, day string, member_id int, counterpart_id int, side_id int, other_side_id int, is_success boolean").withColumn("day", F.to_date("day"))
    rows = {(r["group_id"], r["member_id"]): r for r in features.pregame_member_features(features.member_targets(df)).collect()}
    assert rows[1, 7]["member_games"] == rows[2, 7]["member_games"] == 0.0
    last = rows[3, 7]
    assert (last["member_games"], last["member_opportunities"], last["member_successes"]) == (2.0, 3.0, 2.0)
    assert last["member_success_rate"] == pytest.approx((2 + 5) / (3 + 20))
    assert (last["offence_games"], last["defence_games"], last["relation_opportunities"]) == (2.0, 1.0, 2.0)
    assert rows[3, 6]["member_games"] == 0.0 and rows[3, 6]["offence_successes"] == 2.0


def live(spark, rows, window):
    df = spark.createDataFrame(rows, "fact_id string, member string, counterpart string, event_at timestamp, available_at timestamp, outcome string, is_success boolean, is_opportunity boolean, units int")
    return relations.live_intervals(df.withColumns(relations.fact_values({"walks": ["W"], "strikes": ["K"]})), window)


ROUTE = [relations.Route("r", "member", "counterpart", "entity", "entity")]


def test_edge_leaves_after_the_window_and_sums_parallel_facts(spark):
    at = lambda d, h=23: dt.datetime(2024, 4, d, h)
    rows = [("a", "m", "c", at(1), at(2, 0), "H", True, True, 2), ("b", "m", "c", at(1), at(2, 0), "K", False, True, 0), ("late", "m", "d", at(1), at(3, 5), "W", False, False, 0)]
    edges = relations.relation_edges(live(spark, rows, 3), ROUTE, "2024-04-01", "2024-04-30", 3)
    found = {(r["day"].day, r["destination"]): (r["facts"], r["success_rate"], r["strike_rate"]) for r in edges.collect()}
    assert found == {(2, "c"): (2.0, 0.5, 0.5), (3, "c"): (2.0, 0.5, 0.5), (4, "c"): (2.0, 0.5, 0.5), (4, "d"): (1.0, 0.0, 0.0)}
    ages = {(r["day"].day, r["destination"]): (r["event_age"], r["publication_delay"]) for r in edges.collect()}
    assert ages[2, "c"] == (3600.0, 3600.0)


def test_query_entities_without_history_have_zero_features(spark):
    at = dt.datetime(2024, 4, 1, 23)
    rows = [("a", "m", "c", at, dt.datetime(2024, 4, 2), "H", True, True, 4)]
    asked = spark.createDataFrame([(dt.date(2024, 4, 2), "m"), (dt.date(2024, 4, 2), "new")], "day date, entity string")
    nodes = relations.entity_nodes(live(spark, rows, 1), {"acting": "member", "receiving": "counterpart"}, asked, "2024-04-01", "2024-04-09", 1)
    found = {r["entity"]: r for r in nodes.collect()}
    assert set(found) == {"m", "c", "new"}
    assert found["m"]["acting_four_rate"] == 1.0 and found["m"]["receiving_four_rate"] == 0.0
    assert all(v == 0.0 for k, v in found["new"].asDict().items() if k not in ("day", "entity"))


def test_corrections_flow_into_daily_sums(spark):
    at = lambda d: dt.datetime(2024, 4, d)
    rows = [("k", "old", at(1), at(2), at(2), at(1), None, 5), ("k", "new", at(1), at(5), at(5), at(1), None, 7), ("z", "gone", at(1), at(2), at(2), at(1), at(4), 1)]
    df = spark.createDataFrame(rows, "k string, row_id string, event_at timestamp, available_at timestamp, ingested_at timestamp, valid_from timestamp, valid_to timestamp, v int").withColumn("all", F.lit("x"))
    intervals = history.competition_intervals(df, ["k"], "row_id", window_days=6, carry=["all", "v"])
    state = history.rolling_state(intervals, ["all"], ["v"], F.to_date(F.lit("2024-04-01")), F.to_date(F.lit("2024-04-20")))
    assert {r["day"].day: r["v"] for r in state.collect()} == {2: 6, 3: 6, 4: 5, 5: 7, 6: 7, 7: 7}


def test_incompatible_sources_are_not_mixed(spark):
    fields = ["opportunities", "attempts", "successes"]
    limits = [("successes", "attempts"), ("attempts", "opportunities")]
    schema = "group_id int, side_id int, member_id string, verified boolean, opportunities int, attempts int, successes int"
    reported = spark.createDataFrame([(1, 1, "a", True, None, 4, 2), (1, 1, "b", True, None, 4, 3), (1, 1, "?", False, None, 2, None)], schema)
    derived = spark.createDataFrame([(1, 1, "a", True, 5, 4, 2), (1, 1, "b", True, 5, 4, 1), (1, 1, "c", True, 3, 1, 9)], schema)
    out = {r["member_id"]: r for r in labels.merge_overlapping(reported, derived, limits, fields).collect()}
    assert (out["a"]["opportunities"], out["a"]["origin"]) == (5, "merged")
    assert (out["b"]["opportunities"], out["b"]["successes"]) == (None, 3)
    # Unresolved attempts (2) outrank derived ones; derived successes (9) contradict them and are not used.
    assert [out["c"][f"use_{f}"] for f in fields] == [True, False, False]


def test_repair_judges_original_values(spark):
    df = spark.createDataFrame([(5, 4, 3, 1)], "successes int, attempts int, opportunities int, fours int")
    out = labels.repair_contradictions(df, [("successes", "attempts"), ("attempts", "opportunities"), ("fours", "successes")]).first()
    assert tuple(out) == (None, None, None, 1)


def test_unresolved_row_replaces_the_side(spark):
    schema = "group_id int, day string, member_id string, side_id int, other_side_id int, verified boolean, successes_verified boolean, opportunities int, attempts int, successes int"
    reported = spark.createDataFrame([(1, "d", "x1", 1, 2, False, True, None, 3, 1), (1, "d", "v", 2, 1, True, True, 4, 4, 2), (2, "d", "u", 1, 2, True, False, 4, 4, 2)], schema)
    derived = spark.createDataFrame([(1, "d", "a", 1, 2, True, True, 3, 3, 1), (1, "d", "v", 2, 1, True, True, 9, 9, 9), (1, "d", "w", 2, 1, True, True, 2, 2, 0), (2, "d", "u", 1, 2, True, True, 5, 5, 2)], schema)
    out = {(r["group_id"], r["member_id"]): (r["opportunities"], r["minimum"], r["origin"]) for r in labels.member_success_queries(reported, derived).collect()}
    assert out == {(1, "x1"): (None, 3, "reported"), (1, "v"): (4, 4, "reported"), (1, "w"): (2, 2, "derived"), (2, "u"): (5, 5, "derived")}
