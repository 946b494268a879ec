"""Audits on small hand-written violations."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audits, ingest


def codes(df):
    return sorted((r["code"], r["entity_id"]) for r in df.collect())


def test_combined_audits_keep_all_rows(spark):
    df = spark.createDataFrame([(1, 5), (2, -1)], "id int, v int")
    one = audits.violations(df, [("negative", F.col("v") < 0, "no")], None, F.col("id"))
    two = audits.violations(df, [("large", F.col("v") > 4, "no"), ("null_rule", F.lit(None).cast("boolean"), "no")], None, F.col("id"))
    assert codes(audits.combine(one, two)) == [("large", "1"), ("negative", "2")]


def test_null_children_and_parents_do_not_count(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9), (4, 9), (None, 1)], "a int, b int")
    parent = spark.createDataFrame([(1,), (None,)], "k int")
    found = audits.reference_violations({"c": child, "p": parent}, [("c", ["b"], "p", ["k"])]).first()
    assert (found["missing"], list(found["sample"])) == (1, ["9"])
    pairs = spark.createDataFrame([(1, 1)], "x int, y int")
    found = audits.reference_violations({"c": child, "p": pairs}, [("c", ["a", "b"], "p", ["x", "y"])]).first()
    assert sorted(found["sample"]) == ["3|9", "4|9"]


def test_check_passes_on_null(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 5)], "a int, b int")
    found = {r["check_name"]: r["violations"] for r in audits.constraint_audit(df, {"order": F.col("a") <= F.col("b"), "range": F.col("a") < 3}).collect()}
    assert found == {"order": 1, "range": 1}


def transition(fact="f1", seq=1, sub=0, period=1, half="top", outs=0, added=1, before="000", after="000", scores=(0, 0, 0, 0), units=0, complete=True):
    return (fact, "g", seq, sub, period, half, outs, added, before, after, *scores, units, complete)


SCHEMA = ("fact_id string, group_id string, sequence int, subsequence int, period int, half string, outs_before int, outs_added int, bases_before string, "
          "bases_after string, home_before int, away_before int, home_after int, away_after int, units int, complete boolean")


@pytest.fixture()
def audit(spark):
    def run(*rows, markers=(), **options):
        marks = spark.createDataFrame([("g", a, b) for a, b in markers], "group_id string, sequence int, subsequence int")
        return codes(audits.audit_transitions(spark.createDataFrame(list(rows), SCHEMA), marks, **options))
    return run


def test_half_rolls_over_after_three_outs(audit):
    assert audit(transition("a", 1, outs=2, added=1), transition("b", 2, half="bottom"), transition("c", 3, half="bottom", outs=1)) == []
    assert audit(transition("a", 1, half="bottom", outs=2, added=1), transition("b", 2, period=2)) == []
    assert audit(transition("a", 1, outs=2, added=1), transition("b", 2, outs=1)) == [("next_half_mismatch", "b"), ("next_outs_mismatch", "b")]


def test_a_marker_between_stops_the_comparison(audit):
    rows = (transition("a", 1), transition("b", 3, outs=2))
    assert audit(*rows) == [("next_outs_mismatch", "b")]
    assert audit(*rows, markers=[(2, 0)]) == []
    assert audit(*rows, markers=[(1, 0), (3, 0), (3, 1)]) == [("next_outs_mismatch", "b")]


def test_incomplete_rows_are_skipped_but_reported_when_required(audit):
    rows = (transition("a", 1, complete=False), transition("b", 2, outs=2, added=None))
    assert audit(*rows) == [("complete_fields_missing", "b")]
    assert ("transition_incomplete", "a") in audit(*rows, require_complete=True)


def test_row_rules(audit):
    bad = transition("x", 0, -1, 0, "top", 3, 1, "01", "111", (-1, 0, 0, 1), -2)
    found = {c for c, _ in audit(bad)}
    assert found == {"sequence_invalid", "subsequence_invalid", "period_invalid", "outs_before_invalid", "bases_before_invalid", "units_invalid", "score_invalid",
                     "outs_overflow", "score_delta_mismatch"}


def test_one_row_per_extra_copy(spark):
    facts = spark.createDataFrame([("f", "g", "m", 1, True, True, 1)], "fact_id string, group_id string, member_id string, side_id int, is_opportunity boolean, is_success boolean, units int")
    official = spark.createDataFrame([("g", "m", 1, 1, 1, 1, 1, 0, 0, 0)] * 3 + [("g", "z", 1, 2, 2, 0, 0, 0, 0, 0)],
                                     "group_id string, member_id string, side_id int, opportunities int, attempts int, successes int, ones int, twos int, threes int, fours int")
    assert codes(audits.audit_member_totals(facts, official)) == [("attempts_mismatch", "z"), ("duplicate_member_total", "m"), ("duplicate_member_total", "m"), ("opportunities_mismatch", "z")]


def test_leakage_depends_on_the_experiment(spark):
    rows = spark.sql("""SELECT 'f' AS feature_id, 'g' AS group_id, 'n' AS name, 'forecast' AS kind, TIMESTAMP '2024-01-03' AS target_at, TIMESTAMP '2024-01-01' AS available_at,
        TIMESTAMP '2024-01-01' AS issued_at, CAST(NULL AS TIMESTAMP) AS observed_at UNION ALL
        SELECT 'o', 'g', 'p', 'observation', TIMESTAMP '2024-01-03', TIMESTAMP '2024-01-04', NULL, TIMESTAMP '2024-01-03'""")
    cutoffs = spark.sql("SELECT 'g' AS group_id, TIMESTAMP '2024-01-02' AS cutoff_at")
    assert codes(audits.audit_feature_leakage(rows, cutoffs)) == [("observation_in_forecast_data", "o")]
    assert codes(audits.audit_feature_leakage(rows, cutoffs, oracle=True)) == [("forecast_in_oracle_data", "f")]


def test_reduction_keeps_null_of_the_last_row(spark):
    rows = spark.createDataFrame([("g", 1, 7, "x", 3, "m1"), ("g", 2, 8, None, None, "m2"), ("h", 1, 9, "S", 1, "m3"), ("h", 2, 9, "S", 2, "m4"), ("i", 1, 1, "S", 9, "m5")],
                                 "g string, n int, pre int, outcome string, post int, member string")
    out = ingest.reduce_ordered_group(rows, ["g"], ["n"], first={"pre": "pre"}, last={"post": "post", "outcome": "outcome"},
                                      attribution=ingest.Attribution("member", "outcome", "S", F.col("post") < 2))
    found = {r["g"]: (r["pre"], r["post"], r["outcome"], r["member"]) for r in out.collect()}
    assert found == {"g": (7, None, None, "m2"), "h": (9, 2, "S", "m3"), "i": (1, 9, "S", "m5")}


def test_cells_and_codes(spark):
    codes_table = spark.createDataFrame([(1000, "single"), (2000, "out")], "code int, outcome string")
    cells = spark.createDataFrame([("r", {"1": "1000/2000", "2": "0", "3": "-", "4": "9999", "5": "H\\/Kx", "6": None})], "id string, cells map<string,string>")
    out = ingest.tokenise_cells(cells, ["id"], "cells", r"\\?/", exact={"H": "hit"}, suffixes=[(".x", "ends_x")], codes=codes_table)
    assert sorted((r["cell"], r["part"], r["token"], r["outcome"]) for r in out.collect()) == [
        (1, 0, "1000", "single"), (1, 1, "2000", "out"), (4, 0, "9999", None), (5, 0, "H", "hit"), (5, 1, "Kx", "ends_x")]


def test_thirds(spark):
    texts = ["5", "1/3", "5 2/3", "6 \\/ 3", "3/3", "x", None, " 0 1/3 "]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ingest.thirds_to_units(F.col("t")).alias("u"))
    assert {r["t"]: r["u"] for r in df.collect()} == {"5": 15, "1/3": 1, "5 2/3": 17, "6 \\/ 3": None, "3/3": None, "x": None, None: None, " 0 1/3 ": 1}


def test_phase_order_and_completeness(spark):
    slates = spark.sql("SELECT 1 AS slate_id, 'r' AS rule_version, 'c' AS card_version, 'e' AS eligibility_snapshot, TIMESTAMP '2024-01-09' AS lock_at")
    rules = spark.sql("SELECT 'r' AS rule_version")
    eligible = spark.sql("SELECT 1 AS row_id, 1 AS slate_id, 'e' AS eligibility_snapshot, 'c' AS card_version, 'm' AS member_id, 'p' AS position, true AS is_eligible")
    rows = spark.createDataFrame([(1, "s1", "early", "2024-01-05"), (2, "s2", "late", "2024-01-03")], "capture_id int, snapshot_id string, phase string, at string")
    captures = rows.selectExpr("capture_id", "snapshot_id", "1 AS slate_id", "phase", "'r' AS rule_version", "'c' AS card_version", "'e' AS eligibility_snapshot", "'m' AS member_id", "'p' AS position", "CAST(at AS TIMESTAMP) AS captured_at")
    found = {(r["code"], r["message"]) for r in audits.audit_phase_captures(slates, rules, eligible, captures, ["early", "middle", "late"]).collect()}
    assert found == {("phase_order_invalid", "late precedes an earlier phase"), ("slate_phases_incomplete", "middle"), ("member_phases_incomplete", "middle")}
