"""Ordered reduction and canonical rows (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.bitemporal import framed_sql
from tidemark.functions.clocks import day_clocks
from tidemark.operators import ingest

# Rows of one step are told apart by their state and outcome.
AT = "step, pre_state, coalesce(outcome, '')"
REDUCED_SQL = f"""reduced AS (SELECT group_id, ordinal,
    first(pre_state ORDER BY {AT}) AS pre_state, last(post_state ORDER BY {AT}) AS post_state, last(outcome ORDER BY {AT}) AS outcome,
    CASE WHEN last(outcome ORDER BY {AT}) = 'RF'
         THEN coalesce(last(member_id ORDER BY {AT}) FILTER (WHERE pre_state < 25), first(member_id ORDER BY {AT}))
         ELSE last(member_id ORDER BY {AT}) END AS member_id,
    last(counterpart_id ORDER BY {AT}) AS counterpart_id
    FROM raw_rows GROUP BY group_id, ordinal)"""


def reduced(t):
    rows = t.raw_rows.withColumn("told_apart", F.coalesce("outcome", F.lit("")))
    return ingest.reduce_ordered_group(
        rows, ["group_id", "ordinal"], ["step", "pre_state", "told_apart"], first={"pre_state": "pre_state"},
        last={"post_state": "post_state", "outcome": "outcome", "counterpart_id": "counterpart_id"},
        attribution=ingest.Attribution("member_id", "outcome", "RF", F.col("pre_state") < 25))


@query("e1_reduce_ordered_group", f"WITH {REDUCED_SQL} SELECT * FROM reduced", ("raw_rows",))
def _(t):
    return reduced(t)


@query("e2_reduce_group_max", """
    SELECT r.group_id, strftime(day, '%Y-%m-%d') AS day, any_value(home_id) AS home_id, any_value(away_id) AS away_id,
      max(post_state) AS home_score, max(pre_state) AS away_score
    FROM raw_rows r JOIN games g ON g.group_id = r.group_id GROUP BY r.group_id, day""", ("raw_rows", "games"))
def _(t):
    rows = t.raw_rows.join(t.games.select("group_id", "day", "home_id", "away_id"), "group_id")
    result = ingest.reduce_group_max(rows, ["group_id", "day"], {"home_score": "post_state", "away_score": "pre_state"},
                                     ["home_id", "away_id"])
    return result.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("e3_side_rollup", f"""
    WITH {REDUCED_SQL}, events_by_side AS (SELECT r.group_id, CASE WHEN ordinal % 2 = 1 THEN away_id ELSE home_id END AS side_id, outcome
      FROM reduced r JOIN games g ON g.group_id = r.group_id WHERE outcome IS NOT NULL),
    sides AS (SELECT group_id, home_id AS side_id FROM games UNION ALL SELECT group_id, away_id FROM games)
    SELECT s.group_id, s.side_id, count(*) FILTER (WHERE outcome IN ('RF', 'AF')) AS successes FROM sides s
    LEFT JOIN events_by_side e ON e.group_id = s.group_id AND e.side_id = s.side_id GROUP BY s.group_id, s.side_id""",
       ("raw_rows", "games"))
def _(t):
    events = reduced(t).where("outcome IS NOT NULL").join(t.games, "group_id").withColumn(
        "side_id", F.expr("IF(ordinal % 2 = 1, away_id, home_id)"))
    return ingest.side_rollup(t.games, events, F.col("outcome").isin("RF", "AF"))


APPEARANCES_SQL = """appearances AS (
      SELECT day, 'm' || member_id AS key, CASE WHEN other_side_id % 3 = 0 THEN '  ' ELSE ' side ' || other_side_id END AS name FROM facts
      UNION ALL SELECT day, 'c' || counterpart_id, NULL FROM facts)"""


def appearances(t):
    members = t.facts.selectExpr(
        "day", "concat('m', member_id) AS key", "IF(other_side_id % 3 = 0, '  ', concat(' side ', other_side_id)) AS name")
    others = t.facts.selectExpr("day", "concat('c', counterpart_id) AS key", "CAST(NULL AS STRING) AS name")
    return members.unionByName(others).withColumn("season", F.year("day"))


@query("e4_first_seen_dimension", f"""
    WITH {APPEARANCES_SQL} SELECT CAST(year(day) AS INTEGER) AS season, key, strftime(min(day), '%Y-%m-%d') AS first_day,
      coalesce(first(nullif(trim(name), '') ORDER BY day, nullif(trim(name), '')) FILTER (WHERE trim(name) <> ''), key) AS display_name
    FROM appearances GROUP BY 1, 2""", ("facts",))
def _(t):
    seen = ingest.first_seen(appearances(t), "season", "key", "day", "name")
    return seen.withColumn("first_day", F.date_format("first_day", "yyyy-MM-dd"))


CODE_SQL = """strftime(CASE WHEN group_id % 50 = 7 THEN day + 1 ELSE day END, '%Y%m%d') || lpad(CAST(away_id AS VARCHAR), 2, '0')
      || lpad(CAST(home_id AS VARCHAR), 2, '0') || CASE WHEN group_id % 60 = 9 THEN 'x' ELSE CAST(group_id % 3 AS VARCHAR) END
      || strftime(day, '%Y')"""


def coded(t):
    return t.games.withColumn("code", F.expr(
        """concat(date_format(IF(group_id % 50 = 7, date_add(day, 1), day), 'yyyyMMdd'), lpad(CAST(away_id AS STRING), 2, '0'),
           lpad(CAST(home_id AS STRING), 2, '0'), IF(group_id % 60 = 9, 'x', CAST(group_id % 3 AS STRING)), date_format(day, 'yyyy'))"""))


@query("e5_group_rows", f"""
    SELECT 'game:' || group_id AS row_key, CAST(year(day) AS INTEGER) AS season, 'side:' || home_id AS home_id, 'side:' || away_id AS away_id,
      nullif(TRY_CAST(substr({CODE_SQL}, 13, 1) AS INTEGER), 0) AS ordinal_of_day, home_score, away_score,
      epoch_us(CAST(day AS TIMESTAMP) - to_hours(9)) AS scheduled_at, epoch_us(CAST(day + 1 AS TIMESTAMP) - to_hours(9)) AS available_at
    FROM games""", ("games",))
def _(t):
    clocks = day_clocks(F.col("day"), "Asia/Seoul")
    return coded(t).select(
        F.concat(F.lit("game:"), "group_id").alias("row_key"), F.year("day").alias("season"),
        F.concat(F.lit("side:"), "home_id").alias("home_id"), F.concat(F.lit("side:"), "away_id").alias("away_id"),
        F.nullif(F.substring("code", 13, 1).try_cast("int"), F.lit(0)).alias("ordinal_of_day"), "home_score", "away_score",
        F.unix_micros(clocks["scheduled_at"]).alias("scheduled_at"), F.unix_micros(clocks["available_at"]).alias("available_at"))


@query("e6_unpivot_sides_with_result", """
    SELECT group_id, home_id AS side_id, away_id AS opponent_id, true AS is_home, home_score AS scored, away_score AS allowed,
      CASE WHEN home_score > away_score THEN 'win' WHEN home_score < away_score THEN 'loss' ELSE 'draw' END AS result FROM games
    UNION ALL SELECT group_id, away_id, home_id, false, away_score, home_score,
      CASE WHEN away_score > home_score THEN 'win' WHEN away_score < home_score THEN 'loss' ELSE 'draw' END FROM games""", ("games",))
def _(t):
    return ingest.unpivot_sides(t.games)


# Fixed outcome table of the test binding: outcome, canonical name, is_opportunity, is_success, units.
OUTCOMES = [("RF", "returned_filled", True, True, 2), ("AF", "accepted_filled", True, True, 1),
            ("RO", "returned_open", True, False, 0), ("AO", "accepted_open", False, False, 0)]
OUTCOMES_SQL = "rules(outcome, canonical, is_opportunity, is_success, units) AS (VALUES ('RF', 'returned_filled', true, true, 2), " \
    "('AF', 'accepted_filled', true, true, 1), ('RO', 'returned_open', true, false, 0), ('AO', 'accepted_open', false, false, 0))"


@query("e7_canonical_event_map", f"""
    WITH {REDUCED_SQL}, {OUTCOMES_SQL}
    SELECT 'event:' || r.group_id || ':' || ordinal AS event_id, 'member:' || member_id AS member_key, canonical, is_opportunity, is_success, units,
      CASE WHEN pre_state IS NULL THEN '0' ELSE '1' END || CASE WHEN post_state IS NULL THEN '0' ELSE '1' END AS occupancy,
      post_state - pre_state = units AS transition_complete
    FROM reduced r LEFT JOIN rules ON rules.outcome = r.outcome WHERE r.outcome IS NOT NULL""", ("raw_rows",))
def _(t):
    rules = t.spark.createDataFrame(OUTCOMES, "outcome string, canonical string, is_opportunity boolean, is_success boolean, units int")
    mapped = ingest.map_outcomes(reduced(t).where("outcome IS NOT NULL"), "outcome", rules)
    return mapped.select(
        F.concat_ws(":", F.lit("event"), "group_id", "ordinal").alias("event_id"),
        F.concat(F.lit("member:"), "member_id").alias("member_key"), "canonical", "is_opportunity", "is_success", "units",
        ingest.occupancy(["pre_state", "post_state"]).alias("occupancy"),
        (F.col("post_state") - F.col("pre_state") == F.col("units")).alias("transition_complete"))


@query("e8_decode_validated_id", f"""
    WITH coded AS (SELECT *, {CODE_SQL} AS code FROM games), judged AS (SELECT *, regexp_full_match(code, '[0-9]{{8}}[0-9]{{4}}[012][0-9]{{4}}') AS ok FROM coded)
    SELECT group_id, code, concat_ws(',', CASE WHEN NOT ok THEN 'pattern' END,
      CASE WHEN ok AND substr(code, 1, 8) <> strftime(day, '%Y%m%d') THEN 'date' END,
      CASE WHEN ok AND CAST(substr(code, 9, 2) AS INTEGER) <> away_id THEN 'away' END,
      CASE WHEN ok AND substr(code, 14, 4) <> strftime(day, '%Y') THEN 'year' END) AS reasons
    FROM judged WHERE NOT ok OR substr(code, 1, 8) <> strftime(day, '%Y%m%d') OR CAST(substr(code, 9, 2) AS INTEGER) <> away_id
      OR substr(code, 14, 4) <> strftime(day, '%Y')""", ("games",))
def _(t):
    bad = ingest.decode_violations(coded(t), "code", "[0-9]{8}[0-9]{4}[012][0-9]{4}", {
        "date": F.substring("code", 1, 8) == F.date_format("day", "yyyyMMdd"),
        "away": F.substring("code", 9, 2).try_cast("int") == F.col("away_id"),
        "year": F.substring("code", 14, 4) == F.date_format("day", "yyyy")})
    return bad.select("group_id", "code", F.array_join("reasons", ",").alias("reasons"))


@query("e9_reduced_table_checks", f"""
    WITH {REDUCED_SQL}, scores AS (SELECT group_id, max(post_state) AS home_score FROM raw_rows GROUP BY group_id)
    SELECT 'incomplete_group' AS code, CAST(group_id AS VARCHAR) AS row_key FROM scores GROUP BY group_id HAVING count(*) <> 1 OR count(home_score) <> 1
    UNION ALL SELECT 'unknown_outcome', group_id || ':' || ordinal FROM reduced WHERE outcome NOT IN ('RF', 'AF')
    UNION ALL SELECT 'state_out_of_range', group_id || ':' || ordinal FROM reduced WHERE outcome IS NOT NULL AND
      (pre_state NOT BETWEEN 0 AND 45 OR pre_state IS NULL OR post_state IS NULL)""", ("raw_rows",))
def _(t):
    from tidemark.operators import audits
    scores = t.raw_rows.groupBy("group_id").agg(F.max("post_state").alias("home_score"))
    return audits.reduced_checks(reduced(t), scores, ["group_id"], ["home_score"], ["RF", "AF"],
                                 {"state_out_of_range": F.col("pre_state").between(0, 45) & F.col("post_state").isNotNull()})


STATES_SQL = f"""{REDUCED_SQL}, states AS (SELECT group_id, ordinal, outcome, ordinal % 2 = 1 AS is_top, coalesce(post_state, 0) AS units,
      pre_state AS home_before, pre_state + CASE WHEN ordinal % 2 = 1 THEN 0 ELSE coalesce(post_state, 1) END AS home_after,
      ordinal AS away_before, ordinal + CASE WHEN ordinal % 2 = 1 THEN coalesce(post_state, 0) ELSE 0 END AS away_after FROM reduced)"""


def states(t):
    return reduced(t).selectExpr(
        "group_id", "ordinal", "outcome", "ordinal % 2 = 1 AS is_top", "coalesce(post_state, 0) AS units",
        "pre_state AS home_before", "pre_state + IF(ordinal % 2 = 1, 0, coalesce(post_state, 1)) AS home_after",
        "ordinal AS away_before", "ordinal + IF(ordinal % 2 = 1, coalesce(post_state, 0), 0) AS away_after")


@query("e10_import_quality_counts", f"""
    WITH {STATES_SQL}, totals AS (SELECT group_id, sum(units) AS units FROM states GROUP BY group_id),
    gaps AS (SELECT ordinal, lag(ordinal) OVER (PARTITION BY group_id ORDER BY ordinal) AS previous FROM states)
    SELECT count(*) FILTER (WHERE outcome IS NOT NULL) AS labelled, count(*) FILTER (WHERE outcome IS NULL) AS unlabelled,
      CAST(coalesce(sum(units) FILTER (WHERE outcome IS NULL), 0) AS BIGINT) AS unlabelled_units,
      count(*) FILTER (WHERE outcome IS NOT NULL AND (home_after - home_before <> CASE WHEN is_top THEN 0 ELSE units END
        OR away_after - away_before <> CASE WHEN is_top THEN units ELSE 0 END)) AS bad_transitions,
      (SELECT count(*) FROM games JOIN totals USING (group_id) WHERE home_score + away_score <> units) AS unreconciled,
      (SELECT CAST(sum(home_score + away_score - units) AS BIGINT) FROM games JOIN totals USING (group_id)) AS net_shortfall,
      (SELECT count(*) FROM gaps WHERE ordinal > previous + 1) AS ordinal_gaps FROM states""", ("raw_rows", "games"))
def _(t):
    return ingest.quality_counts(states(t), t.games)


@query("e11_inserted_vs_total", """
    SELECT source_id, count(*) FILTER (WHERE available_at <= TIMESTAMP '2024-01-15 00:00:00') AS rows_before, count(*) AS rows_after,
      count(*) - count(*) FILTER (WHERE available_at <= TIMESTAMP '2024-01-15 00:00:00') AS inserted FROM revisions GROUP BY source_id""",
       ("revisions",))
def _(t):
    before = t.revisions.where(F.col("available_at") <= F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return ingest.inserted_vs_total(before, t.revisions)


# Fixed token rules of the test binding.
EXACT = {"de": "link", "la": "article", "the": "article"}
SUFFIXES = [(r".+ent\.?", "stem_ent"), (r".+er\.?", "stem_er")]
TOKENS_SQL = """cells AS (SELECT conv_id, turn, unnest(string_split(text, '. ')) AS cell_text, generate_subscripts(string_split(text, '. '), 1) AS cell FROM conversations),
    parts AS (SELECT conv_id, turn, CAST(cell AS INTEGER) AS cell, unnest(string_split(cell_text, ' ')) AS raw,
      CAST(generate_subscripts(string_split(cell_text, ' '), 1) - 1 AS INTEGER) AS part FROM cells WHERE trim(cell_text) NOT IN ('0', '', '-')),
    tokens AS (SELECT conv_id, turn, cell, part, trim(raw) AS token, CASE WHEN trim(raw) = 'de' THEN 'link' WHEN trim(raw) IN ('la', 'the') THEN 'article'
      WHEN regexp_full_match(trim(raw), '.+ent\\.?') THEN 'stem_ent' WHEN regexp_full_match(trim(raw), '.+er\\.?') THEN 'stem_er' END AS outcome FROM parts)"""


def tokens(t):
    sentences = F.split("text", r"\. ")
    numbers = F.transform(F.sequence(F.lit(1), F.size(sentences)), lambda n: n.cast("string"))
    rows = t.conversations.select("conv_id", "turn", F.map_from_arrays(numbers, sentences).alias("cells"))
    return ingest.tokenise_cells(rows, ["conv_id", "turn"], "cells", " ", exact=EXACT, suffixes=SUFFIXES)


@query("e12_tokenise_and_map", f"WITH {TOKENS_SQL} SELECT * FROM tokens")
def _(t):
    return tokens(t)


REPORTED_SQL = """reported AS (SELECT conv_id, turn, CAST(length(text) - length(replace(text, ' ', '')) + 1 AS BIGINT) AS reported_words,
    CAST((length(text) - length(replace(text, 'ent ', ''))) / 4 AS BIGINT) AS reported_stems FROM conversations)"""


def reported(t):
    return t.conversations.selectExpr(
        "conv_id", "turn", "CAST(length(text) - length(replace(text, ' ', '')) + 1 AS BIGINT) AS reported_words",
        "CAST((length(text) - length(replace(text, 'ent ', ''))) DIV 4 AS BIGINT) AS reported_stems")


@query("e13_verify_row_counts", f"""
    WITH {TOKENS_SQL}, {REPORTED_SQL}, counted AS (SELECT conv_id, turn, count(*) AS token_count, count(*) FILTER (WHERE outcome IS NULL) AS unknown_tokens,
      count(*) AS token_words, count(*) FILTER (WHERE outcome = 'stem_ent') AS token_stems FROM tokens GROUP BY conv_id, turn),
    judged AS (SELECT r.conv_id, r.turn, reported_words, reported_stems, coalesce(token_count, 0) AS token_count,
      concat_ws(';', CASE WHEN coalesce(unknown_tokens, 0) > 0 THEN 'unknown_token' END,
        CASE WHEN coalesce(token_words, 0) <> reported_words THEN 'words_mismatch:' || coalesce(token_words, 0) || '!=' || reported_words END,
        CASE WHEN coalesce(token_stems, 0) <> reported_stems THEN 'stems_mismatch:' || coalesce(token_stems, 0) || '!=' || reported_stems END) AS reasons
      FROM reported r LEFT JOIN counted c ON c.conv_id = r.conv_id AND c.turn = r.turn)
    SELECT *, CASE WHEN reasons = '' THEN token_count END AS opportunities FROM judged""")
def _(t):
    checked = ingest.verify_token_counts(reported(t), tokens(t), ["conv_id", "turn"], {
        "words": (F.lit(True), "reported_words"), "stems": (F.col("outcome") == "stem_ent", "reported_stems")})
    return checked.select("conv_id", "turn", "reported_words", "reported_stems", "token_count",
                          F.array_join("reasons", ";").alias("reasons"), "opportunities")


@query("e14_ordered_pair_flags", """
    SELECT group_id, ordinal, step, concat_ws(';', CASE WHEN ordinal > pre_state THEN 'ordinal_exceeds_pre_state' END,
      CASE WHEN ordinal > post_state THEN 'ordinal_exceeds_post_state' END) AS flags,
      CASE WHEN post_state IN (1, 2) THEN 3 * pre_state + post_state WHEN post_state IS NULL THEN 3 * pre_state END AS thirds FROM raw_rows""",
       ("raw_rows",))
def _(t):
    text = F.expr("CASE WHEN post_state IS NULL THEN CAST(pre_state AS STRING) ELSE concat(pre_state, ' ', post_state, '/3') END")
    return t.raw_rows.select(
        "group_id", "ordinal", "step",
        F.array_join(ingest.pair_flags([("ordinal", "pre_state"), ("ordinal", "post_state")]), ";").alias("flags"),
        ingest.thirds_to_units(text).alias("thirds"))


MEMBERS_SQL = """members AS (SELECT f.group_id, side_id, member_id, count(*) FILTER (WHERE is_success) AS successes,
      CASE WHEN count(*) FILTER (WHERE outcome = 'NO') = 0 THEN count(*) END AS opportunities FROM facts f GROUP BY 1, 2, 3)"""


def member_rows(t):
    return t.facts.groupBy("group_id", "side_id", "member_id").agg(
        F.count_if("is_success").alias("successes"),
        F.when(F.count_if(F.col("outcome") == "NO") == 0, F.count("*")).alias("opportunities"))


@query("e15_reconcile_side_totals", f"""
    WITH {MEMBERS_SQL}, board AS (SELECT group_id, home_id AS side_id, home_score AS reported FROM games),
    opposing AS (SELECT group_id, side_id, count(*) FILTER (WHERE is_opportunity) AS faced FROM facts GROUP BY 1, 2),
    judged AS (SELECT m.group_id, m.side_id, any_value(reported) AS reported, any_value(faced) AS faced, sum(successes) AS s, sum(opportunities) AS o,
      count(*) FILTER (WHERE opportunities IS NULL) AS open_rows FROM members m LEFT JOIN board b ON b.group_id = m.group_id AND b.side_id = m.side_id
      LEFT JOIN opposing f ON f.group_id = m.group_id AND f.side_id = m.side_id GROUP BY 1, 2),
    verdict AS (SELECT group_id, side_id, concat_ws(';', CASE WHEN reported <> s THEN 'successes_mismatch' END,
      CASE WHEN open_rows > 0 OR faced IS NULL THEN 'totals_unverified' WHEN o <> faced THEN 'opposing_total_mismatch' END) AS reasons FROM judged)
    SELECT m.group_id, m.side_id, m.member_id, m.successes, reasons, CASE WHEN reasons = '' THEN opportunities END AS opportunities
    FROM members m JOIN verdict v ON v.group_id = m.group_id AND v.side_id = m.side_id""", ("facts", "games"))
def _(t):
    board = t.games.select("group_id", F.col("home_id").alias("side_id"), F.col("home_score").alias("reported"))
    opposing = t.facts.groupBy("group_id", "side_id").agg(F.count_if("is_opportunity").alias("faced"))
    rows = ingest.reconcile_side_totals(member_rows(t), board, opposing)
    return rows.select("group_id", "side_id", "member_id", "successes", F.array_join("reasons", ";").alias("reasons"), "opportunities")


@query("e16_dedupe_payloads", """
    WITH v AS (SELECT lang || ':' || n_chars AS key, sha256(text) AS h, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1, 2)
    SELECT key, count(*) AS variants, CAST(sum(copies) AS BIGINT) AS copies, CASE WHEN count(*) = 1 THEN min(first_doc) END AS kept_doc,
      CASE WHEN count(*) = 1 THEN min(h) END AS payload_sha256 FROM v GROUP BY key""")
def _(t):
    docs = t.documents.select(F.concat_ws(":", "lang", "n_chars").alias("key"), "text", "doc_id")
    kept, conflicts = ingest.dedupe_payloads(docs, ["key"], "text", ["doc_id"])
    kept = kept.select("key", F.lit(1).cast("bigint").alias("variants"), "copies", F.col("doc_id").alias("kept_doc"), "payload_sha256")
    return kept.unionByName(conflicts, allowMissingColumns=True)


INCOMING_SQL = """incoming AS (SELECT g.group_id, home_id, away_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE home_score END AS home_score,
    CASE WHEN o_orderpriority = '5-LOW' THEN away_score + 1 ELSE away_score END AS away_score FROM games g JOIN orders ON o_orderkey = g.group_id)"""


def incoming(t):
    joined = t.games.join(t.orders.withColumnRenamed("o_orderkey", "group_id"), "group_id")
    return joined.selectExpr("group_id", "home_id", "away_id", "IF(o_orderstatus = 'P', NULL, home_score) AS home_score",
                             "IF(o_orderpriority = '5-LOW', away_score + 1, away_score) AS away_score")


@query("e17_existing_fact_conflict", f"""
    WITH {INCOMING_SQL} SELECT i.group_id, i.home_id, i.home_score, i.away_score, g.home_id AS stored_home_id, g.home_score AS stored_home_score,
      g.away_score AS stored_away_score FROM incoming i JOIN games g ON g.group_id = i.group_id
    WHERE i.home_id IS DISTINCT FROM g.home_id OR i.home_score IS DISTINCT FROM g.home_score OR i.away_score IS DISTINCT FROM g.away_score""",
       ("games",))
def _(t):
    return ingest.fact_conflicts(incoming(t), t.games, ["group_id"], ["home_id", "home_score", "away_score"])


@query("e18_season_coverage", """
    WITH e AS (SELECT CAST(year(day) AS INTEGER) AS season, count(*) FILTER (WHERE home_score <> away_score) AS expected FROM games GROUP BY 1),
    f AS (SELECT CAST(year(day) AS INTEGER) AS season, group_id, count(*) AS n, min(day) AS lo, max(day) AS hi FROM facts GROUP BY 1, 2)
    SELECT f.season, count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS duplicates, strftime(min(lo), '%Y-%m-%d') AS first_day, strftime(max(hi), '%Y-%m-%d') AS last_day,
      any_value(expected) AS expected, count(*) = any_value(expected) AS complete FROM f LEFT JOIN e ON e.season = f.season GROUP BY f.season""",
       ("facts", "games"))
def _(t):
    expected = t.games.groupBy(F.year("day").alias("season")).agg(F.count_if(F.col("home_score") != F.col("away_score")).alias("expected"))
    rows = t.facts.withColumn("season", F.year("day"))
    coverage = ingest.season_coverage(rows, "season", "group_id", "day", expected)
    return coverage.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")})


@query("e18_reason_histogram", f"""
    WITH {MEMBERS_SQL}, flags AS (SELECT CASE WHEN successes > opportunities THEN 'a' END AS a, CASE WHEN opportunities IS NULL THEN 'unverified' END AS b,
      CASE WHEN successes = 0 THEN 'no_success' END AS c, side_id FROM members)
    SELECT side_id, reason, count(*) AS rows FROM (SELECT side_id, unnest([a, b, c]) AS reason FROM flags) WHERE reason IS NOT NULL GROUP BY 1, 2""", ("facts",))
def _(t):
    reasons = F.array_compact(F.array(F.when(F.col("opportunities").isNull(), F.lit("unverified")),
                                      F.when(F.col("successes") == 0, F.lit("no_success"))))
    return ingest.reason_histogram(member_rows(t).withColumn("reasons", reasons), ["side_id"])


@query("e19_cohort_key", f"""
    WITH named AS (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 1000 THEN '  ' ELSE ' ' || c_mktsegment || ' ' END AS name FROM customer),
    clean AS (SELECT *, nullif(trim(name), '') AS n, 'buyer' AS role, CAST(c_nationkey AS VARCHAR) AS side, 'name-side-role-v1' AS recipe FROM named)
    SELECT c_custkey, CASE WHEN n IS NULL THEN 'side-role:buyer:' || side ELSE 'cohort:' || sha256({framed_sql('recipe', 'n', 'side', 'role')}) END AS cohort_id,
      CASE WHEN n IS NULL THEN 'side_role_fallback' ELSE 'named_cohort' END AS status FROM clean""")
def _(t):
    name = F.when(F.col("c_acctbal") < 1000, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    cohort, status = ingest.cohort_key(F.col("c_nationkey"), F.lit("buyer"), name)
    return t.customer.select("c_custkey", cohort.alias("cohort_id"), status.alias("status"))


@query("e20_preserve_check", f"""
    WITH {INCOMING_SQL} SELECT group_id, home_id, away_id, home_score, away_score FROM games EXCEPT ALL SELECT * FROM incoming""", ("games",))
def _(t):
    return ingest.lost_rows(t.games.select("group_id", "home_id", "away_id", "home_score", "away_score"), incoming(t))
