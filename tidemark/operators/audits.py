"""Audits: every violation is one row, and audits combine by union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tidemark.session import cut_lineage, stored


def reduced_checks(events: DataFrame, groups: DataFrame, group_keys: Sequence[str], required: Sequence[str],
                   outcomes: Sequence[str], ranges: Mapping[str, Column]) -> DataFrame:
    """Incomplete groups, unknown outcomes and out-of-range states as ``(code, row_key)``."""
    per_group = groups.groupBy(*group_keys).agg(F.count("*").alias("n"), *[F.count(c).alias(f"__{c}") for c in required])
    broken = F.col("n") != 1
    for column in required:
        broken = broken | (F.col(f"__{column}") != 1)
    found = per_group.where(broken).select(F.lit("incomplete_group").alias("code"), F.concat_ws(":", *group_keys).alias("row_key"))
    labelled = events.where("outcome IS NOT NULL")
    rules = [F.when(~F.col("outcome").isin(list(outcomes)), F.lit("unknown_outcome"))]
    rules += [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in ranges.items()]
    rows = labelled.select(F.explode(F.array_compact(F.array(*rules))).alias("code"),
                           F.concat_ws(":", "group_id", "ordinal").alias("row_key"))
    return found.unionByName(rows)


def violations(df: DataFrame, rules: Sequence[tuple[str, Column, Column | str]], group: Column | None = None,
               entity: Column | None = None) -> DataFrame:
    """All row rules in one pass: a row for every rule whose condition holds."""
    def text(message: Column | str) -> Column:
        return message if isinstance(message, Column) else F.lit(message)

    hits = F.array_compact(F.array(*[
        F.when(condition, F.struct(F.lit(code).alias("code"), text(message).alias("message")))
        for code, condition, message in rules]))
    none = F.lit(None).cast("string")
    return (
        df.select(F.explode(hits).alias("hit"),
                  (none if group is None else group.cast("string")).alias("group_id"),
                  (none if entity is None else entity.cast("string")).alias("entity_id"))
        .select("hit.code", "hit.message", "group_id", "entity_id"))


def combine(*audits: DataFrame) -> DataFrame:
    result = audits[0]
    for audit in audits[1:]:
        result = result.unionByName(audit)
    return result


def extra_copies(df: DataFrame, copies: str, code: str, message: str, group: Column, entity: Column) -> DataFrame:
    """One violation for every copy after the first."""
    extra = df.where(F.col(copies) > 1).withColumn("__copy", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col(copies))))
    return violations(extra, [(code, F.lit(True), message)], group, entity)


def repeated(df: DataFrame, keys: Sequence[str], code: str, message: str, group: Column | None = None,
             entity: Column | None = None) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    text = F.concat(F.lit(message + ": "), F.col("__n"))
    return violations(counts, [(code, F.lit(True), text)], group, entity)


# --- references and constraints -------------------------------------------------------------

def missing_references(tables: Mapping[str, DataFrame],
                       rules: Sequence[tuple[str, Sequence[str], str, Sequence[str]]]) -> DataFrame:
    """Distinct child values without a parent, one row per value and rule."""
    result = None
    for child, child_columns, parent, parent_columns in rules:
        label = f"{child}({','.join(child_columns)})->{parent}({','.join(parent_columns)})"
        names = [f"__k{i}" for i in range(len(child_columns))]
        wanted = tables[child].select(*[F.col(c).alias(n) for c, n in zip(child_columns, names)]).dropna().distinct()
        known = tables[parent].select(*[F.col(c).alias(n) for c, n in zip(parent_columns, names)]).dropna()
        value = F.concat_ws("|", *[F.col(n).cast("string") for n in names])
        found = wanted.join(known, names, "left_anti").select(F.lit(label).alias("rule"), value.alias("value"))
        result = found if result is None else result.unionByName(found)
    return result


def sampled_counts(found: DataFrame, by: str, value: str, sample: int = 10) -> DataFrame:
    """Count per group and its first ``sample`` values (a bounded list, cut before the shuffle)."""
    from tidemark.plans.ordered import top_k
    counts = found.groupBy(by).agg(F.count("*").alias("missing"))
    first = top_k(found, [by], [F.col(value)], sample).groupBy(by).agg(
        F.sort_array(F.collect_list(value)).alias("sample"))
    return counts.join(first, by)


def reference_violations(tables: Mapping[str, DataFrame], rules: Sequence[tuple[str, Sequence[str], str, Sequence[str]]],
                         sample: int = 10) -> DataFrame:
    return sampled_counts(missing_references(tables, rules), "rule", "value", sample)


def constraint_audit(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Violations per declared check in one aggregate; as in SQL, a NULL check passes."""
    counted = df.agg(*[F.count_if(~F.coalesce(check, F.lit(True))).alias(name) for name, check in checks.items()])
    pairs = [F.struct(F.lit(name).alias("check_name"), F.col(name).alias("violations")) for name in checks]
    return counted.select(F.explode(F.array(*pairs)).alias("c")).select("c.*")


# --- expanding season split -----------------------------------------------------------------

def _group_seasons(samples: DataFrame) -> DataFrame:
    return samples.groupBy("group_id").agg(F.min("season").alias("season"), F.max("season").alias("last_season"))


def split_violations(samples: DataFrame, roles: DataFrame) -> DataFrame:
    """``samples``: row_id, group_id, season; ``roles``: season, role (one row per season)."""
    seasons = _group_seasons(samples)
    judged = seasons.join(roles, "season", "left")
    single = F.col("season") == F.col("last_season")
    return combine(
        repeated(samples, ["row_id"], "duplicate_row_id", "row occurs", entity=F.col("row_id")),
        violations(judged, [
            ("season_conflict", ~single, "one group has several seasons"),
            ("season_outside_policy", single & F.col("role").isNull(), F.concat(F.lit("season "), F.col("season"))),
        ], F.col("group_id")))


def role_assignments(samples: DataFrame, roles: DataFrame) -> DataFrame:
    """Whole groups to roles; use only after ``split_violations`` came back empty."""
    seasons = _group_seasons(samples).where("season = last_season").drop("last_season")
    return seasons.join(roles, "season")


def expanding_folds(assignments: DataFrame, base_season: int, targets: DataFrame) -> DataFrame:
    """Per target role: the seasons and groups before its season, and the groups in it."""
    per_season = assignments.groupBy("season").agg(F.count("*").alias("groups"))
    pairs = targets.join(F.broadcast(per_season), per_season["season"] <= targets["target_season"])  # one row per season
    return pairs.groupBy("target_role", "target_season").agg(
        F.coalesce(F.sum(F.when(F.col("season") < F.col("target_season"), F.col("groups"))), F.lit(0)).alias("training_groups"),
        F.coalesce(F.sum(F.when(F.col("season") == F.col("target_season"), F.col("groups"))), F.lit(0)).alias("target_groups"),
    ).withColumn("training_seasons", F.greatest(F.col("target_season") - base_season, F.lit(0)))


# --- totals against official rows -----------------------------------------------------------

TOTALS = ("opportunities", "attempts", "successes", "ones", "twos", "threes", "fours")


def audit_member_totals(facts: DataFrame, official: DataFrame) -> DataFrame:
    """Facts rolled up per group and member against official totals."""
    success, units = F.col("is_success"), F.col("units")
    row_rules = violations(facts, [
        ("success_without_attempt", success & ~F.col("is_opportunity"), "a success must also be an attempt"),
        ("success_units_invalid", success & ~units.between(1, 4), "a success needs one to four units"),
        ("units_without_success", ~success & (units != 0), "only a success carries units"),
    ], F.col("group_id"), F.col("fact_id"))
    types = F.col("ones") + F.col("twos") + F.col("threes") + F.col("fours")
    official_rules = violations(official, [
        ("attempts_exceed_opportunities", F.col("attempts") > F.col("opportunities"), "more attempts than opportunities"),
        ("successes_exceed_attempts", F.col("successes") > F.col("attempts"), "more successes than attempts"),
        ("success_types_mismatch", types != F.col("successes"), F.concat(types, F.lit("!="), F.col("successes"))),
    ], F.col("group_id"), F.col("member_id"))
    keys = ["group_id", "member_id"]
    tally = facts.groupBy(*keys).agg(
        F.count("*").alias("opportunities"), F.count_if("is_opportunity").alias("attempts"), F.count_if("is_success").alias("successes"),
        *[F.count_if(success & (units == n)).alias(name) for n, name in enumerate(TOTALS[3:], 1)],
        F.min("side_id").alias("low_side"), F.max("side_id").alias("high_side"))
    # The first official row of a pair is compared; further ones are reported as duplicates.
    chosen = official.groupBy(*keys).agg(
        F.count("*").alias("copies"), F.min(F.struct("side_id", *TOTALS)).alias("o"))
    joined = (tally.select(*keys, F.struct("low_side", "high_side", *TOTALS).alias("t"))
              .join(chosen, keys, "full_outer"))
    tallied = {name: F.coalesce(F.col(f"t.{name}"), F.lit(0)) for name in TOTALS}
    present = F.col("o").isNotNull()
    wrong_side = present & F.col("t").isNotNull() & (
        (F.col("t.low_side") != F.col("o.side_id")) | (F.col("t.high_side") != F.col("o.side_id")))
    compared = violations(joined, [
        ("member_total_missing", ~present, "facts without official total"),
        ("member_side_mismatch", wrong_side, "facts belong to another side"),
        *[(f"{name}_mismatch", present & (tallied[name] != F.col(f"o.{name}")),
           F.concat(tallied[name], F.lit("!="), F.col(f"o.{name}"))) for name in TOTALS],
    ], F.col("group_id"), F.col("member_id"))
    return combine(repeated(facts, ["fact_id"], "duplicate_fact", "fact occurs", entity=F.col("fact_id")),
                   extra_copies(chosen, "copies", "duplicate_member_total", "official totals must be unique",
                                F.col("group_id"), F.col("member_id")),
                   row_rules, official_rules, compared)


def audit_group_scores(facts: DataFrame, sides: DataFrame) -> DataFrame:
    """Summed units against final scores; pairs complete, one home row, opponents reciprocal.

    ``sides``: row_id, group_id, side_id, opponent_id, is_home, score.
    """
    keys = ["group_id", "side_id"]
    scored = facts.groupBy(*keys).agg(F.sum("units").alias("units"))
    per_side = sides.groupBy(*keys).agg(F.count("*").alias("copies"), F.min(F.struct("row_id", "score")).alias("s"))
    joined = scored.join(per_side, keys, "full_outer")
    units = F.coalesce("units", F.lit(0))
    compared = violations(joined, [
        ("side_row_missing", F.col("s").isNull(), "facts without final side row"),
        ("side_score_missing", F.col("s").isNotNull() & F.col("s.score").isNull(), "final score is missing"),
        ("side_score_mismatch", units != F.col("s.score"), F.concat(units, F.lit("!="), F.col("s.score"))),
    ], F.col("group_id"), F.col("side_id"))
    # With two rows, "each names the other" is symmetric, so per-group minima and maxima decide it.
    pairs = sides.groupBy("group_id").agg(
        F.count("*").alias("n"), F.count_if("is_home").alias("home"),
        F.min(F.struct("row_id", "side_id", "opponent_id")).alias("a"), F.max(F.struct("row_id", "side_id", "opponent_id")).alias("b"))
    groups = facts.select("group_id").distinct().join(pairs, "group_id", "full_outer")
    n = F.coalesce("n", F.lit(0))
    reciprocal = (F.col("a.side_id") == F.col("b.opponent_id")) & (F.col("b.side_id") == F.col("a.opponent_id"))
    paired = violations(groups, [
        ("side_pair_incomplete", n != 2, F.concat(F.lit("rows: "), n)),
        ("home_row_invalid", (n == 2) & (F.col("home") != 1), "exactly one home row is required"),
        ("opponent_mismatch", (n == 2) & ~reciprocal, "rows must name each other"),
    ], F.col("group_id"))
    return combine(repeated(sides, ["row_id"], "duplicate_side_row_id", "row occurs", entity=F.col("row_id")),
                   extra_copies(per_side, "copies", "duplicate_side_row", "side result must be unique",
                                F.col("group_id"), F.col("side_id")), compared, paired)


def audit_consistency(facts: DataFrame, official: DataFrame, sides: DataFrame) -> DataFrame:
    """Both audits; what is found is stored one after the other, so their shuffles are not on disk together."""
    return combine(stored(audit_member_totals(facts, official), "members"), stored(audit_group_scores(facts, sides), "scores"))


# --- state transitions ----------------------------------------------------------------------

POST_STATE = ("home_before", "away_before", "outs_added", "bases_after", "home_after", "away_after")


def audit_transitions(rows: DataFrame, markers: DataFrame, *, require_complete: bool = False) -> DataFrame:
    """Row rules of one state transition, then continuity with the next row of the group.

    ``rows``: fact_id, group_id, sequence, subsequence, period, half ('top'/'bottom'), outs_before,
    outs_added, bases_before, bases_after, home_before, away_before, home_after, away_after, units, complete.
    Pairs with a marker (group_id, sequence, subsequence) between them are not compared.
    """
    from tidemark.operators.history import count_markers
    from tidemark.plans.ordered import neighbour

    col = F.col
    missing = F.array_compact(F.array(*[F.when(col(c).isNull(), F.lit(c)) for c in POST_STATE]))
    rows = rows.withColumn("__missing", missing)
    # Every rule below is a branch over the rows; stored once, they are read by column.
    rows = stored(rows.withColumn("__usable", col("complete") & (F.size("__missing") == 0)), "transitions")
    bitmap = "^[01]{3}$"
    outs = col("outs_before") + col("outs_added")
    gain_home, gain_away = col("home_after") - col("home_before"), col("away_after") - col("away_before")
    due_home = F.when(col("half") == "bottom", col("units")).otherwise(0)
    due_away = F.when(col("half") == "top", col("units")).otherwise(0)
    usable = col("__usable")
    row_rules = violations(rows, [
        ("sequence_invalid", col("sequence") < 1, "sequence starts at one"),
        ("subsequence_invalid", col("subsequence") < 0, "subsequence cannot be negative"),
        ("period_invalid", col("period") < 1, "period starts at one"),
        ("outs_before_invalid", ~col("outs_before").between(0, 2), "outs before must be zero to two"),
        ("bases_before_invalid", ~col("bases_before").rlike(bitmap), "occupancy needs three bits"),
        ("units_invalid", col("units") < 0, "units cannot be negative"),
        *[("score_invalid", col(c) < 0, f"{c} cannot be negative") for c in ("home_before", "away_before", "home_after", "away_after")],
        ("complete_fields_missing", col("complete") & (F.size("__missing") > 0), F.array_join("__missing", ", ")),
        *([("transition_incomplete", ~col("complete"), "row has no full transition")] if require_complete else []),
        ("outs_added_invalid", usable & ~col("outs_added").between(0, 3), "outs added must be zero to three"),
        ("outs_overflow", usable & (outs > 3), F.concat(F.lit("outs: "), outs)),
        ("bases_after_invalid", usable & ~col("bases_after").rlike(bitmap), "occupancy needs three bits"),
        ("bases_after_three_outs", usable & (outs == 3) & (col("bases_after") != "000"), "occupancy must be empty after three outs"),
        ("score_decreased", usable & ((gain_home < 0) | (gain_away < 0)), "a score cannot decrease"),
        ("score_delta_mismatch", usable & ((gain_home != due_home) | (gain_away != due_away)),
         F.concat(F.lit("home "), gain_home, F.lit(", away "), gain_away, F.lit(" for "), col("units"))),
    ], col("group_id"), col("fact_id"))

    order = ["sequence", "subsequence"]
    bucket = F.floor(col("sequence") / 10000)
    carried = [*order, "period", "half", "outs_before", "outs_added", "bases_after", "home_after", "away_after", "__usable", "__through"]
    counted = count_markers(rows, markers, ["group_id"], order, bucket).select(
        "group_id", "fact_id", "bases_before", "home_before", "away_before", *carried, "__before")
    counted = stored(counted, "counted")  # the rows and the edges of their buckets
    pairs = neighbour(counted, ["group_id"], [*order, "fact_id"], bucket, carried, "p")
    unbroken = col("__before") == col("p.__through")
    after = col("p.outs_before") + col("p.outs_added")
    later = F.struct(*order) > F.struct(col("p.sequence").alias("sequence"), col("p.subsequence").alias("subsequence"))
    compared = pairs.where(col("p").isNotNull() & usable & col("p.__usable") & unbroken & later & (after <= 3))
    rolled = after == 3
    next_period = F.when(rolled & (col("p.half") == "bottom"), col("p.period") + 1).otherwise(col("p.period"))
    next_half = F.when(rolled, F.when(col("p.half") == "top", "bottom").otherwise("top")).otherwise(col("p.half"))
    next_outs = F.when(rolled, 0).otherwise(after)
    next_bases = F.when(rolled, "000").otherwise(col("p.bases_after"))
    continuity = violations(compared, [
        ("next_half_mismatch", (col("period") != next_period) | (col("half") != next_half),
         F.concat(F.lit("expected "), next_period, F.lit("/"), next_half)),
        ("next_outs_mismatch", col("outs_before") != next_outs, F.concat(F.lit("expected "), next_outs)),
        ("next_bases_mismatch", col("bases_before") != next_bases, F.concat(F.lit("expected "), next_bases)),
        ("next_score_mismatch", (col("home_before") != col("p.home_after")) | (col("away_before") != col("p.away_after")),
         "score differs from the previous row"),
    ], col("group_id"), col("fact_id"))
    return combine(
        repeated(rows, ["fact_id"], "duplicate_transition", "transition occurs", entity=col("fact_id")),
        row_rules,
        repeated(rows, ["group_id", *order], "order_duplicate", "order key occurs", group=col("group_id")),
        continuity)


# --- phased captures ------------------------------------------------------------------------

def audit_phase_captures(slates: DataFrame, rules: DataFrame, eligibility: DataFrame, captures: DataFrame,
                         phases: Sequence[str], *, require_all_phases: bool = True) -> DataFrame:
    """Slate, rule, eligibility and capture rows must agree, phase by phase.

    ``slates``: slate_id, rule_version, card_version, eligibility_snapshot, lock_at; ``rules``: rule_version;
    ``eligibility``: row_id, slate_id, eligibility_snapshot, card_version, member_id, position, is_eligible;
    ``captures``: capture_id, snapshot_id, slate_id, phase, rule_version, card_version, eligibility_snapshot,
    member_id, position, captured_at.
    """
    col = F.col
    contract_columns = ["rule_version", "card_version", "eligibility_snapshot", "lock_at"]
    contract = slates.groupBy("slate_id").agg(F.min(F.struct(*contract_columns)).alias("s"))
    found = [
        repeated(rules, ["rule_version"], "rule_duplicate", "rule occurs", entity=col("rule_version")),
        repeated(slates, ["slate_id"], "slate_duplicate", "slate occurs", entity=col("slate_id")),
    ]
    unknown_rule = contract.select("slate_id", col("s.rule_version").alias("rule_version")).join(rules, "rule_version", "left_anti")
    found.append(violations(unknown_rule, [("slate_rule_missing", F.lit(True), F.concat(F.lit("unknown rule "), "rule_version"))],
                            col("slate_id"), col("rule_version")))

    identity = ["eligibility_snapshot", "slate_id", "card_version", "member_id", "position"]
    member_position = F.concat_ws(":", "member_id", "position")
    found.append(repeated(eligibility, identity, "eligibility_duplicate", "identity occurs", col("slate_id"), member_position))
    offered = eligibility.join(contract, "slate_id", "left")
    known = col("s").isNotNull()
    found.append(violations(offered, [
        ("eligibility_slate_missing", ~known, "unknown slate"),
        ("eligibility_snapshot_mismatch", known & (col("eligibility_snapshot") != col("s.eligibility_snapshot")), "snapshot differs from the slate"),
        ("eligibility_card_mismatch", known & (col("card_version") != col("s.card_version")), "card differs from the slate"),
    ], col("slate_id"), col("row_id")))

    found.append(repeated(captures, ["slate_id", "phase", "member_id", "position"], "capture_duplicate", "capture occurs",
                          col("slate_id"), F.concat_ws(":", "member_id", "position", "phase")))
    first_offer = eligibility.groupBy(*identity).agg(F.min(F.struct("row_id", "is_eligible")).alias("e"))
    taken = captures.join(contract, "slate_id", "left").join(first_offer, identity, "left")
    found.append(violations(taken, [
        ("capture_slate_missing", ~known, "unknown slate"),
        ("capture_rule_mismatch", known & (col("rule_version") != col("s.rule_version")), "rule differs from the slate"),
        ("capture_card_mismatch", known & (col("card_version") != col("s.card_version")), "card differs from the slate"),
        ("capture_snapshot_mismatch", known & (col("eligibility_snapshot") != col("s.eligibility_snapshot")), "snapshot differs from the slate"),
        ("capture_after_lock", known & (col("captured_at") > col("s.lock_at")), "captured after the lock"),
        ("capture_eligibility_missing", known & col("e").isNull(), "no matching eligibility row"),
        ("capture_member_ineligible", known & ~col("e.is_eligible"), "member is not eligible"),
    ], col("slate_id"), col("capture_id")))

    per_phase = captures.groupBy("slate_id", "phase").agg(
        F.min("snapshot_id").alias("lo"), F.max("snapshot_id").alias("hi"),
        F.min("captured_at").alias("first_at"), F.max("captured_at").alias("last_at"))
    found.append(violations(per_phase, [
        ("phase_snapshot_inconsistent", col("lo") != col("hi"), F.concat(F.lit("phase "), "phase")),
        ("phase_time_inconsistent", col("first_at") != col("last_at"), F.concat(F.lit("phase "), "phase")),
    ], col("slate_id")))
    uses = captures.select("snapshot_id", "slate_id", "phase").distinct()
    found.append(repeated(uses, ["snapshot_id"], "snapshot_reused", "slate phases", entity=col("snapshot_id")))

    # One row per slate holds the (few) phases as columns, so order and completeness need no window.
    times = {p: F.max(F.when((col("phase") == p) & (col("first_at") == col("last_at")), col("first_at"))) for p in phases}
    wide = per_phase.groupBy("slate_id").agg(
        *[times[p].alias(f"__t{i}") for i, p in enumerate(phases)],
        *[F.max(col("phase") == p).alias(f"__h{i}") for i, p in enumerate(phases)])
    by_slate = contract.join(wide, "slate_id", "left")
    order_rules = []
    for i in range(1, len(phases)):
        earlier = F.coalesce(*[col(f"__t{j}") for j in range(i - 1, -1, -1)])
        order_rules.append(("phase_order_invalid", col(f"__t{i}") < earlier, F.lit(f"{phases[i]} precedes an earlier phase")))
    found.append(violations(by_slate, order_rules, col("slate_id")))
    if require_all_phases:
        absent = [F.when(~F.coalesce(col(f"__h{i}"), F.lit(False)), F.lit(p)) for i, p in enumerate(phases)]
        gaps = F.array_join(F.array_sort(F.array_compact(F.array(*absent))), ", ")
        found.append(violations(by_slate, [("slate_phases_incomplete", gaps != "", gaps)], col("slate_id")))
        eligible = (eligibility.where("is_eligible").select("slate_id", "member_id", "position").distinct()
                    .join(contract, "slate_id", "left_semi"))
        seen = captures.groupBy("slate_id", "member_id", "position").agg(
            *[F.max(col("phase") == p).alias(f"__h{i}") for i, p in enumerate(phases)])
        found.append(violations(eligible.join(seen, ["slate_id", "member_id", "position"], "left"),
                                [("member_phases_incomplete", gaps != "", gaps)], col("slate_id"), member_position))
    return combine(*found)


# --- leakage --------------------------------------------------------------------------------

def audit_feature_leakage(features: DataFrame, cutoffs: DataFrame, *, oracle: bool = False) -> DataFrame:
    """Forecast rows must be issued and published by the cutoff; oracle data holds observations only.

    ``features``: feature_id, group_id, name, kind ('forecast'/'observation'), target_at, available_at,
    issued_at, observed_at; ``cutoffs``: group_id, cutoff_at.
    """
    col = F.col
    joined = features.join(cutoffs, "group_id", "left")
    known = col("cutoff_at").isNotNull()
    forecast, observed = known & (col("kind") == "forecast"), known & (col("kind") == "observation")
    issued = forecast & col("issued_at").isNotNull()
    rules = [
        ("cutoff_missing", ~known, "group has no cutoff"),
        ("forecast_in_oracle_data", forecast & F.lit(oracle), "oracle data holds observations only"),
        ("issue_time_missing", forecast & col("issued_at").isNull(), "forecast needs an issue time"),
        ("available_before_issue", issued & (col("issued_at") > col("available_at")), "available before it was issued"),
        ("issued_after_cutoff", issued & (col("issued_at") > col("cutoff_at")), "issued after the cutoff"),
        ("issued_after_target", issued & (col("issued_at") > col("target_at")), "issued after its target"),
        ("forecast_has_observation", forecast & col("observed_at").isNotNull(), "forecast carries an observation time"),
        ("available_after_cutoff", forecast & (col("available_at") > col("cutoff_at")), "not available at the cutoff"),
        ("observation_in_forecast_data", observed & F.lit(not oracle), "observations only in oracle data"),
        ("observation_time_missing", observed & col("observed_at").isNull(), "observation needs its time"),
        ("available_before_observed", observed & (col("observed_at") > col("available_at")), "available before it was observed"),
        ("observation_has_issue_time", observed & col("issued_at").isNotNull(), "observation carries an issue time"),
    ]
    return combine(
        repeated(features, ["group_id", "name", "target_at"], "duplicate_feature", "rows", col("group_id"), col("name")),
        violations(joined, rules, col("group_id"), col("feature_id")))
