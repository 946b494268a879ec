"""Turning raw ordered feeds into canonical event, group, side and dimension rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.digests import framed
from tidemark.plans.ordered import neighbour


@dataclass(frozen=True)
class Attribution:
    """Member credited with a reduced event.

    When the closing value of ``outcome`` is ``special``, credit goes to the last
    row that satisfies ``condition``, else to the first row; any other outcome
    credits the last row.
    """

    member: str
    outcome: str
    special: str
    condition: Column


def reduce_ordered_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                         first: Mapping[str, str], last: Mapping[str, str],
                         attribution: Attribution | None = None) -> DataFrame:
    """Many ordered rows to one: opening and closing values, NULLs kept as they are."""
    position = F.struct(*order)
    aggregates = [F.min_by(source, position).alias(name) for name, source in first.items()]
    aggregates += [F.max_by(source, position).alias(name) for name, source in last.items()]
    if attribution is not None:
        member = F.col(attribution.member)
        # The struct keeps a NULL member of the chosen row apart from "no such row".
        chosen = F.max_by(F.struct(member.alias("m")), F.when(attribution.condition, position))
        aggregates += [
            F.max_by(F.col(attribution.outcome), position).alias("__outcome"),
            chosen.alias("__chosen"),
            F.min_by(member, position).alias("__opening"),
            F.max_by(member, position).alias("__closing"),
        ]
    reduced = df.groupBy(*keys).agg(*aggregates)
    if attribution is None:
        return reduced
    credited = F.when(F.col("__outcome") == attribution.special,
                      F.coalesce(F.col("__chosen.m"), F.col("__opening"))).otherwise(F.col("__closing"))
    return reduced.withColumn(attribution.member, credited).drop("__outcome", "__chosen", "__opening", "__closing")


def reduce_group_max(df: DataFrame, keys: Sequence[str], maxima: Mapping[str, str],
                     attributes: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(n) for n, c in maxima.items()],
                                 *[F.any_value(c).alias(c) for c in attributes])


def unpivot_sides(groups: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Two rows per group, one per side, with the result seen from that side."""
    home = F.struct(F.col("home_id").alias("side_id"), F.col("away_id").alias("opponent_id"), F.lit(True).alias("is_home"),
                    F.col("home_score").alias("scored"), F.col("away_score").alias("allowed"))
    away = F.struct(F.col("away_id").alias("side_id"), F.col("home_id").alias("opponent_id"), F.lit(False).alias("is_home"),
                    F.col("away_score").alias("scored"), F.col("home_score").alias("allowed"))
    sides = groups.select("group_id", *carry, F.explode(F.array(home, away)).alias("s")).select("group_id", *carry, "s.*")
    result = F.when(F.col("scored") > F.col("allowed"), "win").when(F.col("scored") < F.col("allowed"), "loss")
    return sides.withColumn("result", result.when(F.col("scored") == F.col("allowed"), "draw"))


def side_rollup(groups: DataFrame, events: DataFrame, success: Column) -> DataFrame:
    """Successful events per side; a side without events counts zero."""
    sides = groups.select("group_id", F.col("home_id").alias("side_id")).unionByName(
        groups.select("group_id", F.col("away_id").alias("side_id")))
    counts = events.groupBy("group_id", "side_id").agg(F.count_if(success).alias("successes"))
    return sides.join(counts, ["group_id", "side_id"], "left").withColumn(
        "successes", F.coalesce("successes", F.lit(0)))


def first_seen(appearances: DataFrame, season: str, key: str, day: str, name: str) -> DataFrame:
    """First day and first non-blank name of every key and season; the key stands in for a missing name."""
    text = F.nullif(F.trim(name), F.lit(""))
    return appearances.groupBy(season, key).agg(
        F.min(day).alias("first_day"),
        F.coalesce(F.min_by(text, F.when(text.isNotNull(), F.struct(day, text))), F.first(key).cast("string"))
        .alias("display_name"))


def decode_violations(df: DataFrame, code: str, pattern: str, agreements: Mapping[str, Column]) -> DataFrame:
    """Ids that break their pattern, or whose parts disagree with the row's own columns."""
    shape = F.coalesce(F.col(code).rlike(f"^(?:{pattern})$"), F.lit(False))
    reasons = [F.when(~shape, F.lit("pattern"))]
    reasons += [F.when(shape & ~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in agreements.items()]
    return df.select("*", F.array_compact(F.array(*reasons)).alias("reasons")).where(F.size("reasons") > 0)


def map_outcomes(df: DataFrame, outcome: str, rules: DataFrame) -> DataFrame:
    """Attach the flags of a fixed outcome table (one row per outcome, a dozen rows)."""
    return df.join(rules.withColumnRenamed("outcome", outcome), outcome, "left")


def occupancy(columns: Sequence[str]) -> Column:
    return F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])


def quality_counts(reduced: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of import quality counts over reduced events and their final groups."""
    labelled = F.col("outcome").isNotNull()
    gain_home = F.col("home_after") - F.col("home_before")
    gain_away = F.col("away_after") - F.col("away_before")
    wrong = (gain_home != F.when(F.col("is_top"), 0).otherwise(F.col("units"))) | (
        gain_away != F.when(F.col("is_top"), F.col("units")).otherwise(0))
    rows = reduced.agg(
        F.count_if(labelled).alias("labelled"), F.count_if(~labelled).alias("unlabelled"),
        F.coalesce(F.sum(F.when(~labelled, F.col("units"))), F.lit(0)).cast("bigint").alias("unlabelled_units"),
        F.count_if(labelled & wrong).alias("bad_transitions"))
    totals = reduced.groupBy("group_id").agg(F.sum("units").alias("units"))
    final = groups.join(totals, "group_id").withColumn("short", F.col("home_score") + F.col("away_score") - F.col("units"))
    scores = final.agg(F.count_if(F.col("short") != 0).alias("unreconciled"),
                       F.coalesce(F.sum("short"), F.lit(0)).cast("bigint").alias("net_shortfall"))
    linked = neighbour(reduced.select("group_id", "ordinal"), ["group_id"], ["ordinal"],
                       F.floor(F.col("ordinal") / 10000), ["ordinal"], "previous")
    gaps = linked.agg(F.count_if(F.col("ordinal") > F.col("previous.ordinal") + 1).alias("ordinal_gaps"))
    return rows.crossJoin(F.broadcast(scores)).crossJoin(F.broadcast(gaps))  # three one-row aggregates


def inserted_vs_total(before: DataFrame, after: DataFrame, source: str = "source_id") -> DataFrame:
    old = before.groupBy(source).agg(F.count("*").alias("rows_before"))
    new = after.groupBy(source).agg(F.count("*").alias("rows_after"))
    joined = new.join(old, source, "full_outer").fillna(0, ["rows_before", "rows_after"])
    return joined.withColumn("inserted", F.col("rows_after") - F.col("rows_before"))


def tokenise_cells(df: DataFrame, ids: Sequence[str], cells: str, separator: str, *,
                   exact: Mapping[str, str], suffixes: Sequence[tuple[str, str]],
                   codes: DataFrame | None = None) -> DataFrame:
    """Cells of a wide row to one row per token, mapped where the notation is known.

    Order of rules: numeric code table, exact text, then suffix patterns; what
    none of them knows keeps a NULL outcome.
    """
    entries = df.select(*ids, F.explode(F.map_entries(cells)).alias("cell"))
    used = entries.where(~F.coalesce(F.trim("cell.value").isin("0", "", "-"), F.lit(True)))
    tokens = used.select(*ids, F.col("cell.key").cast("int").alias("cell"),
                         F.posexplode(F.split("cell.value", separator)).alias("part", "raw"))
    tokens = tokens.withColumn("token", F.trim("raw")).drop("raw")
    outcome = F.coalesce(*[F.when(F.col("token") == text, F.lit(value)) for text, value in exact.items()],
                         *[F.when(F.col("token").rlike(f"^(?:{pattern})$"), F.lit(value)) for pattern, value in suffixes])
    if codes is None:
        return tokens.withColumn("outcome", outcome)
    number = F.when(F.col("token").rlike("^[0-9]{4,}$"), F.col("token").try_cast("int"))
    table = codes.select(F.col("code").alias("__code"), F.col("outcome").alias("__outcome"))
    joined = tokens.withColumn("__number", number).join(table, F.col("__number") == F.col("__code"), "left")
    numeric = F.col("token").rlike("^[0-9]{4,}$")
    return joined.withColumn("outcome", F.when(numeric, F.col("__outcome")).otherwise(outcome)).drop(
        "__number", "__code", "__outcome")


def verify_token_counts(rows: DataFrame, tokens: DataFrame, ids: Sequence[str], checks: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Compare counted tokens with each row's reported totals.

    ``checks`` names a condition on tokens and the reported column.  A mismatch
    or an unknown token only withdraws ``opportunities``; reported totals stay.
    """
    counted = tokens.groupBy(*ids).agg(
        F.count("*").alias("token_count"), F.count_if(F.col("outcome").isNull()).alias("unknown_tokens"),
        *[F.count_if(condition).alias(f"token_{name}") for name, (condition, _) in checks.items()])
    joined = rows.join(counted, list(ids), "left")
    zeros = ["token_count", "unknown_tokens", *[f"token_{n}" for n in checks]]
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros})
    reasons = [F.when(F.col("unknown_tokens") > 0, F.lit("unknown_token"))]
    for name, (_, reported) in checks.items():
        bad = F.col(reported).isNotNull() & (F.col(f"token_{name}") != F.col(reported))
        reasons.append(F.when(bad, F.concat(F.lit(f"{name}_mismatch:"), F.col(f"token_{name}"), F.lit("!="), F.col(reported))))
    known = F.lit(True)
    for _, reported in checks.values():
        known = known & F.col(reported).isNotNull()
    joined = joined.withColumn("reasons", F.array_compact(F.array(*reasons)))
    joined = joined.withColumn("verified", known & (F.size("reasons") == 0))
    return joined.withColumn("opportunities", F.when(F.col("verified"), F.col("token_count")))


def pair_flags(pairs: Sequence[tuple[str, str]]) -> Column:
    """Names of the pairs whose smaller value exceeds the larger one (NULL pairs pass)."""
    return F.array_compact(F.array(*[
        F.when(F.col(small) > F.col(large), F.lit(f"{small}_exceeds_{large}")) for small, large in pairs]))


def thirds_to_units(text: Column) -> Column:
    """``"5"``, ``"1/3"`` or ``"5 1/3"`` as a number of thirds; anything else is NULL."""
    clean = F.replace(F.trim(text), F.lit("\\/"), F.lit("/"))
    whole = F.when(clean.rlike("^[0-9]+$"), 3 * clean.try_cast("int"))
    lead = F.coalesce(F.nullif(F.regexp_extract(clean, r"^([0-9]+)\s", 1), F.lit("")).cast("int"), F.lit(0))
    rest = F.regexp_extract(clean, r"([12])/3$", 1)
    mixed = F.when(clean.rlike(r"^(?:[0-9]+\s+)?[12]/3$"), 3 * lead + rest.cast("int"))
    return F.coalesce(whole, mixed)


def reconcile_side_totals(members: DataFrame, board: DataFrame, opposing: DataFrame) -> DataFrame:
    """Side sums against the scoreboard and the other side's own count.

    ``members``: group_id, side_id, member_id, successes, opportunities (NULL = unverified);
    ``board``: group_id, side_id, reported; ``opposing``: group_id, side_id, faced.
    Any failure withdraws the opportunities of every member of the side.
    """
    slot = ["group_id", "side_id"]
    totals = members.groupBy(*slot).agg(
        F.sum("successes").alias("side_successes"), F.sum("opportunities").alias("side_opportunities"),
        F.count_if(F.col("opportunities").isNull()).alias("open_rows"))
    judged = totals.join(board, slot, "left").join(opposing, slot, "left")
    complete = (F.col("open_rows") == 0) & F.col("faced").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(F.col("reported") != F.col("side_successes"), F.lit("successes_mismatch")),
        F.when(~complete, F.lit("totals_unverified")),
        F.when(complete & (F.col("side_opportunities") != F.col("faced")), F.lit("opposing_total_mismatch"))))
    verdict = judged.select(*slot, reasons.alias("reasons"))
    joined = members.join(verdict, slot)
    return joined.withColumn("opportunities", F.when(F.size("reasons") == 0, F.col("opportunities")))


def dedupe_payloads(df: DataFrame, key: Sequence[str], payload: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Ids seen several times: equal payloads keep the first copy, different ones are conflicts."""
    variants = df.groupBy(*key, F.sha2(payload, 256).alias("payload_sha256")).agg(
        F.count("*").alias("copies"), F.min(F.struct(*order)).alias("first_at"))
    per_key = variants.groupBy(*key).agg(
        F.count("*").alias("variants"), F.sum("copies").alias("copies"),
        F.min("first_at").alias("first_at"), F.min("payload_sha256").alias("payload_sha256"))
    kept = per_key.where("variants = 1").select(*key, "payload_sha256", "copies", "first_at.*")
    conflicts = per_key.where("variants > 1").select(*key, "variants", "copies")
    return kept, conflicts


def fact_conflicts(incoming: DataFrame, stored: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Rows whose key is stored with other facts (NULL equals NULL)."""
    old = stored.select(*keys, *[F.col(f).alias(f"stored_{f}") for f in fields])
    same = F.lit(True)
    for field in fields:
        same = same & F.col(field).eqNullSafe(F.col(f"stored_{field}"))
    return incoming.select(*keys, *fields).join(old, list(keys)).where(~same)


def season_coverage(groups: DataFrame, season: str, key: str, day: str, expected: DataFrame | None = None) -> DataFrame:
    """Groups, duplicates, dates and completeness per season."""
    per_key = groups.groupBy(season, key).agg(F.count("*").alias("n"), F.min(day).alias("lo"), F.max(day).alias("hi"))
    coverage = per_key.groupBy(season).agg(
        F.count("*").alias("groups"), F.sum(F.col("n") - 1).cast("bigint").alias("duplicates"),
        F.min("lo").alias("first_day"), F.max("hi").alias("last_day"))
    if expected is None:
        return coverage
    joined = coverage.join(expected, season, "left")
    return joined.withColumn("complete", F.col("groups") == F.col("expected"))


def reason_histogram(df: DataFrame, by: Sequence[str], reasons: str = "reasons") -> DataFrame:
    return df.select(*by, F.explode(reasons).alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("rows"))


def cohort_key(side: Column, role: Column, name: Column, recipe: str = "name-side-role-v1") -> tuple[Column, Column]:
    """``(cohort id, status)``: a digest of name, side and role, or a side-and-role fallback for blank names."""
    clean = F.nullif(F.trim(name), F.lit(""))
    side = F.trim(side.cast("string"))
    digest = F.sha2(framed([F.lit(recipe), clean, side, role]), 256)
    named = F.concat(F.lit("cohort:"), digest)
    fallback = F.concat_ws(":", F.lit("side-role"), role, side)
    return (F.when(clean.isNull(), fallback).otherwise(named),
            F.when(clean.isNull(), F.lit("side_role_fallback")).otherwise(F.lit("named_cohort")))


def lost_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Earlier rows that are missing or different afterwards (multiset difference)."""
    return before.exceptAll(after.select(*before.columns))
