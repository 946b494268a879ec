"""Targets: reported totals, totals derived from facts, and which of the two may be used."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("opportunities", "attempts", "successes", "units", "walks", "strikes", "fours")
# Fixed pairs whose first field can never exceed the second one.
ACTING_LIMITS = (("successes", "attempts"), ("attempts", "opportunities"), ("successes", "units"), ("fours", "successes"), ("strikes", "attempts"))
RECEIVING_LIMITS = (("successes", "attempts"), ("attempts", "opportunities"), ("fours", "successes"), ("strikes", "opportunities"))


def derive_member_totals(facts: DataFrame, member: str, side: str, other: str, classes: Sequence[str], outcomes: Mapping[str, Sequence[str]],
                         unknown: Sequence[str] = ()) -> DataFrame:
    """One row per group and member from its facts; ``unknown`` fields cannot be derived and stay NULL."""
    success = F.col("is_success")
    return facts.groupBy("group_id", F.col(member).alias("member_id")).agg(
        F.min("day").alias("day"), F.min(side).alias("side_id"), F.min(other).alias("other_side_id"), F.count("*").alias("opportunities"),
        F.count_if("is_opportunity").alias("attempts"), F.count_if(success).alias("successes"), F.sum("units").cast("bigint").alias("units"),
        F.count_if(F.col("outcome").isin(list(outcomes["walks"]))).alias("walks"), F.count_if(F.col("outcome").isin(list(outcomes["strikes"]))).alias("strikes"),
        F.count_if(success & (F.col("units") == 4)).alias("fours"), *[F.count_if(F.col("outcome") == c).alias(f"n_{c}") for c in classes],
        (F.min(side) != F.max(side)).alias("conflicting_side"), *[F.lit(None).cast("bigint").alias(u) for u in unknown])


def repair_contradictions(df: DataFrame, limits: Sequence[tuple[str, str]]) -> DataFrame:
    """NULL both fields of every impossible pair; all pairs are judged on the original values."""
    bad = {f: F.lit(False) for pair in limits for f in pair}
    for small, large in limits:
        broken = F.coalesce(F.col(small) > F.col(large), F.lit(False))
        bad[small] = bad[small] | broken
        bad[large] = bad[large] | broken
    return df.withColumns({f: F.when(~condition, F.col(f)) for f, condition in bad.items()})


def usable_totals(df: DataFrame, classes: Sequence[str], derived: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """Acting rows: successes above attempts are withdrawn, and verified class counts settle the dependent totals.

    ``derived`` gives each dependent field as weights over class counts.
    """
    doubtful = ~F.coalesce(F.col("successes_verified"), F.lit(True)) | F.coalesce(F.col("successes") > F.col("attempts"), F.lit(False))
    rows = df.withColumns({"successes": F.when(~doubtful, F.col("successes")), "counts_verified": F.coalesce("counts_verified", F.lit(False)) & ~doubtful})
    settled = {field: F.when(F.col("counts_verified"), sum((F.col(f"n_{c}") * w for c, w in weights.items()), F.lit(0))).otherwise(F.col(field))
               for field, weights in derived.items()}
    return rows.withColumns({f: c.cast("bigint") for f, c in settled.items()})


def merge_overlapping(reported: DataFrame, derived: DataFrame, limits: Sequence[tuple[str, str]], fields: Sequence[str] = FIELDS) -> DataFrame:
    """Reported and derived totals without counting a member twice.

    Verified ids meet their derived row: reported fields come first and derived
    ones only fill gaps, unless any shared field disagrees.  Unresolved ids cannot
    be matched, so per group and side a field they report outranks the derived
    one (``use_<field>`` on the rows that remain derived).
    """
    keys = ["group_id", "member_id"]
    known = reported.where("verified")
    slim = derived.select(*keys, *[F.col(f).alias(f"d_{f}") for f in fields], F.lit(True).alias("__d"))
    matched = known.join(slim, keys, "left")
    agrees = F.lit(True)
    for f in fields:
        agrees = agrees & F.coalesce(F.col(f) == F.col(f"d_{f}"), F.lit(True))
    fill = F.col("__d").isNotNull() & agrees
    merged = matched.withColumns({f: F.when(fill, F.coalesce(F.col(f), F.col(f"d_{f}"))).otherwise(F.col(f)) for f in fields})
    always = [F.lit(True).alias(f"use_{f}") for f in fields]
    shared = ["group_id", "side_id", "member_id"]
    from_known = merged.select(*shared, *fields, F.when(F.col("__d").isNull(), "reported").otherwise("merged").alias("origin"), *always)
    unresolved = reported.where("NOT verified")
    from_unresolved = unresolved.select(*shared, *fields, F.lit("unresolved").alias("origin"), *always)

    rest = derived.join(known.select(*keys), keys, "left_anti")
    slot = ["group_id", "side_id"]
    first = unresolved.groupBy(*slot).agg(*[F.sum(f).alias(f"p_{f}") for f in fields], *[F.count(f).alias(f"pn_{f}") for f in fields])
    second = rest.groupBy(*slot).agg(*[F.sum(f).alias(f"s_{f}") for f in fields], *[F.count(f).alias(f"sn_{f}") for f in fields])
    both = second.join(first, slot, "left")
    free = {f: F.coalesce(F.col(f"pn_{f}"), F.lit(0)) == 0 for f in fields}
    total = {f: F.when(~free[f], F.col(f"p_{f}")).when(F.col(f"sn_{f}") > 0, F.col(f"s_{f}")) for f in fields}
    use = dict(free)
    for small, large in limits:
        broken = F.coalesce(total[small] > total[large], F.lit(False))
        for f in (small, large):
            use[f] = use[f] & ~(broken & free[f])
    masks = both.select(*slot, *[u.alias(f"use_{f}") for f, u in use.items()])
    from_rest = rest.join(masks, slot).select(*shared, *fields, F.lit("derived").alias("origin"), *[f"use_{f}" for f in fields])
    return from_known.unionByName(from_unresolved).unionByName(from_rest)


def label_targets(reported: DataFrame, derived: DataFrame, classes: Sequence[str], fields: Sequence[str] = FIELDS) -> DataFrame:
    """Derived rows with ``use_counts`` and ``use_<field>``: off where a preferred reported row has the target.

    Preferred are the same member's rows and all unresolved rows of the group and side.
    """
    total = sum((F.coalesce(F.col(f"n_{c}"), F.lit(0)) for c in classes), F.lit(0))
    has = {"counts": F.coalesce(F.col("counts_verified"), F.lit(False)) & (total > 0), **{f: F.col(f).isNotNull() & (F.col(f) >= 0) for f in fields}}

    def present(rows: DataFrame, by: Sequence[str], tag: str) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.bool_or(c).alias(f"{tag}_{n}") for n, c in has.items()])

    own = present(reported.where("verified"), ["group_id", "member_id"], "own")
    open_rows = present(reported.where("NOT verified"), ["group_id", "side_id"], "open")
    joined = derived.join(own, ["group_id", "member_id"], "left").join(open_rows, ["group_id", "side_id"], "left")
    use = [(~F.coalesce(F.col(f"own_{n}"), F.lit(False)) & ~F.coalesce(F.col(f"open_{n}"), F.lit(False))).alias(f"use_{n}") for n in has]
    return joined.select("group_id", "side_id", "member_id", *use)


# --- query tables ---------------------------------------------------------------------------

def match_queries(games: DataFrame) -> DataFrame:
    target = F.when(F.col("home_score") > F.col("away_score"), 2).when(F.col("home_score") == F.col("away_score"), 1).otherwise(0)
    return games.select(F.col("group_id").cast("string").alias("query_id"), "day", "group_id", "home_id", "away_id", target.alias("target"), "home_score", "away_score")


def member_success_queries(reported: DataFrame, derived: DataFrame) -> DataFrame:
    """Successes per group and member with known or lower-bound opportunities.

    A usable reported row replaces the derived row of the same member; an unresolved
    one also replaces all other derived rows of its group and side.
    """
    exact = F.col("opportunities") >= 1
    bound = F.col("attempts") >= 1
    usable = reported.where(F.coalesce(F.col("successes_verified"), F.lit(True)) & (F.col("successes") >= 0) & (F.coalesce(exact, F.lit(False)) | F.coalesce(bound, F.lit(False))))
    from_reported = usable.select(
        "group_id", "day", "member_id", "side_id", "other_side_id", F.when(exact, F.col("opportunities")).alias("opportunities"),
        F.when(exact, F.col("opportunities")).otherwise(F.col("attempts")).alias("minimum"), "successes", F.lit("reported").alias("origin"))
    open_sides = usable.where("NOT verified").select("group_id", "side_id").distinct()
    rest = derived.join(usable.select("group_id", "member_id"), ["group_id", "member_id"], "left_anti").join(open_sides, ["group_id", "side_id"], "left_anti")
    from_derived = rest.select("group_id", "day", "member_id", "side_id", "other_side_id", "opportunities", F.col("opportunities").alias("minimum"), "successes", F.lit("derived").alias("origin"))
    both = from_reported.unionByName(from_derived)
    return both.withColumn("query_id", F.concat_ws("|", "group_id", "member_id"))


def fact_queries(facts: DataFrame, classes: Sequence[str], context: Mapping[str, Column], complete: Column, scores: Mapping[str, Column]) -> DataFrame:
    """Facts whose outcome is one of ``classes``, with context; scores are masked when the transition is incomplete."""
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("outcome")).cast("int") - 1
    masked = {}
    for name, score in scores.items():
        value = F.when(complete, score)
        masked[name] = F.coalesce(value, F.lit(0)) / 10
        masked[f"{name}_missing"] = value.isNull().cast("int")
    rows = facts.withColumns({"target": index, **dict(context), **masked}).where("target >= 0")
    return rows.select(F.col("fact_id").alias("query_id"), "day", "group_id", "member_id", "counterpart_id", "target", *context, *masked)


def count_queries(rows: DataFrame, classes: Sequence[str], enabled: Column) -> DataFrame:
    """Class totals of rows with verified counts."""
    total = sum((F.col(f"n_{c}") for c in classes[1:]), F.col(f"n_{classes[0]}"))
    return rows.where(F.col("counts_verified") & enabled & (total > 0)).select(
        "group_id", "day", "member_id", "side_id", "other_side_id", *[f"n_{c}" for c in classes])


def masked_count_queries(rows: DataFrame, fields: Sequence[str], allowed: Mapping[str, Column]) -> DataFrame:
    """Observed and allowed fields of each row; rows without any are left out."""
    kept = {f: allowed.get(f, F.lit(True)) & F.col(f).isNotNull() & (F.col(f) >= 0) for f in fields}
    some = F.lit(False)
    for condition in kept.values():
        some = some | F.coalesce(condition, F.lit(False))
    return rows.where(some).select("group_id", "day", "member_id", "side_id", "other_side_id", *[F.when(c, F.col(f)).alias(f) for f, c in kept.items()])


# --- audits of labels -----------------------------------------------------------------------

def label_audit(raw: DataFrame, usable: DataFrame, keys: Sequence[str], classes: Sequence[str], fields: Sequence[str] = FIELDS) -> DataFrame:
    """Usable targets and the reasons for missing ones, as ``(item, rows)``; ``raw`` holds the values before repair."""
    total = sum((F.coalesce(F.col(f"n_{c}"), F.lit(0)) for c in classes), F.lit(0))
    counted = F.coalesce(F.col("counts_verified"), F.lit(False)) & (total > 0)
    hits = F.coalesce(F.col("successes_verified"), F.lit(True)) & F.coalesce(F.col("successes") >= 0, F.lit(False))
    exact, bound = F.coalesce(F.col("opportunities") >= 1, F.lit(False)), F.coalesce(F.col("attempts") >= 1, F.lit(False))
    before = raw.select(*keys, *[F.col(f).alias(f"raw_{f}") for f in fields])
    joined = usable.join(before, list(keys))
    items = [F.lit("rows"), F.when(counted, F.lit("count_queries")).otherwise(F.lit("missing:unverified_or_zero_counts")),
             F.when(~hits, F.lit("missing:successes")).when(exact, F.lit("success_known")).when(bound, F.lit("success_lower_bound")).otherwise(F.lit("missing:no_appearance"))]
    items += [F.when(F.col(f).isNull(), F.lit(f"missing:{f}")) for f in fields]
    items += [F.when(F.col(f"raw_{f}").isNotNull() & F.col(f).isNull(), F.lit(f"unusable:{f}")) for f in fields]
    return joined.select(F.explode(F.array_compact(F.array(*items))).alias("item")).groupBy("item").agg(F.count("*").alias("rows"))


def identity_audit(rows: DataFrame, cohort: str = "cohort_id", status: str = "status") -> DataFrame:
    """Rows per identity kind, and named cohorts that occur twice in one group."""
    open_row = ~F.col("verified")
    kinds = rows.agg(
        F.count_if("verified").alias("verified_rows"), F.count_if(open_row).alias("source_rows"),
        F.count_if(open_row & (F.col(status) == "named_cohort")).alias("cohort_rows"), F.count_if(open_row & (F.col(status) != "named_cohort")).alias("fallback_rows"))
    named = rows.where(open_row & (F.col(status) == "named_cohort")).groupBy("group_id", cohort).agg(F.count("*").alias("n"))
    clashes = named.agg(F.count_if(F.col("n") > 1).alias("colliding_cohorts"))
    return kinds.crossJoin(F.broadcast(clashes))  # two one-row aggregates


def target_coverage(queries: Mapping[str, DataFrame]) -> DataFrame:
    """Targets per task for every day, season and overall in one roll-up."""
    union = None
    for task, df in queries.items():
        rows = df.select(F.lit(task).alias("task"), "day")
        union = rows if union is None else union.unionByName(rows)
    daily = union.groupBy(F.year("day").alias("season"), "day").agg(*[F.count_if(F.col("task") == t).alias(t) for t in queries])
    return daily.rollup("season", "day").agg(*[F.sum(t).alias(t) for t in queries])
