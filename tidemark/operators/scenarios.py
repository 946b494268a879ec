"""Summaries of scenario tables and scores of selections made against them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.digests import framed
from tidemark.operators.history import band_lookup
from tidemark.plans.ordered import numbered, top_k
from tidemark.session import cut_lineage


def outcome_summary(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Win, tie and loss shares and expected scores over sampled results (home_score, away_score)."""
    home, away = F.col("home_score"), F.col("away_score")
    return samples.groupBy(*by).agg(
        F.count("*").alias("samples"), F.avg((home > away).cast("double")).alias("home_win"), F.avg((home < away).cast("double")).alias("away_win"),
        F.avg((home == away).cast("double")).alias("tie"), F.avg(home).alias("expected_home"), F.avg(away).alias("expected_away"))


def _sizes(scenarios: DataFrame, group: str, scenario: str) -> DataFrame:
    return scenarios.select(group, scenario).distinct().groupBy(group).agg(F.count("*").alias("__scenarios"))


def member_summary(scenarios: DataFrame, group: str = "group_id", scenario: str = "scenario_id", member: str = "member_id", hits: str = "hits") -> DataFrame:
    """Expected hits and chance of at least one per member; a member absent from a scenario has none there."""
    per_member = scenarios.groupBy(group, member).agg(F.sum(hits).alias("__hits"), F.count_if(F.col(hits) >= 1).alias("__ones"))
    joined = per_member.join(_sizes(scenarios, group, scenario), group)
    return joined.select(group, member, (F.col("__hits") / F.col("__scenarios")).alias("expected_hits"), (F.col("__ones") / F.col("__scenarios")).alias("any_hit"))


def joint_success(scenarios: DataFrame, sets: DataFrame, group: str = "group_id", scenario: str = "scenario_id", member: str = "member_id", hits: str = "hits") -> DataFrame:
    """Chance that all members of a set succeed together (``sets``: set_id, group, member); an empty set always does."""
    sizes = sets.groupBy("set_id", group).agg(F.count(member).alias("__size"))
    met = scenarios.where(F.col(hits) >= 1).join(sets.where(F.col(member).isNotNull()), [group, member])
    per_scenario = met.groupBy("set_id", group, scenario).agg(F.count("*").alias("__met"))
    good = per_scenario.join(sizes, ["set_id", group]).where(F.col("__met") == F.col("__size")).groupBy("set_id", group).agg(F.count("*").alias("__good"))
    joined = sizes.join(_sizes(scenarios, group, scenario), group).join(good, ["set_id", group], "left")
    chance = F.when(F.col("__size") == 0, 1.0).otherwise(F.coalesce("__good", F.lit(0)) / F.col("__scenarios"))
    return joined.select("set_id", group, chance.alias("joint_success"))


def combine_scenarios(scenarios: DataFrame, draws: int, seed: int, bucket: Column, group: str = "group_id", scenario: str = "scenario_id",
                      member: str = "member_id", hits: str = "hits") -> DataFrame:
    """Draw one scenario per group and draw, independently between groups, and add up the members' hits.

    The pick is a digest of seed, draw and group, so it does not depend on how the data is laid out.
    ``bucket`` grows with the scenario id and spreads the numbering of a large group.
    """
    listed = scenarios.select(group, scenario).distinct()
    placed = numbered(listed, [group], [scenario], bucket, "__position")
    sizes = placed.groupBy(group).agg(F.max("__position").alias("__n"))
    rolls = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    digest = F.sha2(framed([F.lit(seed), F.col("draw"), F.col(group)]), 256)
    roll = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % F.col("__n") + 1
    picked = rolls.withColumn("__position", roll).join(placed, [group, "__position"])
    rows = picked.select("draw", group, scenario).join(scenarios, [group, scenario])
    return rows.groupBy("draw", member).agg(F.sum(hits).alias(hits)).withColumn("weight", F.lit(1.0 / draws))


def hit_points(hits: Column, table: Sequence[float], extra: float) -> Column:
    """Points of a hit count: table first, then ``extra`` for every hit beyond it."""
    top = len(table) - 1
    beyond = F.lit(float(table[-1])) + (hits - top) * F.lit(float(extra))
    return F.when(hits <= top, F.element_at(F.lit([float(x) for x in table]), (F.least(hits, F.lit(top)) + 1).cast("int"))).otherwise(beyond)


def member_multipliers(candidates: DataFrame, bands: DataFrame, *, owned_bonus: float, side_bonus: float, selected_side: Any = None) -> DataFrame:
    """Band multiplier of the selection rate plus bonuses (``candidates``: position, rate, owned, side_id)."""
    rows = band_lookup(candidates, bands, "rate", ["position"])
    bonus = F.when(F.col("owned"), F.lit(float(owned_bonus))).otherwise(0.0)
    if selected_side is not None:
        bonus = bonus + F.when(F.col("side_id") == F.lit(selected_side), F.lit(float(side_bonus))).otherwise(0.0)
    return rows.withColumn("multiplier", F.col("multiplier") + bonus)


CHUNK = 256  # scenarios that travel together


def _chunk_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums per (selection, chunk) over rows sorted by both: multiplier, slots and the chunk's entries of a member."""
    now, out = None, []
    weight, gain, met = (np.zeros(CHUNK) for _ in range(3))

    def close() -> None:
        seen = weight > 0
        w, g = weight[seen], gain[seen]
        out.append((now[0], float(w.sum()), float((w * g).sum()), float((w * g * g).sum()), float(w[met[seen] == now[2]].sum())))

    def ready() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, pa.float64()) for c in columns[1:]]],
                                          names=["selection_id", "seen", "m1", "m2", "all_hit"])

    kind = pa.null()
    for batch in batches:
        kind = batch.schema.field(0).type
        names, chunks, multipliers, slots = (batch.column(k).to_pylist() for k in range(4))
        entries = batch.column(4)
        ends = entries.offsets.to_numpy() - entries.offsets[0].as_py()
        place, w, g, hit = (c.to_numpy(zero_copy_only=False) for c in entries.flatten().flatten())
        for at, (name, chunk, multiplier, size) in enumerate(zip(names, chunks, multipliers, slots)):
            if now is None or now[:2] != (name, chunk):
                if now is not None:
                    close()
                now = (name, chunk, size)
                for vector in (weight, gain, met):
                    vector[:] = 0.0
            own = slice(ends[at], ends[at + 1])
            weight[place[own]] = w[own]
            np.add.at(gain, place[own], multiplier * g[own])
            np.add.at(met, place[own], hit[own])
        yield ready()
        out.clear()
    if now is not None:
        close()
        yield ready()


def score_selections(selections: DataFrame, scenarios: DataFrame, weights: DataFrame, table: Sequence[float], extra: float, *,
                     risk_aversion: float = 0.0, all_hit_utility: float = 0.0, hits: str = "hits") -> DataFrame:
    """Weighted mean, variance, chance that all succeed, and utility per selection.

    ``selections``: selection_id, slot, member_id, multiplier; ``scenarios``: scenario_id, member_id, hits;
    ``weights``: scenario_id, weight.  A member's scenarios are kept in chunks of ``CHUNK``: one row per member
    and chunk holds the points above none, so a selection meets a chunk's scenarios as vectors, not as rows.
    Scenarios in which no selected member appears all score the same base value; they enter as the left-over
    weight.
    """
    zero = float(table[0])
    total = weights.agg(F.sum("weight").alias("__all"))
    share = weights.crossJoin(F.broadcast(total)).select("scenario_id", (F.col("weight") / F.col("__all")).alias("__w"))  # one-row total
    slot = F.pmod(F.xxhash64("scenario_id"), F.lit(4096))
    placed = numbered(share.where("__w > 0").withColumns({"__one": F.lit(1), "__slot": slot}), ["__one"], ["__slot", "scenario_id"], F.col("__slot"), "__at")
    placed = cut_lineage(placed.select("scenario_id", F.floor((F.col("__at") - 1) / CHUNK).cast("int").alias("__chunk"), ((F.col("__at") - 1) % CHUNK).cast("int").alias("__place"), "__w"))
    entry = F.struct(F.col("__place").alias("place"), F.col("__w").alias("w"), (hit_points(F.col(hits), table, extra) - F.lit(zero)).cast("double").alias("g"),
                     (F.col(hits) >= 1).cast("double").alias("hit"))
    vectors = scenarios.join(placed, "scenario_id").groupBy("member_id", "__chunk").agg(F.collect_list(entry).alias("entries"))  # a chunk's scenarios at most
    base = selections.groupBy("selection_id").agg(F.count("*").alias("__slots"), F.sum(F.col("multiplier") * zero).alias("__base"))
    met = selections.join(vectors, "member_id").join(base, "selection_id").select(
        "selection_id", "__chunk", F.col("multiplier").cast("double").alias("multiplier"), "__slots", "entries")
    dealt = met.repartition("selection_id", "__chunk").sortWithinPartitions("selection_id", "__chunk")
    kind = selections.schema["selection_id"].dataType.simpleString()
    parts = dealt.mapInArrow(_chunk_sums, f"selection_id {kind}, seen double, m1 double, m2 double, all_hit double")
    sums = parts.groupBy("selection_id").agg(*[F.sum(c).alias(f"__{c}") for c in ("seen", "m1", "m2", "all_hit")])
    joined = base.join(sums, "selection_id", "left").na.fill(0.0, ["__seen", "__m1", "__m2", "__all_hit"])
    # Over all scenarios, those without a selected member included, a value is the base and the gain.
    b = F.col("__base")
    mean = b + F.col("__m1")
    variance = F.greatest(F.col("__m2") - F.col("__m1") * F.col("__m1"), F.lit(0.0))
    scored = joined.select("selection_id", mean.alias("expected_points"), variance.alias("variance"), F.col("__all_hit").alias("all_hit_probability"))
    return scored.withColumn("utility", F.col("expected_points") - risk_aversion * F.col("variance") + all_hit_utility * F.col("all_hit_probability"))


def _picked(rows: DataFrame, bonus: float, risk_aversion: float) -> DataFrame:
    """Mean, variance and utility of picks from their running sums."""
    second = F.col("s1") * F.col("s1") - F.col("s2") + F.col("s3") + 2.0 * bonus * F.col("all") * F.col("rewards") + bonus * bonus * F.col("all")
    rows = rows.withColumn("expected_points", F.col("s1") + bonus * F.col("all"))
    rows = rows.withColumn("variance", F.greatest(second - F.col("expected_points") * F.col("expected_points"), F.lit(0.0)))
    return rows.withColumn("utility", F.col("expected_points") - risk_aversion * F.col("variance"))


def best_picks(options: DataFrame, k: int = 1, *, bonus: float = 0.0, risk_aversion: float = 0.0, minimum_probability: float = 0.0) -> DataFrame:
    """Best ``k`` ways to pick one option per market of each slate, exact, by branch and bound over rows.

    ``options``: slate_id, market, option_id, probability, reward.  Markets without two options or without
    probability are left out.  A prefix of markets is a row with its running sums (markets are independent, so
    they give mean and variance).  What the other markets can add at most bounds it from above; finishing it
    with the option of most value per market gives a pick that exists.  Per step the prefixes below the slate's
    ``k``-th such pick, or too improbable for ``minimum_probability``, are dropped: combinations never sit in one
    row, and only those that can still be among the best are listed.  Ties go to the larger mean, the larger
    chance of all, and the later option ids.
    """
    lam, sign = risk_aversion, 1.0 if bonus >= 0 else -1.0
    totals = options.groupBy("slate_id", "market").agg(F.sum("probability").alias("__total"), F.count("*").alias("__options"))
    usable = options.join(totals.where("__options >= 2 AND __total > 0"), ["slate_id", "market"])
    p, r = F.col("p"), F.col("r")
    usable = usable.select("slate_id", "market", F.col("option_id").cast("string").alias("option_id"), (F.col("probability") / F.col("__total")).alias("p"), F.col("reward").cast("double").alias("r"))
    # A pick's utility is a sum over its options (``own``) and a part that its chance scales: the bonus, less risk.
    # ``odd`` bounds what covariance can add there: rewards against the bonus's sign, or all of them if risk is sought.
    usable = usable.withColumns({"own": p * r - lam * p * (1.0 - p) * r * r, "odd": F.greatest(-sign * r, F.lit(0.0)) * (1.0 - p) if lam >= 0 else F.abs(r) * (1.0 - p)})
    one = F.struct("own", "p", "r", "option_id")
    markets = usable.groupBy("slate_id", "market").agg(F.max(one).alias("top"), F.max("p").alias("most"), F.max("odd").alias("odd"))
    numbers = Window.partitionBy("slate_id").orderBy("market")  # markets of one slate, not its options
    rest = Window.partitionBy("slate_id").orderBy(F.col("market").desc()).rowsBetween(Window.unboundedPreceding, -1)
    t = {c: F.col(f"top.{c}") for c in ("own", "p", "r", "option_id")}

    def product(column: Column) -> Column:
        return F.aggregate(F.collect_list(column).over(rest), F.lit(1.0), lambda a, x: a * x)

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column).over(rest), F.lit(0.0))

    markets = markets.select(
        "slate_id", "market", F.row_number().over(numbers).alias("step"), F.max("market").over(Window.partitionBy("slate_id")).alias("__end"), total(t["own"]).alias("t_own"),
        total(F.col("odd")).alias("t_odd"), product(F.col("most")).alias("t_most"), product(t["p"]).alias("t_all"), total(t["p"] * t["r"]).alias("t_s1"),
        total(t["p"] * t["r"] * t["p"] * t["r"]).alias("t_s2"), total(t["p"] * t["r"] * t["r"]).alias("t_s3"), total(t["r"]).alias("t_rewards"))
    markets = cut_lineage(markets.withColumn("is_last", F.col("market") == F.col("__end")).drop("__end"))
    choices = cut_lineage(usable.join(markets, ["slate_id", "market"]))
    steps = markets.agg(F.max("step")).first()[0] or 0
    none = {"picks": F.array().cast("array<string>"), "all": F.lit(1.0), **{c: F.lit(0.0) for c in ("hits", "s1", "s2", "s3", "rewards", "own_sum", "odd_sum")}}
    open_, finished = markets.where("step = 1").select("slate_id", *[c.alias(n) for n, c in none.items()]), None
    for step in range(1, steps + 1):
        grown = open_.join(choices.where(F.col("step") == step), "slate_id")
        pr = p * r
        grown = grown.select(
            "slate_id", F.concat("picks", F.array("option_id")).alias("picks"), (F.col("all") * p).alias("all"), (F.col("hits") + p).alias("hits"), (F.col("s1") + pr).alias("s1"),
            (F.col("s2") + pr * pr).alias("s2"), (F.col("s3") + pr * r).alias("s3"), (F.col("rewards") + r).alias("rewards"), (F.col("own_sum") + F.col("own")).alias("own_sum"),
            (F.col("odd_sum") + F.col("odd")).alias("odd_sum"), "is_last", *[c for c in markets.columns if c.startswith("t_")])
        grown = cut_lineage(grown.where(F.col("all") * F.col("t_most") >= minimum_probability * (1.0 - 1e-12)))
        chance, odd = F.col("all") * F.col("t_most"), F.col("odd_sum") + F.col("t_odd")
        slack = max(bonus, 0.0) * chance + 2.0 * abs(lam) * abs(bonus) * chance * odd + max(-lam, 0.0) * bonus * bonus * chance
        # Finished with the options of most value: a pick of its own for every prefix.
        done = grown.select(
            "slate_id", (F.col("all") * F.col("t_all")).alias("all"), *[(F.col(c) + F.col(f"t_{c}")).alias(c) for c in ("s1", "s2", "s3", "rewards")])
        done = _picked(done.where(F.col("all") >= minimum_probability), bonus, risk_aversion)
        marks = top_k(done.select("slate_id", "utility"), ["slate_id"], [F.col("utility").desc()], k)
        marks = marks.groupBy("slate_id").agg(F.count("*").alias("__n"), F.min("utility").alias("__mark")).where(F.col("__n") == k).drop("__n")
        bound = F.col("own_sum") + F.col("t_own") + slack
        near = bound >= F.col("__mark") - 1e-9 * (1.0 + F.abs("__mark"))
        kept = grown.join(marks, "slate_id", "left").where(F.col("__mark").isNull() | near | F.col("is_last"))
        sums = ["slate_id", *none]
        ended = kept.where("is_last").select(sums)
        finished = ended if finished is None else finished.unionByName(ended)
        open_ = kept.where(~F.col("is_last")).select(sums)
    if finished is None:
        finished = open_
    scored = _picked(finished.where(F.col("all") >= minimum_probability), bonus, risk_aversion)
    order = [F.col(c).desc() for c in ("utility", "expected_points", "all", "picks")]
    best = top_k(scored, ["slate_id"], order, k, "place")
    return best.select("slate_id", F.col("place").cast("int").alias("place"), "utility", "expected_points", F.col("all").alias("all_correct"), "picks", "variance",
                       F.col("hits").alias("expected_correct"))
