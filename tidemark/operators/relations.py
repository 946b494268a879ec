"""Daily temporal relation tables: edges and nodes over the facts live on each day."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clocks import local_day, local_midnight
from tidemark.operators.ingest import unpivot_sides
from tidemark.plans.intervals import days_of, first_midnight_at_or_after
from tidemark.plans.segments import day_totals, segment_days, state_segments
from tidemark.session import stored

FACT_VALUES = ("facts", "attempts", "successes", "units", "walks", "strikes", "fours")
SIDE_VALUES = ("games", "wins", "draws", "scored", "allowed", "diff", "home")
DAY_SECONDS = 86400.0


@dataclass(frozen=True)
class Route:
    """A relation type: which columns of a fact it links, and what kind of node they name."""

    name: str
    source: str
    destination: str
    source_type: str
    destination_type: str
    bidirectional: bool = True
    count_scale: int = 100


def fact_values(outcomes: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """The summed values of a fact; ``outcomes`` lists the codes behind ``walks`` and ``strikes``."""
    success = F.col("is_success")
    return {
        "facts": F.lit(1.0), "attempts": F.col("is_opportunity").cast("double"), "successes": success.cast("double"),
        "units": F.col("units").cast("double"), "walks": F.col("outcome").isin(list(outcomes["walks"])).cast("double"),
        "strikes": F.col("outcome").isin(list(outcomes["strikes"])).cast("double"),
        "fours": (success & (F.col("units") == 4)).cast("double")}


def live_intervals(df: DataFrame, window_days: int | None, tz: str = "UTC") -> DataFrame:
    """Days on which a row is past, published and inside the window (for rows without corrections).

    Corrected facts go through ``history.competition_intervals`` instead, which adds the same columns.
    """
    event_day = local_day(F.col("event_at"), tz)
    start = F.greatest(first_midnight_at_or_after(F.col("available_at"), tz), F.date_add(event_day, 1))
    stop = F.date_add(event_day, window_days + 1) if window_days is not None else F.lit(None).cast("date")
    return clocked(df.withColumns({"event_day": event_day, "active_from": start, "active_to": stop})).where(
        F.col("active_to").isNull() | (F.col("active_from") < F.col("active_to")))


def clocked(df: DataFrame) -> DataFrame:
    return df.withColumns({"event_s": F.unix_micros("event_at") / F.lit(1e6), "available_s": F.unix_micros("available_at") / F.lit(1e6)})


def _cutoff(tz: str) -> Column:
    return F.unix_micros(local_midnight(F.col("day"), tz)) / F.lit(1e6)


def _recency(window_days: int, tz: str) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - (_cutoff(tz) - F.col("event_s")) / F.lit(window_days * DAY_SECONDS))


def _log_scaled(value: Column, scale: int) -> Column:
    return F.log1p(value) / F.lit(math.log1p(scale))


def _span(first: Any, last: Any) -> tuple[Column | None, Column | None]:
    """Limits as dates; ``None`` where the intervals themselves are the limit."""
    return tuple(None if d is None else F.to_date(F.lit(str(d))) for d in (first, last))


def _within(day: str, first: Any, last: Any) -> Column:
    low, high = _span(first, last)
    return (F.lit(True) if low is None else F.col(day) >= low) & (F.lit(True) if high is None else F.col(day) <= high)


def temporal_features(df: DataFrame, cutoff: Column, event: str = "event_s", available: str = "available_s") -> DataFrame:
    """Event age and publication delay in seconds; every relation weighs one unless it says otherwise."""
    columns = {"event_age": cutoff - F.col(event), "publication_delay": F.greatest(F.lit(0.0), F.col(available) - F.col(event))}
    if "weight" not in df.columns:
        columns["weight"] = F.lit(1.0)
    return df.withColumns(columns)


def relation_segments(intervals: DataFrame, routes: Sequence[Route], values: Sequence[str] = FACT_VALUES,
                      clocks: Sequence[str] = ("event_s", "available_s")) -> DataFrame:
    """Edges as segments of days in which the live facts between two endpoints stay the same.

    The daily table holds one row per segment and day; see ``relation_edges``.  ``values`` and ``clocks`` name what
    the caller reads: the features of other values and other clocks are left out, and do not travel either.
    """
    values = ["facts", *[v for v in values if v != "facts"]]
    listed = F.explode(F.array(*[
        F.struct(F.lit(r.name).alias("route"), F.col(r.source).cast("string").alias("source"), F.col(r.destination).cast("string").alias("destination")) for r in routes]))
    rows = intervals.withColumn("__r", listed).select("active_from", "active_to", *clocks, *values, "__r.*")
    state = state_segments(rows, ["route", "source", "destination"], values, clocks, combine=False)
    n = F.col("facts")
    scale = F.element_at(F.create_map(*[x for r in routes for x in (F.lit(r.name), F.lit(math.log1p(r.count_scale)))]), F.col("route"))
    features = {"success_rate": ("successes", 1), "walk_rate": ("walks", 1), "strike_rate": ("strikes", 1), "units_rate": ("units", 4)}
    return state.select(
        "from_day", "to_day", "route", "source", "destination", "facts", (F.log1p(n) / scale).alias("count_log"),
        *[(F.col(v) / n if by == 1 else F.col(v) / n / by).alias(name) for name, (v, by) in features.items() if v in values], *clocks)


def relation_edges(intervals: DataFrame, routes: Sequence[Route], first_day: Any, last_day: Any, window_days: int,
                   tz: str = "UTC", reference_days: int | None = None) -> DataFrame:
    """One edge per day, route and endpoint pair, summed over the live facts between them."""
    days = segment_days(relation_segments(intervals, routes), *_span(first_day, last_day))
    edges = days.select(
        "day", "route", "source", "destination", "facts", *EDGE_FEATURES[:-1], _recency(reference_days or window_days, tz).alias("recency"), "event_s", "available_s")
    return temporal_features(edges, _cutoff(tz)).drop("event_s", "available_s")


def edge_totals(segments: DataFrame, by: Sequence[str], features: Sequence[str], window_days: int, tz: str = "UTC",
                first_day: Any = None, last_day: Any = None) -> DataFrame:
    """Per day and ``by``: edges, and the sums of facts, features, recency, age and delay of the daily edge table.

    The sums come from the segments; ages grow by the day, so they follow from the number of edges and the sum
    of their event clocks, and recency likewise until it reaches zero.
    """
    event, cutoff = F.col("event_s"), _cutoff(tz)
    seconds, rest = F.floor(event), F.col("event_s") - F.floor(event)  # whole seconds are summed as such
    ends = first_midnight_at_or_after(F.timestamp_seconds(event + F.lit(window_days * DAY_SECONDS)), tz)
    values = {"edges": F.lit(1), "facts": F.col("facts"), **{f: F.col(f) for f in features}, "__events": seconds, "__rest": rest,
              "publication_delay": F.greatest(F.lit(0.0), F.col("available_s") - event), "__fresh": F.lit(1), "__fresh_events": seconds, "__fresh_rest": rest}
    days = day_totals(segments, by, values, *_span(first_day, last_day), until={c: ends for c in ("__fresh", "__fresh_events", "__fresh_rest")},
                      whole=["edges", "facts", "__events", "__fresh", "__fresh_events"])
    days = days.withColumns({c: F.col(c).cast("double") for c in values})
    return days.select(
        "day", *by, F.col("edges").cast("bigint").alias("edges"), F.col("facts").cast("bigint").alias("facts"), *features,
        (F.col("__fresh") - (F.col("__fresh") * cutoff - F.col("__fresh_events") - F.col("__fresh_rest")) / F.lit(window_days * DAY_SECONDS)).alias("recency"),
        (F.col("edges") * cutoff - F.col("__events") - F.col("__rest")).alias("event_age"), "publication_delay")


EDGE_FEATURES = ("count_log", "success_rate", "walk_rate", "strike_rate", "units_rate", "recency")


def side_game_edges(games: DataFrame, first_day: Any, last_day: Any, window_days: int, tz: str = "UTC") -> DataFrame:
    """Past games between two sides, oriented home to away (``games`` with live intervals)."""
    home_won, drawn = F.col("home_score") > F.col("away_score"), F.col("home_score") == F.col("away_score")
    rows = games.withColumns({"games": F.lit(1.0), "wins": home_won.cast("double"), "draws": drawn.cast("double"),
                              "scored": F.col("home_score").cast("double"), "allowed": F.col("away_score").cast("double")})
    state = segment_days(state_segments(rows, ["home_id", "away_id"], ["games", "wins", "draws", "scored", "allowed"], ["event_s", "available_s"]), *_span(first_day, last_day))
    n = F.col("games")
    edges = state.select(
        "day", F.lit("side_game_side").alias("route"), F.col("home_id").cast("string").alias("source"), F.col("away_id").cast("string").alias("destination"),
        n.alias("facts"), _log_scaled(n, 20).alias("count_log"), (F.col("wins") / n).alias("home_win_rate"), (F.col("draws") / n).alias("draw_rate"),
        (F.col("scored") / n / 10).alias("home_scored"), (F.col("allowed") / n / 10).alias("away_scored"), _recency(window_days, tz).alias("recency"),
        "event_s", "available_s")
    return temporal_features(edges, _cutoff(tz)).drop("event_s", "available_s")


ROLE_FEATURES = ("count_log", "attempt_rate", "success_rate", "units_rate", "walk_rate", "strike_rate", "four_rate", "recency")


def entity_segments(intervals: DataFrame, roles: Mapping[str, str], queries: DataFrame, values: Sequence[str] = FACT_VALUES,
                    recency: bool = True) -> DataFrame:
    """Entities as segments of days with live history or a query, and all features of each role but recency.

    ``roles`` maps a role name to the fact column holding its entity; ``queries`` has ``(day, entity)``.  The
    last event per role is kept as ``{role}_event_s``, unless no ``recency`` is asked for.  Features of values that
    are not among ``values`` are left out.
    """
    values = ["facts", *[v for v in values if v != "facts"]]
    # A role's values go to that role's columns, and a query enters as a day without values,
    # so one pass by entity covers both roles and the entities that have no history yet.
    sums = [f"{role}_{v}" for role in roles for v in values]
    clocks = [f"{role}_event_s" for role in roles] if recency else []
    sides = []
    for role, column in roles.items():
        added = [(F.col(v) if r == role else F.lit(0.0)).alias(f"{r}_{v}") for r in roles for v in values]
        seen = [(F.col("event_s") if r == role else F.lit(None).cast("double")).alias(f"{r}_event_s") for r in roles] if recency else []
        sides.append(F.struct(F.col(column).cast("string").alias("entity"), *added, *seen))
    rows = intervals.select("active_from", "active_to", F.explode(F.array(*sides)).alias("r")).select("active_from", "active_to", "r.*")
    asked = queries.select(
        F.col("day").alias("active_from"), F.date_add("day", 1).alias("active_to"), F.col("entity").cast("string").alias("entity"),
        *[F.lit(0.0).alias(c) for c in sums], *[F.lit(None).cast("double").alias(c) for c in clocks])
    state = state_segments(rows.unionByName(asked), ["entity"], sums, clocks, combine=False)
    columns = []
    for role in roles:
        n = F.col(f"{role}_facts")
        found = {"count_log": _log_scaled(n, 500)}
        for name, source in (("attempt_rate", "attempts"), ("success_rate", "successes"), ("units_rate", "units"), ("walk_rate", "walks"), ("strike_rate", "strikes"), ("four_rate", "fours")):
            if source in values:
                found[name] = F.col(f"{role}_{source}") / n / 4 if source == "units" else F.col(f"{role}_{source}") / n
        columns += [F.when(n > 0, found[name]).otherwise(0.0).alias(f"{role}_{name}") for name in ROLE_FEATURES[:-1] if name in found]
        if recency:
            columns.append(F.when(n > 0, F.col(f"{role}_event_s")).alias(f"{role}_event_s"))
    return state.select("from_day", "to_day", "entity", *columns)


def entity_days(segments: DataFrame, roles: Sequence[str], first_day: Any, last_day: Any, window_days: int, tz: str = "UTC") -> DataFrame:
    """The daily node table of entity segments (of all, or of those wanted)."""
    days = segment_days(segments, *_span(first_day, last_day))
    recency = {f"{r}_recency": F.coalesce(F.greatest(F.lit(0.0), 1.0 - (_cutoff(tz) - F.col(f"{r}_event_s")) / F.lit(window_days * DAY_SECONDS)), F.lit(0.0)) for r in roles}
    return days.withColumns(recency).select("day", "entity", *[f"{r}_{c}" for r in roles for c in ROLE_FEATURES])


def entity_nodes(intervals: DataFrame, roles: Mapping[str, str], queries: DataFrame, first_day: Any, last_day: Any, window_days: int,
                 tz: str = "UTC") -> DataFrame:
    """All entities with live history or a query on the day, with eight features per role (zero without history)."""
    return entity_days(entity_segments(intervals, roles, queries), list(roles), first_day, last_day, window_days, tz)


def entity_totals(segments: DataFrame, roles: Sequence[str], window_days: int, tz: str = "UTC", extra: Mapping[str, Column] | None = None,
                  first_day: Any = None, last_day: Any = None) -> DataFrame:
    """Per day: entities, the sums of all features of the daily node table, and of ``extra`` columns."""
    features = [f"{r}_{c}" for r in roles for c in ROLE_FEATURES[:-1]]
    values, until = {"entities": F.lit(1), **{f: F.col(f) for f in features}, **(extra or {})}, {}
    whole = ["entities"]
    for r in roles:
        event = F.col(f"{r}_event_s")
        ends = F.when(event.isNotNull(), first_midnight_at_or_after(F.timestamp_seconds(event + F.lit(window_days * DAY_SECONDS)), tz))
        values |= {f"__{r}": event.isNotNull().cast("int"), f"__{r}_events": F.floor(event), f"__{r}_rest": event - F.floor(event)}
        until |= {f"__{r}{c}": ends for c in ("", "_events", "_rest")}
        whole += [f"__{r}", f"__{r}_events"]
    days = day_totals(segments, [], values, *_span(first_day, last_day), until=until, whole=whole)
    days = days.withColumns({c: F.col(c).cast("double") for c in values})
    fresh = {f"{r}_recency": F.col(f"__{r}") - (F.col(f"__{r}") * _cutoff(tz) - F.col(f"__{r}_events") - F.col(f"__{r}_rest")) / F.lit(window_days * DAY_SECONDS) for r in roles}
    return days.withColumns(fresh).select(
        "day", F.col("entities").cast("bigint").alias("entities"), *[f"{r}_{c}" for r in roles for c in ROLE_FEATURES], *(extra or {}))


SIDE_FEATURES = ("games_log", "win_rate", "draw_rate", "scored_rate", "allowed_rate", "diff_rate", "home_rate", "recency")


def side_nodes(games: DataFrame, first_day: Any, last_day: Any, window_days: int, tz: str = "UTC") -> DataFrame:
    """Eight features of every side with live games on the day."""
    carried = ["event_day", "active_from", "active_to", "event_s"]
    sides = unpivot_sides(games, carried)
    rows = sides.withColumns({
        "games": F.lit(1.0), "wins": (F.col("result") == "win").cast("double"), "draws": (F.col("result") == "draw").cast("double"),
        "diff": (F.col("scored") - F.col("allowed")).cast("double"), "scored": F.col("scored").cast("double"), "allowed": F.col("allowed").cast("double"),
        "home": F.col("is_home").cast("double")})
    state = segment_days(state_segments(rows, ["side_id"], SIDE_VALUES, ["event_s"]), *_span(first_day, last_day))
    n = F.col("games")
    return state.select(
        "day", "side_id", _log_scaled(n, 90).alias("games_log"), (F.col("wins") / n).alias("win_rate"), (F.col("draws") / n).alias("draw_rate"),
        (F.col("scored") / n / 10).alias("scored_rate"), (F.col("allowed") / n / 10).alias("allowed_rate"), (F.col("diff") / n / 10).alias("diff_rate"),
        (F.col("home") / n).alias("home_rate"), _recency(window_days, tz).alias("recency"))


def observed_fields(intervals: DataFrame, keys: Sequence[str], fields: Sequence[str], first_day: Any, last_day: Any, window_days: int,
                    tz: str = "UTC", queries: DataFrame | None = None) -> DataFrame:
    """Per key and day: log-scaled sum of each field and of how often it was observed, plus recency.

    A field never observed has count zero; its sum is not an observed zero.  ``queries`` (``day`` and the keys) limits
    the rows to the days it names for a key: each enters as a day without values, so no other day is listed.
    """
    seen = {f"seen_{f}": F.col(f).isNotNull().cast("double") for f in fields}
    rows = intervals.withColumns({**{f: F.col(f).cast("double") for f in fields}, **seen})
    any_seen = F.lit(False)
    for f in fields:
        any_seen = any_seen | F.col(f).isNotNull()
    rows, values = rows.where(any_seen), [*fields, *seen]
    if queries is None:
        state = segment_days(state_segments(rows, keys, values, ["event_s"]), *_span(first_day, last_day))
    else:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        asked = queries.select("day", *keys).distinct().where(_within("day", first_day, last_day))
        asked = asked.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], F.col("day").alias("active_from"), F.date_add("day", 1).alias("active_to"),
                             *[F.lit(None).cast("double").alias(c) for c in (*values, "event_s")], F.lit(1).alias("__asked"), F.lit(0).alias("__live"))
        rows = rows.select(*keys, "active_from", "active_to", *values, "event_s", F.lit(0).alias("__asked"), F.lit(1).alias("__live"))
        state = state_segments(rows.unionByName(asked), keys, [*values, "__asked", "__live"], ["event_s"])
        state = state.where("__asked > 0 AND __live > 0").withColumn("day", F.col("from_day"))
    scaled = [_log_scaled(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), 500).alias(c) for c in (*fields, *seen)]
    return state.select("day", *keys, F.struct(*scaled, _recency(window_days, tz).alias("recency")).alias("observed"))


def with_fallback(queries: DataFrame, sources: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """First history found along a chain (entity, cohort, side): ``sources`` are ``(label, states, join columns)``.

    Every step is stored; only rows that have found no history yet go on to the next source.
    """
    found, rest = [], queries
    for label, states, on in sources:
        joined = stored(rest.join(states.hint("merge"), ["day", *on], "left").select(*queries.columns, "observed"), label)
        found.append(joined.where("observed IS NOT NULL").withColumn("origin", F.lit(label)))
        rest = joined.where("observed IS NULL").select(*queries.columns)
    found.append(joined.where("observed IS NULL").withColumn("origin", F.lit(None).cast("string")))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def game_nodes(games: DataFrame, first_day: Any, last_day: Any, reference_days: int, scheduled: str = "scheduled_at", tz: str = "UTC") -> DataFrame:
    """Past games live on the day and the day's own games; a current game carries no outcome."""
    local = F.from_utc_timestamp(F.col(scheduled), tz)
    fraction = (F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)) / F.lit(DAY_SECONDS)
    rows = games.withColumn("start_fraction", F.coalesce(fraction, F.lit(0.0)))
    past = days_of(rows, "active_from", "active_to", *_span(first_day, last_day))
    age = F.greatest(F.lit(0.0), _cutoff(tz) - F.col("event_s")) / F.lit(DAY_SECONDS)
    past = past.select("day", "group_id", F.lit(0.0).alias("is_current"), F.lit(1.0).alias("is_historical"),
                       F.least(age / F.lit(float(reference_days)), F.lit(1.0)).alias("age"), "start_fraction")
    current = rows.where(_within("event_day", first_day, last_day)).select(
        F.col("event_day").alias("day"), "group_id", F.lit(1.0).alias("is_current"), F.lit(0.0).alias("is_historical"), F.lit(0.0).alias("age"), "start_fraction")
    return past.unionByName(current)


def side_group_edges(games: DataFrame, first_day: Any, last_day: Any, tz: str = "UTC") -> DataFrame:
    """Both sides of every past and current game with the flags current, home, away, historical."""
    past = days_of(games, "active_from", "active_to", *_span(first_day, last_day)).withColumn("is_current", F.lit(0.0))
    current = games.where(_within("event_day", first_day, last_day)).withColumns({"day": F.col("event_day"), "is_current": F.lit(1.0)})
    rows = past.unionByName(current, allowMissingColumns=True)
    sides = F.explode(F.array(F.struct(F.col("home_id").alias("source"), F.lit(1.0).alias("is_home")),
                              F.struct(F.col("away_id").alias("source"), F.lit(0.0).alias("is_home"))))
    rows = rows.select("day", "group_id", "is_current", "event_s", "available_s", sides.alias("s")).select("*", "s.*").drop("s")
    now = F.col("is_current") == 1.0
    timed = temporal_features(rows, _cutoff(tz))
    return timed.select(
        "day", F.lit("side_group").alias("route"), F.col("source").cast("string").alias("source"), F.col("group_id").cast("string").alias("destination"),
        "is_current", "is_home", (1.0 - F.col("is_home")).alias("is_away"), (1.0 - F.col("is_current")).alias("is_historical"),
        F.when(now, 0.0).otherwise(F.col("event_age")).alias("event_age"), F.when(now, 0.0).otherwise(F.col("publication_delay")).alias("publication_delay"), "weight")


def side_group_totals(games: DataFrame, tz: str = "UTC", first_day: Any = None, last_day: Any = None) -> DataFrame:
    """``side_group_edges`` added up by day, side and flags: edges, group ids, ages and delays.

    A past game enters and leaves running sums, so no game is listed by its days; event clocks are whole seconds.
    """
    ends = F.explode(F.array(F.struct(F.col("home_id").alias("source"), F.lit(1.0).alias("is_home")),
                             F.struct(F.col("away_id").alias("source"), F.lit(0.0).alias("is_home"))))
    rows = games.withColumn("s", ends).select("group_id", "event_day", "active_from", "active_to", "event_s", "available_s", "s.*")
    delay = F.greatest(F.lit(0.0), F.col("available_s") - F.col("event_s"))
    values = {"edges": F.lit(1), "destinations": F.col("group_id"), "__events": F.floor("event_s"), "__rest": F.col("event_s") - F.floor("event_s"), "publication_delay": delay}
    by = ["source", "is_home"]
    past = day_totals(rows.withColumnsRenamed({"active_from": "from_day", "active_to": "to_day"}), by, values, *_span(first_day, last_day),
                      whole=["edges", "destinations", "__events"])
    past = past.select("day", *by, F.lit(0.0).alias("is_current"), "edges", "destinations",
                       (F.col("edges") * _cutoff(tz) - F.col("__events") - F.col("__rest")).alias("event_age"), "publication_delay")
    current = rows.where(_within("event_day", first_day, last_day)).groupBy(F.col("event_day").alias("day"), *by).agg(
        F.lit(1.0).alias("is_current"), F.count("*").alias("edges"), F.sum(F.col("group_id").cast("bigint")).alias("destinations"),
        F.lit(0.0).alias("event_age"), F.lit(0.0).alias("publication_delay"))
    return past.unionByName(current).select(
        "day", F.col("source").cast("string").alias("source"), "is_current", "is_home", (1.0 - F.col("is_home")).alias("is_away"),
        (1.0 - F.col("is_current")).alias("is_historical"), "edges", "destinations", "event_age", "publication_delay")


def fact_segments(intervals: DataFrame, source: str, destination: str, context: Mapping[str, Column]) -> DataFrame:
    """Parallel fact edges as one row each: the days from entry on, without an end where history is never left.

    ``segments.write_segments`` stores them by the days they enter and leave, ``fact_edges`` reads a day.
    """
    rows = intervals.withColumns(dict(context))
    return rows.select(
        F.col("active_from").alias("from_day"), F.col("active_to").alias("to_day"), F.lit("fact").alias("route"), F.col(source).cast("string").alias("source"),
        F.col(destination).cast("string").alias("destination"), "fact_id", *[F.col(v) if v != "units" else (F.col("units") / 4).alias("units") for v in FACT_VALUES],
        *context, "event_s", "available_s")


def fact_edges(rows: DataFrame, context: Sequence[str], tz: str = "UTC") -> DataFrame:
    """The edge table of the days of ``rows``: fact segments with a ``day`` inside them."""
    timed = temporal_features(rows, _cutoff(tz))
    return timed.select("day", "route", "source", "destination", "fact_id", *FACT_VALUES, *context, "event_age", "publication_delay", "weight")


def fact_totals(segments: DataFrame, context: Sequence[str], last_day: Column | None = None, tz: str = "UTC") -> DataFrame:
    """Per day: number of fact edges and the sums of their values, ages and delays, however long the history is."""
    values = {"edges": F.lit(1), **{c: F.col(c) for c in (*FACT_VALUES, *context)}, "__events": F.floor("event_s"),
              "__rest": F.col("event_s") - F.floor("event_s"), "publication_delay": F.greatest(F.lit(0.0), F.col("available_s") - F.col("event_s"))}
    days = day_totals(segments, [], values, None, last_day, whole=["edges", "__events"])
    days = days.withColumns({c: F.col(c).cast("double") for c in values})
    return days.select("day", F.col("edges").cast("bigint").alias("edges"), *FACT_VALUES, *context,
                       (F.col("edges") * _cutoff(tz) - F.col("__events") - F.col("__rest")).alias("event_age"), "publication_delay")
