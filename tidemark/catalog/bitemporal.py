"""Bitemporal selection (B), day intervals (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.tables import CUTOFF, KNOWLEDGE
from tidemark.functions.clocks import day_clocks
from tidemark.functions.digests import row_digest, table_digest
from tidemark.operators import history, temporal
from tidemark.plans.ordered import spread
from tidemark.sources.sinks import publish_snapshot, scratch_folder, verify_snapshot

KEY = ["entity_id"]
KNOWN = f"available_at <= TIMESTAMP '{CUTOFF}' AND ingested_at <= TIMESTAMP '{KNOWLEDGE}'"
LATEST = f"""latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY
    available_at DESC, ingested_at DESC, valid_from DESC, row_id DESC) AS rn FROM revisions WHERE {KNOWN}) WHERE rn = 1)"""
CURRENT = f"""folded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, valid_from ORDER BY
    available_at DESC, ingested_at DESC, row_id DESC) AS cn FROM revisions WHERE {KNOWN}) WHERE cn = 1),
  current_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC,
    available_at DESC, ingested_at DESC, row_id DESC) AS rn FROM folded
    WHERE valid_from <= TIMESTAMP '{CUTOFF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{CUTOFF}')) WHERE rn = 1)"""
SUPERSEDED = """typed AS (SELECT *, TRY_CAST(CASE WHEN json_valid(metadata_json) THEN metadata_json ->> '$.season' END AS INTEGER) AS season,
    TRY_CAST(CASE WHEN json_valid(metadata_json) THEN metadata_json ->> '$.adapter_version' END AS INTEGER) AS adapter_version FROM sources),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY provider, season ORDER BY ingested_at DESC, adapter_version DESC,
    source_id DESC) AS rn FROM typed WHERE season BETWEEN 2000 AND 2099 AND adapter_version >= 1
    AND ingested_at <= TIMESTAMP '2024-01-02 12:00:00'),
  superseded AS (SELECT * FROM ranked WHERE rn > 1)"""
SHOWN = ["entity_id", "row_id", "source_id", "event_type"]


def framed_sql(*columns: str) -> str:
    """DuckDB text of ``digests.framed``."""
    return " || ".join(
        f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'n')" for c in columns)


def clock_us(*names):
    return [F.unix_micros(n).alias(n) for n in names]


@query("as_of_live_by_source", f"WITH {LATEST} SELECT source_id, count(*) AS live FROM latest GROUP BY source_id",
       ("revisions",))
def _(t):
    return (temporal.as_of_latest(t.revisions, KEY, "row_id", CUTOFF, KNOWLEDGE)
            .groupBy("source_id").agg(F.count("*").alias("live")))


@query("b1_as_of_latest", f"WITH {LATEST} SELECT entity_id, row_id, source_id, event_type, epoch_us(valid_from) AS valid_from FROM latest",
       ("revisions",))
def _(t):
    return temporal.as_of_latest(t.revisions, KEY, "row_id", CUTOFF, KNOWLEDGE).select(*SHOWN, *clock_us("valid_from"))


@query("b2_as_of_current", f"WITH {CURRENT} SELECT entity_id, row_id, source_id, event_type, epoch_us(valid_from) AS valid_from FROM current_rows",
       ("revisions",))
def _(t):
    return temporal.as_of_current(t.revisions, KEY, "row_id", CUTOFF, KNOWLEDGE).select(*SHOWN, *clock_us("valid_from"))


@query("b3_observed_before_cutoff", f"WITH {LATEST} SELECT entity_id, row_id, source_id, event_type, epoch_us(event_at) AS event_at FROM latest WHERE event_at < TIMESTAMP '{CUTOFF}'",
       ("revisions",))
def _(t):
    rows = temporal.as_of_latest(t.revisions, KEY, "row_id", CUTOFF, KNOWLEDGE, observed_before_cutoff=True)
    return rows.select(*SHOWN, *clock_us("event_at"))


@query("b4_post_filters", f"WITH {LATEST} SELECT entity_id, row_id, source_id, event_type FROM latest WHERE event_type IN ('click', 'error', 'purchase') AND valid_to IS NULL",
       ("revisions",))
def _(t):
    return temporal.as_of_latest(
        t.revisions, KEY, "row_id", CUTOFF, KNOWLEDGE,
        filters={"event_type": ["click", "error", "purchase"], "valid_to": None}).select(*SHOWN)


@query("b5_superseded_sources", f"WITH {SUPERSEDED} SELECT source_id, provider, season, adapter_version FROM superseded", ("sources",))
def _(t):
    return temporal.superseded_sources(t.sources, "2024-01-02 12:00:00").select(
        "source_id", "provider", "season", "adapter_version")


@query("b6_exclude_superseded", f"WITH {SUPERSEDED} SELECT fact_id, member_id FROM facts WHERE 'rev:' || member_id NOT IN (SELECT source_id FROM superseded)",
       ("sources", "facts"))
def _(t):
    replaced = temporal.superseded_sources(t.sources, "2024-01-02 12:00:00")
    facts = t.facts.withColumn("source_id", F.concat(F.lit("rev:"), F.col("member_id")))
    return temporal.without_superseded(facts, replaced).select("fact_id", "member_id")


@query("b7_latest_run", """
    SELECT entity_id, row_id, source_id, event_type FROM revisions
    WHERE entity_id = 8 AND available_at <= TIMESTAMP '2024-01-20 00:00:00' AND ingested_at <= TIMESTAMP '2024-01-20 00:00:00'
    ORDER BY available_at DESC, ingested_at DESC, valid_from DESC, row_id DESC LIMIT 1""", ("revisions",))
def _(t):
    return temporal.latest_run(t.revisions, "entity_id", "row_id", 8, "2024-01-20 00:00:00").select(*SHOWN)


@query("b8_label_snapshot", f"""
    WITH seen AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from DESC, available_at DESC,
        ingested_at DESC, row_id DESC) AS rn FROM revisions WHERE {KNOWN.replace(CUTOFF, KNOWLEDGE)}
        AND valid_from <= TIMESTAMP '{KNOWLEDGE}'),
      scored AS (SELECT DISTINCT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F')
    SELECT entity_id, row_id, source_id, event_type, strftime(event_at, '%Y-%m-%d') AS local_day FROM seen
    WHERE rn = 1 AND (valid_to IS NULL OR valid_to > TIMESTAMP '{KNOWLEDGE}') AND entity_id IN (SELECT c_custkey FROM scored)""",
       ("revisions",))
def _(t):
    final = (t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("entity_id")))
    rows = temporal.label_snapshot(t.revisions, KEY, "row_id", KNOWLEDGE, groups=final, group="entity_id")
    return rows.select(*SHOWN, F.date_format("event_at", "yyyy-MM-dd").alias("local_day"))


@query("b9_canonical_latest_view", """
    WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, event_type ORDER BY valid_from DESC,
        available_at DESC, ingested_at DESC, row_id DESC) AS rn FROM revisions) WHERE rn = 1 AND valid_to IS NULL)
    SELECT f.row_id, f.entity_id, f.event_type, c_mktsegment, n_name, r_name FROM f
    JOIN customer ON c_custkey = f.entity_id LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN region ON r_regionkey = n_regionkey""", ("revisions",))
def _(t):
    order = [F.col(c).desc() for c in (*temporal.VALIDITY_ORDER, "row_id")]
    from tidemark.plans.ordered import top_k
    facts = top_k(t.revisions, ["entity_id", "event_type"], order).where(F.col("valid_to").isNull())
    groups = t.customer.withColumnRenamed("c_custkey", "entity_id")
    nation = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    region = t.region.withColumnRenamed("r_regionkey", "n_regionkey")
    view = temporal.canonical_view(facts, groups, KEY, [(nation, ["c_nationkey"]), (region, ["n_regionkey"])])
    return view.select("row_id", "entity_id", "event_type", "c_mktsegment", "n_name", "r_name")


SNAPSHOT_COLUMNS = ("entity_id", "row_id", "source_id", "event_type")
SPECS = (
    temporal.SnapshotSpec("latest", ("entity_id",), "row_id", SNAPSHOT_COLUMNS),
    temporal.SnapshotSpec("current", ("entity_id",), "row_id", SNAPSHOT_COLUMNS, current_only=True),
    temporal.SnapshotSpec("observed", ("entity_id",), "row_id", SNAPSHOT_COLUMNS, observed_before_cutoff=True),
)


def digest_sql(rows: str, columns: tuple[str, ...], header: str, by: str = "") -> str:
    sums = ", ".join(
        f"coalesce(sum(CAST('0x' || substr(d, {s}, 15) AS BIGINT)), 0) AS s{i}" for i, s in enumerate((1, 16, 31, 46)))
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}row_count, sha256(concat_ws('|', '{header}', row_count, s0, s1, s2, s3)) AS content_sha256 FROM (
        SELECT {lead}count(*) AS row_count, {sums} FROM (SELECT {lead}sha256({framed_sql(*columns)}) AS d FROM {rows}) {group})"""


HEADER = "entity_id:bigint,row_id:bigint,source_id:string,event_type:string"


@query("b10_pit_snapshot_manifest", f"""
    WITH {LATEST}, {CURRENT}, observed AS (SELECT * FROM latest WHERE event_at < TIMESTAMP '{CUTOFF}')
    SELECT 'latest' AS table_name, false AS current_only, false AS observed_before_cutoff, * FROM ({digest_sql('latest', SNAPSHOT_COLUMNS, HEADER)})
    UNION ALL SELECT 'current', true, false, * FROM ({digest_sql('current_rows', SNAPSHOT_COLUMNS, HEADER)})
    UNION ALL SELECT 'observed', false, true, * FROM ({digest_sql('observed', SNAPSHOT_COLUMNS, HEADER)})""", ("revisions",))
def _(t):
    tables = {spec.name: t.revisions for spec in SPECS}
    return temporal.snapshot_manifest(temporal.snapshot_tables(tables, SPECS, CUTOFF, KNOWLEDGE), SPECS)


@query("b11_content_digest", digest_sql(
    "facts", ("fact_id", "group_id", "outcome", "units"),
    "fact_id:string,group_id:bigint,outcome:string,units:int", "side_id"), ("facts",))
def _(t):
    return table_digest(t.facts, ["fact_id", "group_id", "outcome", "units"], by=["side_id"])


MIDNIGHT = "CAST({0} AS DATE) + CASE WHEN {0} = date_trunc('day', {0}) THEN 0 ELSE 1 END"


def intervals_sql(window_days: int | None) -> str:
    """Straightforward per-version form: best of the versions competing so far, then the next better one."""
    window = f", event_day + {window_days + 1}" if window_days is not None else ""
    return f"""
    entries AS (SELECT entity_id, row_id, CAST(event_at AS DATE) AS event_day, event_type,
        CAST(round(value * 100) AS BIGINT) AS cents, available_at,
        greatest({MIDNIGHT.format('valid_from')}, {MIDNIGHT.format('available_at')}, {MIDNIGHT.format('ingested_at')},
                 CAST(event_at AS DATE) + 1) AS active_from,
        {MIDNIGHT.format('valid_to')} AS expires,
        row_number() OVER (PARTITION BY entity_id ORDER BY valid_from, available_at, ingested_at, row_id) AS r
        FROM revisions),
    daily AS (SELECT *, row_number() OVER (PARTITION BY entity_id, active_from ORDER BY r DESC) AS rn FROM entries),
    running AS (SELECT *, max(r) OVER (PARTITION BY entity_id ORDER BY active_from ROWS UNBOUNDED PRECEDING) AS best
        FROM daily WHERE rn = 1),
    changes AS (SELECT *, lead(active_from) OVER (PARTITION BY entity_id ORDER BY active_from) AS next_from
        FROM running WHERE best = r),
    intervals AS (SELECT entity_id, row_id, event_day, event_type, cents, available_at, active_from,
        least(next_from, expires{window}) AS active_to FROM changes
        WHERE least(next_from, expires{window}) IS NULL OR active_from < least(next_from, expires{window}))"""


def day_text(*names):
    return [F.date_format(n, "yyyy-MM-dd").alias(n) for n in names]


def intervals(t, window_days=None, carry=("event_type", "cents", "available_at")):
    revisions = t.revisions.withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    return history.competition_intervals(revisions, KEY, "row_id", window_days=window_days, carry=carry)


@query("b12_xor_fingerprint", f"""
    WITH {intervals_sql(10)}, sliced AS (SELECT active_from, active_to, sha256({framed_sql('entity_id', 'row_id')}) AS d FROM intervals),
    days AS (SELECT active_from AS day FROM sliced UNION SELECT active_to FROM sliced WHERE active_to IS NOT NULL)
    SELECT strftime(day, '%Y-%m-%d') AS day, count(d) AS active,
      {', '.join(f"coalesce(bit_xor(CAST('0x' || substr(d, {s}, 15) AS BIGINT)), 0) AS fp{i}" for i, s in enumerate((1, 16, 31, 46)))}
    FROM days LEFT JOIN sliced ON day >= active_from AND (active_to IS NULL OR day < active_to) GROUP BY day""", ("revisions",))
def _(t):
    prints = history.xor_fingerprints(intervals(t, 10), row_digest([F.col("entity_id"), F.col("row_id")]))
    return prints.select(*day_text("day"), "active", "fp0", "fp1", "fp2", "fp3")


@query("b13_verify_snapshot", f"""
    WITH {LATEST}, {CURRENT} SELECT 'current' AS table_name, count(*) AS row_count, 2 * count(*) AS actual_rows FROM current_rows""", ("revisions",))
def _(t):
    # Published, one of its stored tables written twice over, and read back against the manifest.
    folder = scratch_folder(t.spark, "snapshot")
    publish_snapshot(t.spark, {s.name: t.revisions for s in SPECS}, SPECS, CUTOFF, KNOWLEDGE, folder)
    table = t.spark.read.parquet(f"{folder}/tables/current")
    table.write.mode("append").parquet(f"{folder}/tables/current")
    return verify_snapshot(t.spark, folder, SPECS)


@query("b14_validate_revisions", """
    SELECT row_id, code FROM (
      SELECT user_id AS row_id, 'duplicate_in_batch' AS code FROM events GROUP BY user_id HAVING count(*) > 1
      UNION ALL SELECT user_id, 'ingested_before_available' FROM events JOIN revisions ON row_id = event_id WHERE event_at < available_at
      UNION ALL SELECT user_id, 'validity_not_positive' FROM events JOIN revisions ON row_id = event_id WHERE valid_to <= available_at
      UNION ALL SELECT DISTINCT user_id, 'already_stored' FROM events JOIN customer ON c_custkey = user_id)""", ("revisions",))
def _(t):
    batch = t.revisions.select(
        F.col("entity_id").alias("row_id"), "event_at", "available_at", F.col("event_at").alias("ingested_at"),
        F.col("available_at").alias("valid_from"), "valid_to")
    return temporal.validate_revisions(batch, "row_id", t.customer.select(F.col("c_custkey").alias("row_id")))


@query("b15_clock_policy", """
    SELECT group_id, epoch_us(CAST(day AS TIMESTAMP) - to_hours(9)) AS scheduled_at,
      epoch_us(CAST(day AS TIMESTAMP) + to_seconds(86399) - to_hours(9)) AS event_at,
      epoch_us(CAST(day + 1 AS TIMESTAMP) - to_hours(9)) AS available_at FROM games""", ("games",))
def _(t):
    clocks = day_clocks(F.col("day"), "Asia/Seoul")
    return t.games.select("group_id", *[F.unix_micros(c).alias(n) for n, c in clocks.items()])


@query("d1_competition_intervals", f"""
    WITH {intervals_sql(None)} SELECT entity_id, row_id, strftime(event_day, '%Y-%m-%d') AS event_day,
      strftime(active_from, '%Y-%m-%d') AS active_from, strftime(active_to, '%Y-%m-%d') AS active_to FROM intervals""",
       ("revisions",))
def _(t):
    return intervals(t).select("entity_id", "row_id", *day_text("event_day", "active_from", "active_to"))


@query("d2_active_on_days", """
    WITH days AS (SELECT CAST(unnest(range(DATE '2023-12-01', DATE '2024-04-01', INTERVAL 1 DAY)) AS DATE) AS day),
    eligible AS (SELECT day, entity_id, row_id, CAST(event_at AS DATE) AS event_day, valid_to,
        row_number() OVER (PARTITION BY day, entity_id ORDER BY valid_from DESC, available_at DESC, ingested_at DESC, row_id DESC) AS rn
      FROM days JOIN revisions ON available_at <= day AND ingested_at <= day AND valid_from <= day AND CAST(event_at AS DATE) < day)
    SELECT strftime(day, '%Y-%m-%d') AS day, entity_id, row_id FROM eligible
    WHERE rn = 1 AND (valid_to IS NULL OR valid_to > day) AND event_day >= day - 10""", ("revisions",))
def _(t):
    days = history.active_on_days(intervals(t, 10))
    return days.select(*day_text("day"), "entity_id", "row_id")


@query("d3_rolling_entity_sums", f"""
    WITH {intervals_sql(10)}, days AS (SELECT CAST(unnest(range(DATE '2023-12-01', DATE '2024-04-01', INTERVAL 1 DAY)) AS DATE) AS day)
    SELECT strftime(day, '%Y-%m-%d') AS day, event_type, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS versions,
      strftime(max(event_day), '%Y-%m-%d') AS last_event_day, epoch_us(max(available_at)) AS last_available
    FROM days JOIN intervals ON day >= active_from AND (active_to IS NULL OR day < active_to) GROUP BY day, event_type""",
       ("revisions",))
def _(t):
    state = history.rolling_state(
        intervals(t, 10), ["event_type"], ["cents"], latest=["available_at"])
    return state.select(*day_text("day", "last_event_day"), "event_type", "cents", "versions",
                        F.unix_micros("available_at").alias("last_available"))


@query("d3_rolling_state_changes", f"""
    WITH {intervals_sql(None)}, points AS (SELECT event_type, active_from AS from_day FROM intervals
        UNION SELECT event_type, active_to FROM intervals WHERE active_to IS NOT NULL)
    SELECT strftime(from_day, '%Y-%m-%d') AS from_day, p.event_type, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents
    FROM points p LEFT JOIN intervals i ON i.event_type = p.event_type AND from_day >= active_from
      AND (active_to IS NULL OR from_day < active_to) GROUP BY from_day, p.event_type""", ("revisions",))
def _(t):
    return history.state_changes(intervals(t), ["event_type"], ["cents"]).select(
        *day_text("from_day"), "event_type", "cents")


@query("d4_key_change_stream", f"""
    WITH {intervals_sql(10)} SELECT strftime(active_from, '%Y-%m-%d') AS day, entity_id FROM intervals
    UNION SELECT strftime(active_to, '%Y-%m-%d'), entity_id FROM intervals WHERE active_to IS NOT NULL""", ("revisions",))
def _(t):
    return history.key_changes(intervals(t, 10), KEY).select(*day_text("day"), "entity_id")


@query("d5_marker_between", """
    WITH ordered AS (SELECT row_id, entity_id, ts, lag(ts) OVER (PARTITION BY entity_id ORDER BY ts) AS previous
      FROM (SELECT event_id AS row_id, user_id AS entity_id, ts FROM events WHERE event_type <> 'error'))
    SELECT row_id, EXISTS (SELECT 1 FROM events m WHERE m.event_type = 'error' AND m.user_id = entity_id
      AND m.ts > previous AND m.ts < ordered.ts) AS marker_between FROM ordered""")
def _(t):
    rows = t.events.select(F.col("event_id").alias("row_id"), F.col("user_id").alias("entity_id"), "ts", "event_type")
    flagged = history.marker_between(
        rows.where("event_type <> 'error'").select("row_id", "entity_id", "ts"),
        rows.where("event_type = 'error'"), KEY, ["ts"], spread(F.col("ts"), 3600))
    return flagged.select("row_id", "marker_between")


@query("d6_rate_band_lookup", """
    WITH bands(position, low, high, multiplier) AS (VALUES ('a', 0e0, 0.25e0, 3e0), ('a', 0.25e0, 0.5e0, 2e0),
      ('a', 0.5e0, 1e0, 1e0), ('b', 0e0, 0.1e0, 5e0), ('b', 0.1e0, 1e0, 1.5e0))
    SELECT group_id, member_id, scenario_id, multiplier FROM (SELECT *, CASE WHEN member_id % 2 = 0 THEN 'a' ELSE 'b' END AS position,
      hits / 4e0 AS rate FROM scenarios) s LEFT JOIN bands b ON b.position = s.position AND rate >= low AND (rate < high OR (high = 1 AND rate <= 1))""",
       ("scenarios",))
def _(t):
    bands = t.spark.createDataFrame(
        [("a", 0.0, 0.25, 3.0), ("a", 0.25, 0.5, 2.0), ("a", 0.5, 1.0, 1.0), ("b", 0.0, 0.1, 5.0), ("b", 0.1, 1.0, 1.5)],
        "position string, low double, high double, multiplier double")
    rows = t.scenarios.withColumn("position", F.expr("IF(member_id % 2 = 0, 'a', 'b')")).withColumn(
        "rate", F.col("hits") / F.lit(4.0))
    return history.band_lookup(rows, bands, "rate", ["position"]).select(
        "group_id", "member_id", "scenario_id", "multiplier")
