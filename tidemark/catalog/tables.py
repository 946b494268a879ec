"""Bindings of the operators' inputs to the provided Parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import size_shuffles, stored, tune

CUTOFF = "2024-01-15 00:00:00"
KNOWLEDGE = "2024-01-15 02:00:00"

# SQL text of the fixture views, repeated as CTEs in front of an oracle.
VIEWS: dict[str, str] = {
    "revisions": """
        SELECT user_id AS entity_id, event_id AS row_id, 'src-' || (event_id % 4) AS source_id,
               event_type, value,
               CASE WHEN event_id % 11 = 0 THEN ts + to_hours(48) ELSE ts END AS event_at,
               ts + to_hours(CAST(event_id % 5 AS BIGINT)) AS available_at,
               ts + to_hours(CAST(event_id % 5 + event_id % 3 AS BIGINT)) AS ingested_at,
               CASE WHEN event_id % 13 = 0 THEN date_trunc('day', ts) + to_hours(48)
                    ELSE date_trunc('day', ts) END AS valid_from,
               CASE WHEN event_id % 3 = 0 THEN
                   (CASE WHEN event_id % 13 = 0 THEN date_trunc('day', ts) + to_hours(48)
                    ELSE date_trunc('day', ts) END) + to_hours(12) END AS valid_to
        FROM events""",
    "games": """
        SELECT o_orderkey AS group_id, CAST(o_orderdate AS DATE) AS day, c_nationkey AS home_id,
               CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INTEGER) AS away_id,
               CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 10 AS INTEGER) AS home_score,
               CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 8 AS INTEGER) AS away_score
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "raw_rows": """
        SELECT l_orderkey AS group_id, l_linenumber AS ordinal,
               l_partkey * 1000000 + l_suppkey AS step, l_suppkey AS member_id, l_partkey AS counterpart_id,
               CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag || l_linestatus END AS outcome,
               CAST(l_quantity AS INTEGER) AS pre_state,
               CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) % 4 END AS post_state
        FROM lineitem""",
    "facts": """
        SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS fact_id,
               l_orderkey AS group_id, CAST(o_orderdate AS DATE) AS day,
               l_suppkey AS member_id, l_partkey AS counterpart_id,
               s_nationkey AS side_id, c_nationkey AS other_side_id,
               l_returnflag || l_linestatus AS outcome, l_returnflag = 'R' AS is_success,
               (l_linestatus = 'F' OR l_returnflag = 'R') AS is_opportunity,
               CASE WHEN l_returnflag = 'R' THEN 1 + l_linenumber % 4 ELSE 0 END AS units
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
             JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey""",
    "sources": """
        SELECT 'rev:' || s_suppkey AS source_id, 'prov-' || (s_nationkey % 3) AS provider,
               CASE WHEN s_suppkey % 11 = 0 THEN 'not json'
                    ELSE '{"season":"' || (2000 + s_suppkey % 7) || '","adapter_version":"'
                         || (1 + s_suppkey % 2) || '"}' END AS metadata_json,
               TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(s_suppkey % 50 AS BIGINT)) AS ingested_at
        FROM supplier""",
    "predictions": """
        SELECT labels.doc_id AS query_id, quality AS label,
               (n_chars % 97 + 1) / 99e0 AS p1_a, ((labels.doc_id * 37) % 97 + 1) / 99e0 AS p1_b,
               CAST(1 + labels.doc_id % 3 AS INTEGER) AS weight,
               CAST(labels.doc_id % 4 AS INTEGER) AS fold_id, lang AS stage
        FROM labels JOIN documents ON labels.doc_id = documents.doc_id""",
    "scenarios": """
        SELECT CAST(event_id % 100 AS INTEGER) AS scenario_id, event_type AS group_id,
               user_id AS member_id, count(*) AS hits
        FROM events GROUP BY 1, 2, 3""",
}


def view_sql(sql: str, views: tuple[str, ...]) -> str:
    """Put the fixture views in front of ``sql`` as CTEs."""
    if not views:
        return sql
    head = ", ".join(f"{name} AS ({VIEWS[name]})" for name in views)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


def revisions_of(events: DataFrame) -> DataFrame:
    """The ``revisions`` view over a batch or streaming events table."""
    day = F.date_trunc("day", "ts")
    valid_from = F.when(F.expr("event_id % 13 = 0"), day + F.expr("INTERVAL 48 HOURS")).otherwise(day)
    return events.select(
        F.col("user_id").alias("entity_id"), F.col("event_id").alias("row_id"),
        F.expr("concat('src-', event_id % 4)").alias("source_id"), "event_type", "value",
        F.expr("CASE WHEN event_id % 11 = 0 THEN timestampadd(HOUR, 48, ts) ELSE ts END").alias("event_at"),
        F.expr("timestampadd(HOUR, event_id % 5, ts)").alias("available_at"),
        F.expr("timestampadd(HOUR, event_id % 5 + event_id % 3, ts)").alias("ingested_at"),
        valid_from.alias("valid_from"),
        F.when(F.expr("event_id % 3 = 0"), valid_from + F.expr("INTERVAL 12 HOURS")).alias("valid_to"),
    )


class Tables:
    """Lazy access to the raw tables and the fixture views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")
        size_shuffles(self.spark, self.folder)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(self.path(name))
        clocks = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in clocks}) if clocks else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def keep(self, *names: str) -> Tables:
        """Store fixture views that a query starts from several times; they are built once."""
        for name in names:
            self.__dict__[name] = stored(getattr(self, name), name)
        return self

    @cached_property
    def revisions(self) -> DataFrame:
        return revisions_of(self.read("events"))

    @cached_property
    def games(self) -> DataFrame:
        joined = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return joined.selectExpr(
            "o_orderkey AS group_id", "CAST(o_orderdate AS DATE) AS day", "c_nationkey AS home_id",
            "CAST((c_nationkey + 1 + o_orderkey % 24) % 25 AS INT) AS away_id",
            "CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 10 AS INT) AS home_score",
            "CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 8 AS INT) AS away_score")

    @cached_property
    def raw_rows(self) -> DataFrame:
        return self.read("lineitem").selectExpr(
            "l_orderkey AS group_id", "l_linenumber AS ordinal",
            "l_partkey * 1000000 + l_suppkey AS step", "l_suppkey AS member_id", "l_partkey AS counterpart_id",
            "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag || l_linestatus END AS outcome",
            "CAST(l_quantity AS INT) AS pre_state",
            "CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(l_quantity AS INT) % 4 END AS post_state")

    @cached_property
    def facts(self) -> DataFrame:
        # The smaller tables meet first, so the lines travel by order and not once more by customer.
        ordered = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        supplied = self.read("lineitem").join(self.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        joined = supplied.join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.selectExpr(
            "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS fact_id",
            "l_orderkey AS group_id", "CAST(o_orderdate AS DATE) AS day",
            "l_suppkey AS member_id", "l_partkey AS counterpart_id",
            "s_nationkey AS side_id", "c_nationkey AS other_side_id",
            "l_returnflag || l_linestatus AS outcome", "l_returnflag = 'R' AS is_success",
            "(l_linestatus = 'F' OR l_returnflag = 'R') AS is_opportunity",
            "CASE WHEN l_returnflag = 'R' THEN 1 + l_linenumber % 4 ELSE 0 END AS units")

    @cached_property
    def sources(self) -> DataFrame:
        return self.read("supplier").selectExpr(
            "concat('rev:', s_suppkey) AS source_id", "concat('prov-', s_nationkey % 3) AS provider",
            """CASE WHEN s_suppkey % 11 = 0 THEN 'not json' ELSE concat('{"season":"', 2000 + s_suppkey % 7,
               '","adapter_version":"', 1 + s_suppkey % 2, '"}') END AS metadata_json""",
            "timestampadd(HOUR, s_suppkey % 50, TIMESTAMP '2024-01-01 00:00:00') AS ingested_at")

    @cached_property
    def predictions(self) -> DataFrame:
        return self.read("labels").join(self.read("documents"), "doc_id").selectExpr(
            "doc_id AS query_id", "quality AS label", "(n_chars % 97 + 1) / 99e0 AS p1_a",
            "((doc_id * 37) % 97 + 1) / 99e0 AS p1_b", "CAST(1 + doc_id % 3 AS INT) AS weight",
            "CAST(doc_id % 4 AS INT) AS fold_id", "lang AS stage")

    @cached_property
    def scenarios(self) -> DataFrame:
        return (
            self.read("events")
            .groupBy(F.expr("CAST(event_id % 100 AS INT)").alias("scenario_id"),
                     F.col("event_type").alias("group_id"), F.col("user_id").alias("member_id"))
            .agg(F.count("*").alias("hits")))
