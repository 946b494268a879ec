"""Size and cost tables of days and of fixed batches of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.selection import argmax_per_dimension, top_rows

ORDER = ("work_units", "effective_edges", "nodes", "effective_queries")


def day_workload(counts: DataFrame, *, hidden: int, layers: int, edge_cap: int | None = None, capped_task: str | None = None,
                 task_cap: int | None = None) -> DataFrame:
    """Nodes, edges, queries and estimated cost per day; ``counts`` is (day, kind, name, n) with kind node, edge or query."""
    edge = F.least(F.col("n"), F.lit(edge_cap)) if edge_cap else F.col("n")
    asked = F.col("n")
    if capped_task is not None and task_cap:
        asked = F.when(F.col("name") == capped_task, F.least(F.col("n"), F.lit(task_cap))).otherwise(F.col("n"))

    def total(kind: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("bigint")

    days = counts.groupBy("day").agg(
        total("node", F.col("n")).alias("nodes"), total("edge", F.col("n")).alias("edges"), total("edge", edge).alias("effective_edges"),
        total("query", F.col("n")).alias("queries"), total("query", asked).alias("effective_queries"))
    state = F.lit(hidden * layers) * (F.col("nodes") + F.col("effective_edges"))
    query = F.lit(hidden) * F.col("effective_queries")
    return days.withColumns({"state_work_units": state, "query_work_units": query, "work_units": state + query})


SIZES = ("nodes", "edges", "effective_edges", "queries", "effective_queries", "state_work_units", "query_work_units", "work_units")


def fixed_batches(days: DataFrame, batch_days: int) -> DataFrame:
    """Every ``batch_days`` consecutive days as one batch (the ordered part has one row per day)."""
    order = Window.partitionBy(F.lit(1)).orderBy("day")
    placed = days.withColumn("batch", F.floor((F.row_number().over(order) - 1) / batch_days))
    return placed.groupBy("batch").agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
                                       *[F.sum(c).alias(c) for c in SIZES])


def worst_batch(batches: DataFrame) -> DataFrame:
    return top_rows(batches, [*[F.col(c).desc() for c in ORDER], F.col("batch")], 1)


def candidate_batches(batches: DataFrame, dimensions: Sequence[str] = ("work_units", "effective_edges", "nodes", "effective_queries")) -> DataFrame:
    """The largest batch of every dimension, listed once with its dimensions."""
    return argmax_per_dimension(batches, "batch", {d: F.col(d) for d in dimensions}, list(ORDER))


def top_day_bound(days: DataFrame, batch_days: int) -> DataFrame:
    """Sum over the heaviest days: an upper bound for any batch of that many days."""
    heavy = top_rows(days, [*[F.col(c).desc() for c in ORDER], F.col("day").desc()], batch_days)
    return heavy.agg(F.count("*").alias("days"), *[F.sum(c).alias(c) for c in SIZES])
