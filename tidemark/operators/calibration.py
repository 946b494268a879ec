"""Fitted calibrators: temperatures, isotonic steps, stacked models."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.ordered import neighbour, spread
from tidemark.session import cut_lineage

LOW, HIGH = 0.05, 20.0


def apply_temperature(probabilities: Column, temperature: Column) -> Column:
    logs = F.transform(probabilities, lambda x: F.log(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0))) / temperature)
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda x: x / total)


@dataclass(frozen=True)
class Temperatures:
    """One overall temperature and those of the stages with enough evidence."""

    overall: float
    by_stage: Mapping[str, float] = field(default_factory=dict)

    def column(self, stage: str | None = None) -> Column:
        default = F.lit(self.overall)
        if stage is None or not self.by_stage:
            return default
        table = F.create_map(*[part for s, v in self.by_stage.items() for part in (F.lit(s), F.lit(v))])
        return F.coalesce(F.try_element_at(table, F.col(stage)), default)

    def apply(self, df: DataFrame, stage: str | None = None) -> DataFrame:
        return df.withColumn("probabilities", apply_temperature(F.col("probabilities"), self.column(stage)))


def _plus(array: Column | str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


class _Slope:
    """Root of a rising slope inside a bracket: Newton steps, halving when one leaves the bracket.

    An end of the bracket is tried itself before halving towards it, so an optimum
    on the bound is settled in one pass.
    """

    def __init__(self) -> None:
        self.low, self.high, self.at, self.done = 1.0 / HIGH, 1.0 / LOW, 1.0, False
        self.untried = {self.low, self.high}

    def update(self, slope: float, curve: float, tolerance: float) -> None:
        on_low, on_high = self.at == 1.0 / HIGH, self.at == 1.0 / LOW
        if (on_low and slope >= 0) or (on_high and slope <= 0):
            self.done = True
            return
        self.untried.discard(self.at)
        if slope > 0:
            self.high = self.at
        else:
            self.low = self.at
        step = self.at - slope / curve if curve > 0 else math.nan
        if step <= self.low and self.low in self.untried:
            nxt = self.low
        elif step >= self.high and self.high in self.untried:
            nxt = self.high
        else:
            nxt = step if self.low < step < self.high else 0.5 * (self.low + self.high)
        self.done = abs(nxt - self.at) <= tolerance * self.at or self.high - self.low <= tolerance * self.high
        self.at = nxt


def fit_temperatures(df: DataFrame, stage: str | None = None, *, minimum_rows: int = 100, maximum_passes: int = 60, tolerance: float = 1e-10) -> Temperatures:
    """Temperatures in [0.05, 20] that minimise the weighted log loss, overall and per stage.

    The loss is convex in ``1 / temperature``, so each pass only sums its slope
    and curvature; overall and stage problems share the pass.  Per pass the driver
    sees one row per stage.
    """
    group = F.col(stage).cast("string") if stage else F.lit("")
    logs = F.transform("probabilities", lambda x: F.log(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0))))
    rows = df.select(group.alias("stage"), logs.alias("logs"), F.col("label").alias("label"), F.col("weight").cast("double").alias("w"))
    rows = cut_lineage(rows.withColumn("chosen", F.get("logs", F.col("label"))))  # read by every pass
    sizes = {r["stage"]: r for r in rows.groupBy("stage").agg(
        F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).collect()}  # one row per stage
    fitted = {s: _Slope() for s, r in sizes.items() if stage and r["n"] >= minimum_rows and r["lo"] != r["hi"]}
    overall = _Slope()
    for _ in range(maximum_passes):  # Newton steps: a handful in practice
        if overall.done and all(p.done for p in fitted.values()):
            break
        # The trial values enter as a table, so every pass runs the same compiled plan.
        trial = df.sparkSession.createDataFrame(
            [(s, fitted[s].at if s in fitted else overall.at, overall.at) for s in sizes], "stage string, s double, o double")
        placed = rows.join(trial, "stage")  # one row per stage
        parts = []
        for tag in ("s", "o"):
            # One named column per step: nested array functions would repeat the work of the inner ones.
            placed = placed.withColumn("x", F.zip_with("logs", F.array_repeat(F.col(tag), F.size("logs")), lambda x, b: x * b))
            placed = placed.withColumn("top", F.array_max("x"))
            placed = placed.withColumn("x", F.zip_with("x", F.array_repeat(F.col("top"), F.size("logs")), lambda x, t: F.exp(x - t)))
            placed = placed.withColumns({
                "m0": _plus("x"), "m1": _plus(F.zip_with("x", "logs", lambda m, x: m * x)), "m2": _plus(F.zip_with("x", "logs", lambda m, x: m * x * x))})
            placed = placed.withColumns({f"{tag}1": F.col("w") * (F.col("m1") / F.col("m0") - F.col("chosen")),
                                         f"{tag}2": F.col("w") * (F.col("m2") / F.col("m0") - F.pow(F.col("m1") / F.col("m0"), 2))})
            parts += [F.sum(f"{tag}1").alias(f"{tag}1"), F.sum(f"{tag}2").alias(f"{tag}2")]
        sums = placed.groupBy("stage").agg(*parts).collect()  # one row per stage
        if not overall.done:
            overall.update(sum(r["o1"] for r in sums), sum(r["o2"] for r in sums), tolerance)
        for r in sums:
            problem = fitted.get(r["stage"])
            if problem is not None and not problem.done:
                problem.update(r["s1"], r["s2"], tolerance)
        late = [s for s, p in {"": overall, **fitted}.items() if not p.done]
    if late:
        raise RuntimeError(f"temperatures of {late} did not settle in {maximum_passes} passes")
    return Temperatures(1.0 / overall.at, {s: 1.0 / p.at for s, p in fitted.items()})


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pool adjacent violators of a sorted run of blocks (high, weight, total); the means that come out rise."""
    highs, weights, totals = [], [], []
    for batch in batches:
        for high, weight, total in zip(*(c.to_pylist() for c in batch.columns)):
            while totals and totals[-1] * weight >= total * weights[-1]:
                weight += weights.pop()
                total += totals.pop()
                highs.pop()
            highs.append(high)
            weights.append(weight)
            totals.append(total)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (highs, weights, totals)], names=["high", "weight", "total"])


def isotonic_steps(df: DataFrame, score: str = "score", label: str = "label", weight: str = "weight", block_rows: int = 200_000) -> DataFrame:
    """Blocks ``(low, high] -> value`` of the isotonic fit, as a table; equal scores are merged before the fit.

    Ranges of scores are pooled apart; the blocks that are left sum up all that the fit needs, so pooling them
    again, in ranges cut at other places, changes nothing but violations across the cuts.  Rounds end when the
    ranges join without one, at the latest when all blocks fit one range of ``block_rows``.  Per round the
    driver sees one row per range.  Rows of null score or weight, or without weight, do not count.
    """
    wide = F.col(weight).cast("double")
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull() & (wide > 0))
    blocks = rows.groupBy(F.col(score).cast("double").alias("high")).agg(F.sum(wide).alias("weight"), F.sum(F.col(label).cast("double") * wide).alias("total"))
    blocks, turn = cut_lineage(blocks), 0
    while True:
        ranges = -(-blocks.count() // block_rows) or 1
        # Another number of ranges each time, so that a cut does not come back to its place.
        dealt = blocks.repartitionByRange(ranges + turn % 3 if ranges > 1 else 1, "high").sortWithinPartitions("high")
        blocks, turn = cut_lineage(dealt.mapInArrow(_pooled, "high double, weight double, total double")), turn + 1
        mean = F.col("total") / F.col("weight")
        edges = blocks.groupBy(F.spark_partition_id()).agg(F.min("high").alias("at"), F.min_by(mean, "high").alias("first"), F.max_by(mean, "high").alias("last"))
        edges = sorted(tuple(r) for r in edges.select("at", "first", "last").collect())  # one row per range
        if all(a[2] < b[1] for a, b in zip(edges, edges[1:])):
            break
    placed = neighbour(blocks.withColumn("__all", F.lit(1)), ["__all"], ["high"], spread(F.col("high"), 1 / SLOTS), ["high"], "before")
    return placed.select(F.col("before.high").alias("low"), "high", (F.col("total") / F.col("weight")).alias("value"))


SLOTS = 4096


def apply_steps(df: DataFrame, steps: DataFrame, score: str = "score", slots: int = SLOTS) -> DataFrame:
    """Value of the first block whose upper end is not below the score (the last block beyond it).

    Rows and blocks are sorted together inside slots of the score, where a row takes the next block; a slot's
    first block is handed to the slots before it that have none.  Null scores get no value.
    """
    marks = steps.select(F.col("high").alias("__at"), F.lit(1).alias("__kind"), F.struct("value").alias("__block"))
    rows = df.withColumns({"__at": F.col(score).cast("double"), "__kind": F.lit(0)})
    both = rows.unionByName(marks, True).withColumn("__slot", spread(F.col("__at"), 1 / slots))
    firsts = marks.groupBy(spread(F.col("__at"), 1 / slots).alias("__slot")).agg(F.min_by("__block", "__at").alias("__first"))
    # One row per slot from here on.
    taken = both.select("__slot").distinct().join(firsts, "__slot", "left")
    later = Window.partitionBy(F.lit(1)).orderBy(F.col("__slot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    last = steps.agg(F.struct(F.max_by("value", "high").alias("value")).alias("__last"))
    carried = taken.select("__slot", F.last("__first", True).over(later).alias("__later"))
    near = Window.partitionBy("__slot").orderBy(F.col("__at").desc(), F.col("__kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__near", F.last("__block", True).over(near)).where("__kind = 0")
    found = found.join(carried, found["__slot"].eqNullSafe(carried["__slot"]), "left").drop("__slot").crossJoin(F.broadcast(last))  # one row
    value = F.when(F.col("__at").isNotNull(), F.coalesce("__near", "__later", "__last")["value"])
    return found.withColumn("calibrated", value).drop("__at", "__kind", "__block", "__near", "__later", "__last")


def _log_features(df: DataFrame, models: Sequence[str], classes: int) -> DataFrame:
    names = [f"__x_{m}_{k}" for m in models for k in range(classes)]
    columns = {f"__x_{m}_{k}": F.log(F.least(F.greatest(F.get(m, F.lit(k)), F.lit(1e-12)), F.lit(1.0))) for m in models for k in range(classes)}
    return VectorAssembler(inputCols=names, outputCol="__features").transform(df.withColumns(columns)).drop(*names)


def _stack(df: DataFrame, ridge: float) -> LogisticRegressionModel:
    step = LogisticRegression(featuresCol="__features", labelCol="__label", weightCol="weight", family="multinomial", regParam=ridge,
                              elasticNetParam=0.0, standardization=True, maxIter=500, tol=1e-7, probabilityCol="__probability")
    model = step.fit(df.withColumn("__label", F.col("label").cast("double")))
    if model.summary.totalIterations >= 500:
        raise RuntimeError("the stacked model did not settle in 500 passes")
    return model


def _predict(model: LogisticRegressionModel, df: DataFrame, classes: int) -> DataFrame:
    raw = vector_to_array("__probability")
    aligned = F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda i: F.coalesce(F.try_element_at(raw, i), F.lit(0.0)))
    return model.transform(df).withColumn("probabilities", aligned).drop("__probability", "rawPrediction", "prediction", "__features")


@dataclass(frozen=True)
class Stacked:
    model: LogisticRegressionModel
    temperatures: Temperatures
    out_of_fold: DataFrame


def stack_out_of_fold(df: DataFrame, models: Sequence[str], classes: int, folds: Sequence[int], *, fold: str = "fold_id",
                      stage: str = "stage", ridge: float = 1e-3, minimum_rows: int = 100) -> Stacked:
    """Multinomial stack on log base probabilities; fold k is predicted from the folds before it only.

    ``folds`` is the time order.  Stage temperatures come from the out-of-fold
    predictions, the final model from all rows.
    """
    kept = cut_lineage(df)  # every fold trains on it again
    unplaced = kept.where(F.col(fold).isNull() | ~F.col(fold).isin(list(folds))).select(fold).limit(1).collect()
    if len(set(folds)) != len(folds) or unplaced:
        raise ValueError(f"every fold of the rows has to be named once; {unplaced[0][0] if unplaced else 'one'} is not")
    rows = cut_lineage(_log_features(kept, models, classes))  # assembled once for all fits
    crossed = None
    for at in range(1, len(folds)):
        model = _stack(rows.where(F.col(fold).isin(list(folds[:at]))), ridge)
        part = _predict(model, rows.where(F.col(fold) == folds[at]), classes)
        crossed = part if crossed is None else crossed.unionByName(part)
    return Stacked(_stack(rows, ridge), fit_temperatures(crossed, stage, minimum_rows=minimum_rows), crossed)


def apply_stack(stacked: Stacked, df: DataFrame, models: Sequence[str], classes: int, stage: str = "stage") -> DataFrame:
    return stacked.temperatures.apply(_predict(stacked.model, _log_features(df, models, classes), classes), stage)
