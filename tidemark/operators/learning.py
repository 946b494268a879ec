"""Model steps that use Spark ML on the feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.session import cut_lineage


def fit_and_score(df: DataFrame, features: Sequence[str], specs: Sequence[tuple[str, int, int]], classes: int, *,
                  estimator: Estimator | None = None, season: str = "season", target: str = "target", day: str = "day", **report: Any) -> DataFrame:
    """Fit on the seasons before each evaluation season and score it.

    ``specs``: (name, first training season, evaluation season).  Class columns a
    model never saw get probability zero, so every fold has the same classes.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    # Training passes over the rows many times; the checkpoint keeps them from rebuilding the features.
    inputs = cut_lineage(df.select(season, day, F.col(target).cast("double").alias("label"), *features))
    rows = assembler.transform(inputs)
    model_step = estimator or LogisticRegression(family="multinomial", maxIter=200, regParam=0.01)
    result = None
    for name, first, held in specs:
        train = rows.where((F.col(season) >= first) & (F.col(season) < held))
        evaluation = rows.where(F.col(season) == held)
        model = model_step.fit(train)
        settle = getattr(model, "summary", None)
        if settle is not None and settle.totalIterations >= model_step.getOrDefault("maxIter"):
            raise RuntimeError(f"the model of {name} did not settle in {settle.totalIterations} passes")
        scored = model.transform(evaluation)
        raw = vector_to_array("probability")
        aligned = F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda i: F.coalesce(F.try_element_at(raw, i), F.lit(0.0)))
        scored = scored.select(F.col("label").cast("int").alias("label"), aligned.alias("probabilities"), F.lit(1.0).alias("weight"), day)
        spans = scored.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
        row = metrics.evaluate(scored, [], classes, **report).crossJoin(F.broadcast(spans)).select(  # two one-row aggregates
            F.lit(name).alias("fold"), F.lit(held).alias("evaluation_season"), "*")
        result = row if result is None else result.unionByName(row)
    return result
