"""Quality classifier: regularised quadratic discriminant over document statistics.

A text is turned into ``FEATURES``, shares and lengths brought to even scales by roots and logarithms.
Per class, mean and covariance are sums over all labelled training rows; each covariance is shrunk
towards the one of both classes together and then towards its diagonal (``shrinkage``, ``ridge``).  The
score is the difference of the two log densities, from Mahalanobis lengths by Cholesky factors that are
computed once, put on a scale of 0 to 1 by a logistic curve fitted to the training rows' differences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_session

FEATURES = (
    "words", "word_length", "distinct_words", "commonest_word", "neighbour_repeats", "symbols", "pipes", "exclamations",
    "capitals", "stops", "commas", "line_feeds", "repeated_lines", "digits", "pair_repeats", "beyond_ascii",
)
#: Range and step of the log-density differences the logistic curve is fitted on.
_LIMIT, _STEP = 60.0, 0.05


def features(text: bytes) -> list[float]:
    """``FEATURES`` of one UTF-8 text; an empty one has zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(count.sum() - count[0x80:0xC0].sum())
    solid = max(chars - int(count[[9, 10, 11, 12, 13, 32]].sum()), 1)
    seen = Counter(words)
    lines = [line for line in text.split(b"\n") if line]
    pairs = len(set(zip(words, words[1:])))

    def share(codes: bytes, of: int) -> float:
        return float(np.sqrt(count[list(codes)].sum() / of))

    return [
        float(np.log1p(n)), solid / n, len(seen) / n ** 0.9, float(np.sqrt(max(seen.values()) / n)),
        float(np.sqrt(sum(map(eq, words, words[1:])) / n)), share(b"#$%&*@^~<>=+_{}[]\\", n), share(b"|", n), share(b"!", n),
        float(np.sqrt(count[65:91].sum() / solid)), share(b".", n), share(b",", n), share(b"\n", n),
        float(np.sqrt(1 - len(set(lines)) / max(len(lines), 1))), float(np.sqrt(count[48:58].sum() / solid)),
        float(np.sqrt(1 - pairs / max(n - 1, 1))), float(np.sqrt(count[0xC0:].sum() / solid)),
    ]


def document_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ``held_out``, ``x``) per row; the fold is crc32 of the id as text modulo 5."""
    rows = docs.select(F.col(id_col).alias("id"), (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0).alias("held_out"),
                       F.col(text_col).cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py() or b"") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["id", "held_out", "x"])

    return rows.mapInArrow(run, f"id {kind}, held_out boolean, x array<double>")


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the classes 0 and 1, and the score curve."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        density = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - 0.5 * d for m, w, d in zip(self.means, self.factors, self.log_dets)]
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(x) + self.shift, -500, 500)))


def fit(train: DataFrame, shrinkage: float = 0.15, ridge: float = 0.05) -> Discriminant | float:
    """Fit on (x, good); with a single class, or none, its share of ones (a half without rows) is the model."""
    k = len(FEATURES)
    cells = [F.col("x")[i].alias(f"x{i}") for i in range(k)]
    rows = train.select("good", *cells)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    centre = rows.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(k)]).first()
    if centre[0] is None:
        return 0.5
    # Around the common mean, so that the sums of products keep their digits.
    moved = rows.select("good", *[(F.col(f"x{i}") - float(centre[i])).alias(f"x{i}") for i in range(k)])
    sums = moved.groupBy("good").agg(
        F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(k)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    by_class = {bool(r["good"]): r for r in sums}
    if len(by_class) < 2:
        return 1.0 if True in by_class else 0.0
    counts, means, spreads = [], [], []
    for good in (False, True):
        row = by_class[good]
        n, mean = row["n"], np.array([row[f"s{i}"] for i in range(k)]) / row["n"]
        products = np.zeros((k, k))
        for i, j in pairs:
            products[i, j] = products[j, i] = row[f"p{i}_{j}"]
        counts.append(n)
        means.append(mean)
        spreads.append(products / n - np.outer(mean, mean))
    pooled = (counts[0] * spreads[0] + counts[1] * spreads[1]) / sum(counts)
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, dets = [], []
    for spread in spreads:
        shrunk = (1 - shrinkage) * spread + shrinkage * pooled
        shrunk = (1 - ridge) * shrunk + ridge * (np.diag(np.diag(shrunk)) + scale) / 2
        root = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(root))
        dets.append(2 * np.log(np.diag(root)).sum())
    return Discriminant(np.array(means) + np.array([centre[i] for i in range(k)]), np.array(factors), np.array(dets))


def _with_difference(rows: DataFrame, model: Discriminant) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.difference(x))], names=["good", "difference"])

    return rows.select("good", "x").mapInArrow(run, "good boolean, difference double")


def calibrated(model: Discriminant, train: DataFrame) -> Discriminant:
    """Fit the score curve on a histogram of the training differences (of bounded size) by Newton steps."""
    slot = F.round(F.greatest(F.least(F.col("difference"), F.lit(_LIMIT)), F.lit(-_LIMIT)) / _STEP)
    bins = _with_difference(train, model).groupBy(slot.alias("slot"), "good").count().toArrow()
    d = bins.column("slot").to_numpy() * _STEP
    y, weight = bins.column("good").to_numpy().astype(float), bins.column("count").to_numpy().astype(float)
    design = np.stack([d, np.ones_like(d)], axis=1)
    beta = np.array([0.5, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        slope = design.T @ (weight * (y - p)) - np.array([1.0, 0.1]) * (beta - np.array([0.5, 0.0]))
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1.0, 0.1])
        step = np.linalg.solve(curve, slope)
        beta = beta + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.shift = max(float(beta[0]), 1e-3), float(beta[1])
    return model


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
                    threshold: float = 0.3) -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``) for every row of ``docs``.

    Labelled rows whose id falls into fold 0 are never learnt from.  Null labels are left out, a repeated
    label counts once (the better one).  Null and empty texts are scored like any other.  With labels of
    one kind only that kind is certain, without labels every score is a half.  An empty table gives an
    empty result.
    """
    text_session(docs.sparkSession)
    rows = stored(document_features(docs, id_col, text_col), "features")
    marks = labels.where(F.col(quality_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(
        (F.max(F.col(quality_col)) == 1).alias("good"))
    train = stored(rows.where(~F.col("held_out")).join(marks, F.col("id") == F.col("label_id")).select("good", "x"), "training")
    model = fit(train)
    if isinstance(model, Discriminant):
        model = calibrated(model, train)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, len(FEATURES))
            score = model.score(x) if isinstance(model, Discriminant) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=["id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
