"""Mix sources to target weights by Poisson replication.

A source's rate is the number of times its text has to be repeated, on average, for the mix to hold the
target share of it.  Each document draws its count from a Poisson distribution of that mean by inverting
the distribution function at a number hashed from the seed and the document's id, so a rerun draws the
same.  A rate above ``PIECE`` is the sum of several draws of an equal share of it.  Documents are repeated
by their count, and all copies are sorted by a hash of id and copy: a global shuffle in random order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

PIECE = 16
#: P(Poisson(16) > 90) is below 2**-53.
TERMS = 90


def rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", text_col: str = "text", epochs: float = 1.0) -> DataFrame:
    """(source, rate): how often the text of each source is wanted, by characters over all documents.

    ``weights`` has (source, weight); they are brought to a sum of one over the sources there are, and a
    source without a weight is not wanted.  Without a table a source weighs the square root of its size.
    The mix has ``epochs`` times the characters of the input.  A source without any text keeps rate ``epochs``.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).agg(
        F.sum(F.coalesce(F.length(F.col(text_col)), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.sqrt("size"))
    else:
        given = weights.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.max("weight").cast("double").alias("weight"))
        weighed = sizes.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    totals = weighed.agg(F.sum("size").alias("all_size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("all_weight"))
    rate = F.lit(float(epochs)) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")
    return weighed.crossJoin(totals).select("source", F.when(F.col("size") > 0, rate).otherwise(F.lit(float(epochs))).alias("rate"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def _distribution(mean: Column) -> Column:
    """P(Poisson(mean) <= k) for k from 0 to TERMS."""
    start = F.struct(F.exp(-mean).alias("term"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("below"))

    def add(state: Column, k: Column) -> Column:
        total = state["total"] + state["term"]
        return F.struct((state["term"] * mean / (k + 1)).alias("term"), total.alias("total"), F.array_append(state["below"], total).alias("below"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TERMS)), start, add, lambda s: s["below"])


def mix(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        epochs: float = 1.0, seed: str = "mix") -> DataFrame:
    """``docs`` repeated and shuffled, with ``copy`` (from 1) and ``mix_key`` (the order); columns of those names are replaced.

    Null sources are the source ''; null texts count no characters but are drawn like any other; rows of
    equal id draw alike; an empty table gives an empty one.
    """
    docs = docs.drop("copy", "mix_key")
    source, rate, pieces, below, count = (_free(docs, n) for n in ("source_", "rate_", "pieces_", "below_", "count_"))
    wanted = rates(docs, weights, source_col, text_col, epochs).where("rate > 0")
    wanted = wanted.select(F.col("source").alias(source), F.col("rate").alias(rate), F.ceil(F.col("rate") / PIECE).cast("int").alias(pieces))
    # Stored, so that Spark knows the size of this table of one row per source when it picks the join.
    wanted = stored(wanted.withColumn(below, _distribution(F.col(rate) / F.col(pieces))), "rates")
    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    joined = docs.join(wanted, F.coalesce(docs[source_col].cast("string"), F.lit("")) == F.col(source))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col(pieces)), F.lit(0), lambda n, i: n + F.size(F.filter(
        F.col(below), lambda p: p <= uniform(F.lit(seed), F.lit("draw"), named, i.cast("string")))))
    copies = joined.withColumn(count, drawn).where(F.col(count) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(count))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), named, F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("mix_key", key).orderBy("mix_key")


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


ORACLE = f"""
WITH sizes AS (SELECT coalesce(source, '') AS source, sum(coalesce(length(text), 0))::DOUBLE AS size FROM documents GROUP BY 1),
rated AS (SELECT source, CASE WHEN size > 0 THEN (SELECT sum(size) FROM sizes) * sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) / size ELSE 1.0 END AS rate FROM sizes),
pieces AS (SELECT source, rate, ceil(rate / {PIECE})::INT AS pieces FROM rated),
laws AS (SELECT source, pieces, list_transform(range(0, {TERMS + 1}), lambda k: list_sum(list_transform(range(0, k + 1),
  lambda j: exp(j * ln(rate / pieces) - rate / pieces - lgamma(j + 1))))) AS below FROM pieces),
draws AS (SELECT d.*, below, unnest(range(1, pieces + 1)) AS i FROM documents d JOIN laws l ON coalesce(d.source, '') = l.source),
counts AS (SELECT doc_id, sum(len(list_filter(below, lambda p: p <= ('0x' || substr(md5('mix:draw:' || doc_id || ':' || i), 1, 13))::BIGINT / 4503599627370496.0)))::INT AS n
  FROM draws GROUP BY doc_id),
copies AS (SELECT d.*, unnest(range(1, n + 1))::INT AS copy FROM documents d JOIN counts c ON d.doc_id = c.doc_id)
SELECT *, md5('mix:order:' || doc_id || ':' || copy) AS mix_key FROM copies"""
