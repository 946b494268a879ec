"""A training corpus from raw documents: quality rules, near-duplicates, benchmark passages, source weights, token ids.

Every stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet to the shared folder
and read again as the next stage's documents.  All but the last return the columns of their input, whatever
further columns there are and however they are named; an empty table gives an empty one.  A stage
starts by deleting the scratch tables of the stage before it, whose output has been written by then.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, quality_rules, simhash, token_output
from tidemark.llm.common import row_key, stored
from tidemark.session import scratch_folders, shared_folder, sweep

#: The last stage's tokens are not expressible in SQL; the tests hold the whole run against a brute-force version.
ORACLE_SQL = None


_left: list[str] = []  # scratch tables behind the output of the latest stage


def stage(function):
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, _left)
        before = scratch_folders()
        out = function(spark, docs, sf_dir)
        _left[:] = [f for f in scratch_folders() if f not in before]
        return out

    return run_stage


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learnt cutoffs keep.

    Null and empty texts have no words and fail the base rules.  Repeated rows are judged alike and all stay or
    all go; a language that has no proven cutoff, null included, is judged by the base rules alone.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # Names of its own, so that further columns of the documents cannot clash with the statistics.
    own = {c: f"doc_{k}" for k, c in enumerate(docs.columns)}
    labels = labels.select(F.col("doc_id").alias(own["doc_id"]), "quality")
    judged = quality_rules.judge(docs.withColumnsRenamed(own), labels, own["doc_id"], own["text"], own["lang"])
    return judged.where("kept").select(*[F.col(name).alias(c) for c, name in own.items()])


@stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    A null id loses to any other.  Rows equal in id and text are one document; where several texts share the
    smallest id, one of them stays, the same in every run.
    """
    return simhash.keep_one(docs)


@stage
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none and stay, as do repeated rows; items without words match nothing.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = docs.select(F.struct(*row_key("doc_id", "text")).alias("row"), "text")
    found = decontaminate.decontaminate(named, items, id_col="row")
    leaked = stored(found.where("n_hit > 0").select("row").distinct(), "leaked")
    mark = "row"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.struct(*row_key("doc_id", "text")))
    return marked.join(leaked.withColumnRenamed("row", mark), mark, "left_anti").select(*docs.columns)


@stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the target weights of their sources, shuffled.

    Rows of null source count for the source of empty name.  Rows of equal id draw the same count each.
    """
    own = {c: f"doc_{k}" for k, c in enumerate(docs.columns)}
    mixed = mixing.mix(docs.withColumnsRenamed(own), id_col=own["doc_id"], source_col=own["source"], text_col=own["text"])
    return mixed.select(*[F.col(name).alias(c) for c, name in own.items()])


@stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in the binary format; one row per document as read back, in ascending order of ids.

    Null ids come first; a null or empty text has the end id alone; every repeated row gets its own place.
    """
    return token_output.tokenise(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
    ("token_output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, function) in enumerate(STAGES):
        out = function(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{number}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{number}-{name}")
    return docs
