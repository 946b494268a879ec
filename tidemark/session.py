"""Session settings shared by tests, the bench and ad-hoc use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on in any session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Split a skewed join side even where that costs another shuffle for the aggregate behind it.
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # What a step has shuffled goes when its result is written, so a query holds the shuffles of one step at a time.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


PART_BYTES = 1 << 20


def size_shuffles(spark: SparkSession, folder: str) -> None:
    """As many shuffle partitions as the input asks for, so that what one task holds does not grow with the input.

    A stored megabyte of the tables has a partition of its own; AQE puts small ones together, up to 16 MB and to a
    quarter of their number, so a task holds the share of a few stored megabytes of what is shuffled.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    stored = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // PART_BYTES))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionNum", str(max(spark.sparkContext.defaultParallelism, parts // 4)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a scan task joins and counts what it reads, all in memory


_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a scratch folder: on a cluster every
    executor has to reach the files, so a missing setting is an error there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named is None:
        named = context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-shared-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder, which ``sweep`` deletes."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def scratch_folders() -> list[str]:
    """The scratch folders that have not been deleted yet."""
    return list(_made)


def sweep(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Delete scratch folders (all, unless some are named); call it once results that read them are written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for name in scratch_folders() if folders is None else folders:
        if name in _made:
            _made.remove(name)
            path = hadoop(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Rows written once as Parquet in the shared folder: far smaller than a checkpoint, and read by column."""
    path = scratch_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
