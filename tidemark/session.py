"""Session settings, shared-folder lookup and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its measured size is below this.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(name: str = "tidemark", cores: str = "*", partitions: int = 8, folder: str | None = None) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder named by the session.

    A cluster sets ``spark.checkpoint.dir`` to storage every executor can read.  A session on
    one machine that sets nothing gets a folder of its own; elsewhere a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = spark.sparkContext.applicationId
    if own not in _OWN_FOLDERS:
        _OWN_FOLDERS[own] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return _OWN_FOLDERS[own]


def new_folder(spark: SparkSession, name: str) -> str:
    """A place of its own below the shared folder, not made yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table's path is a folder of files rather than one file, in whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result survives lost executors and has no lineage, unlike a local checkpoint.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of ``df``, as text, fit in ``limit`` bytes.  Runs one aggregate."""
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))) + 16
    total = df.select(F.sum(size).alias("n")).first()["n"]
    return (total or 0) <= limit


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring the side; otherwise leave it to a shuffle."""
    return F.broadcast(df) if small_enough(df, limit) else df


def spread(df: DataFrame) -> DataFrame:
    """Give a source with fewer splits than cores one split per core.

    Tokenising is heavy per byte, so a table in one small file should not be one task.  A
    table of many files already has splits enough and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
