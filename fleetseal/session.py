"""Session settings the engine relies on, and the shared folder for what is staged."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Times are compared as UTC; adaptive execution sizes partitions and splits skewed join sides at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def build_session(app: str = "fleetseal", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session with the settings above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only when a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    return tempfile.mkdtemp(prefix="fleetseal-checkpoint-")


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to a new folder below the checkpoint folder and read it back, so that later steps share one result."""
    path = f"{checkpoint_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    result = df.sparkSession.read.schema(df.schema).parquet(path)
    result.staged_path = path
    return result


def drop(staged: DataFrame) -> None:
    """Delete a staged table that nothing will read again."""
    jvm, path = staged.sparkSession.sparkContext._jvm, staged.staged_path
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(staged.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark give up the files of shuffles that no plan in use refers to; it learns of them when the driver's collector has run."""
    spark.sparkContext._jvm.System.gc()
