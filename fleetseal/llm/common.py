"""Helpers shared by the operators of this subpackage: tables, staged results, word rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseal.session import checkpoint_dir, drop  # noqa: F401

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/llm-{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame, what: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps neither recompute it nor depend on an executor.

    The shuffles that made it are needed no more; Spark gives up their files when the driver's collector has seen that.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, what)
    df.write.parquet(path, compression=compression)
    spark.sparkContext._jvm.System.gc()
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_parts(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts in ``column`` hold about ``most`` bytes each; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        first, held = 0, 0
        for row, size in enumerate(sizes):
            if row > first and held + size > most:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        yield batch.slice(first)
