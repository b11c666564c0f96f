"""Tables that micro-batches write: plain Parquet, a folder per batch and in it one per hash bucket of the key.

A batch writes its own folder and reads only those of batches before it. A replay therefore finds what its first try found and writes
the same folder again: nothing is lost, nothing counts twice, and no log of commits is kept. Every few batches the rows are merged
into a fold, so what a batch reads is one fold and a bounded number of batches, however many went before, and of these only
the buckets that its keys fall into.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

BUCKETS = 64
FOLD_EVERY = 16


class BatchTable:
    """Rows below ``path`` with the columns of ``schema``, spread by ``keys``.

    ``merge`` resolves the rows of all batches into the current ones, with the columns of ``schema`` and ``batch_id``. Batch ids count from
    0 without gaps, as those of a streaming query do.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame],
                 buckets: int = BUCKETS, fold_every: int = FOLD_EVERY):
        self.spark, self.path, self.keys, self.merge = spark, path.rstrip("/"), list(keys), merge
        self.buckets, self.fold_every = buckets, fold_every
        # Partition columns come last.
        self.schema = StructType([*schema.fields]).add("batch_id", LongType())
        self._stored = StructType([*self.schema.fields]).add("bucket", IntegerType())

    def write(self, batch_id: int, rows: DataFrame) -> None:
        """Make ``rows`` the content of a batch, whatever an earlier try left; fold when it is time to."""
        self._put(f"batches/batch={batch_id}", rows.withColumn("batch_id", F.lit(batch_id).cast("long")))
        if (batch_id + 1) % self.fold_every == 0:
            self._put(f"folds/fold={batch_id}", self.merge(self.before(batch_id + 1, folded=False)))

    def before(self, batch_id: int, wanted: DataFrame | None = None, folded: bool = True) -> DataFrame:
        """Rows of the batches before this one, from the newest fold on. ``wanted`` (the keys) limits them to the buckets it touches."""
        base = batch_id // self.fold_every * self.fold_every - 1
        if not folded and base == batch_id - 1:
            base -= self.fold_every
        rows = self._read([f"folds/fold={base}"] if base >= 0 else [], "folds").unionByName(
            self._read([f"batches/batch={b}" for b in range(max(base, -1) + 1, batch_id)], "batches"))
        if wanted is not None:
            touched = wanted.select(self._bucket().alias("bucket")).distinct()  # at most as many rows as there are buckets
            rows = rows.filter(F.col("bucket").isin([r.bucket for r in touched.collect()]))
        return rows.drop("bucket")

    def next_batch(self) -> int:
        """Number of the batch after the newest one."""
        try:
            newest = self.spark.read.schema(self._stored).parquet(f"{self.path}/batches").agg(F.max("batch_id")).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None
        return 0 if newest is None else newest + 1

    def current(self, last_batch: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """The merged rows up to ``last_batch``, or up to the newest batch that has rows.

        ``columns`` are all that is read and moved; they must hold what ``merge`` goes by.
        """
        rows = self.before(self.next_batch() if last_batch is None else last_batch + 1)
        return self.merge(rows if columns is None else rows.select(*columns))

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _put(self, folder: str, rows: DataFrame) -> None:
        named = rows.select(*self.schema.names).withColumn("bucket", self._bucket())
        named.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{folder}")

    def _read(self, folders: list[str], root: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self._stored)
        read = self.spark.read.schema(self._stored).option("basePath", f"{self.path}/{root}")
        return read.parquet(*[f"{self.path}/{f}" for f in folders]).select(*self._stored.names)
