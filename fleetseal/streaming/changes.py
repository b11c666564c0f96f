"""A stream of file changes into the projection, the outbox and the record of failures, on tables written batch by batch."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fleetseal.functions.paths import normalize_entity
from fleetseal.operators import findings, outbox, projection
from fleetseal.sources.buckets import BatchTable
from fleetseal.streaming.pipelines import outbox_rows, with_retries

_FAILURES = "host string, t_ms bigint, sink string, reason string, attempt int, batch_id bigint"


def _merged_operations(rows: DataFrame) -> DataFrame:
    return projection.merge_operations(rows).withColumn("present", F.lit(True)).select(*rows.columns)


def _first_admitted(rows: DataFrame) -> DataFrame:
    """Of every record id the row that was admitted first."""
    rest = [c for c in rows.columns if c not in ("host", "id")]
    first = rows.groupBy("host", "id").agg(F.min_by(F.struct(*rest), "batch_id").alias("__row"))
    return first.select("host", "id", *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*rows.columns)


class ChangeTables:
    """Projection, outbox and failures of a change stream below one folder. ``changes`` is the schema of the stream."""

    def __init__(self, spark: SparkSession, path: str, changes: StructType, **options: int):
        self.spark, self.path = spark, path.rstrip("/")
        empty = spark.createDataFrame([], changes)
        operations = projection.projection_operations(self._unknown(empty)).schema
        self.projection = BatchTable(spark, f"{self.path}/projection", operations, projection.KEY, _merged_operations, **options)
        admitted = outbox_rows(findings.file_findings(self._unknown(empty))).schema
        self.outbox = BatchTable(spark, f"{self.path}/outbox", admitted, ["host", "id"], _first_admitted, **options)

    @staticmethod
    def _unknown(changes: DataFrame) -> DataFrame:
        return changes.withColumns({"previous_hash": F.lit(""), "previous_acl": F.lit(""), "previous_size_bytes": F.lit(None).cast("bigint")})

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Previous evidence, findings and projection of a batch. Both tables see batches before this one only, so their order does
        not matter and a replay after a failure between them writes the same."""
        batch = batch.persist()
        try:
            wanted = batch.select("host", normalize_entity(F.coalesce("old_path", "full_path")).alias("normalized_entity"))
            enriched = projection.attach_previous(batch, self.projection.before(batch_id, wanted))
            rows = outbox_rows(findings.file_findings(enriched))
            self.outbox.write(batch_id, outbox.admit(rows, self.outbox.before(batch_id, rows.select("host", "id")), ["host", "id"], "occurred_ms"))
            self.projection.write(batch_id, projection.projection_operations(enriched))
        finally:
            batch.unpersist()

    def record_failure(self, batch_id: int, sink: str = "projection", host: str = "driver") -> Callable[[str, int], None]:
        """A callback that appends each failed try of a batch to the failures."""
        def record(reason: str, attempt: int) -> None:
            row = [(host, int(time.time() * 1000), sink, reason, attempt, batch_id)]
            self.spark.createDataFrame(row, _FAILURES).write.mode("append").parquet(f"{self.path}/failures")
        return record

    def failures(self) -> DataFrame:
        """Failed tries (host, t_ms, sink, reason, attempt, batch_id); for :func:`fleetseal.operators.findings.sink_failures`."""
        try:
            return self.spark.read.schema(_FAILURES).parquet(f"{self.path}/failures")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _FAILURES)


def start(changes: DataFrame, tables: ChangeTables, checkpoint: str, before: Sequence[Callable[[int], None]] = (), **trigger) -> StreamingQuery:
    """Run a change stream into its tables. A failed try is recorded and tried again; the last failure ends the query, and Spark replays
    the batch when it is started anew. ``before`` are called with the batch id ahead of every try."""
    def process(batch: DataFrame, batch_id: int) -> None:
        def attempt() -> None:
            for call in before:
                call(batch_id)
            tables.write(batch, batch_id)
        with_retries(attempt, tables.record_failure(batch_id))
    return (changes.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
