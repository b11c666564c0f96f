"""Micro-batch pipelines: a batch of changes becomes findings in the outbox and operations on the projection.

Both are committed together under the batch id, so a batch that Spark replays after a failure changes nothing twice.
The projection grows by the operations of each batch and is merged on read; :func:`compact_projection` folds it.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetseal.operators import findings, outbox, projection
from fleetseal.sources.state import Snapshot, StateStore

FILE_TABLE = "fs_changes"
REGISTRY_TABLE = "reg_changes"
OUTBOX_TABLE = "outbox"

_ATTEMPTS = 3
_log = logging.getLogger(__name__)


def outbox_rows(events: DataFrame, created_ms: int | None = None, error: bool = False) -> DataFrame:
    """Outbox rows of an envelope, due at once. Revision 0 is the admission."""
    created = F.col("occurred_ms") if created_ms is None else F.lit(created_ms).cast("bigint")
    return events.select(
        "host", F.col("record_id").alias("id"), "schema_version", "event_id", "record_type", "occurred_ms", "scope_hash", "fields",
        F.lit(error).alias("error"), created.alias("created_ms"), F.lit(0).cast("bigint").alias("next_attempt_ms"),
        F.lit(None).cast("bigint").alias("delivered_ms"), F.lit(0).alias("delivery_attempts"),
        F.lit(None).cast("string").alias("last_error"), F.lit(0).cast("bigint").alias("revision"))


def current_outbox(store: StateStore, at: Snapshot | None = None) -> DataFrame:
    """Newest revision of every outbox row."""
    rows = store.read(OUTBOX_TABLE, at=at)
    keys = ["host", "id"]
    others = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("revision")).alias("__row"))
    return newest.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others]).select(*rows.columns)


def admit_new(store: StateStore, events: DataFrame, error: bool = False, at: Snapshot | None = None) -> DataFrame:
    """Rows of events whose record id the outbox does not hold."""
    at = at or store.snapshot()
    rows = outbox_rows(events, error=error)
    existing = None
    if store.has(OUTBOX_TABLE, at):
        existing = store.read(OUTBOX_TABLE, at=at).select("host", "id")
    return outbox.admit(rows, existing, ["host", "id"], "occurred_ms")


def write_file_changes(store: StateStore, batch: DataFrame, batch_id: int, writer: str = "files") -> None:
    """Previous evidence, findings and projection of a batch of file changes, in one commit."""
    at, batch = store.snapshot(), batch.persist()
    if store.has(FILE_TABLE, at):
        enriched = projection.attach_previous(batch, store.read(FILE_TABLE, at=at))
    else:
        enriched = batch.withColumns({"previous_hash": F.lit(""), "previous_acl": F.lit(""),
                                      "previous_size_bytes": F.lit(None).cast("bigint")})
    enriched = enriched.persist()
    try:
        operations = projection.projection_operations(enriched).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        store.commit(append={FILE_TABLE: operations, OUTBOX_TABLE: admit_new(store, findings.file_findings(enriched), at=at)},
                     batch_id=batch_id, writer=writer)
    finally:
        enriched.unpersist()
        batch.unpersist()


def write_registry_changes(store: StateStore, batch: DataFrame, batch_id: int, writer: str = "registry") -> None:
    """The same for registry changes; the previous access list is the one stored before the batch."""
    at, batch = store.snapshot(), batch.persist()
    if store.has(REGISTRY_TABLE, at):
        enriched = projection.attach_previous_acl(batch, store.read(REGISTRY_TABLE, at=at))
    else:
        enriched = batch.withColumn("previous_acl", F.lit(""))
    enriched = enriched.persist()
    try:
        latest = projection.latest_by_entity(enriched).withColumn("present", F.lit(True))
        operations = latest.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        store.commit(append={REGISTRY_TABLE: operations, OUTBOX_TABLE: admit_new(store, findings.registry_findings(enriched), at=at)},
                     batch_id=batch_id, writer=writer)
    finally:
        enriched.unpersist()
        batch.unpersist()


def with_retries(write: Callable[[], None], on_failure: Callable[[str, int], None], attempts: int = _ATTEMPTS) -> None:
    """Try a batch a few times and report every failure. The last one is raised, and Spark keeps the batch."""
    for attempt in range(1, attempts + 1):
        try:
            write()
            return
        except Exception as error:  # noqa: BLE001 - every failure of the sink counts
            on_failure(type(error).__name__, attempt)
            if attempt == attempts:
                raise
            time.sleep(0.1 * 2 ** (attempt - 1))


def failure_log(store: StateStore, sink: str, host: str = "driver") -> Callable[[str, int], None]:
    """A callback for :func:`with_retries`: every failed try becomes a sink failure in the outbox.

    A store that cannot take it either is reported to the log, and the failure of the batch stays the one that counts.
    """
    def record(reason: str, attempt: int) -> None:
        row = [(host, int(time.time() * 1000), sink, reason, attempt)]
        try:
            tried = store.spark.createDataFrame(row, "host string, t_ms bigint, sink string, reason string, attempt int")
            store.commit(append={OUTBOX_TABLE: admit_new(store, findings.sink_failures(tried), error=True)})
        except Exception:  # noqa: BLE001 - must not hide the failure it reports
            _log.exception("cannot record that %s failed with %s on try %s", sink, reason, attempt)
    return record


def start_projection(changes: DataFrame, store: StateStore, checkpoint: str,
                     write: Callable[[StateStore, DataFrame, int], None] = write_file_changes,
                     on_failure: Callable[[str, int], None] | None = None, **trigger) -> StreamingQuery:
    """Run a change stream into the store. ``trigger`` is what ``DataStreamWriter.trigger`` takes.

    Failed tries go to the outbox unless ``on_failure`` takes them.
    """
    on_failure = on_failure or failure_log(store, "projection")

    def process(batch: DataFrame, batch_id: int) -> None:
        with_retries(lambda: write(store, batch, batch_id), on_failure)

    return (changes.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_projection(store: StateStore, table: str = FILE_TABLE) -> DataFrame:
    """The projection as it is now."""
    return projection.merge_operations(store.read(table))


def compact_projection(store: StateStore, table: str = FILE_TABLE) -> None:
    """Fold the accumulated operations of a projection into one segment, sorted by host and entity."""
    operations = store.read(table)
    merged = projection.merge_operations(operations).withColumn("present", F.lit(True)).select(*operations.columns)
    keys = ["host", "normalized_entity"]
    store.commit(replace={table: merged.repartitionByRange(*keys).sortWithinPartitions(*keys)})


def compact_outbox(store: StateStore, as_of_ms: int, days: int = outbox.RETENTION_DAYS) -> None:
    """Fold outbox revisions and drop what was delivered longer ago than the retention."""
    kept = outbox.retain(current_outbox(store), as_of_ms, days)
    store.commit(replace={OUTBOX_TABLE: kept.repartitionByRange("host", "id").sortWithinPartitions("host", "id")})
