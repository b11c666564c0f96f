"""Both sides of at-least-once delivery, and live heartbeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetseal.functions.events import is_allocated
from fleetseal.operators import outbox
from fleetseal.session import drop, free_shuffles, staged
from fleetseal.sources import sinks
from fleetseal.sources.buckets import BatchTable


def dedupe_records(events: DataFrame, delay: str = "10 minutes", time: str = "occurred_at") -> DataFrame:
    """Drop repeated records by record id while their first copy is within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(["record_id"])


def heartbeat_stream(log: DataFrame, interval: str = "60 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Counters per host and interval from a stream of (host, t_ms, kind)."""
    kind = F.col("kind")
    timed = log.withColumn("at", F.timestamp_millis("t_ms"))
    if log.isStreaming:
        timed = timed.withWatermark("at", watermark)
    return timed.groupBy("host", F.window("at", interval).alias("w")).agg(
        F.count_if(kind == "accepted").alias("accepted"), F.count_if(kind == "processed").alias("processed"),
        F.count_if(kind == "dropped").alias("dropped"), F.count_if(kind == "failed").alias("enrichment_failures"),
        F.min("t_ms").alias("first_ms"),
    ).select("host", F.unix_millis("w.end").alias("t_ms"), "accepted", "processed", "dropped", "enrichment_failures", "first_ms")


def gap_stream(notifications: DataFrame, capacity: int, interval: str = "1 second", watermark: str = "10 seconds") -> DataFrame:
    """One row per host and interval that got more notifications than the capacity, with how many were too many."""
    timed = notifications.withColumn("at", F.timestamp_millis("captured_ms"))
    if notifications.isStreaming:
        timed = timed.withWatermark("at", watermark)
    return (timed.groupBy("host", F.window("at", interval).alias("w")).agg(F.count("*").alias("offered"))
            .filter(F.col("offered") > capacity)
            .select("host", F.unix_millis("w.start").alias("t_ms"), (F.col("offered") - capacity).alias("lost_count")))


def outbox_table(spark: SparkSession, path: str, schema: StructType, **options: int) -> BatchTable:
    """An outbox written round by round; of every record the newest revision counts."""
    def newest(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("host", "id")]
        best = rows.groupBy("host", "id").agg(F.max_by(F.struct(*rest), F.struct("revision", "batch_id")).alias("__row"))
        return best.select("host", "id", *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*rows.columns)
    return BatchTable(spark, path, schema, ["host", "id"], newest, **options)


# What a record is told from others by, and what its turn depends on.
_RECORD = ("host", "id", "revision", "batch_id")
_TURN = ("created_ms", "next_attempt_ms", "delivered_ms")


def _due(table: BatchTable, number: int, as_of_ms: int, limit: int | None) -> DataFrame | None:
    """The whole rows of the records that round ``number`` delivers, staged; None if there are none.

    Whose turn it is, is found on the few columns that this depends on. Whole rows are moved only if they may be among those: they
    are due themselves and lie between the oldest and the newest of them.
    """
    turn = staged(outbox.ready_batch(table.current(number - 1, [*_RECORD, *_TURN]), as_of_ms, limit).select(*_RECORD, "created_ms"), "turn")
    free_shuffles(table.spark)
    n, low, high, untimed = turn.agg(F.count("*"), F.min("created_ms"), F.max("created_ms"), F.count_if(F.col("created_ms").isNull())).first()
    if not n:
        drop(turn)
        return None
    # Null is equal to null within a struct. Rows that a record has twice in a batch count once.
    named = F.struct(*_RECORD).alias("__record")
    at = F.coalesce(F.col("created_ms").between(low, high), F.lit(untimed > 0))
    rows = table.before(number).filter(outbox.is_ready(as_of_ms)).filter(at)
    due = staged(rows.select("*", named).join(turn.select(named).hint("merge"), "__record", "left_semi")
                 .dropDuplicates(["__record"]).drop("__record", "batch_id"), "due")
    drop(turn)
    free_shuffles(table.spark)
    return due


def deliver_rounds(table: BatchTable, sink: str, as_of_ms: int, limit: int | None = None, fails: Column | None = None) -> int:
    """Deliver until nothing is due; every round is a batch of the table and a folder of the sink, named by its number.

    A round that failed between the two is done again under its number and writes both anew. A record whose id and type the
    catalog does not allocate to each other fails like one the sink rejects (``fails``), and is due again after its back-off. ``limit``
    is the size of a round per host. Returns how many rounds there were. What a round stages goes with it.
    """
    first = number = table.next_batch()
    while True:
        free_shuffles(table.spark)
        ready = _due(table, number, as_of_ms, limit)
        if ready is None:
            return number - first
        allocated = F.coalesce(is_allocated(F.col("event_id"), F.col("record_type")), F.lit(False))
        outcome = allocated if fails is None else allocated & ~F.coalesce(fails, F.lit(False))
        error = F.when(~allocated, "NotAllocated").otherwise("SinkError")
        state = outbox.apply_delivery(ready, outcome, error, as_of_ms).withColumn("revision", F.col("revision") + 1)
        sinks.deliver(ready.filter(outcome).select(
            "host", "schema_version", "event_id", "record_type", "occurred_ms", F.col("id").alias("record_id"), "scope_hash", "fields", "error"), sink, number)
        table.write(number, state.select(*ready.columns))
        drop(ready)
        number += 1
