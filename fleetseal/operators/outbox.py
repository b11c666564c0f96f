"""Durable delivery: admission once per record id, ready batches, state changes, retention, backlog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetseal.functions.delivery import backoff_seconds
from fleetseal.functions.paths import has_content
from fleetseal.operators.ordered import HOUR_MS, running

RETENTION_DAYS = 7
DAY_MS = 86_400_000
# Spark limits a ranked window before the shuffle up to this rank.
_LIMITED_EARLY = 1000


def admit(records: DataFrame, existing: DataFrame | None = None, keys: Sequence[str] = ("id",), seq: str = "seq") -> DataFrame:
    """First record of each id that the outbox does not hold yet."""
    rest = [c for c in records.columns if c not in keys]
    first = records.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("__row"))
    flat = first.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*records.columns)
    if existing is None:
        return flat
    # Only ids of this batch are looked up, so the stored side is filtered where it lies when the batch is small.
    known = existing.select(*keys).join(first.select(*keys), list(keys), "left_semi")
    return flat.join(known, list(keys), "left_anti")


def is_ready(as_of_ms: int) -> Column:
    """Undelivered and due."""
    return F.col("delivered_ms").isNull() & (F.col("next_attempt_ms") <= as_of_ms)


def ready_batch(outbox: DataFrame, as_of_ms: int, limit: int | None = 200, by: Sequence[str] = ("host",)) -> DataFrame:
    """The oldest due records of every host, at most ``limit`` each (None: all): one delivery batch. No host is ranked by one task."""
    if limit is None:
        return outbox.filter(is_ready(as_of_ms))
    # Records without a time come first.
    due = outbox.filter(is_ready(as_of_ms)).withColumn("__at", F.coalesce("created_ms", F.lit(-(2**62))).cast("bigint"))
    if limit <= _LIMITED_EARLY:
        # Of an hour of a host no more rows than that can be among the oldest; the others are left out before the shuffle.
        hour = Window.partitionBy(*by, F.floor(F.col("__at") / HOUR_MS)).orderBy("__at", "id")
        due = due.withColumn("__early", F.rank().over(hour)).filter(F.col("__early") <= limit).drop("__early")
    ranked = running(due, by, ["__at", "id"], {"__rank": ("sum", F.lit(1))})
    return ranked.filter(F.col("__rank") <= limit).drop("__rank", "__at")


def pending_results(results: DataFrame, limit: int | None = 500, by: Sequence[str] = ("host",)) -> DataFrame:
    """Undelivered reconciliation results, oldest first, at most ``limit`` per host (None: all)."""
    if limit is None:
        return results.filter("delivered_ms IS NULL")
    oldest = Window.partitionBy(*by).orderBy("detected_ms", "id")
    return (results.filter("delivered_ms IS NULL").withColumn("__rank", F.row_number().over(oldest))
            .filter(F.col("__rank") <= limit).drop("__rank"))


def apply_delivery(outbox: DataFrame, outcome: Column, error: Column, as_of_ms: int) -> DataFrame:
    """State after one delivery round.

    ``outcome`` is true (delivered), false (failed) or null (not tried); ``error`` names a failure. A record without
    a record type cannot be delivered and is closed with a reason.
    """
    tried = outcome.isNotNull() & is_ready(as_of_ms)
    blank = tried & ~has_content(F.col("record_type"))
    failed = tried & ~blank & ~outcome
    attempts = F.col("delivery_attempts") + F.when(tried, 1).otherwise(0)
    changed = {
        "delivery_attempts": attempts,
        "delivered_ms": F.when(tried & ~failed, F.lit(as_of_ms)).otherwise(F.col("delivered_ms")),
        "next_attempt_ms": F.when(failed, F.lit(as_of_ms) + backoff_seconds(attempts).cast("bigint") * 1000)
        .otherwise(F.col("next_attempt_ms")),
        "last_error": F.when(blank, "EmptyRecordType").when(failed, error).when(tried, None)
        .otherwise(F.col("last_error") if "last_error" in outbox.columns else F.lit(None).cast("string")),
    }
    return outbox.select(*[c for c in outbox.columns if c not in changed], *[v.alias(k) for k, v in changed.items()])


def record_attempts(results: DataFrame, published: Column, as_of_ms: int) -> DataFrame:
    """Reconciliation results after a publish round: one more attempt each, delivered where it worked."""
    tried = F.col("delivered_ms").isNull() & published.isNotNull()
    return results.withColumns({
        "delivery_attempts": F.col("delivery_attempts") + F.when(tried, 1).otherwise(0),
        "delivered_ms": F.when(tried & published, F.lit(as_of_ms)).otherwise(F.col("delivered_ms"))})


def retain(outbox: DataFrame, as_of_ms: int, days: int = RETENTION_DAYS) -> DataFrame:
    """Drop what was delivered longer ago than the retention; pending records always stay."""
    cutoff = as_of_ms - max(1, days) * DAY_MS
    return retain_since(outbox, cutoff)


def retain_since(outbox: DataFrame, cutoff_ms: int) -> DataFrame:
    """The same with an explicit cut-off."""
    return outbox.filter(F.col("delivered_ms").isNull() | (F.col("delivered_ms") >= cutoff_ms))


def backlog(outbox: DataFrame, as_of_ms: int, by: Sequence[str] = ("host",)) -> DataFrame:
    """Pending count, and creation time and age of the oldest pending record."""
    pending = F.col("delivered_ms").isNull()
    return outbox.groupBy(*by).agg(
        F.count_if(pending).alias("pending"), F.min(F.when(pending, F.col("created_ms"))).alias("oldest_ms"),
    ).withColumn("oldest_age_ms", F.coalesce(F.lit(as_of_ms) - F.col("oldest_ms"), F.lit(0).cast("bigint")))
