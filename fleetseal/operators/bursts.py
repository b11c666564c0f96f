"""Bursts of raw notifications: rename halves, collapse inside a window, admission accounting, threshold counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetseal.functions.paths import normalize_entity

WINDOW_MS = 75
CAPACITY = 8192


def fixed_window(time: Column, width: int = WINDOW_MS) -> Column:
    """Start of the fixed window a time falls in; activity never extends it."""
    return time - F.pmod(time, F.lit(width))


def normalize_renames(pairs: DataFrame, old_in_scope: Column, new_in_scope: Column) -> DataFrame:
    """Reduce rename pairs (old_path, new_path) to notifications, hiding the half that is out of scope.

    Both halves make a Changed with both paths, the old half alone a Deleted, the new half alone a Created; a pair
    without a visible half disappears.
    """
    rest = [c for c in pairs.columns if c not in ("old_path", "new_path", "full_path", "category")]
    # The halves are columns of their own first, so that each scope test is worked out once.
    halves = pairs.select(*rest, F.when(F.coalesce(old_in_scope, F.lit(False)), F.col("old_path")).alias("__old"),
                          F.when(F.coalesce(new_in_scope, F.lit(False)), F.col("new_path")).alias("__new")).filter("__old IS NOT NULL OR __new IS NOT NULL")
    old, new = F.col("__old"), F.col("__new")
    both = old.isNotNull() & new.isNotNull()
    return halves.select(
        *rest, F.coalesce(new, old).alias("full_path"),
        F.when(both, "Changed").when(old.isNotNull(), "Deleted").otherwise("Created").alias("category"),
        F.when(both, old).alias("old_path"), F.when(both, new).alias("new_path"))


def touches(notifications: DataFrame, path: str = "full_path", old_path: str = "old_path") -> DataFrame:
    """A row per path a notification touches: the path it is about, and the old path a rename leaves.

    Whether a notification survives depends only on the touches of its own path, so a burst can be collapsed path by
    path and no window has to be gathered whole.
    """
    leaves = F.struct(normalize_entity(F.col(old_path)).alias("path_key"), F.lit(0).alias("arrives"))
    about = F.struct(normalize_entity(F.col(path)).alias("path_key"), F.lit(1).alias("arrives"))
    both = F.when(F.col(old_path).isNotNull(), F.array(leaves, about)).otherwise(F.array(about))
    return notifications.select("*", F.explode(both).alias("__t")).select(
        *notifications.columns, F.col("__t.path_key").alias("path_key"), F.col("__t.arrives").alias("arrives"))


def collapse(notifications: DataFrame, window: Sequence[str], seq: str = "seq", keep_rename_chain: bool = False) -> DataFrame:
    """Notifications that survive their window, in arrival order ``seq``.

    A rename removes the earlier Changed rows (renames included) of its old path and stays itself. A Changed goes
    when the last surviving row of its path is a Created, a Changed or a rename. Created and Deleted always stay.
    ``keep_rename_chain`` keeps every rename, also one whose target is renamed again.
    """
    arrives = F.col("arrives") == 1
    renamed = F.col("old_path").isNotNull()
    # Rows a rename away from their path does not remove, and what the last of them was.
    lasting = F.col("category").isin("Created", "Deleted") & ~renamed
    lasting = lasting | renamed if keep_rename_chain else lasting
    kind = F.when(renamed, "Renamed").otherwise(F.col("category"))
    by_path = Window.partitionBy(*window, "path_key")
    ordered = by_path.orderBy(seq, "arrives")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    marked = (
        touches(notifications)
        .withColumn("__before", F.lag(F.struct("arrives", "category", F.col("old_path").isNotNull().alias("renamed"))).over(ordered))
        .withColumn("__lasting", F.last(F.when(arrives & lasting, kind), ignorenulls=True).over(before))
        .withColumn("__left_at", F.max(F.when(~arrives, F.col(seq))).over(by_path)))
    was = F.col("__before")
    was_deleted = (was["category"] == "Deleted") & ~was["renamed"]
    starts_fresh = (
        F.when(was.isNull(), True)
        .when(was["arrives"] == 1, was_deleted)
        .otherwise(F.coalesce(F.col("__lasting") == "Deleted", F.lit(True))))
    left_later = F.coalesce(F.col("__left_at") > F.col(seq), F.lit(False))
    changed = (F.col("category") == "Changed") & ~renamed
    survives = (
        F.when(renamed, F.lit(True) if keep_rename_chain else ~((F.col("category") == "Changed") & left_later))
        .when(changed, starts_fresh & ~left_later)
        .otherwise(True))
    return marked.filter(arrives & survives).select(*notifications.columns)


def admission_gaps(notifications: DataFrame, window: Sequence[str], capacity: int = CAPACITY, time: str = "t_ms") -> DataFrame:
    """One row per window that got more than the capacity: what was admitted and what was shed."""
    counted = notifications.groupBy(*window).agg(
        F.count("*").alias("offered"), F.min(time).alias("first_ms"), F.max(time).alias("last_ms"))
    return counted.filter(F.col("offered") > capacity).select(
        *window, F.lit(capacity).cast("bigint").alias("admitted"),
        (F.col("offered") - capacity).alias("lost_count"), "first_ms", "last_ms")


def burst_aggregation(events: DataFrame, keys: Sequence[str], time: str = "t_ms", record_id: str = "id",
                      threshold: int = 100, width: int = 10_000) -> DataFrame:
    """Groups that reach the threshold inside a fixed window, with the first record as a sample."""
    start = fixed_window(F.col(time), width)
    return (events.groupBy(*keys, start.alias("window_started_ms"))
            .agg(F.count("*").alias("count"), F.min_by(record_id, F.struct(time, record_id)).alias("sample_record_id"))
            .filter(F.col("count") >= threshold)
            .withColumn("window_ended_ms", F.col("window_started_ms") + width))
