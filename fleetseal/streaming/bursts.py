"""Burst collapse on a live stream: fixed event-time windows, one small group per host, window and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.operators.bursts import WINDOW_MS, touches


def _survivors(group: Column, keep_rename_chain: bool) -> Column:
    """Rows of one path's ordered touches that survive; the rule of :func:`fleetseal.operators.bursts.collapse`.

    One fold over the group carries what the touch before was, what the last lasting row was and who survives so far; the last place at which
    a rename leaves the path is worked out ahead of it. Places of survivors are kept as numbers, and rows are picked at the end.
    """
    left_at = F.array_max(F.transform(F.filter(group, lambda o: o["arrives"] == 0), lambda o: o["seq"]))
    # Nothing, a touch that leaves, or the row before: was it a plain deletion?
    start = F.struct(F.lit("none").alias("before"), F.lit(True).alias("fresh_after_leave"), F.array().cast("array<boolean>").alias("kept"), F.col("__left_at").alias("left_at"))

    def step(state: Column, item: Column) -> Column:
        left_later = F.coalesce(state["left_at"] > item["seq"], F.lit(False))
        fresh = F.when(state["before"] == "none", True).when(state["before"] == "left", state["fresh_after_leave"]).otherwise(state["before"] == "deleted")
        renamed_stays = F.lit(True) if keep_rename_chain else ~((item["category"] == "Changed") & left_later)
        arrives = item["arrives"] == 1
        stays = arrives & F.when(item["renamed"], renamed_stays).when(item["category"] == "Changed", fresh & ~left_later).otherwise(True)
        lasting = arrives & F.when(item["renamed"], F.lit(keep_rename_chain)).otherwise(item["category"].isin("Created", "Deleted"))
        deleted = (item["category"] == "Deleted") & ~item["renamed"]
        return F.struct(
            F.when(~arrives, "left").when(deleted, "deleted").otherwise("other").alias("before"),
            F.when(lasting, deleted).otherwise(state["fresh_after_leave"]).alias("fresh_after_leave"),
            F.concat(state["kept"], F.array(stays)).alias("kept"), state["left_at"].alias("left_at"))
    return left_at, F.aggregate(group, start, step, lambda s: s["kept"])


def collapse_stream(notifications: DataFrame, watermark: str = "10 seconds", width: int = WINDOW_MS,
                    keep_rename_chain: bool = False) -> DataFrame:
    """Surviving notifications of each window once it is complete. Needs ``seq`` and ``captured_ms``.

    A window opens on the fixed grid and is never extended. The collected group is what one host did to one path
    inside one window. The same code runs on a batch, where the result equals the batch operator's.
    """
    timed = notifications.withColumn("captured_at", F.timestamp_millis("captured_ms"))
    if notifications.isStreaming:
        timed = timed.withWatermark("captured_at", watermark)
    touch = F.struct("seq", "arrives", "category", F.col("old_path").isNotNull().alias("renamed"),
                     F.struct(*notifications.columns).alias("row"))
    grouped = (touches(timed)
               .groupBy("host", F.window("captured_at", f"{width} milliseconds"), "path_key")
               .agg(F.array_sort(F.collect_list(touch)).alias("__group")))
    left_at, kept = _survivors(F.col("__group"), keep_rename_chain)
    judged = grouped.withColumn("__left_at", left_at).select(F.explode(F.arrays_zip(F.col("__group").alias("item"), kept.alias("kept"))).alias("__s"))
    return judged.filter("__s.kept").select("__s.item.row.*")
