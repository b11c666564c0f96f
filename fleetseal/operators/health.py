"""Is the coverage known? Counters, losses, missing heartbeats, open gaps, overdue inventories, qualification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.operators.bursts import fixed_window
from fleetseal.operators.ordered import DEFAULT_WIDTHS, Scan, previous_row, running

HEARTBEAT_MS = 60_000


def pipeline_counters(log: DataFrame, width: int = HEARTBEAT_MS, widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """Per host and window: accepted, processed, dropped, failures, and the queue depth at its end.

    ``log`` is (host, t_ms, kind) with kind accepted, processed, dropped or failed. Counts combine before the
    shuffle; only the window totals are then scanned in order.
    """
    kind = F.col("kind")
    totals = log.groupBy("host", fixed_window(F.col("t_ms"), width).alias("window_ms")).agg(
        F.count_if(kind == "accepted").alias("accepted"), F.count_if(kind == "processed").alias("processed"),
        F.count_if(kind == "dropped").alias("dropped"), F.count_if(kind == "failed").alias("enrichment_failures"))
    change = F.col("accepted") - F.col("processed") - F.col("enrichment_failures")
    return running(totals, ["host"], ["window_ms"], {"queue_depth": ("sum", change)}, widths)


def oldest_item_age(queue: DataFrame, as_of_ms: int) -> DataFrame:
    """Age of the oldest item still queued per host: (host, captured_ms, completed_ms)."""
    waiting = (F.col("captured_ms") <= as_of_ms) & (F.col("completed_ms").isNull() | (F.col("completed_ms") > as_of_ms))
    return queue.groupBy("host").agg(F.min(F.when(waiting, F.col("captured_ms"))).alias("oldest_ms")).select(
        "host", F.coalesce(F.lit(as_of_ms) - F.col("oldest_ms"), F.lit(0).cast("bigint")).alias("oldest_age_ms"))


def loss_deltas(counters: DataFrame, keys: Sequence[str], order: Sequence[str], total: str,
                widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """Rows where a cumulative loss counter grew, and by how much."""
    stepped = previous_row(counters, keys, order, [total], "__before", widths)
    delta = F.col(total) - F.coalesce(F.col(f"__before.{total}"), F.lit(0))
    return stepped.select(*counters.columns, delta.alias("lost_count")).filter("lost_count > 0")


def heartbeat_gaps(beats: DataFrame, interval_ms: int, as_of_ms: int | None = None,
                   widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """Alerts from (host, t_ms, dropped, enrichment_failures, oldest_age_ms) beats.

    Missing beats (more than two intervals, also up to ``as_of_ms``), a queue older than one interval, and growing
    drops or failures.
    """
    stepped = previous_row(beats, ["host"], ["t_ms"], ["t_ms", "dropped", "enrichment_failures"], "__b", widths)
    gap = F.col("t_ms") - F.col("__b.t_ms")
    alerts = F.array_compact(F.array(
        F.when(gap > 2 * interval_ms, F.struct(F.lit("MissingHeartbeat").alias("reason"), gap.alias("amount"))),
        F.when(F.col("oldest_age_ms") > interval_ms, F.struct(F.lit("QueueAge").alias("reason"), F.col("oldest_age_ms").alias("amount"))),
        F.when(F.col("dropped") > F.col("__b.dropped"),
               F.struct(F.lit("Dropped").alias("reason"), (F.col("dropped") - F.col("__b.dropped")).alias("amount"))),
        F.when(F.col("enrichment_failures") > F.col("__b.enrichment_failures"),
               F.struct(F.lit("EnrichmentFailures").alias("reason"),
                        (F.col("enrichment_failures") - F.col("__b.enrichment_failures")).alias("amount")))))
    found = stepped.select("host", "t_ms", F.explode(alerts).alias("a")).select("host", "t_ms", "a.reason", "a.amount")
    if as_of_ms is None:
        return found
    silent = beats.groupBy("host").agg(F.max("t_ms").alias("t_ms")).select(
        "host", "t_ms", F.lit("MissingHeartbeat").alias("reason"), (F.lit(as_of_ms) - F.col("t_ms")).alias("amount"))
    return found.unionByName(silent.filter(F.col("amount") > 2 * interval_ms))


def unresolved_gaps(records: DataFrame, keys: Sequence[str] = ("host", "scope"), time: str = "seq") -> DataFrame:
    """Coverage gaps with no recovery at or after them for the same scope."""
    recovered = records.filter("record_type = 'SourceRecovered'").groupBy(*keys).agg(F.max(time).alias("__recovered"))
    gaps = records.filter("record_type = 'CoverageGap'").join(recovered, list(keys), "left")
    still_open = F.col("__recovered").isNull() | (F.col("__recovered") < F.col(time))
    return gaps.filter(still_open).select(*records.columns)


def overdue_transitions(checks: DataFrame, keys: Sequence[str], order: Sequence[str], interval_ms: Column | int,
                        widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """Only the checks where an inventory becomes overdue or current again.

    ``checks`` is (keys, t_ms, success_ms, started_ms); ``success_ms`` is the time of a success first seen by the
    check, else null. Overdue means twice the interval without success, or one interval after a start that never
    succeeded.
    """
    interval = F.lit(interval_ms) if isinstance(interval_ms, int) else interval_ms
    time, started = F.col("t_ms"), F.col("started_ms")

    def overdue(at: Column, last_success: Column, start: Column) -> Column:
        return F.coalesce(F.when(last_success.isNotNull(), at - last_success > interval * 2).otherwise(at - start > interval), F.lit(False))

    # The state of the check before comes from the same scan: its time and start, and the newest success until then.
    stepped = running(checks, keys, order, {
        "__success": Scan("max", F.col("success_ms")),
        "__success_before": Scan("max", F.col("success_ms"), inclusive=False),
        "__b": Scan("last", F.struct("t_ms", "started_ms"), inclusive=False)}, widths)
    now = overdue(time, F.col("__success"), started)
    before = F.col("__b").isNotNull() & overdue(F.col("__b.t_ms"), F.col("__success_before"), F.col("__b.started_ms"))
    return (stepped.withColumns({"overdue": now, "__was": before}).filter(F.col("overdue") != F.col("__was"))
            .select(*checks.columns, F.when(F.col("overdue"), "CoverageGap").otherwise("SourceRecovered").alias("record_type"),
                    F.when(F.col("overdue"), "BaselineOverdue").otherwise("BaselineCurrent").alias("reason")))


_QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def qualification(latencies: DataFrame, keys: Sequence[str] = ("host",), latency: str = "latency_ms", widths: Sequence[int] = (1000, 1_000_000)) -> DataFrame:
    """Exact p50, p95, p99 of whole-millisecond latencies per host, between two values by linear interpolation.

    Distributed selection: values are counted, counts are summed up in order of value within chunks of ``widths`` ms, and the values are picked
    in which the wanted ranks fall. No task holds the values of a host. Null latencies count as events only.
    """
    keys = list(keys)
    counted = latencies.groupBy(*keys, latency).agg(F.count("*").alias("n"))
    whole = counted.groupBy(*keys).agg(F.sum("n").alias("events"), F.max(latency).alias("max_ms"), F.sum(F.when(F.col(latency).isNotNull(), F.col("n"))).alias("__known"))
    placed = running(counted.filter(F.col(latency).isNotNull()), keys, [latency], {"__upto": ("sum", F.col("n"))}, widths)
    renamed = whole.withColumnsRenamed({k: f"__w_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__w_{k}"))
    value, before = F.col(latency).cast("double"), F.col("__upto") - F.col("n")
    at = {name: share * (F.col("__known") - 1) for name, share in _QUANTILES.items()}
    holds = lambda rank: (before <= rank) & (rank < F.col("__upto"))
    picked = renamed.join(placed, same, "left").groupBy(*[f"__w_{k}" for k in keys], "events", "max_ms", "__known").agg(
        *[F.max(F.when(holds(side(rank)), value)).alias(f"{name}_{end}") for name, rank in at.items() for end, side in (("low", F.floor), ("high", F.ceil))])

    def between(name: str) -> Column:
        rank, low, high = at[name], F.col(f"{name}_low"), F.col(f"{name}_high")
        return F.when(low == high, low).otherwise((F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high).alias(name)
    return picked.select(*[F.col(f"__w_{k}").alias(k) for k in keys], "events", "max_ms", *[between(name) for name in _QUANTILES])


def peak_rates(events: DataFrame, keys: Sequence[str] = ("host",), time: str = "t_ms",
               burst_ms: int = 60_000, sustained_ms: int = 1_800_000) -> DataFrame:
    """Most events in any burst window and in any sustained window, per host.

    Short windows are counted first; long ones are sums of them. The long window must be a multiple of the short.
    """
    if sustained_ms % burst_ms:
        raise ValueError("the sustained window must be a multiple of the burst window")
    bursts = events.groupBy(*keys, fixed_window(F.col(time), burst_ms).alias("burst")).agg(F.count("*").alias("n"))
    sustained = bursts.groupBy(*keys, fixed_window(F.col("burst"), sustained_ms).alias("long")).agg(
        F.sum("n").alias("n"), F.max("n").alias("burst_n"))
    return sustained.groupBy(*keys).agg(F.max("burst_n").alias("burst_events"), F.max("n").alias("sustained_events"))


def peak_depth(log: DataFrame, keys: Sequence[str], order: Sequence[str], change: Column,
               widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """Greatest queue depth ever reached per key, from +1 / -1 changes in order."""
    depth = running(log, keys, order, {"__depth": ("sum", change)}, widths)
    return depth.groupBy(*keys).agg(F.max("__depth").alias("max_depth"))


def coalesce_requests(requests: DataFrame, run_starts: DataFrame, keys: Sequence[str] = ("host", "source"),
                      time: str = "t_ms", widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """One pending snapshot request per source and run interval: the first reason wins, the next run takes it.

    ``requests`` is (keys, t_ms, reason), ``run_starts`` is (keys, t_ms); a run takes what was asked before it.
    """
    asked = requests.select(*keys, time, "reason", F.lit(0).alias("__run"))
    runs = run_starts.select(*keys, time, F.lit(None).cast("string").alias("reason"), F.lit(1).alias("__run"))
    numbered = running(asked.unionByName(runs), keys, [time, "__run", "reason"], {
        "run_number": ("sum", F.col("__run").cast("bigint"))}, widths, inclusive=False)
    first = F.struct(time, "reason")
    return (numbered.filter("__run = 0")
            .withColumn("run_number", F.coalesce("run_number", F.lit(0).cast("bigint")))
            .groupBy(*keys, "run_number")
            .agg(F.min(time).alias("first_ms"), F.min_by("reason", first).alias("reason"), F.count("*").alias("requests")))
