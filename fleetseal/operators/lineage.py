"""Baseline generations: which one to compare with, which to keep, and whether their life cycle was legal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetseal.operators.ordered import DEFAULT_WIDTHS, Scan, previous_row, running

LINEAGE = ("source", "scope_hash", "source_identity", "schema_version", "algorithm")

# Allowed status transitions; the empty text stands for "no row before".
TRANSITIONS = (
    ("", "Building"), ("Building", "Reconciling"), ("Reconciling", "Complete"),
    ("Building", "Invalid"), ("Reconciling", "Invalid"),
)


def latest_complete(baselines: DataFrame, lineage: Sequence[str] = ("host", *LINEAGE)) -> DataFrame:
    """Newest Complete and Current baseline of every lineage (ties: greatest id)."""
    usable = baselines.filter("status = 'Complete' AND applicability = 'Current'")
    others = [c for c in baselines.columns if c not in lineage]
    best = usable.groupBy(*lineage).agg(
        F.max_by(F.struct(*others), F.struct("completed_ms", "id")).alias("__row"))
    return best.select(*lineage, *[F.col(f"__row.{c}").alias(c) for c in others]).select(*baselines.columns)


def reinstate_fallback(baselines: DataFrame, fallback: DataFrame, lineage: Sequence[str] = ("host", *LINEAGE)) -> DataFrame:
    """Make the newest Complete baseline of each fallback lineage Current again.

    An id names a baseline within its host. ``fallback`` holds the runs (id and lineage, one per lineage) that could not use their preferred algorithm.
    """
    runs = fallback.select(*lineage, F.col("id").alias("__run"))
    newest = (baselines.filter("status = 'Complete'").join(runs, list(lineage))
              .filter(F.col("id") != F.col("__run"))
              .groupBy(*lineage).agg(F.max_by("id", F.struct("completed_ms", "id")).alias("id")))
    flipped = newest.select("host", "id").withColumn("__flip", F.lit(True))
    joined = baselines.join(flipped, ["host", "id"], "left")
    applicability = F.when(F.col("__flip"), F.lit("Current")).otherwise(F.col("applicability"))
    return joined.withColumn("applicability", applicability).select(*baselines.columns)


def retention(baselines: DataFrame, results: DataFrame, generations: int = 2,
              lineage: Sequence[str] = ("host", *LINEAGE)) -> DataFrame:
    """What compaction does with each baseline: ``keep``, ``drop_members`` or ``delete``.

    The newest complete generations of each lineage stay whole. Everything else loses its members; its metadata and
    results go too, unless an undelivered result still needs them. ``results`` is (host, baseline_id, delivered_ms).
    """
    newest = Window.partitionBy(*lineage).orderBy(F.col("completed_ms").desc(), F.col("id").desc())
    kept = (baselines.filter("status = 'Complete'").withColumn("__rank", F.row_number().over(newest))
            .filter(F.col("__rank") <= max(1, generations)).select("host", "id").withColumn("__keep", F.lit(True)))
    undelivered = (results.filter("delivered_ms IS NULL").select("host", F.col("baseline_id").alias("id")).distinct()
                   .withColumn("__pending", F.lit(True)))
    action = F.when(F.col("__keep"), "keep").when(F.col("__pending"), "drop_members").otherwise("delete")
    return (baselines.join(kept, ["host", "id"], "left").join(undelivered, ["host", "id"], "left")
            .select(*baselines.columns, action.alias("action")))


def supersede(baselines: DataFrame, begun: DataFrame, by: Sequence[str] = ("host", "source"),
              lineage: Sequence[str] = LINEAGE) -> DataFrame:
    """A run that begins makes every Complete baseline of its source with another lineage Superseded.

    ``begun`` has one row per ``by`` with the lineage columns of the new run.
    """
    rest = [c for c in lineage if c not in by]
    started = begun.select(*by, F.lit(True).alias("__begun"), *[F.col(c).alias(f"__new_{c}") for c in rest])
    joined = baselines.join(started, list(by), "left")
    same = F.lit(True)
    for c in rest:
        same = same & F.col(c).eqNullSafe(F.col(f"__new_{c}"))
    replaced = F.col("__begun") & (F.col("status") == "Complete") & ~same
    applicability = F.when(replaced, F.lit("Superseded")).otherwise(F.col("applicability"))
    return joined.withColumn("applicability", applicability).select(*baselines.columns)


def comparable_pairs(current: DataFrame, baselines: DataFrame, lineage: Sequence[str] = LINEAGE) -> DataFrame:
    """(host, baseline_id, previous_baseline_id) for running baselines that have something to compare with."""
    keys = ["host", *lineage]
    previous = latest_complete(baselines, keys).select(*keys, F.col("id").alias("previous_baseline_id"))
    return current.select(*keys, F.col("id").alias("baseline_id")).join(previous, keys)


def lifecycle_violations(log: DataFrame, key: str, order: Sequence[str], widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """Status changes that are not an allowed transition."""
    stepped = previous_row(log, [key], order, ["status"], "__before", widths)
    before = F.coalesce(F.col("__before.status"), F.lit(""))
    allowed = F.lit(False)
    for old, new in TRANSITIONS:
        allowed = allowed | ((before == old) & (F.col("status") == new))
    return stepped.filter(~allowed).select(*log.columns, before.alias("previous_status"))


def run_health(runs: DataFrame, keys: Sequence[str], order: Sequence[str], success: Column, failure: Column,
               duration: Column | None = None, widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """After each run: consecutive failures since the last success, and time and duration of that success.

    ``order[0]`` is the time of the run. A run that is neither success nor failure is still going.
    """
    failed = F.when(failure, 1).otherwise(0).cast("bigint")
    scans = {
        "consecutive_failures": Scan("since", failed, reset=success),
        "last_success_ms": Scan("max", F.when(success, F.col(order[0]))),
    }
    if duration is not None:
        scans["last_duration_ms"] = Scan("last", F.when(success, duration))
    return running(runs, keys, order, scans, widths).withColumn(
        "running", ~(F.coalesce(success, F.lit(False)) | F.coalesce(failure, F.lit(False))))


def current_run_health(runs: DataFrame, keys: Sequence[str], order: Sequence[str], success: Column, failure: Column,
                       duration: Column | None = None, widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """State after the newest run of each key."""
    states = run_health(runs, keys, order, success, failure, duration, widths)
    columns = [c for c in ("running", "consecutive_failures", "last_success_ms", "last_duration_ms") if c in states.columns]
    newest = states.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__s"))
    return newest.select(*keys, "__s.*")
