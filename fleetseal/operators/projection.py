"""The latest state of every entity, and what was known about it before a change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.functions.paths import normalize_entity
from fleetseal.operators.ordered import DEFAULT_WIDTHS, running

KEY = ("host", "normalized_entity")
EVIDENCE = ("current_hash", "acls", "size_bytes", "object_type")


def latest_by_entity(changes: DataFrame, keys: Sequence[str] = KEY, time: str = "t_ms", seq: str = "seq") -> DataFrame:
    """Newest change per entity, ignoring case; of equal times the first seen stays."""
    keyed = changes.withColumn("normalized_entity", normalize_entity(F.col("entity")))
    others = [c for c in keyed.columns if c not in keys]
    best = keyed.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(time), -F.col(seq))).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])


def dedupe_projection(projection: DataFrame, order: Sequence[str] = ("t_ms", "seq")) -> DataFrame:
    """One-time clean-up: rewrite the key and keep the newest row of each entity."""
    return latest_by_entity(projection.drop("normalized_entity"), KEY, order[0], order[1])


def projection_operations(batch: DataFrame) -> DataFrame:
    """What a batch does to the projection: a row to put per latest entity, a removal per renamed-away path."""
    latest = latest_by_entity(batch)
    puts = latest.withColumn("present", F.lit(True))
    away = normalize_entity(F.col("old_path"))
    gone = (latest.filter(F.col("old_path").isNotNull() & (away != F.col("normalized_entity")))
            .withColumn("normalized_entity", away).withColumn("present", F.lit(False)))
    return puts.unionByName(gone)


def latest_state(changes: DataFrame) -> DataFrame:
    """Projection after a batch: newest change per entity, without the paths its renames left behind."""
    return merge_operations(projection_operations(changes).withColumn("batch_id", F.lit(0))).drop("batch_id")


def merge_operations(operations: DataFrame) -> DataFrame:
    """Resolve accumulated operations: the last batch wins, within it the newest. Removed entities drop out."""
    others = [c for c in operations.columns if c not in KEY]
    order = F.struct("batch_id", "t_ms", "seq", ~F.col("present"))
    best = operations.groupBy(*KEY).agg(F.max_by(F.struct(*others), order).alias("__row"))
    flat = best.select(*KEY, *[F.col(f"__row.{c}").alias(c) for c in others])
    return flat.filter("present").drop("present")


def previous_evidence(changes: DataFrame, evidence: Sequence[str] = EVIDENCE,
                      widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """Hash, access list, size and type known before each change, for a backfill over many changes.

    A rename looks under its old path. A renamed-away path is forgotten, so what comes next there sees nothing.
    """
    entity = normalize_entity(F.col("entity"))
    away = normalize_entity(F.col("old_path"))
    evidence = [c for c in evidence if c in changes.columns]
    known = F.struct(F.lit(True).alias("present"), *[F.col(c) for c in evidence])
    empty = F.struct(F.lit(False).alias("present"),
                     *[F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in evidence])
    # One pass over the changes yields the look-up of each change, what it leaves at its entity, and what a rename
    # clears at its old path; at equal times the look-up comes first.
    look = F.struct(F.coalesce(away, entity).alias("key"), F.lit(0).alias("rank"), F.lit(None).alias("state"), F.struct(*changes.columns).alias("row"))
    put = F.struct(entity.alias("key"), F.lit(1).alias("rank"), known.alias("state"), F.lit(None).alias("row"))
    clear = F.when(away.isNotNull() & (away != entity),
                   F.struct(away.alias("key"), F.lit(1).alias("rank"), empty.alias("state"), F.lit(None).alias("row")))
    steps = (changes.select("host", "t_ms", "seq", F.explode(F.array_compact(F.array(look, put, clear))).alias("__s"))
             .select("host", F.col("__s.key").alias("__key"), "t_ms", "seq", F.col("__s.rank").alias("__rank"),
                     F.col("__s.state").alias("__state"), F.col("__s.row").alias("__row")))
    order = ["t_ms", "seq", "__rank"]
    scanned = running(steps, ["host", "__key"], order, {"__prev": ("last", F.col("__state"))}, widths)
    found = scanned.filter("__row IS NOT NULL")
    prev = F.when(F.col("__prev.present"), F.col("__prev"))
    out = [F.col(f"__row.{c}").alias(c) for c in changes.columns if c != "object_type" or "object_type" not in evidence]
    if "object_type" in evidence:
        out.append(F.when(F.col("__row.change_category") == "Deleted", F.coalesce(prev["object_type"], F.col("__row.object_type")))
                   .otherwise(F.col("__row.object_type")).alias("object_type"))
    names = {"current_hash": ("previous_hash", True), "acls": ("previous_acl", True),
             "size_bytes": ("previous_size_bytes", False), "current_size_bytes": ("previous_size_bytes", False)}
    for column in evidence:
        if column in names:
            name, blank = names[column]
            value = F.coalesce(prev[column], F.lit("")) if blank else prev[column]
            out.append(value.alias(name))
    return found.select(*out)


def lookup(operations: DataFrame, keys: DataFrame) -> DataFrame:
    """Projection rows of the given (host, normalized_entity) keys, resolved from accumulated operations.

    Operations of other entities are filtered out before anything is merged or shuffled.
    """
    return merge_operations(operations.join(keys.select(*KEY).distinct(), list(KEY), "left_semi"))


def attach_previous(batch: DataFrame, operations: DataFrame) -> DataFrame:
    """The same for a live batch: look the entity (or the old path of a rename) up in the stored projection."""
    keyed = batch.withColumn("__key", normalize_entity(F.coalesce("old_path", "full_path")))
    wanted = keyed.select("host", F.col("__key").alias("normalized_entity"))
    known = lookup(operations, wanted).select(
        "host", F.col("normalized_entity").alias("__key"), F.col("current_hash").alias("__hash"),
        F.col("acls").alias("__acl"), F.col("current_size_bytes").alias("__size"), F.col("object_type").alias("__type"))
    joined = keyed.join(known, ["host", "__key"], "left")
    return (joined.withColumn("previous_hash", F.coalesce("__hash", F.lit("")))
            .withColumn("previous_acl", F.coalesce("__acl", F.lit("")))
            .withColumn("previous_size_bytes", F.col("__size"))
            .withColumn("object_type", F.when(F.col("change_category") == "Deleted", F.coalesce("__type", "object_type"))
                        .otherwise(F.col("object_type")))
            .select(*dict.fromkeys([*batch.columns, "previous_hash", "previous_acl", "previous_size_bytes"])))


def attach_previous_acl(batch: DataFrame, operations: DataFrame) -> DataFrame:
    """Access list of a registry key in the projection as the batch found it; "" when unknown."""
    keyed = batch.withColumn("normalized_entity", normalize_entity(F.col("entity")))
    known = lookup(operations, keyed).select("host", "normalized_entity", F.col("acls").alias("__acl"))
    joined = keyed.join(known, list(KEY), "left")
    return joined.withColumn("previous_acl", F.coalesce("__acl", F.lit(""))).select(
        *dict.fromkeys([*batch.columns, "previous_acl"]))


def previous_acl_by_batch(changes: DataFrame, batch: Column, widths: Sequence[int] = (1000, 1_000_000)) -> DataFrame:
    """Backfill of the same: every change of a batch sees the state the batches before it left."""
    keyed = changes.withColumn("normalized_entity", normalize_entity(F.col("entity"))).withColumn("__batch", batch)
    ended = keyed.groupBy("host", "normalized_entity", "__batch").agg(
        F.max_by("acls", F.struct(F.col("t_ms"), -F.col("seq"))).alias("__acl"))
    carried = running(ended, ["host", "normalized_entity"], ["__batch"], {"__before": ("last", F.col("__acl"))},
                      widths, inclusive=False).select("host", "normalized_entity", "__batch", "__before")
    joined = keyed.join(carried, ["host", "normalized_entity", "__batch"], "left")
    return joined.select(*changes.columns, F.coalesce("__before", F.lit("")).alias("previous_acl"))
