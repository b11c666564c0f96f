"""Discovery inventory: attribute mask, entities not known yet, entities whose hash changed, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.functions.paths import normalize_entity

# Attribute bits of entries discovery leaves out.
EXCLUDED_ATTRIBUTES = {
    "System": 0x4, "Directory": 0x10, "Device": 0x40, "Temporary": 0x100,
    "SparseFile": 0x200, "ReparsePoint": 0x400, "Offline": 0x1000,
}
EXCLUDED_MASK = sum(EXCLUDED_ATTRIBUTES.values())


def is_plain_file(attributes: Column) -> Column:
    """None of the excluded attribute bits is set."""
    return attributes.bitwiseAND(EXCLUDED_MASK) == 0


def new_entities(found: DataFrame, projection: DataFrame, host: Sequence[str] = ("host",)) -> DataFrame:
    """Discovered paths the projection does not know, ignoring case."""
    known = projection.select(*host, normalize_entity(F.col("entity")).alias("__key"))
    return (found.withColumn("__key", normalize_entity(F.col("path")))
            .join(known, [*host, "__key"], "left_anti").drop("__key"))


def hash_changed(found: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Discovered entries whose hash is not the previous one, ignoring case; no previous row reads as ""."""
    before = previous.select(*keys, F.col("content_hash").alias("previous_hash"))
    joined = found.join(before, list(keys), "left").withColumn("previous_hash", F.coalesce("previous_hash", F.lit("")))
    return joined.filter(~F.upper("content_hash").eqNullSafe(F.upper("previous_hash")))


def statistics(found: DataFrame, kept: Column, by: Sequence[str] = ()) -> DataFrame:
    """Total, kept, filtered out and its percentage (0 for an empty inventory)."""
    counts = [F.count("*").alias("total"), F.count_if(kept).alias("kept")]
    out = found.groupBy(*by).agg(*counts) if by else found.agg(*counts)
    filtered = F.col("total") - F.col("kept")
    return out.select(*by, "total", "kept", filtered.alias("filtered_out"),
                      F.when(F.col("total") == 0, 0.0).otherwise(F.round(filtered * 100.0 / F.col("total"), 2))
                      .cast("double").alias("percentage"))
