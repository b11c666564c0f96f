"""Effective settings: precedence, validation reports and change detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.functions.paths import has_content
from fleetseal.operators.ordered import DEFAULT_WIDTHS, previous_row
from fleetseal.operators.scope import expand_environment

# Names of the hives.
HIVES = ("HKEY_LOCAL_MACHINE", "HKEY_CURRENT_USER", "HKEY_USERS", "HKEY_CURRENT_CONFIG", "HKEY_CLASSES_ROOT")
# Keys that hold the engine's own configuration; they are always monitored and can never be excluded.
PROTECTED_KEYS = ("HKEY_LOCAL_MACHINE\\SOFTWARE\\Policies\\Fleetseal", "HKEY_LOCAL_MACHINE\\SOFTWARE\\Fleetseal")

# Allowed bounds of numeric settings (null = no upper bound).
BOUNDS = {
    "CaptureQueueCapacity": (1, None),
    "DiscoveryConcurrency": (1, 64),
    "WatcherBufferSizeKB": (8, 64),
    "ScopeReresolutionInterval": (10, None),
    "FileSystemSnapshotInterval": (60, None),
    "RegistrySnapshotInterval": (60, None),
}
# Settings whose change starts a new generation.
GENERATION_FIELDS = (
    "enable_local_database", "enable_registry", "integrity_mode", "integrity_public_key", "hash_limit_mb",
    "heartbeat_interval", "capture_queue_capacity", "discovery_concurrency", "watcher_buffer_kb",
    "scope_reresolution_interval", "file_snapshot_interval", "registry_snapshot_interval", "scope_hash",
)


def effective(policy: DataFrame, preference: DataFrame, legacy: DataFrame, keys: Sequence[str] = ("host", "name")) -> DataFrame:
    """Value by value: policy, else preference, else legacy. Each input is (host, name, value)."""
    layers = (policy.select(*keys, "value", F.lit(0).alias("__layer"))
              .unionByName(preference.select(*keys, "value", F.lit(1).alias("__layer")))
              .unionByName(legacy.select(*keys, "value", F.lit(2).alias("__layer"))))
    known = layers.filter("value IS NOT NULL")
    return known.groupBy(*keys).agg(F.min_by("value", "__layer").alias("value"),
                                    F.element_at(F.array(F.lit("policy"), F.lit("preference"), F.lit("legacy")),
                                                 F.min("__layer") + 1).alias("layer"))


# Codes of what is wrong with a setting.
BLANK, NOT_ABSOLUTE, QUESTION_MARK, LOOSE_STAR, STAR_IN_KEY, UNKNOWN_HIVE, HIDES_SETTINGS, OUT_OF_RANGE, NO_VALUES, TOO_MANY = (
    "blank", "not-absolute", "question-mark", "loose-star", "star-in-key", "unknown-hive", "hides-settings", "out-of-range", "no-values", "too-many")


def _parts(path: Column) -> Column:
    return F.split(F.replace(path, F.lit("/"), F.lit("\\")), r"\\")


def is_absolute(path: Column) -> Column:
    r"""A drive and a separator, or a share with server and name; variables are taken as they stand."""
    parts = _parts(path)
    drive = F.get(parts, F.lit(0)).rlike("^[A-Za-z]:$") & (F.size(parts) > 1)
    share = (F.get(parts, F.lit(0)) == "") & (F.get(parts, F.lit(1)) == "") & (F.length(F.get(parts, F.lit(2))) > 0) & (F.length(F.get(parts, F.lit(3))) > 0)
    return F.coalesce(drive | (share & path.startswith("\\\\")), F.lit(False))


def path_problem(value: Column) -> Column:
    """Code of why a path (its variables expanded) cannot be watched; null if it can. One star may stand for one whole part."""
    stars = F.filter(_parts(value), lambda p: p.contains("*"))
    whole = (F.size(stars) == 0) | ((F.size(stars) == 1) & (F.get(stars, F.lit(0)) == "*"))
    checks = ((~has_content(value), BLANK), (~is_absolute(value), NOT_ABSOLUTE), (value.contains("?"), QUESTION_MARK), (~whole, LOOSE_STAR))
    return F.coalesce(*[F.when(bad, code) for bad, code in checks])


def key_problem(value: Column) -> Column:
    """Code of why a registry key cannot be watched; null if it can."""
    hive = F.upper(F.substring_index(value, "\\", 1))
    checks = ((~has_content(value), BLANK), (value.rlike("[*?]"), STAR_IN_KEY), (~hive.isin(*HIVES), UNKNOWN_HIVE))
    return F.coalesce(*[F.when(bad, code) for bad, code in checks])


def protected_problem(value: Column, protected: Sequence[str] = PROTECTED_KEYS) -> Column:
    """An exclusion may not hide the keys that hold the settings: none of them lies at or below it."""
    shut = F.upper(F.concat(F.rtrim(F.trim(value), F.lit("\\")), F.lit("\\")))
    hidden = F.exists(F.array(*[F.lit(f"{k.upper()}\\") for k in protected]), lambda k: k.startswith(shut))
    return F.when(has_content(value) & hidden, HIDES_SETTINGS)


def number_problem(name: Column, value: Column) -> Column:
    """``out-of-range`` with the bounds that a numeric setting breaks; null when it breaks none."""
    bounds = F.create_map(*[x for k, (low, high) in BOUNDS.items() for x in (F.lit(k), F.struct(F.lit(low).alias("low"), F.lit(high).cast("int").alias("high")))])
    own = F.try_element_at(bounds, name)
    broken = (value < own["low"]) | F.coalesce(value > own["high"], F.lit(False))
    return F.when(broken, F.concat(F.lit(OUT_OF_RANGE + ":"), own["low"].cast("string"), F.lit(".."), F.coalesce(own["high"].cast("string"), F.lit(""))))


def validate(lists: DataFrame, hosts: DataFrame, protected: Sequence[str] = PROTECTED_KEYS, environment: DataFrame | None = None) -> DataFrame:
    """Problems of (host, list_name, value) rows, and required lists without rows, as (host, list_name, value, reason).

    Variables of a path are expanded by ``environment`` (host, name, value) before it is judged; unknown ones stay as they are.
    """
    name, value, judged = F.col("list_name"), F.col("value"), F.col("__judged")
    rows = lists.select("host", "list_name", "value", F.col("value").alias("__judged"))
    if environment is not None:
        rows = expand_environment(rows, environment, "__judged")
    optional = name.startswith("Excluded")
    is_path = name.isin("MonitoredPaths", "ExcludedPaths")
    reason = F.when(~(optional & (F.coalesce(value, F.lit("")) == "")), F.when(is_path, path_problem(judged)).when(
        name == "MonitoredKeys", key_problem(value)).when(name == "ExcludedKeys", F.coalesce(key_problem(value), protected_problem(value, protected))))
    bad = rows.select("host", "list_name", "value", reason.alias("reason")).filter("reason IS NOT NULL")
    required = hosts.select("host", F.explode(F.array(F.lit("MonitoredPaths"), F.lit("MonitoredKeys"))).alias("list_name"))
    empty = required.join(lists.select("host", "list_name").distinct(), ["host", "list_name"], "left_anti").select(
        "host", "list_name", F.lit(None).cast("string").alias("value"), F.lit(NO_VALUES).alias("reason"))
    return bad.unionByName(empty)


def validate_attribution_scopes(scopes: DataFrame, switches: DataFrame, limit: int = 64) -> DataFrame:
    """Hosts that attribute by audit records and whose (host, scope) rows are none, more than ``limit``, or hold a star.

    ``switches`` is (host, enabled).
    """
    per = scopes.groupBy("host").agg(F.count("*").alias("scopes"), F.bool_or(F.col("scope").contains("*")).alias("__star"))
    judged = switches.filter("enabled").select("host").join(per, "host", "left").withColumn("scopes", F.coalesce("scopes", F.lit(0).cast("bigint")))
    checks = ((F.col("scopes") == 0, NO_VALUES), (F.col("scopes") > limit, TOO_MANY), (F.col("__star"), LOOSE_STAR))
    return judged.select("host", "scopes", F.coalesce(*[F.when(bad, code) for bad, code in checks]).alias("reason")).filter("reason IS NOT NULL")


def generation_changes(generations: DataFrame, keys: Sequence[str] = ("host",), order: Sequence[str] = ("generation",),
                       fields: Sequence[str] = GENERATION_FIELDS, widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """Generations that differ from the one before in any field, with the old and new scope hash."""
    present = [f for f in fields if f in generations.columns]
    stepped = previous_row(generations, keys, order, present, "__b", widths)
    differs = F.lit(False)
    for f in present:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"__b.{f}"))
    return stepped.filter(F.col("__b").isNotNull() & differs).select(
        *keys, *order, F.col("__b.scope_hash").alias("previous_scope_hash"), F.col("scope_hash").alias("new_scope_hash"))
