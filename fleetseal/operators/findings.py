"""Findings: one envelope per change, gates on version and catalog, text form, and the unified stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.functions import events as E

ENVELOPE = ("host", "schema_version", "event_id", "record_type", "occurred_ms", "record_id", "scope_hash", "fields")


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _field_map(df: DataFrame, fields: dict[str, str], computed: dict[str, Column]) -> Column:
    values = []
    for column in fields.values():
        value = computed[column] if column in computed else _optional(df, column)
        if column == "attribution_source_ms":
            value = E.iso_timestamp(value.cast("bigint"))
        values.append(value.cast("string"))
    return F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*values))


def _envelope(df: DataFrame, event_id: Column, record_type: Column, record_id: Column, fields: Column) -> DataFrame:
    scope = F.col("scope_hash") if "scope_hash" in df.columns else F.lit("")
    return df.select(
        "host", F.lit(E.SCHEMA_VERSION).alias("schema_version"), event_id.cast("int").alias("event_id"),
        record_type.alias("record_type"), F.col("t_ms").alias("occurred_ms"), record_id.alias("record_id"),
        scope.alias("scope_hash"), fields.alias("fields"))


def file_findings(changes: DataFrame) -> DataFrame:
    """One finding per file change; discovery rows never become one."""
    kept = changes.filter(F.col("change_category") != "Discovery")
    old, new = _optional(kept, "old_path"), _optional(kept, "new_path")
    renamed = old.isNotNull()
    computed = {
        "operation": E.operation(F.col("change_category"), old, new),
        "rename_method": F.when(renamed, "RuntimeAdjacentBufferPair"),
        "rename_confidence": F.when(renamed, "Low"),
    }
    return _envelope(kept, E.finding_event_id(F.lit("FileSystem"), F.col("change_category")),
                     F.lit("FileSystemFinding"), F.col("id"), _field_map(kept, E.FS_FIELDS, computed))


def registry_findings(changes: DataFrame) -> DataFrame:
    """One finding per registry change."""
    kept = changes.filter(F.col("change_category") != "Discovery")
    computed = {"operation": E.operation(F.col("change_category"))}
    return _envelope(kept, E.finding_event_id(F.lit("Registry"), F.col("change_category")),
                     F.lit("RegistryFinding"), F.col("id"), _field_map(kept, E.REG_FIELDS, computed))


def baseline_findings(results: DataFrame, baselines: DataFrame) -> DataFrame:
    """Pending reconciliation results with the scope and source of their baseline; orphans are skipped."""
    known = baselines.select("host", F.col("id").alias("baseline_id"), "source", "scope_hash")
    joined = results.filter("delivered_ms IS NULL").join(known, ["host", "baseline_id"])
    names = {"baselineId": "baseline_id", "source": "source", "change": "change", "identity": "identity",
             "oldPath": "old_path", "newPath": "new_path", "detectedAt": "detected_ms"}
    values = [E.iso_timestamp(F.col(c)) if c == "detected_ms" else F.col(c).cast("string") for c in names.values()]
    fields = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*values))
    return _envelope(joined.withColumn("t_ms", F.col("detected_ms")), F.lit(7795), F.lit("BaselineFinding"),
                     F.col("id"), fields)


def audit_findings(records: DataFrame) -> DataFrame:
    """Audit attribution records as events, with the native XML kept as evidence."""
    names = {"nativeEventId": "native_event_id", "provider": "provider", "subjectUserSid": "subject_user_sid",
             "subjectUserName": "subject_user_name", "objectName": "object_name", "oldValue": "old_value",
             "newValue": "new_value", "nativeEvidence": "xml"}
    fields = F.map_from_arrays(F.array(*[F.lit(n) for n in names]),
                               F.array(*[_optional(records, c).cast("string") for c in names.values()]))
    return _envelope(records, F.lit(7797), F.lit("SecurityAuditAttribution"), F.col("record_id").cast("string"), fields)


def service_events(rows: DataFrame, event_id: int, fields: dict[str, Column]) -> DataFrame:
    """Health, gap, recovery, sink-failure and configuration records from (host, t_ms, scope_hash?) rows.

    The record id is a hash of the content, so a replay writes the same record.
    """
    record_type = E.EVENT_CATALOG[event_id]
    values = [v.cast("string") for v in fields.values()]
    identity = F.sha2(F.concat_ws("\u001f", F.lit(record_type), "host", F.col("t_ms").cast("string"),
                                  *[F.coalesce(v, F.lit("")) for v in values]), 256)
    mapped = F.map_from_arrays(F.array(*[F.lit(n) for n in fields]), F.array(*values))
    return _envelope(rows, F.lit(event_id), F.lit(record_type), identity, mapped)


def coverage_gaps(rows: DataFrame) -> DataFrame:
    """Gap records of (host, t_ms, source, scope, reason, lost_count) rows."""
    return service_events(rows, 7791, {"source": F.col("source"), "scope": F.col("scope"), "reason": F.col("reason"),
                                       "lostCount": F.col("lost_count")})


def recoveries(rows: DataFrame) -> DataFrame:
    """Recovery records of (host, t_ms, source, scope, action) rows."""
    return service_events(rows, 7792, {"source": F.col("source"), "scope": F.col("scope"), "action": F.col("action")})


def sink_failures(rows: DataFrame) -> DataFrame:
    """Sink failure records of (host, t_ms, sink, reason, attempt) rows."""
    return service_events(rows, 7793, {"sink": F.col("sink"), "reason": F.col("reason"), "attempt": F.col("attempt")})


def configuration_changes(rows: DataFrame) -> DataFrame:
    """Configuration records of (host, t_ms, previous_scope_hash, new_scope_hash) rows, one per changed generation."""
    return service_events(rows, 7794, {"previousScopeHash": F.col("previous_scope_hash"), "newScopeHash": F.col("new_scope_hash")})


def integrity_unavailable(rows: DataFrame) -> DataFrame:
    """Records of (host, t_ms, scope, reason, fallback_algorithm): a run had to use its fallback algorithm."""
    return service_events(rows, 7798, {"scope": F.col("scope"), "reason": F.col("reason"), "fallbackAlgorithm": F.col("fallback_algorithm")})


def overdue_records(transitions: DataFrame, source: Column) -> DataFrame:
    """Gap and recovery records of overdue transitions."""
    named = transitions.withColumns({"source": source, "scope": F.lit(""), "lost_count": F.lit(0), "action": F.col("reason")})
    return unify(coverage_gaps(named.filter("record_type = 'CoverageGap'")), recoveries(named.filter("record_type = 'SourceRecovered'")))


# Heartbeat fields in the order they are written, and the column each one reads.
HEARTBEAT_FIELDS = {
    "queueDepth": "queue_depth", "oldestItemAgeMs": "oldest_item_age_ms", "accepted": "accepted", "processed": "processed",
    "dropped": "dropped", "enrichmentFailures": "enrichment_failures",
    "fileSystemSnapshotRunning": "file_running", "fileSystemSnapshotFailures": "file_failures",
    "fileSystemSnapshotLastSuccess": "file_last_success_ms", "fileSystemSnapshotLastDurationMs": "file_last_duration_ms",
    "registrySnapshotRunning": "registry_running", "registrySnapshotFailures": "registry_failures",
    "registrySnapshotLastSuccess": "registry_last_success_ms", "registrySnapshotLastDurationMs": "registry_last_duration_ms",
    "eventOutboxPending": "pending", "eventOutboxOldestAgeMs": "oldest_age_ms",
    "databaseBytes": "database_bytes", "databaseVolumeFreeBytes": "database_volume_free_bytes",
}


def heartbeats(beats: DataFrame, snapshots: DataFrame | None = None, backlog: DataFrame | None = None,
               storage: DataFrame | None = None) -> DataFrame:
    """Heartbeat records with all eighteen metrics.

    ``beats`` is (host, t_ms, counters), ``snapshots`` the current run health per (host, source), ``backlog`` and
    ``storage`` one row per host. What is not given stays empty.
    """
    joined = beats
    if snapshots is not None:
        per_host = snapshots.groupBy("host").agg(*[
            F.max(F.when(F.col("source") == source, F.col(column))).alias(f"{prefix}_{name}")
            for source, prefix in (("FileSystem", "file"), ("Registry", "registry"))
            for column, name in (("running", "running"), ("consecutive_failures", "failures"), ("last_success_ms", "last_success_ms"),
                                 ("last_duration_ms", "last_duration_ms"))])
        joined = joined.join(per_host, "host", "left")
    for other in (backlog, storage):
        if other is not None:
            joined = joined.join(other, "host", "left")
    values = {}
    for name, column in HEARTBEAT_FIELDS.items():
        value = F.col(column) if column in joined.columns else F.lit(None)
        values[name] = E.iso_timestamp(value.cast("bigint")) if name.endswith("LastSuccess") else value
    return service_events(joined, 7790, values)


def unify(*streams: DataFrame) -> DataFrame:
    """All findings in one envelope stream."""
    return reduce(lambda a, b: a.unionByName(b), [s.select(*ENVELOPE) for s in streams])


def version_gate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): exactly the current schema version passes."""
    current = F.col("schema_version") == E.SCHEMA_VERSION
    return events.filter(current), events.filter(~F.coalesce(current, F.lit(False)))


def catalog_gate(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): the event id must be allocated to exactly the record type."""
    allocated = E.is_allocated(F.col("event_id"), F.col("record_type"))
    return events.filter(allocated), events.filter(~allocated)


def rendered(events: DataFrame) -> DataFrame:
    """Envelope rows with their text form and severity."""
    error = F.col("error") if "error" in events.columns else F.lit(False)
    return events.select(
        "*", E.severity(F.col("event_id"), error).alias("severity"),
        E.render_event(*[F.col(c) for c in ENVELOPE[1:]]).alias("message"))
