"""The event envelope: ids, severities, finding fields and text form."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA_VERSION = 1

# Event ids and the one record type each of them is allocated to.
EVENT_CATALOG = {
    7776: "FileSystemFinding",
    7777: "FileSystemFinding",
    7778: "FileSystemFinding",
    7786: "RegistryFinding",
    7787: "RegistryFinding",
    7788: "RegistryFinding",
    7790: "Health",
    7791: "CoverageGap",
    7792: "SourceRecovered",
    7793: "SinkFailure",
    7794: "ConfigurationChanged",
    7795: "BaselineFinding",
    7796: "Aggregation",
    7797: "SecurityAuditAttribution",
    7798: "TpmIntegrityUnavailable",
}
SERVICE_ERROR = 7770
OTHER_SERVICE_EVENT = 7780
ERROR_IDS = (7770, 7791, 7793, 7798)
WARNING_IDS = (7794, 7795)

# Finding fields in the order they are written, and the change column each one reads.
FS_FIELDS = {
    "category": "change_category", "operation": "operation", "path": "entity", "oldPath": "old_path",
    "newPath": "new_path", "currentHash": "current_hash", "previousHash": "previous_hash",
    "currentSizeBytes": "current_size_bytes", "previousSizeBytes": "previous_size_bytes", "currentAcl": "acls",
    "previousAcl": "previous_acl", "objectType": "object_type", "renameCorrelationMethod": "rename_method",
    "renameCorrelationConfidence": "rename_confidence", "attributionStatus": "attribution_status",
    "attributionMethod": "attribution_method", "attributionConfidence": "attribution_confidence",
    "attributionSourceTimestamp": "attribution_source_ms", "attributionMissingReason": "attribution_missing_reason",
    "processSequenceNumber": "process_sequence_number", "processId": "process_id", "processName": "process_name",
    "userSid": "user_sid", "username": "username",
}
REG_FIELDS = {
    "category": "change_category", "operation": "operation", "key": "entity", "hive": "hive",
    "valueName": "value_name", "valueData": "value_data", "evidenceStatus": "evidence_status",
    "evidenceMissingReason": "evidence_missing_reason", "currentAcl": "acls", "previousAcl": "previous_acl",
    "attributionStatus": "attribution_status", "attributionMethod": "attribution_method",
    "attributionConfidence": "attribution_confidence", "attributionSourceTimestamp": "attribution_source_ms",
    "attributionMissingReason": "attribution_missing_reason", "processId": "process_id",
    "processName": "process_name", "userSid": "user_sid", "username": "username",
}


def finding_event_id(source: Column, category: Column) -> Column:
    """Event id of a finding; null for categories that never become one (Discovery)."""
    offset = F.when(category == "Created", 0).when(category == "Changed", 1).when(category == "Deleted", 2)
    base = F.when(source == "FileSystem", 7776).when(source == "Registry", 7786)
    return base + offset


def log_event_id(explicit: Column, is_error: Column, is_information: Column, source: Column, category: Column) -> Column:
    """Id of a log line: an explicit id in 1..65535 wins, errors share one id, known changes map to theirs."""
    known = F.when(
        is_information,
        F.when(F.upper(source) == "FILESYSTEM", finding_event_id(F.lit("FileSystem"), F.initcap(category)))
        .when(F.upper(source) == "REGISTRY", finding_event_id(F.lit("Registry"), F.initcap(category))),
    )
    return (
        F.when(explicit.between(1, 65535), explicit)
        .when(is_error, SERVICE_ERROR)
        .otherwise(F.coalesce(known, F.lit(OTHER_SERVICE_EVENT)))
    )


def operation(category: Column, old_path: Column | None = None, new_path: Column | None = None) -> Column:
    """Created, Modified, Deleted; RenamedOrMoved when both paths are known."""
    plain = (
        F.when(category == "Created", "Created")
        .when(category == "Changed", "Modified")
        .when(category == "Deleted", "Deleted")
        .otherwise("Other")
    )
    if old_path is None or new_path is None:
        return plain
    return F.when(old_path.isNotNull() & new_path.isNotNull(), "RenamedOrMoved").otherwise(plain)


def severity(event_id: Column, error: Column) -> Column:
    """Error, Warning or Information."""
    return (
        F.when(event_id.isin(*ERROR_IDS), "Error")
        .when(event_id.isin(*WARNING_IDS), "Warning")
        .when(error, "Error")
        .otherwise("Information")
    )


def catalog_type(event_id: Column) -> Column:
    """Record type an event id is allocated to; null for ids outside the catalog."""
    expected = F.lit(None).cast("string")
    for code, record_type in EVENT_CATALOG.items():
        expected = F.when(event_id == code, F.lit(record_type)).otherwise(expected)
    return expected


def is_allocated(event_id: Column, record_type: Column) -> Column:
    """The id belongs to exactly this record type."""
    return F.coalesce(catalog_type(event_id) == record_type, F.lit(False))


def _spaced(name: str) -> str:
    """The display rule on a name known when the plan is built."""
    spaced = "".join(f" {c}" if i and c.isupper() and name[i - 1].islower() else c for i, c in enumerate(name))
    return spaced[:1].upper() + spaced[1:]


def display_name(name: Column, known: Iterable[str] = (*FS_FIELDS, *REG_FIELDS)) -> Column:
    """``userSid`` becomes ``User Sid``: upper first letter, a space between lower and upper.

    Names of findings are looked up in a literal map; only other names go through the pattern.
    """
    looked_up = F.create_map(*[F.lit(text) for n in dict.fromkeys(known) for text in (n, _spaced(n))])
    spaced = F.regexp_replace(name, r"(?<=\p{Ll})(?=\p{Lu})", " ")
    ruled = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))
    return F.coalesce(F.try_element_at(looked_up, name), ruled)


def iso_timestamp(ms: Column) -> Column:
    """Round-trip UTC text with seven fractional digits, whatever the session's time zone."""
    since_epoch = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(ms / 1000).cast("decimal(18,6)"))
    clock = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + since_epoch).cast("string")
    millis = F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0")
    return F.concat(F.replace(F.substring(clock, 1, 19), F.lit(" "), F.lit("T")), F.lit("."), millis, F.lit("0000+00:00"))


def render_event(schema_version: Column, event_id: Column, record_type: Column, occurred_ms: Column,
                 record_id: Column, scope_hash: Column, fields: Column) -> Column:
    """Readable ``Name: value`` lines: the six envelope fields, then the map in its own order; null reads None.

    A line break inside a value continues on a line that begins with a tab.
    """
    def line(label: Column, value: Column) -> Column:
        return F.concat(label, F.lit(": "), F.replace(F.coalesce(value, F.lit("None")), F.lit("\n"), F.lit("\n\t")))

    envelope = {
        "SchemaVersion": schema_version.cast("string"), "EventId": event_id.cast("string"), "RecordType": record_type,
        "OccurredAt": iso_timestamp(occurred_ms), "RecordId": record_id, "ScopeHash": scope_hash,
    }
    head = [line(F.lit(_spaced(name)), value) for name, value in envelope.items()]
    body = F.transform(F.map_entries(fields), lambda e: line(display_name(e["key"]), e["value"]))
    return F.array_join(F.concat(F.array(*head), body), "\n")


def parse_event(text: Column) -> Column:
    """The consumer's inverse: a map from display name to value, split at the first ``: `` of each line.

    A line that begins with a tab continues the value before it; of a repeated name the first counts.
    """
    name = lambda x: F.substring_index(x, ": ", 1)
    value = lambda x: F.replace(F.substr(x, F.length(name(x)) + 3), F.lit("\n\t"), F.lit("\n"))

    def add(seen: Column, x: Column) -> Column:
        known = ~x.contains(": ") | F.exists(seen, lambda e: e["name"] == name(x))
        return F.when(known, seen).otherwise(F.concat(seen, F.array(F.struct(name(x).alias("name"), value(x).alias("value")))))

    # One fold: the text is split once, however long it takes to come about.
    none = F.array().cast("array<struct<name:string,value:string>>")
    return F.map_from_entries(F.aggregate(F.split(text, "\n(?!\t)"), none, add))
