"""Explicit schemas of every table and stream, and the fixed enumerations.

Readers always pass these schemas, so no scan ever infers one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumeration codes as they are stored (code = position unless a mapping is given).
NODE_TYPES = ("File", "Directory", "ReparsePoint", "RegistryKey", "RegistryValue")
HASH_STATES = ("Hashed", "SkippedBySizeCap", "Locked", "AccessDenied", "Vanished", "Failed", "NotApplicable")
EVIDENCE_STATES = ("Available", "AccessDenied", "Vanished", "Failed")
BASELINE_STATUSES = ("Building", "Reconciling", "Complete", "Invalid")
APPLICABILITY = ("Current", "Superseded")
SOURCES = ("FileSystem", "Registry")
CHANGE_CATEGORIES = ("Created", "Changed", "Deleted", "Discovery")
ATTRIBUTION_STATUSES = ("Unattributed", "Attributed", "Unavailable", "RundownMissing", "ImpersonationAmbiguous")
OBJECT_TYPES = ("Directory", "File", "SymbolicLink", "Unknown")
ALGORITHMS = {1: "Sha256", 2: "RegistryV2", 3: "TpmRsaPssSha256"}

MEMBERS = """
  host string, baseline_id string, identity string, path string, node_type int, content_hash string,
  hash_state int, acl_state int, acl_evidence string, stream_names array<string>, link_count int,
  is_system boolean, is_sparse boolean, is_temporary boolean, is_offline boolean,
  registry_value_kind string, registry_value_data binary"""

BASELINES = """
  host string, id string, source string, scope_hash string, source_identity string, schema_version int,
  algorithm int, status string, applicability string, started_ms bigint, completed_ms bigint, item_count bigint,
  observation_passes int, consistency_method string, start_cursor string, end_cursor string,
  invalid_reason string, manifest_digest string"""

RECONCILIATION_RESULTS = """
  host string, id string, baseline_id string, previous_baseline_id string, identity string, change string,
  old_path string, new_path string, detected_ms bigint, delivered_ms bigint, delivery_attempts int"""

_CHANGE = """
  host string, id string, seq bigint, t_ms bigint, entity string, change_category string, acls string,
  previous_acl string, scope_hash string, source_computer string, process_id int, process_name string,
  process_sequence_number decimal(20,0), username string, user_sid string, attribution_status string,
  attribution_method string, attribution_confidence string, attribution_source_ms bigint,
  attribution_missing_reason string"""

FS_CHANGES = _CHANGE + """,
  full_path string, old_path string, new_path string, current_hash string, previous_hash string,
  current_size_bytes bigint, previous_size_bytes bigint, object_type string"""

REG_CHANGES = _CHANGE + """,
  event_name string, hive string, key_name string, value_name string, value_data string,
  evidence_status string, evidence_missing_reason string"""

OUTBOX = """
  host string, id string, schema_version int, event_id int, record_type string, occurred_ms bigint,
  scope_hash string, fields map<string,string>, error boolean, created_ms bigint, next_attempt_ms bigint,
  delivered_ms bigint, delivery_attempts int, last_error string"""

RAW_NOTIFICATIONS = """
  host string, seq bigint, captured_ms bigint, scope string, full_path string, category string,
  old_path string, new_path string"""

REGISTRY_TRACE = """
  host string, seq bigint, t_ms bigint, opcode int, handle decimal(20,0), key_name string, value_name string,
  process_id int, process_name string"""

FILE_TRACE = """
  host string, seq bigint, t_ms bigint, task string, opcode string, process_id int,
  process_sequence_number decimal(20,0), process_name string, path string, username string, user_sid string"""

AUDIT_RECORDS = "host string, record_id string, native_event_id int, provider string, t_ms bigint, xml string"

EVENT_ENVELOPE = """
  host string, schema_version int, event_id int, record_type string, occurred_ms bigint, record_id string,
  scope_hash string, fields map<string,string>"""

SETTINGS_VALUES = "host string, name string, value string"


def enum_name(code: Column, names: tuple[str, ...] | dict[int, str]) -> Column:
    """Name of a stored enumeration code; null for a code outside the enumeration."""
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    name = F.lit(None).cast("string")
    for value, label in pairs:
        name = F.when(code == value, F.lit(label)).otherwise(name)
    return name


def enum_code(name: Column, names: tuple[str, ...]) -> Column:
    """Stored code of an enumeration name; null for an unknown name."""
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), name), F.lit(0)).cast("int") - 1
