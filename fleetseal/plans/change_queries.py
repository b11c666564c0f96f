"""Queries over change events: state, evidence, findings, bursts and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetseal.functions import acl, events, registry
from fleetseal.functions.paths import in_scope
from fleetseal.operators import attribution, bursts, findings, projection, scope
from fleetseal.plans.registry import query
from fleetseal.sources import tables

SECOND = 1000
SCAN = (600 * SECOND, 600_000 * SECOND)
SEQ = (500, 500_000)


@query("""
  SELECT host, normalized_entity, id, current_hash, t_ms FROM (SELECT host, upper(entity) AS normalized_entity, id, current_hash, t_ms,
    row_number() OVER (PARTITION BY host, upper(entity) ORDER BY t_ms DESC, seq) AS rn FROM {fs_changes}) x WHERE rn = 1""")
def latest_state(t):
    return projection.latest_by_entity(t.fs_changes).select("host", "normalized_entity", "id", "current_hash", "t_ms")


@query("""
  WITH latest AS (SELECT * FROM (SELECT *, upper(entity) AS k, row_number() OVER (PARTITION BY host, upper(entity) ORDER BY t_ms DESC, seq) AS rn
      FROM {fs_changes}) x WHERE rn = 1)
  SELECT host, k AS normalized_entity, id, change_category FROM latest l WHERE NOT EXISTS (
    SELECT 1 FROM latest r WHERE r.host = l.host AND upper(r.old_path) = l.k AND r.k <> l.k AND (r.t_ms, r.seq) >= (l.t_ms, l.seq))""")
def projection_state(t):
    return projection.latest_state(t.fs_changes).select("host", "normalized_entity", "id", "change_category")


@query("""
  SELECT host, normalized_entity, id FROM (SELECT host, upper(entity) AS normalized_entity, id,
    row_number() OVER (PARTITION BY host, upper(entity) ORDER BY t_ms DESC, seq) AS rn FROM {reg_changes}) x WHERE rn = 1""")
def projection_dedupe(t):
    return projection.dedupe_projection(t.reg_changes).select("host", "normalized_entity", "id")


@query("""
  WITH steps AS (
    SELECT host, upper(entity) AS k, t_ms, seq, 1 AS r, true AS present, current_hash, acls, size_bytes, object_type, NULL AS id,
      NULL AS category, NULL AS own_type FROM {fs_changes}
    UNION ALL SELECT host, upper(old_path), t_ms, seq, 1, false, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {fs_changes}
      WHERE old_path IS NOT NULL AND upper(old_path) <> upper(entity)
    UNION ALL SELECT host, upper(coalesce(old_path, entity)), t_ms, seq, 0, NULL, NULL, NULL, NULL, NULL, id, change_category, object_type FROM {fs_changes}),
  seen AS (SELECT *, last_value(CASE WHEN present IS NOT NULL THEN {'p': present, 'h': current_hash, 'a': acls, 's': size_bytes, 't': object_type} END IGNORE NULLS)
    OVER (PARTITION BY host, k ORDER BY t_ms, seq, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM steps)
  SELECT id, CASE WHEN b.p THEN b.h ELSE '' END AS previous_hash, CASE WHEN b.p THEN b.a ELSE '' END AS previous_acl,
    CASE WHEN b.p THEN b.s END AS previous_size_bytes,
    CASE WHEN category = 'Deleted' AND b.p THEN b.t ELSE own_type END AS object_type FROM seen WHERE id IS NOT NULL""")
def previous_evidence(t):
    return projection.previous_evidence(t.fs_changes, widths=SCAN).select(
        "id", "previous_hash", "previous_acl", "previous_size_bytes", "object_type")


@query("""
  WITH ended AS (SELECT host, upper(entity) AS k, seq // 500 AS b, arg_max(acls, seq) AS acl FROM {reg_changes} GROUP BY ALL)
  SELECT c.id, coalesce((SELECT arg_max(e.acl, e.b) FROM ended e WHERE e.host = c.host AND e.k = upper(c.entity) AND e.b < c.seq // 500), '') AS previous_acl
  FROM {reg_changes} c""")
def registry_previous_acl(t):
    batch = F.floor(F.col("seq") / 500).cast("long")
    return projection.previous_acl_by_batch(t.reg_changes, batch, (8, 8000)).select("id", "previous_acl")


_FS_MESSAGE = """'Schema Version: 1' || chr(10) || 'Event Id: ' || event_id || chr(10) || 'Record Type: FileSystemFinding' || chr(10)
  || 'Occurred At: ' || strftime(make_timestamp(t_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || '0000+00:00' || chr(10) || 'Record Id: ' || id || chr(10)
  || 'Scope Hash: ' || chr(10) || 'Category: ' || change_category || chr(10) || 'Operation: ' || operation || chr(10) || 'Path: ' || entity || chr(10)
  || 'Old Path: ' || coalesce(old_path, 'None') || chr(10) || 'New Path: ' || CASE WHEN old_path IS NULL THEN 'None' ELSE entity END || chr(10)
  || 'Current Hash: ' || current_hash || chr(10) || 'Previous Hash: None' || chr(10) || 'Current Size Bytes: ' || size_bytes || chr(10)
  || 'Previous Size Bytes: None' || chr(10) || 'Current Acl: ' || acls || chr(10) || 'Previous Acl: None' || chr(10) || 'Object Type: ' || object_type
  || chr(10) || 'Rename Correlation Method: ' || CASE WHEN old_path IS NULL THEN 'None' ELSE 'RuntimeAdjacentBufferPair' END || chr(10)
  || 'Rename Correlation Confidence: ' || CASE WHEN old_path IS NULL THEN 'None' ELSE 'Low' END || chr(10) || 'Attribution Status: None' || chr(10)
  || 'Attribution Method: None' || chr(10) || 'Attribution Confidence: None' || chr(10) || 'Attribution Source Timestamp: None' || chr(10)
  || 'Attribution Missing Reason: None' || chr(10) || 'Process Sequence Number: None' || chr(10) || 'Process Id: None' || chr(10)
  || 'Process Name: None' || chr(10) || 'User Sid: None' || chr(10) || 'Username: None'"""


def _file_findings(t):
    named = (t.fs_changes.withColumnRenamed("size_bytes", "current_size_bytes")
             .withColumn("new_path", F.when(F.col("old_path").isNotNull(), F.col("entity"))))
    return findings.file_findings(named)


_FS_BASE = """(SELECT *, CASE change_category WHEN 'Created' THEN 7776 WHEN 'Changed' THEN 7777 ELSE 7778 END AS event_id,
    CASE WHEN old_path IS NOT NULL THEN 'RenamedOrMoved' WHEN change_category = 'Created' THEN 'Created' WHEN change_category = 'Changed' THEN 'Modified'
      ELSE 'Deleted' END AS operation FROM {fs_changes} WHERE change_category <> 'Discovery')"""


@query(f"SELECT host, event_id, id AS record_id, operation, entity AS path, old_path, current_hash FROM {_FS_BASE} f")
def fs_findings(t):
    f = F.col("fields")
    return _file_findings(t).select("host", "event_id", "record_id", f["operation"].alias("operation"), f["path"].alias("path"),
                                    f["oldPath"].alias("old_path"), f["currentHash"].alias("current_hash"))


@query(f"SELECT id AS record_id, 'Information' AS severity, {_FS_MESSAGE} AS message FROM {_FS_BASE} f")
def event_render(t):
    return findings.rendered(_file_findings(t)).select("record_id", "severity", "message")


@query(f"SELECT id AS record_id, cast(event_id AS varchar) AS event_id, operation, entity AS path, coalesce(old_path, 'None') AS old_path FROM {_FS_BASE} f")
def event_parse(t):
    parsed = findings.rendered(_file_findings(t)).select("record_id", events.parse_event(F.col("message")).alias("m"))
    return parsed.select("record_id", F.col("m")["Event Id"].alias("event_id"), F.col("m")["Operation"].alias("operation"),
                         F.col("m")["Path"].alias("path"), F.col("m")["Old Path"].alias("old_path"))


@query("""SELECT host, id AS record_id, CASE change_category WHEN 'Created' THEN 7786 WHEN 'Changed' THEN 7787 ELSE 7788 END AS event_id,
    CASE change_category WHEN 'Created' THEN 'Created' WHEN 'Changed' THEN 'Modified' ELSE 'Deleted' END AS operation, entity AS key, value_name, hive
  FROM {reg_changes}""")
def registry_findings(t):
    f = F.col("fields")
    return findings.registry_findings(t.reg_changes).select(
        "host", "record_id", "event_id", f["operation"].alias("operation"), f["key"].alias("key"),
        f["valueName"].alias("value_name"), f["hive"].alias("hive"))


@query(f"""
  SELECT host, event_id, 'FileSystemFinding' AS record_type, id AS record_id, t_ms AS occurred_ms FROM {_FS_BASE} f
  UNION ALL SELECT host, CASE change_category WHEN 'Created' THEN 7786 WHEN 'Changed' THEN 7787 ELSE 7788 END, 'RegistryFinding', id, t_ms FROM {{reg_changes}}
  UNION ALL SELECT p.host, 7795, 'BaselineFinding', p.id, p.detected_ms FROM {{pending_source}} p JOIN {{baselines}} b ON b.host = p.host AND b.id = p.baseline_id WHERE p.delivered_ms IS NULL
  UNION ALL SELECT host, 7797, 'SecurityAuditAttribution', cast(record_id AS varchar), t_ms FROM {{audit_xml}} WHERE native_event_id <> 4670""")
def unified_findings(t):
    audit = findings.audit_findings(attribution.parse_audit(t.audit_xml))
    every = findings.unify(_file_findings(t), findings.registry_findings(t.reg_changes),
                           findings.baseline_findings(t.pending_source, t.baselines), audit)
    return every.select("host", "event_id", "record_type", "record_id", "occurred_ms")


@query("""SELECT seq, CASE WHEN event_id IN (7791, 7798, 7770) THEN 'Error' WHEN event_id IN (7794, 7795) THEN 'Warning'
    WHEN error THEN 'Error' ELSE 'Information' END AS severity FROM {typed_events}""")
def event_severity(t):
    return t.typed_events.select("seq", events.severity(F.col("event_id"), F.col("error")).alias("severity"))


@query("SELECT seq, event_id, record_type FROM {typed_events} WHERE record_type IN ('Unknown', 'ServiceError')")
def catalog_quarantine(t):
    return findings.catalog_gate(t.typed_events)[1].select("seq", "event_id", "record_type")


@query("SELECT seq, record_type FROM {typed_events} WHERE schema_version = 1")
def version_gate(t):
    return findings.version_gate(t.typed_events)[0].select("seq", "record_type")


@query("""SELECT seq, CASE WHEN seq % 10 = 1 THEN 42 WHEN error THEN 7770 WHEN record_type = 'FileSystemFinding' THEN 7777 WHEN record_type = 'RegistryFinding' THEN 7788
    ELSE 7780 END AS log_id FROM {typed_events}""")
def log_event_ids(t):
    kind = F.col("record_type")
    source = F.when(kind == "FileSystemFinding", "filesystem").when(kind == "RegistryFinding", "Registry")
    category = F.when(kind == "FileSystemFinding", "CHANGED").when(kind == "RegistryFinding", "deleted")
    explicit = F.when(F.col("seq") % 10 == 1, 42)
    return t.typed_events.select("seq", events.log_event_id(explicit, F.col("error"), ~F.col("error"), source, category).alias("log_id"))


@query("""SELECT event_id, CASE event_id % 28 WHEN 10 THEN 'Created' WHEN 12 THEN 'Deleted' WHEN 15 THEN 'Deleted' ELSE 'Changed' END AS category FROM events""")
def registry_opcode_category(t):
    return t.events.select("event_id", registry.opcode_category(F.col("event_id") % 28).alias("category"))


_ACE_SQL = """'; ACE: [Identity: ' || identity_name || '; Rights: 0x' || lpad(hex(rights), 8, '0') || '; Type: ' || ace_type || '; Inherited: ' ||
  CASE WHEN inherited THEN 'true' ELSE 'false' END || '; Inheritance: ' || CASE inheritance WHEN 0 THEN 'None' WHEN 1 THEN 'ContainerInherit'
  WHEN 2 THEN 'ObjectInherit' ELSE 'ObjectInherit|ContainerInherit' END || '; Propagation: ' || CASE propagation WHEN 0 THEN 'None'
  WHEN 1 THEN 'NoPropagateInherit' ELSE 'InheritOnly' END || ']'"""


def _ace_list(keep=None):
    ace = F.struct("ord", "identity_name", "rights", "ace_type", "inherited", "inheritance", "propagation")
    return F.array_sort(F.collect_list(ace if keep is None else F.when(keep, ace)))


@query(f"""SELECT acl_id, 'Owner: O' || acl_id || '; PrimaryGroup: None; AceCount: ' || count(*) || string_agg({_ACE_SQL}, '' ORDER BY ord) AS acl_text
  FROM {{aces}} GROUP BY acl_id""")
def acl_render(t):
    lists = t.aces.groupBy("acl_id").agg(_ace_list().alias("aces"))
    owner = F.concat(F.lit("O"), F.col("acl_id").cast("string"))
    return lists.select("acl_id", acl.render_acl(owner, F.lit(None).cast("string"), F.col("aces")).alias("acl_text"))


@query("""SELECT acl_id, bool_or((ord % 7 = 0) <> (ord % 5 = 0)) AS changed, count(*) FILTER (ord % 7 = 0 AND ord % 5 <> 0) AS added,
    count(*) FILTER (ord % 7 <> 0 AND ord % 5 = 0) AS removed FROM {aces} GROUP BY acl_id""")
def acl_diff(t):
    lists = t.aces.groupBy("acl_id").agg(_ace_list(F.col("ord") % 7 != 0).alias("before"), _ace_list(F.col("ord") % 5 != 0).alias("after"))
    none = F.lit(None).cast("string")
    return lists.select(
        "acl_id", acl.acl_changed(acl.render_acl(none, none, F.col("before")), acl.render_acl(none, none, F.col("after"))).alias("changed"),
        F.size(acl.aces_added(F.col("before"), F.col("after"))).cast("long").alias("added"),
        F.size(acl.aces_removed(F.col("before"), F.col("after"))).cast("long").alias("removed"))


# The check replays the rule with joins inside a window: for each row the last one that touches its path, and whether
# a later rename leaves it.
_COLLAPSE = """
  WITH touch AS (
    SELECT host, win, seq, 1 AS a, upper(full_path) AS p, category, old_path IS NOT NULL AS ren FROM {raw_notifications}
    UNION ALL SELECT host, win, seq, 0, upper(old_path), category, true FROM {raw_notifications} WHERE old_path IS NOT NULL),
  judged AS (
    SELECT r.*, (SELECT arg_max(CASE WHEN t.a = 0 THEN 'left' WHEN t.ren THEN 'renamed' ELSE t.category END, t.seq * 2 + t.a) FROM touch t
        WHERE t.host = r.host AND t.win = r.win AND t.p = upper(r.full_path) AND t.seq < r.seq) AS before,
      (SELECT arg_max(t.category, t.seq) FROM touch t WHERE t.host = r.host AND t.win = r.win AND t.p = upper(r.full_path) AND t.seq < r.seq
        AND t.a = 1 AND NOT t.ren AND t.category <> 'Changed') AS lasting,
      EXISTS (SELECT 1 FROM touch t WHERE t.host = r.host AND t.win = r.win AND t.p = upper(r.full_path) AND t.a = 0 AND t.seq > r.seq) AS left_later
    FROM {raw_notifications} r)
  SELECT host, win, seq, category, full_path, old_path FROM judged
  WHERE CASE WHEN old_path IS NOT NULL THEN NOT left_later
    WHEN category = 'Changed' THEN NOT left_later AND (before IS NULL OR before = 'Deleted' OR (before = 'left' AND coalesce(lasting, 'Deleted') = 'Deleted'))
    ELSE true END"""


@query(_COLLAPSE)
def burst_collapse(t):
    return bursts.collapse(t.raw_notifications, ["host", "win"]).select("host", "win", "seq", "category", "full_path", "old_path")


@query("""
  WITH s AS (SELECT seq, CASE WHEN old_path LIKE 'C:/U%' AND NOT old_path LIKE 'C:/U3/%' THEN old_path END AS o,
      CASE WHEN new_path LIKE 'C:/U%' AND NOT new_path LIKE 'C:/U3/%' THEN new_path END AS n FROM {rename_pairs})
  SELECT seq, coalesce(n, o) AS full_path, CASE WHEN n IS NOT NULL AND o IS NOT NULL THEN 'Changed' WHEN o IS NOT NULL THEN 'Deleted' ELSE 'Created' END AS category,
    CASE WHEN n IS NOT NULL THEN o END AS old_path, CASE WHEN o IS NOT NULL THEN n END AS new_path FROM s WHERE n IS NOT NULL OR o IS NOT NULL""")
def rename_normalize(t):
    monitored = [f"C:/U{i}" for i in range(10)]
    visible = lambda c: in_scope(F.col(c), monitored, ["c:/u3"], [])
    return bursts.normalize_renames(t.rename_pairs, visible("old_path"), visible("new_path"))


@query("""SELECT host, t_ms - t_ms % 750 AS window_ms, cast(20 AS bigint) AS admitted, count(*) - 20 AS lost_count, min(t_ms) AS first_ms, max(t_ms) AS last_ms
  FROM {raw_notifications} GROUP BY host, t_ms - t_ms % 750 HAVING count(*) > 20""")
def admission_gaps(t):
    windowed = t.raw_notifications.withColumn("window_ms", bursts.fixed_window(F.col("t_ms"), 750))
    return bursts.admission_gaps(windowed, ["host", "window_ms"], capacity=20)


@query("""SELECT host, change_category, t_ms - t_ms % 100000 AS window_started_ms, count(*) AS count, arg_min(id, seq) AS sample_record_id,
    t_ms - t_ms % 100000 + 100000 AS window_ended_ms FROM {fs_changes} GROUP BY host, change_category, t_ms - t_ms % 100000 HAVING count(*) >= 8""")
def burst_aggregation(t):
    return bursts.burst_aggregation(t.fs_changes, ["host", "change_category"], threshold=8, width=100_000)


_RESOLVED = """SELECT i.*, p.process_name AS resolved_name,
    CASE WHEN p.pid IS NOT NULL THEN 'Attributed' ELSE 'Unavailable' END AS status,
    CASE WHEN i.seq IS NULL THEN 'ProcessSequenceNumberMissing' WHEN p.pid IS NULL THEN 'ProcessInstanceNotFound' END AS missing_reason
  FROM {file_io} i LEFT JOIN {process_instances} p ON i.pid = p.pid AND i.seq = p.seq AND p.start_ms <= i.t_ms AND i.t_ms < p.end_ms"""


def _resolved(t):
    return attribution.resolve_process(t.file_io, t.process_instances, [])


@query(f"SELECT io_id, status, missing_reason, resolved_name FROM ({_RESOLVED}) r")
def process_instance_join(t):
    return _resolved(t).select("io_id", "status", "missing_reason", "resolved_name")


@query(f"""
  WITH io AS ({_RESOLVED}), best AS (SELECT n.id, max(i.io_id) AS io_id FROM {{notif}} n JOIN io i ON i.path_id = n.path_id
    AND i.t_ms BETWEEN n.t_ms - 10000 AND n.t_ms + 50 GROUP BY n.id)
  SELECT n.id, b.io_id, coalesce(i.status, 'Unattributed') AS attribution_status,
    CASE WHEN i.status = 'Attributed' THEN 'High' ELSE 'None' END AS attribution_confidence,
    CASE WHEN b.io_id IS NULL THEN 'NoCorrelatedFileEvent' ELSE i.missing_reason END AS attribution_missing_reason, i.resolved_name AS process_name
  FROM {{notif}} n LEFT JOIN best b ON n.id = b.id LEFT JOIN io i ON i.io_id = b.io_id""")
def file_attribution(t):
    activity = _resolved(t).withColumnRenamed("resolved_name", "process_name")
    found = attribution.attribute_files(t.notif, activity, ["path_id"], ["t_ms", "io_id"], ["status", "missing_reason", "process_name"])
    named = attribution.attribution_fields(found.withColumn("io_id", F.col("io.io_id")))
    return named.select("id", "io_id", "attribution_status", "attribution_confidence", "attribution_missing_reason", "process_name")


@query("""
  WITH b AS (SELECT *, last_value(CASE WHEN op IN ('create', 'delete') THEN {'p': CASE WHEN op = 'create' THEN path END, 'a': seq} END IGNORE NULLS)
      OVER (PARTITION BY host, handle ORDER BY seq ROWS UNBOUNDED PRECEDING) AS bound FROM {kcb})
  SELECT seq, host, handle, CASE WHEN handle <> 0 AND NOT EXISTS (SELECT 1 FROM {kcb_clears} c WHERE c.host = b.host AND c.seq >= b.bound.a AND c.seq <= b.seq)
      THEN bound.p END AS resolved_path FROM b WHERE op = 'use'""")
def handle_path_resolution(t):
    return attribution.resolve_handles(t.kcb, t.kcb_clears, widths=SEQ).select("seq", "host", "handle", "resolved_path")


@query("""SELECT r.row_id, r.sid, coalesce(CASE WHEN trim(l.account) <> '' THEN l.account END, tr.account, r.sid) AS account
  FROM {sid_rows} r LEFT JOIN {sid_local} l ON l.sid = r.sid LEFT JOIN {sid_translated} tr ON tr.sid = r.sid""")
def sid_account(t):
    return attribution.resolve_accounts(t.sid_rows, t.sid_local, t.sid_translated)


@query("""
  SELECT record_id, 'S-1-5-' || regexp_extract(xml, 'SubjectUserSid">S-1-5-([0-9]+)<', 1) AS subject_user_sid,
    regexp_extract(xml, '>(C:/S[0-9]+/f)<', 1) AS object_name, regexp_extract(xml, 'newvalue">([a-z]+)<', 1) AS new_value FROM {audit_xml}
  WHERE native_event_id IN (4663, 4657) AND (regexp_extract(xml, '>(C:/S[0-9]+/f)<', 1) LIKE 'C:/S1%' OR regexp_extract(xml, '>(C:/S[0-9]+/f)<', 1) LIKE 'C:/S2%')""")
def audit_xml(t):
    parsed = attribution.parse_audit(t.audit_xml)
    return scope.audit_scope(parsed, "scope_name", ["c:/s1", "C:/S2"]).select("record_id", "subject_user_sid", "object_name", "new_value")


@query("""SELECT seq, host, path FROM {file_trace} WHERE task = 'fileio' AND opcode IN ('Write', 'Delete', 'SetInfo') AND process_id > 0 AND process_id <> 7 AND trim(path) <> ''""")
def file_mutation_filter(t):
    return attribution.file_mutations(tables.split_file_trace(t.file_trace)[0], own_pid=7).select("seq", "host", "path")


@query("""SELECT host, process_id, cast(process_sequence_number AS bigint) AS process_sequence_number, min(CASE WHEN opcode <> 'Stop' THEN t_ms END) AS start_ms,
    max(CASE WHEN opcode = 'Stop' THEN t_ms END) AS end_ms, arg_max(process_name, CASE WHEN opcode <> 'Stop' THEN seq END) AS process_name,
    (SELECT min(t_ms) FROM {file_trace} d WHERE d.host = f.host AND d.task = 'Process' AND d.opcode = 'DCStart' AND d.process_sequence_number IS NOT NULL) AS rundown_ms
  FROM {file_trace} f WHERE task = 'Process' AND process_sequence_number IS NOT NULL GROUP BY host, process_id, process_sequence_number
  HAVING min(CASE WHEN opcode <> 'Stop' THEN t_ms END) IS NOT NULL""")
def process_lifecycle(t):
    lifecycle = tables.split_file_trace(t.file_trace)[1]
    spans = attribution.process_intervals(lifecycle).join(attribution.rundown_times(lifecycle), "host", "left")
    return spans.select("host", "process_id", F.col("process_sequence_number").cast("long").alias("process_sequence_number"),
                        "start_ms", "end_ms", "process_name", "rundown_ms")


@query("""SELECT seq, CASE WHEN process_id > 3 THEN 'Low' ELSE 'None' END AS attribution_confidence, CASE WHEN process_id > 3 THEN NULL ELSE 'ProcessExitedOrAccessDenied' END
    AS attribution_missing_reason, 'RegistryETWPostEventPid' AS attribution_method FROM {file_trace} WHERE process_id <> -1""")
def registry_attribution(t):
    status = F.when(F.col("process_id") > 3, "Attributed").otherwise("Unavailable")
    kept = attribution.registry_actors(t.file_trace, "path")
    return kept.select("seq", *[v.alias(k) for k, v in attribution.registry_attribution(status).items()])


@query("""
  SELECT seq, CASE WHEN opcode = 'Write' THEN 'use' WHEN opcode = 'Delete' THEN 'delete' ELSE 'create' END AS op FROM {file_trace} WHERE opcode IN ('Write', 'Delete', 'Start')""")
def handle_trace_split(t):
    opcode = F.when(F.col("opcode") == "Write", 14).when(F.col("opcode") == "Delete", 23).when(F.col("opcode") == "Start", 22)
    trace = t.file_trace.select("seq", opcode.alias("opcode"), F.col("path").alias("key_name")).filter("opcode IS NOT NULL")
    return tables.handle_operations(trace).select("seq", "op")
