"""Inputs of the registered queries, derived from the given tables.

One SQL text per derived table, used by Spark here and as a CTE by the SQL the results are checked against. Names in
braces are other tables. The few spellings that differ between the engines are marked: ``SHA[[x]]`` (SHA-256 as lower
hex), ``DAYS[[x]]`` (days since 1970-01-01) and ``EACH[[a,b]]`` (one row per value).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

_PATH = "concat('C:/Data/', source, '/', lang, '/doc', cast(doc_id AS string))"

DERIVED = {
    # Inventories: host = document source, path = its place, content = its whole text.
    "members_prev": f"""
      SELECT source AS host, {_PATH} AS path, upper({_PATH}) AS identity_key, 0 AS node_type, n_chars AS size_bytes,
        upper(SHA[[text]]) AS content_hash, CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END AS hash_state
      FROM {{documents}} WHERE doc_id % 11 <> 0""",
    "members_curr": f"""
      SELECT source AS host, {_PATH} AS path, upper({_PATH}) AS identity_key, 0 AS node_type, n_chars AS size_bytes,
        upper(SHA[[CASE WHEN doc_id % 7 = 0 THEN concat(text, '#v2') ELSE text END]]) AS content_hash,
        CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END AS hash_state
      FROM {{documents}} WHERE doc_id % 13 <> 0""",
    "member_dirs": """
      SELECT DISTINCT source AS host, concat('C:/Data/', source, '/', lang) AS path,
        CASE WHEN lang = 'en' THEN 3 WHEN lang = 'fr' THEN 1 ELSE 0 END AS acl_state FROM {documents}""",
    "passes": """
      SELECT host, identity_key, pass, CASE WHEN host = 'src2' AND doc_id % 10 < 9 THEN concat('u', cast(pass AS string))
        WHEN host = 'src1' AND pass = 1 THEN 'old' ELSE 'same' END AS fingerprint
      FROM (SELECT source AS host, doc_id, concat('D', cast(doc_id AS string)) AS identity_key, EACH[[1,2,3]] AS pass
            FROM {documents}) d""",
    "dup_members": """
      SELECT concat('L', cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS identity_key FROM {lineitem}""",
    "found_files": """
      SELECT source AS host, concat('c:/data/', source, '/', lang, '/doc', cast(doc_id AS string)) AS path,
        doc_id % 8192 AS attributes FROM {documents}""",
    # Baselines: one per order.
    "baselines": """
      SELECT concat('H', cast(o_orderkey % 4 AS string)) AS host, cast(floor(o_orderkey / 4) AS bigint) AS id,
        CASE WHEN o_custkey % 2 = 0 THEN 'FileSystem' ELSE 'Registry' END AS source, concat('S', cast(o_custkey % 5 AS string)) AS scope_hash, concat('V', cast(o_custkey % 3 AS string)) AS source_identity,
        1 AS schema_version, 1 + o_orderkey % 3 AS algorithm,
        CASE o_orderstatus WHEN 'F' THEN 'Complete' WHEN 'O' THEN 'Building' ELSE 'Invalid' END AS status,
        CASE WHEN o_orderkey % 10 < 8 THEN 'Current' ELSE 'Superseded' END AS applicability,
        cast(DAYS[[o_orderdate]] AS bigint) * 86400000 AS completed_ms
      FROM {orders}""",
    "run_results": """
      SELECT concat('H', cast(l_orderkey % 4 AS string)) AS host, cast(floor(l_orderkey / 4) AS bigint) AS baseline_id, CASE WHEN l_linestatus <> 'O' THEN cast(0 AS bigint) END AS delivered_ms FROM {lineitem}""",
    "begun": """
      SELECT b.host, b.source, b.scope_hash, b.source_identity, b.schema_version, b.algorithm FROM {baselines} b
      JOIN (SELECT host, source, max(id) AS id FROM {baselines} WHERE status = 'Building' GROUP BY host, source) m
        ON b.host = m.host AND b.id = m.id AND b.source = m.source""",
    "fallback_runs": """
      SELECT host, source, scope_hash, source_identity, schema_version, algorithm, max(id) AS id FROM {baselines}
      WHERE status = 'Building' GROUP BY host, source, scope_hash, source_identity, schema_version, algorithm""",
    "status_log": """
      SELECT o_custkey AS baseline, o_orderkey AS step,
        CASE o_orderstatus WHEN 'F' THEN 'Reconciling' WHEN 'O' THEN 'Building' ELSE 'Complete' END AS status FROM {orders}""",
    "pending_source": """
      SELECT concat('F', cast(event_id AS string)) AS id, concat('H', cast(user_id % 4 AS string)) AS host,
        event_id * 2 AS baseline_id, concat('ID', cast(user_id AS string)) AS identity,
        CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' ELSE 'Changed' END AS change,
        CASE WHEN event_type <> 'signup' THEN concat('C:/f', cast(user_id AS string)) END AS old_path,
        CASE WHEN event_type <> 'error' THEN concat('C:/f', cast(user_id AS string)) END AS new_path,
        event_id * 1000 AS detected_ms,
        CASE WHEN event_type IN ('click', 'view') THEN event_id * 1000 + 5 END AS delivered_ms,
        event_id % 4 AS delivery_attempts FROM {events}""",
    # Path scopes.
    "scope_paths": "SELECT page_id, url AS path FROM {pages}",
    "scope_monitored": """
      SELECT regexp_replace(path, '/[^/]*/?$', '') AS root, min(page_id) AS ordinal FROM {scope_paths}
      WHERE page_id % 5 = 0 GROUP BY regexp_replace(path, '/[^/]*/?$', '')""",
    "scope_excluded": "SELECT DISTINCT regexp_replace(path, '/$', '') AS root FROM {scope_paths} WHERE page_id % 9 = 0",
    # Registry names and values.
    "registry_keys": """
      SELECT concat('HKEY_USERS', chr(92), CASE WHEN c_custkey % 10 = 0 THEN '.DEFAULT'
          ELSE concat('S-1-5-21-', cast(c_custkey % 50 AS string)) END, chr(92), 'Software', chr(92), c_mktsegment, chr(92),
          replace(c_name, '#', '')) AS key_name, c_custkey AS row_id FROM {customer}
      UNION ALL
      SELECT concat('HKEY_LOCAL_MACHINE', chr(92), 'SOFTWARE', chr(92), replace(p_brand, '#', ''), chr(92), p_type), p_partkey FROM {part}""",
    "registry_included": """
      SELECT DISTINCT concat('HKEY_CURRENT_USER', chr(92), 'SOFTWARE', chr(92), c_mktsegment) AS root FROM {customer} WHERE c_custkey % 3 = 0
      UNION SELECT DISTINCT concat('HKEY_LOCAL_MACHINE', chr(92), 'SOFTWARE', chr(92), replace(p_brand, '#', '')) FROM {part} WHERE p_partkey % 4 = 0""",
    "registry_excluded": """
      SELECT DISTINCT concat('HKEY_LOCAL_MACHINE', chr(92), 'SOFTWARE', chr(92), replace(p_brand, '#', ''), chr(92), p_type) AS root
      FROM {part} WHERE p_partkey % 97 = 0""",
    "registry_roots": "SELECT root FROM {registry_included} UNION SELECT root FROM {registry_excluded}",
    "host_roots": """
      SELECT DISTINCT concat('host', cast(c_nationkey AS string)) AS host, CASE WHEN c_custkey % 4 = 0
        THEN concat('HKEY_LOCAL_MACHINE', chr(92), c_mktsegment, chr(92))
        ELSE concat('HKEY_CURRENT_USER', chr(92), 'Software', chr(92), c_mktsegment) END AS root FROM {customer}""",
    "loaded_sids": """
      SELECT DISTINCT concat('host', cast(c_nationkey AS string)) AS host, concat('S-1-5-21-', cast(c_custkey % 50 AS string),
        CASE WHEN c_custkey % 7 = 0 THEN '_Classes' ELSE '' END) AS sid FROM {customer}""",
    "kernel_names": """
      SELECT p_partkey AS row_id, concat(chr(92), 'REGISTRY', chr(92), CASE WHEN p_partkey % 2 = 0 THEN 'Machine' ELSE 'USER' END) AS cached,
        CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_brand END AS key_part, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_type END AS value_part
      FROM {part}""",
    "registry_values": """
      SELECT p_partkey AS row_id, CASE p_partkey % 5 WHEN 0 THEN 'DWord' WHEN 1 THEN 'QWord' WHEN 2 THEN 'Binary'
          WHEN 3 THEN 'MultiString' ELSE 'String' END AS kind,
        CASE WHEN p_partkey % 40 = 4 THEN '' ELSE p_name END AS text_value, cast(p_size AS bigint) AS int_value, hex(p_name) AS hex_value
      FROM {part}""",
    "scope_lists": """
      SELECT concat('host', cast(c_nationkey AS string)) AS host,
        CASE c_custkey % 5 WHEN 0 THEN 'MP' WHEN 1 THEN 'XP' WHEN 2 THEN 'XE' WHEN 3 THEN 'MK' ELSE 'XK' END AS list_name,
        CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN concat(' C:', chr(92), c_mktsegment, chr(92))
          ELSE concat('c:', chr(92), lower(c_mktsegment)) END AS value FROM {customer}""",
    # Change events: host = user_id % 4.
    "raw_notifications": """
      SELECT concat('H', cast(user_id % 4 AS string)) AS host, event_id AS seq, event_id * 10 AS t_ms,
        cast(floor(event_id / 8) AS bigint) AS win,
        CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' ELSE 'Changed' END AS category,
        concat(CASE WHEN event_id % 2 = 0 THEN 'C:/B' ELSE 'c:/b' END,
          cast((user_id + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) % 3 AS string)) AS full_path,
        CASE WHEN event_type = 'purchase' THEN concat('C:/B', cast(user_id % 3 AS string)) END AS old_path FROM {events}""",
    "rename_pairs": """
      SELECT event_id AS seq, CASE WHEN user_id % 5 <> 0 THEN concat('C:/U', cast(user_id % 10 AS string), '/a') END AS old_path,
        CASE WHEN user_id % 7 <> 0 THEN concat('C:/U', cast((user_id + 3) % 10 AS string), '/b') END AS new_path FROM {events}""",
    "fs_changes": """
      SELECT concat('H', cast(user_id % 4 AS string)) AS host, concat('R', cast(event_id AS string)) AS id, event_id AS seq,
        event_id * 1000 AS t_ms, CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' WHEN 'view' THEN 'Discovery'
          ELSE 'Changed' END AS change_category,
        concat(CASE WHEN event_id % 2 = 0 THEN 'C:/U' ELSE 'c:/u' END, cast(user_id AS string), '/f',
          cast((event_id + CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) % 5 AS string)) AS entity,
        CASE WHEN event_type = 'purchase' THEN concat('C:/U', cast(user_id AS string), '/f', cast(event_id % 5 AS string)) END AS old_path,
        upper(SHA[[cast(event_id % 17 AS string)]]) AS current_hash, cast(floor(value * 100) AS bigint) AS size_bytes,
        concat('acl', cast(event_id % 3 AS string)) AS acls,
        CASE WHEN event_id % 4 = 0 THEN 'Directory' ELSE 'File' END AS object_type FROM {events}""",
    "reg_changes": """
      SELECT concat('H', cast(user_id % 4 AS string)) AS host, concat('G', cast(event_id AS string)) AS id, event_id AS seq,
        event_id * 1000 AS t_ms, concat(CASE WHEN event_id % 2 = 0 THEN 'HKEY_LOCAL_MACHINE' ELSE 'hkey_local_machine' END, chr(92),
          'Vendor', cast(user_id % 40 AS string)) AS entity,
        CASE event_type WHEN 'signup' THEN 'Created' WHEN 'error' THEN 'Deleted' ELSE 'Changed' END AS change_category,
        'LocalMachine' AS hive, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('v', cast(event_id % 5 AS string)) END AS value_name,
        concat('acl', cast(event_id % 7 AS string)) AS acls FROM {events}""",
    "typed_events": """
      SELECT event_id AS seq, concat('H', cast(user_id % 4 AS string)) AS host, cast(event_id % 3 AS int) AS schema_version,
        cast(CASE event_id % 8 WHEN 0 THEN 7776 WHEN 1 THEN 7786 WHEN 2 THEN 7790 WHEN 3 THEN 7791 WHEN 4 THEN 7794 WHEN 5 THEN 7795
          WHEN 6 THEN 7798 ELSE 7770 END AS int) AS event_id,
        CASE WHEN event_id % 19 = 0 THEN 'Unknown' ELSE CASE event_id % 8 WHEN 0 THEN 'FileSystemFinding' WHEN 1 THEN 'RegistryFinding'
          WHEN 2 THEN 'Health' WHEN 3 THEN 'CoverageGap' WHEN 4 THEN 'ConfigurationChanged' WHEN 5 THEN 'BaselineFinding'
          WHEN 6 THEN 'TpmIntegrityUnavailable' ELSE 'ServiceError' END END AS record_type,
        event_type = 'error' AS error FROM {events}""",
    # Access lists of at most sixteen entries.
    "aces": """
      SELECT cast(floor(s_suppkey / 16) AS bigint) AS acl_id, s_suppkey AS ord, s_name AS identity_name, 2032127 - s_suppkey AS rights,
        CASE WHEN s_suppkey % 4 = 0 THEN 'Deny' ELSE 'Allow' END AS ace_type, s_suppkey % 2 = 0 AS inherited,
        cast(s_suppkey % 4 AS int) AS inheritance, cast(s_suppkey % 3 AS int) AS propagation FROM {supplier}""",
    # Attribution.
    "notif": "SELECT event_id AS id, event_id * 1000 AS t_ms, user_id % 50 AS path_id FROM {events} WHERE event_type = 'purchase'",
    "file_io": """
      SELECT event_id AS io_id, event_id * 1000 AS t_ms, user_id % 50 AS path_id, user_id % 20 AS pid,
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast(floor(event_id / 500) AS bigint) END AS seq
      FROM {events} WHERE event_type <> 'purchase'""",
    "process_instances": """
      SELECT user_id % 20 AS pid, cast(floor(event_id / 500) AS bigint) AS seq, min(event_id) * 1000 AS start_ms,
        max(event_id) * 1000 - 20000 AS end_ms, concat('p', cast(user_id % 20 AS string), '.exe') AS process_name
      FROM {events} WHERE user_id % 20 <> 7 GROUP BY user_id % 20, cast(floor(event_id / 500) AS bigint)""",
    "kcb": """
      SELECT concat('H', cast(user_id % 4 AS string)) AS host, event_id AS seq, user_id AS handle,
        CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'use' END AS op,
        concat('K', cast(event_id AS string)) AS path FROM {events}""",
    "kcb_clears": """
      SELECT concat('H', cast(user_id % 4 AS string)) AS host, event_id AS seq FROM {events}
      WHERE event_type = 'error' AND event_id % 16 = 3""",
    "sid_rows": "SELECT c_custkey AS row_id, concat('S-1-5-', cast(c_custkey AS string)) AS sid FROM {customer}",
    "sid_local": "SELECT concat('S-1-5-', cast(c_custkey AS string)) AS sid, CASE WHEN c_custkey % 6 = 0 THEN ' ' ELSE c_name END AS account FROM {customer} WHERE c_custkey % 3 = 0",
    "sid_translated": "SELECT concat('S-1-5-', cast(c_custkey AS string)) AS sid, concat('DOM', chr(92), c_name) AS account FROM {customer} WHERE c_custkey % 2 = 0",
    "audit_xml": """
      SELECT concat('H', cast(user_id % 4 AS string)) AS host, event_id AS record_id, event_id * 1000 AS t_ms,
        CASE WHEN event_id % 5 = 0 THEN 4670 WHEN event_id % 2 = 0 THEN 4663 ELSE 4657 END AS native_event_id,
        concat('<Event><Data Name="SubjectUserSid">S-1-5-', cast(user_id AS string), '</Data><Data Name="',
          CASE WHEN event_id % 3 = 0 THEN 'KeyName' ELSE 'ObjectName' END, '">C:/S', cast(user_id % 30 AS string),
          '/f</Data><Data Name="NewValue">old</Data><Data Name="newvalue">', event_type, '</Data></Event>') AS xml FROM {events}""",
    # Delivery.
    "outbox_inserts": """
      SELECT event_id AS seq, concat('R', cast(event_id % 9000 AS string)) AS id, concat('H', cast(user_id % 4 AS string)) AS host,
        CASE WHEN event_id % 101 = 0 THEN '' ELSE 'FileSystemFinding' END AS record_type, event_id * 1000 AS created_ms,
        CASE WHEN event_type IN ('click', 'view') THEN event_id * 1000 + 500 END AS delivered_ms,
        event_id % 12 AS delivery_attempts, event_id * 1000 + (event_id % 12) * 100000 AS next_attempt_ms,
        event_type = 'error' AS sink_fails FROM {events}""",
    "outbox": """
      SELECT o.seq, o.id, o.host, o.record_type, o.created_ms, o.delivered_ms, o.delivery_attempts, o.next_attempt_ms, o.sink_fails
      FROM {outbox_inserts} o JOIN (SELECT id, min(seq) AS seq FROM {outbox_inserts} GROUP BY id) f ON o.id = f.id AND o.seq = f.seq""",
    # Health.
    "pipeline_log": """
      SELECT concat('H', cast(user_id % 4 AS string)) AS host, event_id * 1000 AS t_ms,
        CASE event_type WHEN 'click' THEN 'processed' WHEN 'error' THEN 'dropped' WHEN 'purchase' THEN 'failed' ELSE 'accepted' END AS kind
      FROM {events}""",
    "heartbeats": """
      SELECT concat('H', cast(user_id % 4 AS string)) AS host, cast(floor(event_id / 40) AS bigint) AS beat, max(event_id) * 1000 AS t_ms,
        count(*) AS accepted, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS dropped,
        sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS enrichment_failures,
        (max(event_id) - min(event_id)) * 1000 AS oldest_age_ms,
        cast(floor(max(event_id) / 130) AS bigint) * 3 AS events_lost
      FROM {events} GROUP BY concat('H', cast(user_id % 4 AS string)), cast(floor(event_id / 40) AS bigint)""",
    "gap_events": """
      SELECT event_id AS seq, concat('H', cast(user_id % 4 AS string)) AS host, concat('scope', cast(user_id % 25 AS string)) AS scope,
        CASE event_type WHEN 'error' THEN 'CoverageGap' ELSE 'SourceRecovered' END AS record_type
      FROM {events} WHERE event_type IN ('error', 'signup')""",
    "checks": """
      SELECT concat('H', cast(user_id % 4 AS string)) AS host, event_id * 1000 AS t_ms,
        CASE WHEN event_type = 'signup' THEN event_id * 1000 END AS success_ms, cast(0 AS bigint) AS started_ms FROM {events}""",
    "latencies": "SELECT concat('H', cast(user_id % 4 AS string)) AS host, event_id * 1000 AS t_ms, cast(floor(value) AS bigint) AS latency_ms FROM {events}",
    "requests": """
      SELECT concat('H', cast(user_id % 4 AS string)) AS host, CASE WHEN event_id % 3 = 0 THEN 'Registry' ELSE 'FileSystem' END AS source,
        event_id * 1000 AS t_ms, concat('reason', cast(event_id AS string)) AS reason FROM {events} WHERE event_type = 'error'""",
    "run_starts": """
      SELECT concat('H', cast(user_id % 4 AS string)) AS host, CASE WHEN event_id % 3 = 0 THEN 'Registry' ELSE 'FileSystem' END AS source,
        event_id * 1000 AS t_ms FROM {events} WHERE event_type = 'signup'""",
    "file_trace": """
      SELECT concat('H', cast(user_id % 4 AS string)) AS host, event_id AS seq, event_id * 1000 AS t_ms,
        CASE WHEN event_id % 6 = 0 THEN 'Process' ELSE 'fileio' END AS task,
        CASE WHEN event_id % 6 = 0 THEN CASE event_type WHEN 'error' THEN 'Stop' WHEN 'view' THEN 'DCStart' ELSE 'Start' END
          ELSE CASE event_type WHEN 'view' THEN 'Read' WHEN 'click' THEN 'Write' WHEN 'error' THEN 'Delete' ELSE 'SetInfo' END END AS opcode,
        cast(user_id % 20 - 1 AS int) AS process_id, CASE WHEN event_id % 9 <> 0 THEN user_id % 3 END AS process_sequence_number,
        concat('p', cast(user_id % 20 AS string), '.exe') AS process_name,
        CASE WHEN event_id % 10 = 7 THEN ' ' ELSE concat('C:/t', cast(user_id % 50 AS string)) END AS path,
        concat('u', cast(user_id % 5 AS string)) AS username, concat('S-1-', cast(user_id % 5 AS string)) AS user_sid FROM {events}""",
    "read_outcomes": """
      SELECT doc_id, n_chars AS length, CASE doc_id % 9 WHEN 0 THEN 'AccessDenied' WHEN 1 THEN 'Vanished' WHEN 2 THEN 'Locked' WHEN 3 THEN 'Odd' END AS error,
        doc_id % 5 <> 0 AS is_file FROM {documents}""",
    "full_members": """
      SELECT source AS host, concat('C:/Data/', source, '/doc', cast(doc_id AS string)) AS path, cast(doc_id % 5 AS int) AS node_type,
        CASE WHEN doc_id % 3 <> 0 THEN upper(SHA[[text]]) END AS content_hash, cast(doc_id % 7 AS int) AS hash_state, cast(doc_id % 4 AS int) AS acl_state,
        concat('acl', cast(doc_id % 6 AS string)) AS acl_evidence, CASE WHEN doc_id % 2 = 0 THEN cast(doc_id % 4 AS int) END AS link_count,
        doc_id % 2 = 0 AS is_system, doc_id % 3 = 0 AS is_sparse, doc_id % 5 = 0 AS is_temporary, doc_id % 7 = 0 AS is_offline,
        CASE WHEN doc_id % 5 = 4 THEN 'String' END AS registry_value_kind, doc_id, lang FROM {documents}""",
    # Settings: host = nation.
    "settings_policy": "SELECT concat('host', cast(n_nationkey AS string)) AS host, name, concat('pol-', name) AS value FROM (SELECT n_nationkey, EACH[['MonitoredPaths','HashLimitMB','HeartbeatInterval']] AS name FROM {nation}) n WHERE n_nationkey % 3 = 0",
    "settings_preference": "SELECT concat('host', cast(n_nationkey AS string)) AS host, name, concat('pref-', name) AS value FROM (SELECT n_nationkey, EACH[['MonitoredPaths','HashLimitMB','HeartbeatInterval']] AS name FROM {nation}) n WHERE n_nationkey % 2 = 0",
    "settings_legacy": "SELECT concat('host', cast(n_nationkey AS string)) AS host, name, concat('leg-', name) AS value FROM (SELECT n_nationkey, EACH[['MonitoredPaths','HashLimitMB','HeartbeatInterval']] AS name FROM {nation}) n WHERE n_nationkey % 5 <> 0",
    "settings_values": """
      SELECT c_custkey AS row_id, CASE c_custkey % 6 WHEN 0 THEN concat('C:', chr(92), c_mktsegment) WHEN 1 THEN concat('relative', chr(92), c_mktsegment)
          WHEN 2 THEN concat('C:', chr(92), 'Us*ers', chr(92), c_mktsegment) WHEN 3 THEN concat('C:', chr(92), '*', chr(92), '*', chr(92), c_mktsegment)
          WHEN 4 THEN '' ELSE concat('C:', chr(92), 'a?b') END AS path_value,
        CASE c_custkey % 5 WHEN 0 THEN concat('HKLM', chr(92), c_mktsegment) WHEN 1 THEN concat('HKEY_USERS', chr(92), '*')
          WHEN 2 THEN concat('HKEY_LOCAL_MACHINE', chr(92), c_mktsegment) WHEN 3 THEN concat('hkey_local_machine', chr(92), 'software', chr(92)) ELSE '' END AS key_value,
        CASE c_custkey % 4 WHEN 0 THEN 'CaptureQueueCapacity' WHEN 1 THEN 'DiscoveryConcurrency' WHEN 2 THEN 'WatcherBufferSizeKB'
          ELSE 'RegistrySnapshotInterval' END AS number_name, c_custkey % 90 AS number_value FROM {customer}""",
    "settings_generations": """
      SELECT concat('host', cast(o_custkey % 25 AS string)) AS host, o_orderkey AS generation, concat('S', cast(o_orderkey % 3 AS string)) AS scope_hash,
        CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS enable_registry FROM {orders}""",
    "audit_scopes": """
      SELECT concat('host', cast(c_nationkey AS string)) AS host, concat('C:', chr(92), c_name, CASE WHEN c_custkey % 211 = 0 THEN '*' ELSE '' END) AS scope
      FROM {customer}""",
    # Hosts named after regions have no rows in any list.
    "settings_hosts": """
      SELECT concat('host', cast(n_nationkey AS string)) AS host FROM {nation}
      UNION ALL SELECT concat('region', cast(r_regionkey AS string)) AS host FROM {region}""",
    "audit_switches": """
      SELECT concat('host', cast(n_nationkey AS string)) AS host, n_nationkey % 6 <> 0 AS enabled FROM {nation}
      UNION ALL SELECT concat('region', cast(r_regionkey AS string)) AS host, r_regionkey <> 1 AS enabled FROM {region}""",
    "legacy_baselines": """
      SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'sha256-v1' WHEN 1 THEN 'registry-v1' WHEN 2 THEN 'registry-v2'
          WHEN 3 THEN 'tpm-rsa-pss-sha256-v1' WHEN 4 THEN 'sha256-v1+tpm-rsa-pss-v1' ELSE 'registry-v2+tpm-rsa-pss-v1' END AS algorithm_version,
        'Complete' AS status, SHA[[cast(o_orderkey AS string)]] AS integrity_manifest_hash FROM {orders}""",
}


def dependencies(name: str) -> list[str]:
    """Tables a derivation reads directly."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", DERIVED[name])))


def _spell(sql: str, sha: str, days: str, each: str) -> str:
    sql = re.sub(r"SHA\[\[(.*?)\]\]", lambda m: sha.format(m.group(1)), sql)
    sql = re.sub(r"DAYS\[\[(.*?)\]\]", lambda m: days.format(m.group(1)), sql)
    return re.sub(r"EACH\[\[(.*?)\]\]", lambda m: each.format(m.group(1)), sql)


class Inputs:
    """Reads given tables and builds derived ones on demand."""

    def __init__(self, spark: SparkSession, directory: str, known: dict[str, DataFrame] | None = None):
        self.spark, self.directory, self._known = spark, directory, dict(known or {})

    def streaming(self, table: str, **options: str) -> Inputs:
        """The same inputs with one given table read as a stream of its files; ``options`` go to the reader."""
        schema = getattr(self, table).schema
        # The trailing star makes this a pattern, which covers a single file as well as a folder of part files.
        stream = (self.spark.readStream.schema(schema).options(**options)
                  .parquet(f"{self.directory}/{table}.parquet*"))
        return Inputs(self.spark, self.directory, {table: stream})

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
            elif name in DERIVED:
                sql = _spell(DERIVED[name], "sha2({}, 256)", "unix_date(cast({} AS date))", "explode(array({}))")
                self._known[name] = self.spark.sql(sql, **{d: getattr(self, d) for d in dependencies(name)})
            else:
                raise AttributeError(name)
        return self._known[name]


# Rows in a file of a table that arrives in parts.
_FILE_ROWS = 250_000


def arriving(df: DataFrame, part: Column, parts: int, folder: str, least: int = 2) -> int:
    """Write the rows of parts 0, 1, ... to ``folder``, one part after the other; give the number of files, which is that of every part.

    The largest part decides on the number, so that no task has much to write; a part that fills fewer files gets empty ones.
    """
    sizes = [row["count"] for row in df.groupBy(part.alias("part")).count().filter(f"part BETWEEN 0 AND {parts - 1}").collect()]  # a row per part
    files, written = max(least, -(-max(sizes, default=0) // _FILE_ROWS)), df.sparkSession.read.schema(df.schema)
    for k in range(parts):
        df.filter(part == k).repartition(files).write.mode("append").parquet(folder)
        for _ in range((k + 1) * files - len(written.parquet(folder).inputFiles())):
            df.sparkSession.createDataFrame([], df.schema).write.mode("append").parquet(folder)
    return files


def with_tables(sql: str) -> str:
    """Checking SQL with the derived tables it names (in braces) put in front as CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in DERIVED and name not in ordered:
            for dependency in dependencies(name):
                visit(dependency)
            ordered.append(name)

    for name in re.findall(r"\{(\w+)\}", sql):
        visit(name)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    spelled = {n: _spell(DERIVED[n], "sha256({})", "date_diff('day', DATE '1970-01-01', cast({} AS date))", "unnest([{}])")
               for n in ordered}
    ctes = [f"{n} AS ({plain(spelled[n])})" for n in ordered]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
