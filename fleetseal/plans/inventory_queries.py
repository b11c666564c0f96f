"""Queries over inventories and baseline generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetseal.functions import evidence
from fleetseal.operators import discovery, inventory, lineage, migration
from fleetseal.plans.registry import query
from fleetseal.schemas import EVIDENCE_STATES, HASH_STATES, enum_name
from fleetseal.sources.tables import registry_members

DAY_MS = 86_400_000
MONTHS = (30 * DAY_MS, 3000 * DAY_MS)
IDS = (1000, 1_000_000)


@query("""
  SELECT coalesce(p.host, c.host) AS host, coalesce(p.identity_key, c.identity_key) AS identity_key,
    CASE WHEN p.path IS NULL THEN 'Created' WHEN c.path IS NULL THEN 'Deleted' ELSE 'Changed' END AS change,
    p.path AS old_path, c.path AS new_path
  FROM {members_prev} p FULL OUTER JOIN {members_curr} c ON p.host = c.host AND p.identity_key = c.identity_key
  WHERE p.path IS NULL OR c.path IS NULL OR p.content_hash <> c.content_hash OR p.hash_state <> c.hash_state""")
def snapshot_diff(t):
    return inventory.diff(inventory.with_identity(t.members_prev), inventory.with_identity(t.members_curr))


@query("SELECT identity_key, count(*) AS n FROM {dup_members} GROUP BY identity_key HAVING count(*) > 1")
def duplicate_identity_guard(t):
    return inventory.duplicate_identities(t.dup_members, ["identity_key"])


@query("""
  WITH agree AS (
    SELECT a.host, b.pass, count(*) AS items FROM {passes} a
    JOIN {passes} b ON a.host = b.host AND a.identity_key = b.identity_key AND b.pass = a.pass + 1
    GROUP BY a.host, b.pass HAVING bool_and(a.fingerprint = b.fingerprint)),
  first_agree AS (SELECT host, min(pass) AS pass FROM agree GROUP BY host)
  SELECT h.host, cast(f.pass AS integer) AS agreed_pass, a.items AS item_count, f.pass IS NULL AS unstable
  FROM (SELECT DISTINCT host FROM {passes}) h LEFT JOIN first_agree f ON h.host = f.host
  LEFT JOIN agree a ON a.host = f.host AND a.pass = f.pass""")
def snapshot_convergence(t):
    return inventory.convergence(t.passes)


@query("""
  WITH l AS (SELECT host, identity_key, content_hash, hash_state FROM {members_prev}),
  r AS (SELECT host, identity_key, content_hash, hash_state FROM {members_curr}),
  lo AS (SELECT host, count(*) AS n FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r) x GROUP BY host),
  ro AS (SELECT host, count(*) AS n FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l) x GROUP BY host)
  SELECT h.host, coalesce(lo.n, 0) AS only_left, coalesce(ro.n, 0) AS only_right,
    coalesce(lo.n, 0) = 0 AND coalesce(ro.n, 0) = 0 AS equal
  FROM (SELECT host FROM l UNION SELECT host FROM r) h LEFT JOIN lo ON h.host = lo.host LEFT JOIN ro ON h.host = ro.host""")
def inventory_set_equality(t):
    return inventory.inventory_equality(inventory.with_identity(t.members_prev), inventory.with_identity(t.members_curr))


@query("SELECT host, count(*) AS item_count FROM {members_curr} GROUP BY host")
def member_counts(t):
    return inventory.item_counts(t.members_curr, ["host"])


_DIGEST_FIELDS = ("identity_key", "path", "node_type", "content_hash", "hash_state")
_PREFIXED = " || ".join(
    f"coalesce(cast(length(cast({c} AS varchar)) AS varchar) || ':' || cast({c} AS varchar), '-;')" for c in _DIGEST_FIELDS)
_TREE = f"""
  hashed AS (SELECT host, h, count(*) AS n FROM (SELECT host, sha256({_PREFIXED}) AS h FROM {{source}}) x GROUP BY host, h),
  leaf AS (SELECT host, h[1:6] AS p, sum(n) AS n, sha256(string_agg(h || ':' || cast(n AS varchar), ',' ORDER BY h)) AS d
    FROM hashed GROUP BY host, h[1:6]),
  mid AS (SELECT host, p[1:3] AS p, sum(n) AS n, sha256(string_agg(p || ':' || d, ',' ORDER BY p)) AS d FROM leaf GROUP BY host, p[1:3]),
  top AS (SELECT host, sum(n) AS n, sha256(string_agg(p || ':' || d, ',' ORDER BY p)) AS d FROM mid GROUP BY host),
  manifest AS (SELECT host, cast(n AS bigint) AS item_count,
    sha256(length(cast(n AS varchar)) || ':' || cast(n AS varchar) || length(d) || ':' || d) AS digest FROM top)"""


def _digest(members):
    fields = [F.col(c).cast("string") for c in _DIGEST_FIELDS]
    return inventory.manifest_digest(members, fields)


@query("WITH " + _TREE.replace("{source}", "{members_curr}") + " SELECT host, item_count, digest FROM manifest")
def manifest_digest(t):
    return _digest(t.members_curr)


@query("""SELECT p.host FROM {members_prev} p LEFT JOIN {members_curr} c ON p.host = c.host AND p.identity_key = c.identity_key
  GROUP BY p.host HAVING count(*) <> (SELECT count(*) FROM {members_curr} x WHERE x.host = p.host)
    OR bool_or(c.path IS NULL OR c.content_hash <> p.content_hash OR c.hash_state <> p.hash_state)""")
def manifest_verification(t):
    return inventory.verify_manifest(_digest(t.members_curr), _digest(t.members_prev)).select("host")


@query("""
  WITH d AS (
    SELECT coalesce(p.host, c.host) AS host, coalesce(p.identity_key, c.identity_key) AS identity_key,
      CASE WHEN p.path IS NULL THEN 'Created' WHEN c.path IS NULL THEN 'Deleted' ELSE 'Changed' END AS change, p.path AS old_path
    FROM {members_prev} p FULL OUTER JOIN {members_curr} c ON p.host = c.host AND p.identity_key = c.identity_key
    WHERE p.path IS NULL OR c.path IS NULL OR p.content_hash <> c.content_hash OR p.hash_state <> c.hash_state)
  SELECT host, identity_key, change, change = 'Deleted' AND EXISTS (SELECT 1 FROM {member_dirs} m WHERE m.host = d.host
    AND m.acl_state IN (1, 3) AND starts_with(d.old_path, m.path || '/')) AS suspect FROM d""")
def suspect_deletions(t):
    changes = inventory.diff(inventory.with_identity(t.members_prev), inventory.with_identity(t.members_curr))
    return inventory.flag_suspect_deletions(changes, t.member_dirs).select("host", "identity_key", "change", "suspect")


@query("""
  SELECT host, id, source, scope_hash, source_identity, schema_version, algorithm, completed_ms FROM (
    SELECT *, row_number() OVER (PARTITION BY host, source, scope_hash, source_identity, schema_version, algorithm
      ORDER BY completed_ms DESC, id DESC) AS rn FROM {baselines} WHERE status = 'Complete' AND applicability = 'Current') x WHERE rn = 1""")
def latest_complete_baseline(t):
    return lineage.latest_complete(t.baselines).drop("status", "applicability")


@query("""
  WITH newest AS (SELECT host, id FROM (SELECT b.host, b.id, row_number() OVER (PARTITION BY b.host, b.source, b.scope_hash, b.source_identity,
      b.schema_version, b.algorithm ORDER BY b.completed_ms DESC, b.id DESC) AS rn
    FROM {baselines} b JOIN {fallback_runs} f USING (host, source, scope_hash, source_identity, schema_version, algorithm)
    WHERE b.status = 'Complete' AND b.id <> f.id) x WHERE rn = 1)
  SELECT host, id, status, CASE WHEN (host, id) IN (SELECT host, id FROM newest) THEN 'Current' ELSE applicability END AS applicability FROM {baselines}""")
def fallback_reinstate(t):
    return lineage.reinstate_fallback(t.baselines, t.fallback_runs).select("host", "id", "status", "applicability")


@query("""
  WITH ranked AS (SELECT host, id, row_number() OVER (PARTITION BY host, source, scope_hash, source_identity, schema_version, algorithm
      ORDER BY completed_ms DESC, id DESC) AS rn FROM {baselines} WHERE status = 'Complete')
  SELECT b.host, b.id, CASE WHEN r.rn <= 2 THEN 'keep' WHEN EXISTS (SELECT 1 FROM {run_results} u WHERE u.host = b.host AND u.baseline_id = b.id
      AND u.delivered_ms IS NULL) THEN 'drop_members' ELSE 'delete' END AS action
  FROM {baselines} b LEFT JOIN ranked r ON b.host = r.host AND b.id = r.id""")
def generation_retention(t):
    return lineage.retention(t.baselines, t.run_results).select("host", "id", "action")


@query("""
  SELECT b.host, b.id, CASE WHEN b.status = 'Complete' AND (b.scope_hash, b.source_identity, b.schema_version, b.algorithm)
      <> (g.scope_hash, g.source_identity, g.schema_version, g.algorithm) THEN 'Superseded' ELSE b.applicability END AS applicability
  FROM {baselines} b LEFT JOIN {begun} g ON b.host = g.host AND b.source = g.source""")
def supersede_lineages(t):
    return lineage.supersede(t.baselines, t.begun).select("host", "id", "applicability")


@query("""
  SELECT source, scope_hash, source_identity, schema_version, algorithm, count(*) AS generations,
    max(completed_ms) AS newest_ms FROM {baselines} WHERE status = 'Complete'
  GROUP BY source, scope_hash, source_identity, schema_version, algorithm""")
def lineage_groups(t):
    return t.baselines.filter("status = 'Complete'").groupBy(*lineage.LINEAGE).agg(
        F.count("*").alias("generations"), F.max("completed_ms").alias("newest_ms"))


@query("""
  SELECT baseline, step, status, previous_status FROM (
    SELECT *, coalesce(lag(status) OVER (PARTITION BY baseline ORDER BY step), '') AS previous_status FROM {status_log}) x
  WHERE (previous_status, status) NOT IN (('', 'Building'), ('Building', 'Reconciling'), ('Reconciling', 'Complete'),
    ('Building', 'Invalid'), ('Reconciling', 'Invalid'))""")
def lifecycle_conformance(t):
    return lineage.lifecycle_violations(t.status_log, "baseline", ["step"], IDS)


@query("""
  WITH c AS (SELECT *, sum(CASE WHEN status = 'Complete' THEN 1 ELSE 0 END) OVER w AS island,
      max(CASE WHEN status = 'Complete' THEN completed_ms END) OVER w AS last_success_ms FROM {baselines}
    WINDOW w AS (PARTITION BY host, source ORDER BY completed_ms, id ROWS UNBOUNDED PRECEDING))
  SELECT host, id, cast(sum(CASE WHEN status = 'Invalid' THEN 1 ELSE 0 END) OVER (PARTITION BY host, source, island ORDER BY completed_ms, id
    ROWS UNBOUNDED PRECEDING) AS bigint) AS consecutive_failures, last_success_ms, status = 'Building' AS running,
    last_value(CASE WHEN status = 'Complete' THEN id % 97 END IGNORE NULLS) OVER (PARTITION BY host, source ORDER BY completed_ms, id
    ROWS UNBOUNDED PRECEDING) AS last_duration_ms FROM c""")
def run_health_state(t):
    health = lineage.run_health(t.baselines, ["host", "source"], ["completed_ms", "id"],
                                F.col("status") == "Complete", F.col("status") == "Invalid", F.col("id") % 97, MONTHS)
    return health.select("host", "id", "consecutive_failures", "last_success_ms", "running", "last_duration_ms")


@query("""
  SELECT id, cast(CASE id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 3 END AS integer) AS algorithm,
    CASE WHEN id % 6 = 1 THEN 'Invalid' ELSE 'Complete' END AS status,
    CASE WHEN id % 6 = 1 THEN 'superseded-format' END AS invalid_reason,
    upper(sha256(cast(id AS varchar))) AS manifest_hex FROM {legacy_baselines}""")
def legacy_decode(t):
    decoded = migration.decode_baselines(t.legacy_baselines)
    return decoded.select("id", "algorithm", "status", "invalid_reason", F.hex("integrity_manifest_hash").alias("manifest_hex"))


@query("SELECT host, path, attributes FROM {found_files} WHERE attributes & 5972 = 0")
def attribute_mask(t):
    return t.found_files.filter(discovery.is_plain_file(F.col("attributes")))


@query("""
  SELECT host, path, attributes FROM {found_files} f WHERE NOT EXISTS (
    SELECT 1 FROM {members_prev} m WHERE m.host = f.host AND m.identity_key = upper(f.path))""")
def discovery_new_entities(t):
    return discovery.new_entities(t.found_files, t.members_prev.withColumnRenamed("path", "entity"))


@query("""
  SELECT c.host, c.identity_key, c.content_hash, coalesce(p.content_hash, '') AS previous_hash FROM {members_curr} c
  LEFT JOIN {members_prev} p ON c.host = p.host AND c.identity_key = p.identity_key
  WHERE upper(c.content_hash) IS DISTINCT FROM upper(coalesce(p.content_hash, ''))""")
def discovery_hash_changed(t):
    changed = discovery.hash_changed(t.members_curr, t.members_prev, ["host", "identity_key"])
    return changed.select("host", "identity_key", "content_hash", "previous_hash")


@query("""
  SELECT host, count(*) AS total, count(*) FILTER (attributes & 5972 = 0) AS kept, count(*) FILTER (attributes & 5972 <> 0) AS filtered_out,
    round(count(*) FILTER (attributes & 5972 <> 0) * 100.0 / count(*), 2)::double AS percentage FROM {found_files} GROUP BY host""")
def discovery_stats(t):
    return discovery.statistics(t.found_files, discovery.is_plain_file(F.col("attributes")), ["host"])


@query("""
  SELECT path, ['File', 'Directory', 'ReparsePoint', 'RegistryKey', 'RegistryValue'][node_type + 1] || '|' || coalesce(content_hash, '') || '|' ||
    ['Hashed', 'SkippedBySizeCap', 'Locked', 'AccessDenied', 'Vanished', 'Failed', 'NotApplicable'][hash_state + 1] || '|' ||
    ['Available', 'AccessDenied', 'Vanished', 'Failed'][acl_state + 1] || '|' || acl_evidence || '|s1' || chr(31) || lang || '|' || coalesce(link_count::varchar, '') || '|' ||
    CASE WHEN is_system THEN 'True' ELSE 'False' END || '|' || CASE WHEN is_sparse THEN 'True' ELSE 'False' END || '|' ||
    CASE WHEN is_temporary THEN 'True' ELSE 'False' END || '|' || CASE WHEN is_offline THEN 'True' ELSE 'False' END || '|' ||
    coalesce(registry_value_kind, '') || '|' || CASE WHEN registry_value_kind IS NULL THEN '' ELSE base64(encode(lang)) END AS fingerprint FROM {full_members}""")
def member_fingerprint(t):
    members = t.full_members.withColumns({
        "stream_names": F.array(F.lit("s1"), F.col("lang")),
        "registry_value_data": F.when(F.col("registry_value_kind").isNotNull(), F.encode("lang", "UTF-8"))})
    return members.select("path", evidence.fingerprint(members).alias("fingerprint"))


@query("""
  SELECT doc_id, CASE WHEN NOT is_file THEN 'NotApplicable' WHEN error IN ('AccessDenied', 'Vanished', 'Locked') THEN error WHEN error IS NOT NULL THEN 'Failed'
      WHEN length <= 500 THEN 'Hashed' ELSE 'SkippedBySizeCap' END AS snapshot_state,
    CASE WHEN NOT is_file THEN 'NotApplicable' WHEN error IN ('AccessDenied', 'Vanished', 'Locked') THEN error WHEN error IS NOT NULL THEN 'Failed'
      WHEN length < 500 THEN 'Hashed' ELSE 'SkippedBySizeCap' END AS live_state,
    CASE WHEN error IS NULL THEN 'Available' WHEN error IN ('AccessDenied', 'Vanished') THEN error ELSE 'Failed' END AS acl_state,
    CASE WHEN error = 'Vanished' THEN 'Unavailable' WHEN error IS NOT NULL THEN 'Partial' ELSE 'Available' END AS live_status FROM {read_outcomes}""")
def evidence_states(t):
    error, cap = F.col("error"), F.lit(500)
    state = lambda live: enum_name(evidence.hash_state(F.col("length"), cap, error, F.col("is_file"), live), HASH_STATES)
    return t.read_outcomes.select(
        "doc_id", state(False).alias("snapshot_state"), state(True).alias("live_state"),
        enum_name(evidence.evidence_state(error), EVIDENCE_STATES).alias("acl_state"),
        evidence.live_evidence_status(F.when(error == "Vanished", error), error).alias("live_status"))


@query("""
  WITH k AS (SELECT DISTINCT 'h' AS host, 'HKEY_LOCAL_MACHINE' || chr(92) || p_brand AS path FROM part),
  v AS (SELECT 'h' AS host, 'hkey_local_machine' || chr(92) || p.p_brand AS key_path, 'v' || p.p_partkey AS value_name, r.* FROM part p JOIN {registry_values} r ON r.row_id = p.p_partkey)
  SELECT 'KEY|' || upper(path) AS identity_key, path, cast(3 AS integer) AS node_type, 'acl-' || path AS acl_evidence, NULL AS stored_hex FROM k
  UNION ALL SELECT 'VALUE|' || upper(key_path || chr(92) || value_name), key_path || chr(92) || value_name, 4, 'acl-' || (SELECT k.path FROM k WHERE upper(k.path) = upper(v.key_path)),
    CASE WHEN kind IN ('DWord', 'QWord') THEN hex(cast(int_value AS varchar)) WHEN kind = 'Binary' THEN hex_value
      WHEN kind = 'MultiString' THEN array_to_string(list_transform(string_split(text_value, ' '), lambda x: hex(x)), '00') ELSE hex(text_value) END FROM v""")
def registry_inventory(t):
    name = F.concat(F.lit("HKEY_LOCAL_MACHINE\\"), "p_brand")
    keys = t.part.select(F.lit("h").alias("host"), name.alias("path")).distinct().select(
        "host", "path", F.lit(0).alias("acl_state"), F.concat(F.lit("acl-"), "path").alias("acl_evidence"))
    values = t.part.join(t.registry_values, F.col("p_partkey") == F.col("row_id")).select(
        F.lit("h").alias("host"), F.concat(F.lit("hkey_local_machine\\"), "p_brand").alias("key_path"),
        F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("value_name"), "kind", "text_value", "int_value",
        F.unhex("hex_value").alias("data"), F.split("text_value", " ").alias("items"))
    return registry_members(keys, values).select("identity_key", "path", "node_type", "acl_evidence", F.hex("registry_value_data").alias("stored_hex"))
