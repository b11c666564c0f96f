"""Queries over scopes, registry names and settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetseal.functions import paths, registry
from fleetseal.operators import scope, settings
from fleetseal.plans.registry import query

IDS = (1000, 1_000_000)
_WITHIN = "(upper(s.path) = upper(r.root) OR starts_with(upper(s.path), upper(r.root) || '/'))"


@query(f"""
  SELECT page_id, path FROM {{scope_paths}} s WHERE NOT (s.path LIKE '%5' OR s.path LIKE '%7')
    AND EXISTS (SELECT 1 FROM {{scope_monitored}} r WHERE {_WITHIN}) AND NOT EXISTS (SELECT 1 FROM {{scope_excluded}} r WHERE {_WITHIN})""")
def path_scope_filter(t):
    return scope.filter_paths(t.scope_paths, "path", t.scope_monitored, t.scope_excluded, ["5", "7"])


@query(f"""
  SELECT doc_id, path FROM (SELECT doc_id, 'C:/Data/' || source || '/' || lang || '/doc' || doc_id AS path FROM documents) s
  WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT 'c:/data/' || source AS root FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) r WHERE {_WITHIN})""")
def listed_scope_filter(t):
    paths_of = t.documents.select("doc_id", F.concat(F.lit("C:/Data/"), "source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string")).alias("path"))
    roots = t.documents.join(t.labels.filter("toxic = 1"), "doc_id").select(F.concat(F.lit("c:/data/"), "source").alias("root"))
    return scope.select_paths(paths_of, "path", roots)


@query("""SELECT host, path FROM {members_curr} WHERE (upper(path) = 'C:/DATA/SRC1' OR starts_with(upper(path), 'C:/DATA/SRC1/')
    OR starts_with(upper(path), 'C:/DATA/SRC2/')) AND NOT starts_with(upper(path), 'C:/DATA/SRC2/EN/') AND NOT upper(path) LIKE '%7'""")
def path_scope_predicate(t):
    kept = paths.in_scope(F.col("path"), ["c:/data/src1", "C:/Data/src2/"], ["C:/Data/src2/en"], ["7"])
    return t.members_curr.filter(kept).select("host", "path")


@query("SELECT page_id, path FROM {scope_paths} WHERE NOT (upper(path) LIKE '%5' OR upper(path) LIKE '%7')")
def suffix_filter(t):
    return t.scope_paths.filter(~paths.has_suffix(F.col("path"), ["5", "7"]))


@query(f"""
  SELECT s.page_id, coalesce((SELECT arg_min(r.root, r.ordinal) FROM {{scope_monitored}} r WHERE {_WITHIN}), '') AS scope
  FROM {{scope_paths}} s""")
def scope_assignment(t):
    return scope.assign_scope(t.scope_paths, "path", t.scope_monitored).select("page_id", "scope")


@query(f"SELECT page_id, path FROM {{scope_paths}} s WHERE NOT EXISTS (SELECT 1 FROM {{scope_excluded}} r WHERE {_WITHIN})")
def subtree_prune(t):
    return scope.prune_subtrees(t.scope_paths, "path", t.scope_excluded)


@query("""SELECT page_id, path FROM {scope_paths} s WHERE NOT EXISTS (
    SELECT 1 FROM {scope_monitored} r WHERE starts_with(upper(s.path), upper(r.root) || '/'))""")
def reparse_prune(t):
    return scope.prune_subtrees(t.scope_paths, "path", t.scope_monitored, keep_container=True)


_REG_MATCH = r"""(upper(k.key_name) = upper(r.root) OR starts_with(upper(k.key_name), upper(r.root) || chr(92))
   OR (k.key_name LIKE 'HKEY_USERS%S-1-%' AND starts_with(upper('HKEY_CURRENT_USER' || regexp_replace(k.key_name, '^HKEY_USERS.S-1-[^\\]*', '')) || chr(92), upper(r.root) || chr(92))))"""


@query(f"""
  SELECT k.row_id, k.key_name FROM {{registry_keys}} k WHERE EXISTS (SELECT 1 FROM {{registry_included}} r WHERE {_REG_MATCH})
    AND NOT EXISTS (SELECT 1 FROM {{registry_excluded}} r WHERE {_REG_MATCH})""")
def registry_scope_filter(t):
    return scope.filter_registry(t.registry_keys, "key_name", t.registry_included, t.registry_excluded).select("row_id", "key_name")


@query("""
  SELECT r.host, CASE WHEN starts_with(r.root, 'HKEY_CURRENT_USER') THEN 'HKEY_USERS' || chr(92) || s.sid || r.root[18:] ELSE r.root END AS root
  FROM {host_roots} r LEFT JOIN {loaded_sids} s ON r.host = s.host AND starts_with(r.root, 'HKEY_CURRENT_USER') AND s.sid NOT LIKE '%_Classes'
  WHERE NOT starts_with(r.root, 'HKEY_CURRENT_USER') OR s.sid IS NOT NULL""")
def hkcu_expansion(t):
    return scope.expand_current_user(t.host_roots, t.loaded_sids)


@query("""
  WITH u AS (SELECT upper(root) AS k, min(root) AS root FROM {registry_roots} GROUP BY upper(root))
  SELECT a.root FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE starts_with(a.k, b.k || chr(92)))""")
def overlapping_roots(t):
    return scope.remove_overlaps(t.registry_roots)


@query("SELECT DISTINCT source AS host, concat('C:/Data/', source, '/', lang) AS root FROM documents WHERE lang IN (SELECT lang FROM labels JOIN documents USING (doc_id))")
def wildcard_scope_expansion(t):
    folders = t.member_dirs.select("host", F.col("path")).unionByName(
        t.member_dirs.select("host", F.regexp_replace("path", "/[^/]*$", "").alias("path"))).distinct()
    langs = t.labels.join(t.documents, "doc_id").select("lang").distinct()
    hosts_langs = t.documents.select(F.col("source").alias("host"), "lang").distinct().join(langs, "lang")
    scopes = hosts_langs.select("host", F.concat(F.lit("C:/Data/*/"), "lang").alias("root"))
    return scope.resolve_wildcards(scopes, folders.withColumn("is_directory", F.lit(True)))


@query("SELECT DISTINCT source AS host, concat('C:/Data/', source, '/', lang, '/%NONE%') AS root FROM documents")
def environment_scope_expansion(t):
    names = t.documents.select(F.col("source").alias("host"), "lang").distinct()
    scopes = names.select("host", F.concat(F.lit("%data%/"), "lang", F.lit("/%NONE%")).alias("root"))
    variables = names.select("host", F.lit("DATA").alias("name"), F.concat(F.lit("C:/Data/"), "host").alias("value")).distinct()
    return scope.expand_environment(scopes, variables)


@query("""
  WITH c AS (SELECT DISTINCT host, list_name, upper(rtrim(trim(value), chr(92))) AS v FROM {scope_lists} WHERE trim(value) <> ''),
  l AS (SELECT host, list_name, string_agg(v, '|' ORDER BY v) AS text FROM c GROUP BY host, list_name),
  names AS (SELECT h.host, n.name, n.ord FROM (SELECT DISTINCT host FROM {scope_lists}) h
    CROSS JOIN (VALUES ('MP', 1), ('XP', 2), ('XE', 3), ('MK', 4), ('XK', 5)) n(name, ord))
  SELECT names.host, sha256(string_agg(name || '=' || coalesce(text, ''), chr(10) ORDER BY ord)) AS scope_hash
  FROM names LEFT JOIN l ON l.host = names.host AND l.list_name = names.name GROUP BY names.host""")
def scope_hash(t):
    return scope.scope_hash(t.scope_lists)


@query("""
  SELECT host, string_agg(v, ';' ORDER BY v) AS source_identity FROM (SELECT DISTINCT host, upper(rtrim(root, chr(92))) AS v FROM {host_roots}) x
  GROUP BY host""")
def source_identity(t):
    return scope.source_identity(t.host_roots)


@query("""
  SELECT host, string_agg(v, ';' ORDER BY upper(v)) AS source_identity FROM (
    SELECT source AS host, min(v) AS v FROM (SELECT source, CASE WHEN doc_id % 2 = 0 THEN 'C:' || chr(92) || '|' || lang ELSE 'c:' || chr(92) || '|' || upper(lang) END AS v
    FROM documents) d GROUP BY source, upper(v)) x GROUP BY host""")
def volume_source_identity(t):
    spelled = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("C:\\|"), "lang")).otherwise(F.concat(F.lit("c:\\|"), F.upper("lang")))
    return scope.volume_identity(t.documents.select(F.col("source").alias("host"), spelled.alias("volume")))


@query("""
  WITH r AS (SELECT 'C:/U' || x AS root, 9 - x AS ordinal FROM (SELECT DISTINCT user_id % 5 AS x FROM events) e),
  s AS (SELECT p.seq, (SELECT arg_min(r.root, r.ordinal) FROM r WHERE starts_with(p.new_path, r.root || '/')) AS n,
    (SELECT arg_min(r.root, r.ordinal) FROM r WHERE starts_with(p.old_path, r.root || '/')) AS o FROM {rename_pairs} p)
  SELECT seq, coalesce(n, o, '') AS scope FROM s""")
def rename_scope(t):
    roots = t.events.select((F.col("user_id") % 5).alias("x")).distinct().select(
        F.concat(F.lit("C:/U"), F.col("x").cast("string")).alias("root"), (9 - F.col("x")).alias("ordinal"))
    return scope.assign_rename_scope(t.rename_pairs, roots).select("seq", "scope")


@query("""
  WITH required AS (SELECT DISTINCT host, 'HKEY_LOCAL_MACHINE' || chr(92) || 'HOUSEHOLD' AS root FROM {host_roots}
    UNION SELECT DISTINCT host, 'hkey_local_machine' || chr(92) || 'Software' FROM {host_roots}),
  listed AS (SELECT DISTINCT host, rtrim(root, chr(92)) AS root FROM {host_roots})
  SELECT host, root FROM listed UNION ALL
  SELECT host, root FROM required r WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.host = r.host AND upper(l.root) = upper(r.root))""")
def mandatory_keys(t):
    trimmed = t.host_roots.select("host", F.regexp_replace("root", r"\\+$", "").alias("root"))
    required = ["HKEY_LOCAL_MACHINE\\HOUSEHOLD", "hkey_local_machine\\Software"]
    return scope.add_required_keys(trimmed, trimmed.select("host").distinct(), required)


@query("SELECT min(root) AS root FROM (SELECT key_name AS root FROM {registry_keys}) k GROUP BY upper(root)")
def distinct_ignoring_case(t):
    return scope.distinct_ignoring_case(t.registry_keys.select(F.col("key_name").alias("root")), "root")


@query("""
  SELECT row_id, kind,
    CASE WHEN kind IN ('DWord', 'QWord') THEN cast(int_value AS varchar) WHEN kind = 'Binary' THEN rtrim(regexp_replace(lower(hex_value), '(..)', '\\1 ', 'g'))
      WHEN text_value = '' THEN CASE WHEN kind = 'MultiString' THEN '' END ELSE text_value END AS rendered,
    CASE WHEN kind IN ('DWord', 'QWord') THEN hex(cast(int_value AS varchar)) WHEN kind = 'Binary' THEN hex_value
      WHEN kind = 'MultiString' THEN array_to_string(list_transform(string_split(text_value, ' '), lambda x: hex(x)), '00') ELSE hex(text_value) END AS stored_hex
  FROM {registry_values}""")
def registry_value_render(t):
    value = (F.col("kind"), F.col("text_value"), F.col("int_value"), F.unhex("hex_value"), F.split("text_value", " "))
    return t.registry_values.select("row_id", "kind", registry.render_value(*value).alias("rendered"),
                                    F.hex(registry.serialise_value(*value)).alias("stored_hex"))


@query(r"""
  SELECT row_id, regexp_replace(regexp_replace(concat_ws(chr(92), cached, CASE WHEN trim(key_part) <> '' THEN key_part END,
      CASE WHEN trim(value_part) <> '' THEN value_part END), '\\REGISTRY\\MACHINE', 'HKEY_LOCAL_MACHINE', 'gi'), '\\REGISTRY\\USER', 'HKEY_USERS', 'gi') AS full_name
  FROM {kernel_names}""")
def hive_prefix(t):
    name = registry.full_key_name(F.col("cached"), F.col("key_part"), F.col("value_part"))
    return t.kernel_names.select("row_id", name.alias("full_name"))


@query(r"""
  WITH k AS (SELECT row_id, key_name, string_split(key_name, chr(92)) AS s FROM {registry_keys})
  SELECT row_id, key_name, CASE WHEN row_id % 3 = 0 AND lower(s[-1]) <> s[-1] THEN array_to_string(s[2:], chr(92))
      ELSE array_to_string(s[2:len(s) - 1], chr(92)) END AS subkey,
    CASE WHEN s[1] = 'HKEY_LOCAL_MACHINE' THEN 'LocalMachine' ELSE 'Users' END AS hive,
    CASE WHEN s[1] = 'HKEY_USERS' AND starts_with(s[2], 'S-1-') THEN 'HKEY_CURRENT_USER' || chr(92) || array_to_string(s[3:], chr(92)) END AS current_user_name,
    (CASE WHEN row_id % 2 = 0 THEN 'VALUE|' ELSE 'KEY|' END) || upper(key_name) AS identity
  FROM k""")
def strip_full_name(t):
    name = F.col("key_name")
    last = F.regexp_extract(name, r"[^\\]*$", 0)
    value = F.when(F.col("row_id") % 3 == 0, F.lower(last)).otherwise(last)
    return t.registry_keys.select(
        "row_id", "key_name", registry.strip_full_name(name, value).alias("subkey"), registry.parse_hive(name).alias("hive"),
        registry.current_user_form(name).alias("current_user_name"),
        registry.registry_identity(name, F.col("row_id") % 2 == 0).alias("identity"))


@query("""
  SELECT host, name, coalesce(p.value, f.value, l.value) AS value,
    CASE WHEN p.value IS NOT NULL THEN 'policy' WHEN f.value IS NOT NULL THEN 'preference' ELSE 'legacy' END AS layer
  FROM {settings_policy} p FULL JOIN {settings_preference} f USING (host, name) FULL JOIN {settings_legacy} l USING (host, name)""")
def settings_effective(t):
    return settings.effective(t.settings_policy, t.settings_preference, t.settings_legacy)


@query("""
  SELECT row_id,
    CASE WHEN path_value = '' THEN 'blank' WHEN path_value LIKE 'relative%' THEN 'not-absolute'
      WHEN path_value LIKE '%?%' THEN 'question-mark'
      WHEN path_value LIKE '%*%' THEN 'loose-star' END AS path_reason,
    CASE WHEN key_value = '' THEN 'blank' WHEN key_value LIKE '%*%' THEN 'star-in-key'
      WHEN key_value LIKE 'HKLM%' THEN 'unknown-hive' END AS key_reason,
    CASE WHEN lower(key_value) LIKE 'hkey_local_machine%software%' THEN 'hides-settings' END AS exclusion_reason,
    CASE WHEN number_name = 'CaptureQueueCapacity' AND number_value < 1 THEN 'out-of-range:1..'
      WHEN number_name = 'DiscoveryConcurrency' AND (number_value < 1 OR number_value > 64) THEN 'out-of-range:1..64'
      WHEN number_name = 'WatcherBufferSizeKB' AND (number_value < 8 OR number_value > 64) THEN 'out-of-range:8..64'
      WHEN number_name = 'RegistrySnapshotInterval' AND number_value < 60 THEN 'out-of-range:60..' END AS number_reason
  FROM {settings_values}""")
def settings_validation(t):
    return t.settings_values.select(
        "row_id", settings.path_problem(F.col("path_value")).alias("path_reason"),
        settings.key_problem(F.col("key_value")).alias("key_reason"),
        settings.protected_problem(F.col("key_value")).alias("exclusion_reason"),
        settings.number_problem(F.col("number_name"), F.col("number_value")).alias("number_reason"))


@query("""
  SELECT host, generation, previous_scope_hash, new_scope_hash FROM (
    SELECT host, generation, scope_hash AS new_scope_hash, lag(scope_hash) OVER w AS previous_scope_hash, enable_registry,
      lag(enable_registry) OVER w AS previous_registry FROM {settings_generations} WINDOW w AS (PARTITION BY host ORDER BY generation)) x
  WHERE previous_scope_hash IS NOT NULL AND (previous_scope_hash <> new_scope_hash OR previous_registry <> enable_registry)""")
def settings_changes(t):
    return settings.generation_changes(t.settings_generations, widths=IDS)


@query("""
  SELECT w.host, count(s.scope) AS scopes, CASE WHEN count(s.scope) = 0 THEN 'no-values'
      WHEN count(s.scope) > 64 THEN 'too-many' ELSE 'loose-star' END AS reason
  FROM {audit_switches} w LEFT JOIN {audit_scopes} s ON w.host = s.host WHERE w.enabled GROUP BY w.host
  HAVING count(s.scope) = 0 OR count(s.scope) > 64 OR bool_or(s.scope LIKE '%*%')""")
def attribution_scope_validation(t):
    return settings.validate_attribution_scopes(t.audit_scopes, t.audit_switches)


@query("""
  WITH l AS (SELECT 'host' || c.c_nationkey AS host, CASE v.row_id % 4 WHEN 0 THEN 'MonitoredPaths' WHEN 1 THEN 'ExcludedPaths' WHEN 2 THEN 'MonitoredKeys'
      ELSE 'ExcludedKeys' END AS list_name, CASE WHEN v.row_id % 4 < 2 THEN v.path_value ELSE v.key_value END AS value, v.row_id
    FROM {settings_values} v JOIN customer c ON c.c_custkey = v.row_id),
  r AS (SELECT host, list_name, value, CASE WHEN list_name LIKE 'Excluded%' AND value = '' THEN NULL
      WHEN value = '' THEN 'blank'
      WHEN list_name LIKE '%Paths' THEN CASE WHEN value LIKE 'relative%' THEN 'not-absolute' WHEN value LIKE '%?%' THEN
        'question-mark' WHEN value LIKE '%*%' THEN 'loose-star' END
      ELSE CASE WHEN value LIKE '%*%' THEN 'star-in-key' WHEN value LIKE 'HKLM%' THEN 'unknown-hive'
        WHEN list_name = 'ExcludedKeys' AND lower(value) LIKE '%software%' THEN 'hides-settings' END END AS reason FROM l)
  SELECT host, list_name, value, reason FROM r WHERE reason IS NOT NULL
  UNION ALL SELECT h.host, q.list_name, NULL, 'no-values' FROM {settings_hosts} h CROSS JOIN (SELECT unnest(['MonitoredPaths', 'MonitoredKeys']) AS list_name) q
    WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.host = h.host AND l.list_name = q.list_name)""")
def settings_list_validation(t):
    named = t.settings_values.join(t.customer.select(F.col("c_custkey").alias("row_id"), "c_nationkey"), "row_id")
    kind = F.col("row_id") % 4
    lists = named.select(
        F.concat(F.lit("host"), F.col("c_nationkey").cast("string")).alias("host"),
        F.when(kind == 0, "MonitoredPaths").when(kind == 1, "ExcludedPaths").when(kind == 2, "MonitoredKeys").otherwise("ExcludedKeys").alias("list_name"),
        F.when(kind < 2, F.col("path_value")).otherwise(F.col("key_value")).alias("value"))
    return settings.validate(lists, t.settings_hosts)


@query("""
  WITH s AS (SELECT page_id, string_split(rtrim(upper(path), '/'), '/') AS g FROM {scope_paths})
  SELECT page_id, list_aggregate([array_to_string(g[1:i], '/') FOR i IN generate_series(1, len(g) - 1) IF array_to_string(g[1:i], '/') <> ''], 'string_agg', '>') AS above FROM s""")
def path_ancestors(t):
    return t.scope_paths.select("page_id", F.array_join(paths.ancestors(F.col("path")), ">").alias("above"))
