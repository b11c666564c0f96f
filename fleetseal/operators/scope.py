r"""Scope filters over tables of roots, and the preparation of roots.

Containment is an equality join: a path is exploded into the few keys that can contain it, and those are joined to
the root keys. Short configured lists are better served by :func:`fleetseal.functions.paths.in_scope`, a plain
predicate without a shuffle. No side is broadcast by hint: Spark decides by the size it measures.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.functions.paths import (ancestors, container_keys, fs_identity, has_content, has_suffix, in_scope,
                                       registry_ancestors, root_key, trim_separator)
from fleetseal.functions.registry import current_user_form


def _contained(df: DataFrame, path: str, roots: DataFrame, aggregates: Sequence[Column],
               host: Sequence[str] = ()) -> DataFrame:
    """One row per distinct path that lies within some root, with ``aggregates`` over the matching roots.

    ``roots`` carries ``__root`` and the columns the aggregates read.
    """
    distinct = df.select(*host, fs_identity(F.col(path)).alias("__path")).distinct()
    exploded = distinct.select(*host, "__path", F.explode(container_keys(F.col("__path"))).alias("__root"))
    return exploded.join(roots, [*host, "__root"]).groupBy(*host, "__path").agg(*aggregates)


def _keep(df: DataFrame, path: str, found: DataFrame, how: str, host: Sequence[str] = ()) -> DataFrame:
    keyed = df.withColumn("__path", fs_identity(F.col(path)))
    return keyed.join(found.select(*host, "__path"), [*host, "__path"], how).select(*df.columns)


def filter_paths(df: DataFrame, path: str, monitored: DataFrame, excluded: DataFrame | None = None,
                 suffixes: Sequence[str] = (), host: Sequence[str] = ()) -> DataFrame:
    """Rows within a monitored root, within no excluded root and without an excluded suffix.

    ``monitored`` and ``excluded`` have a ``root`` column (and the ``host`` columns when given).
    """
    tagged = monitored.select(*host, root_key(F.col("root")).alias("__root"), F.lit(False).alias("__out"))
    if excluded is not None:
        tagged = tagged.unionByName(
            excluded.select(*host, root_key(F.col("root")).alias("__root"), F.lit(True).alias("__out")))
    roots = tagged.filter("__root IS NOT NULL").groupBy(*host, "__root").agg(
        F.bool_or(~F.col("__out")).alias("__in"), F.bool_or("__out").alias("__out"))
    candidates = df.filter(~F.coalesce(has_suffix(F.col(path), list(suffixes)), F.lit(False)))
    found = _contained(candidates, path, roots, [F.bool_or("__in").alias("__in"), F.bool_or("__out").alias("__out")], host)
    return _keep(candidates, path, found.filter("__in AND NOT __out"), "left_semi", host)


def select_paths(df: DataFrame, path: str, monitored: DataFrame | Sequence[str], excluded: DataFrame | Sequence[str] | None = None,
                 suffixes: Sequence[str] = ()) -> DataFrame:
    """Rows in scope. Roots given as lists become a predicate without a shuffle, roots in tables a join."""
    if isinstance(monitored, DataFrame) or isinstance(excluded, DataFrame):
        tables = [r if isinstance(r, DataFrame) or r is None else df.sparkSession.createDataFrame([(x,) for x in r], "root string")
                  for r in (monitored, excluded)]
        return filter_paths(df, path, *tables, suffixes)
    return df.filter(in_scope(F.col(path), list(monitored), list(excluded or ()), list(suffixes)))


def prune_subtrees(df: DataFrame, path: str, containers: DataFrame, host: Sequence[str] = (),
                   keep_container: bool = False) -> DataFrame:
    """Drop everything below the containers (``root`` column), and the containers too unless they are kept.

    Excluded directories go with their subtree; a reparse point stays as evidence and only what lies below it goes.
    """
    roots = containers.select(*host, root_key(F.col("root")).alias("__root")).filter("__root IS NOT NULL").distinct()
    distinct = df.select(*host, fs_identity(F.col(path)).alias("__path")).distinct()
    keys = ancestors(F.col("__path")) if keep_container else container_keys(F.col("__path"))
    below = (distinct.select(*host, "__path", F.explode(keys).alias("__root"))
             .join(roots, [*host, "__root"], "left_semi").select(*host, "__path").distinct())
    return _keep(df, path, below, "left_anti", host)


def prune_excluded_members(members: DataFrame, excluded_member: Column, host: Sequence[str] = ("host",)) -> DataFrame:
    """Apply a scope predicate to a whole inventory: an excluded directory takes its subtree along."""
    containers = members.filter(excluded_member & (F.col("node_type") == 1)).select(*host, F.col("path").alias("root"))
    kept = members.filter(~F.coalesce(excluded_member, F.lit(False)))
    return prune_subtrees(kept, "path", containers, host)


def prune_reparse_points(members: DataFrame, host: Sequence[str] = ("host",)) -> DataFrame:
    """Keep reparse points themselves, drop what lies below them."""
    containers = members.filter(F.col("node_type") == 2).select(*host, F.col("path").alias("root"))
    return prune_subtrees(members, "path", containers, host, keep_container=True)


def assign_scope(df: DataFrame, path: str, roots: DataFrame, into: str = "scope", host: Sequence[str] = ()) -> DataFrame:
    """First configured root (lowest ``ordinal``) that contains the path, "" when none does."""
    keyed_roots = roots.select(*host, root_key(F.col("root")).alias("__root"), "root", "ordinal").filter("__root IS NOT NULL")
    first = _contained(df, path, keyed_roots, [F.min_by("root", "ordinal").alias("__scope")], host)
    keyed = df.withColumn("__path", fs_identity(F.col(path)))
    joined = keyed.join(first, [*host, "__path"], "left")
    return joined.select(*df.columns, F.coalesce("__scope", F.lit("")).alias(into))


def assign_rename_scope(pairs: DataFrame, roots: DataFrame, host: Sequence[str] = ()) -> DataFrame:
    """Scope of rename pairs: the root of the new path, else that of the old one, else ""."""
    new = assign_scope(pairs, "new_path", roots, "__new_scope", host)
    both = assign_scope(new, "old_path", roots, "__old_scope", host)
    scope = F.coalesce(F.nullif("__new_scope", F.lit("")), F.col("__old_scope"))
    return both.select(*pairs.columns, scope.alias("scope"))


def _registry_keys(name: Column) -> Column:
    """(key, is_self) pairs a registry name can lie within, in its own and in its current-user spelling."""
    def spelled(text: Column) -> Column:
        above = F.transform(registry_ancestors(text), lambda a: F.struct(a.alias("key"), F.lit(False).alias("is_self")))
        own = F.array(F.struct(F.upper(text).alias("key"), F.lit(True).alias("is_self")))
        return F.when(text.isNotNull(), F.concat(above, own)).otherwise(F.array().cast("array<struct<key:string,is_self:boolean>>"))

    return F.concat(spelled(name), spelled(current_user_form(name)))


def filter_registry(df: DataFrame, name: str, included: DataFrame, excluded: DataFrame | None = None,
                    host: Sequence[str] = ()) -> DataFrame:
    r"""Names within an included root and within no excluded one; exclusion wins.

    ``HKEY_CURRENT_USER\x`` also covers ``HKEY_USERS\<S-1-...>\x``. Only ``\`` is a boundary; a root written with a
    trailing ``\`` covers what lies below it, not the key itself.
    """
    def keyed(roots: DataFrame, out: bool) -> DataFrame:
        root = F.upper(F.col("root"))
        return roots.filter(has_content(F.col("root"))).select(
            *host, F.regexp_replace(root, r"\\+$", "").alias("__root"), root.endswith("\\").alias("__below_only"),
            F.lit(out).alias("__out"))

    tagged = keyed(included, False)
    if excluded is not None:
        tagged = tagged.unionByName(keyed(excluded, True))
    distinct = df.filter(has_content(F.col(name))).select(*host, F.upper(F.col(name)).alias("__path")).distinct()
    exploded = distinct.select(*host, "__path", F.explode(_registry_keys(F.col("__path"))).alias("__e")).select(
        *host, "__path", F.col("__e.key").alias("__root"), F.col("__e.is_self").alias("__self"))
    roots = tagged.distinct()
    found = (exploded.join(roots, [*host, "__root"])
             .filter(~(F.col("__below_only") & F.col("__self")))
             .groupBy(*host, "__path")
             .agg(F.bool_or(~F.col("__out")).alias("__in"), F.bool_or("__out").alias("__out"))
             .filter("__in AND NOT __out"))
    return (df.withColumn("__path", F.upper(F.col(name)))
            .join(found.select(*host, "__path"), [*host, "__path"], "left_semi").select(*df.columns))


def expand_current_user(roots: DataFrame, sids: DataFrame) -> DataFrame:
    r"""Each ``HKEY_CURRENT_USER[\x]`` root becomes ``HKEY_USERS\<sid>[\x]`` per loaded user hive of the host.

    ``roots`` is (host, root), ``sids`` is (host, sid). Other roots pass through.
    """
    prefix = "HKEY_CURRENT_USER"
    key = F.upper("root")
    is_current = (key == prefix) | key.startswith(prefix + "\\")
    loaded = sids.filter(F.upper("sid").startswith("S-1-") & ~F.upper("sid").endswith("_CLASSES")).select("host", "sid").distinct()
    expanded = roots.filter(is_current).join(loaded, "host").select(
        "host", F.concat(F.lit("HKEY_USERS\\"), "sid", F.substr("root", F.lit(len(prefix) + 1))).alias("root"))
    return expanded.unionByName(roots.filter(~is_current).select("host", "root"))


def distinct_ignoring_case(df: DataFrame, column: str, host: Sequence[str] = ()) -> DataFrame:
    """One spelling (the smallest) per case-insensitive value."""
    return (df.groupBy(*host, F.upper(F.col(column)).alias("__key")).agg(F.min(column).alias(column))
            .select(*host, column))


def remove_overlaps(roots: DataFrame, host: Sequence[str] = ()) -> DataFrame:
    """Drop roots that lie below another root; ``SOFT`` does not cover ``SOFTWARE``."""
    trimmed = roots.select(*host, F.regexp_replace("root", r"\\+$", "").alias("root")).filter("root <> ''")
    unique = distinct_ignoring_case(trimmed, "root", host)
    keyed = unique.withColumn("__path", F.upper("root"))
    above = keyed.select(*host, "__path", F.explode(registry_ancestors(F.col("__path"))).alias("__root"))
    covered = (above.join(keyed.select(*host, F.col("__path").alias("__root")), [*host, "__root"], "left_semi")
               .select(*host, "__path").distinct())
    return keyed.join(covered, [*host, "__path"], "left_anti").select(*host, "root")


def expand_environment(scopes: DataFrame, environment: DataFrame, column: str = "root") -> DataFrame:
    """Replace ``%NAME%`` by the host's value, ignoring case; unknown names stay. A host has a handful of variables."""
    variables = environment.groupBy("host").agg(
        F.sort_array(F.collect_set(F.struct("name", "value"))).alias("__env"))
    replaced = F.aggregate(
        F.coalesce("__env", F.array().cast("array<struct<name:string,value:string>>")), F.col(column),
        lambda text, v: F.regexp_replace(
            text, F.concat(F.lit(r"(?i)%\Q"), v["name"], F.lit(r"\E%")),
            F.regexp_replace(v["value"], r"([\\$])", r"\\$1")))
    return scopes.join(variables, "host", "left").withColumn(column, replaced).drop("__env")


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"[\\/][^\\/]*$", "")


def resolve_wildcards(scopes: DataFrame, inventory: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    r"""Resolve one whole-segment ``*`` against the directories that exist.

    ``scopes`` is (host, root); ``inventory`` is (host, path, is_directory); ``profiles`` is (host, profile_path,
    downloads), the redirected download folders. ``prefix\*\suffix`` yields ``prefix\child\suffix`` where that exists,
    a trailing ``*`` yields the files directly below, other roots pass through unless they start with ``*``.
    """
    star = F.instr("root", "*")
    sep = F.when(F.col("root").contains("/"), F.lit("/")).otherwise(F.lit("\\"))
    literal = scopes.filter(star == 0).select("host", "root")
    with_star = scopes.filter((star > 0) & (has_content(F.col("root")))).select(
        "host", "root",
        F.upper(F.regexp_replace(F.substring("root", F.lit(1), star - 1), r"[\\/]+$", "")).alias("__prefix"),
        F.regexp_replace(F.substring("root", star + 1, F.length("root")), r"^[\\/]+", "").alias("__suffix"),
        sep.alias("__sep"), F.col("root").endswith("*").alias("__tail"))
    children = inventory.select(
        "host", F.col("path").alias("__child"), "is_directory", F.upper(_parent(F.col("path"))).alias("__prefix"))
    below = with_star.join(children, ["host", "__prefix"])
    files = below.filter("__tail AND NOT is_directory").select("host", F.col("__child").alias("root"))
    candidates = below.filter("NOT __tail AND is_directory").select(
        "host", F.concat("__child", "__sep", "__suffix").alias("root"))
    found = [literal, files, _existing(candidates, inventory)]
    if profiles is not None:
        wants = (with_star.filter((F.upper("__suffix") == "DOWNLOADS") & F.regexp_like("__prefix", F.lit(r"(^|[\\/])USERS$")))
                 .select("host").distinct())
        default = F.concat(F.regexp_replace("profile_path", r"[\\/]+$", ""), F.lit("\\Downloads"))
        named = F.regexp_replace(
            F.col("downloads"), F.lit(r"(?i)%USERPROFILE%"), F.regexp_replace("profile_path", r"([\\$])", r"\\$1"))
        absolute = F.when(F.regexp_like(named, F.lit(r"^(?:[A-Za-z]:[\\/]|\\\\)")), named).otherwise(
            F.concat(F.regexp_replace("profile_path", r"[\\/]+$", ""), F.lit("\\"), named))
        redirected = (profiles.filter(has_content(F.col("profile_path"))).join(wants, "host", "left_semi")
                      .select("host", F.when(~has_content(F.col("downloads")), default)
                              .otherwise(absolute).alias("root")))
        found.append(_existing(redirected, inventory))
    union = found[0]
    for part in found[1:]:
        union = union.unionByName(part)
    return distinct_ignoring_case(union, "root", ["host"])


def _existing(candidates: DataFrame, inventory: DataFrame) -> DataFrame:
    present = inventory.select("host", F.upper("path").alias("__path"))
    return (candidates.withColumn("__path", F.upper(trim_separator(F.col("root"))))
            .join(present, ["host", "__path"], "left_semi").select("host", "root"))


def add_required_keys(roots: DataFrame, hosts: DataFrame, required: Sequence[str]) -> DataFrame:
    """Make sure every host monitors the keys that hold its own configuration."""
    added = hosts.select("host", F.explode(F.array(*[F.lit(r) for r in required])).alias("root"))
    ranked = roots.select("host", "root", F.lit(0).alias("__added")).unionByName(added.withColumn("__added", F.lit(1)))
    return (ranked.groupBy("host", F.upper("root").alias("__key"))
            .agg(F.min_by("root", F.struct("__added", "root")).alias("root")).select("host", "root"))


def audit_scope(df: DataFrame, name: str, scopes: Sequence[str]) -> DataFrame:
    """Audit records whose object starts with a declared scope: no boundary check. All scopes together are one pattern."""
    if not scopes:
        return df.filter(F.lit(False))
    starts = "^(?:" + "|".join(re.escape(s.upper()) for s in scopes) + ")"
    return df.filter(has_content(F.col(name)) & F.upper(F.col(name)).rlike(starts))


def canonical_list(values: Column) -> Column:
    """Trimmed, upper-cased, distinct, ordered, blanks dropped, joined by ``|``."""
    cleaned = F.transform(F.filter(values, lambda v: has_content(v)),
                          lambda v: F.upper(F.regexp_replace(F.trim(v), r"\\+$", "")))
    return F.array_join(F.array_sort(F.array_distinct(cleaned)), "|")


def scope_hash(settings: DataFrame) -> DataFrame:
    """Identity of each host's effective scope, from (host, list_name, value) rows.

    ``list_name`` is MP, XP, XE, MK or XK. Order, case, repeats and trailing separators do not change it. A host's
    lists are its configuration, so they are small; equal entries combine before the shuffle.
    """
    names = ("MP", "XP", "XE", "MK", "XK")
    lists = settings.groupBy("host").agg(
        *[F.collect_set(F.when(F.col("list_name") == n, F.col("value"))).alias(n) for n in names])
    text = F.concat_ws("\n", *[F.concat(F.lit(n + "="), canonical_list(F.col(n))) for n in names])
    return lists.select("host", F.sha2(text, 256).alias("scope_hash"))


def source_identity(roots: DataFrame, column: str = "root") -> DataFrame:
    """Distinct, ordered, ``;``-joined identity of what a host's snapshot covers, from (host, root) rows."""
    key = F.upper(F.regexp_replace(F.col(column), r"\\+$", ""))
    return roots.groupBy("host").agg(F.array_join(F.array_sort(F.collect_set(key)), ";").alias("source_identity"))


def volume_identity(volumes: DataFrame, column: str = "volume") -> DataFrame:
    """Distinct, ordered, ``;``-joined volume identities of a host's file snapshot, ignoring case but keeping a spelling."""
    unique = volumes.groupBy("host", F.upper(F.col(column)).alias("__key")).agg(F.min(column).alias("__raw"))
    listed = unique.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("__key", "__raw"))).alias("__all"))
    return listed.select("host", F.array_join(F.transform("__all", lambda v: v["__raw"]), ";").alias("source_identity"))
