"""Comparing inventories: diff, convergence, equality, guards and the manifest digest.

Two inventories are compared by stacking them and grouping by identity, not by joining them: one shuffle of key, path
and fingerprint hash, values combine before it, and repeated identities are counted on the way instead of multiplying.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.functions.evidence import fingerprint_hash, length_prefixed
from fleetseal.functions.paths import ancestors, fs_identity, normalize_entity
from fleetseal.schemas import EVIDENCE_STATES

IDENTITY = ("host", "identity_key")


def with_identity(members: DataFrame, strict: bool = False) -> DataFrame:
    """(host, identity_key, path, fingerprint) of an inventory: all that a comparison needs."""
    key = F.col("identity_key") if "identity_key" in members.columns else normalize_entity(F.col("identity"))
    return members.select("host", key.alias("identity_key"), "path", fingerprint_hash(members, strict).alias("fingerprint"))


def duplicate_identities(members: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Identities that occur more than once; an inventory with any of them is rejected."""
    return members.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def item_counts(members: DataFrame, keys: Sequence[str] = ("host", "baseline_id")) -> DataFrame:
    """Members per inventory."""
    return members.groupBy(*keys).agg(F.count("*").alias("item_count"))


def _stack(previous: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    columns = [*keys, "path", "fingerprint"]
    return (previous.select(*columns).withColumn("__after", F.lit(False))
            .unionByName(current.select(*columns).withColumn("__after", F.lit(True))))


def diff(previous: DataFrame | None, current: DataFrame, keys: Sequence[str] = IDENTITY,
         on_duplicate: str = "raise") -> DataFrame:
    """Created, Changed and Deleted identities between two inventories (columns of :func:`with_identity`).

    Without a previous inventory there is nothing to compare and the result is empty; an empty previous inventory is
    something else and makes every member Created. A repeated identity fails the query, or with
    ``on_duplicate="report"`` comes out as a ``Duplicate`` row.
    """
    if previous is None:
        previous, current = current.limit(0), current.limit(0)
    after = F.col("__after")
    side = F.struct("path", "fingerprint")
    both = _stack(previous, current, keys).groupBy(*keys).agg(
        F.count_if(~after).alias("n_before"), F.count_if(after).alias("n_after"),
        F.max(F.when(~after, side)).alias("before"), F.max(F.when(after, side)).alias("after"))
    repeated = (F.col("n_before") > 1) | (F.col("n_after") > 1)
    if on_duplicate == "raise":
        message = F.concat(F.lit("an inventory cannot contain duplicate identities: "), F.col(keys[-1]))
        duplicate = F.when(repeated, F.raise_error(message).cast("string"))
    else:
        duplicate = F.when(repeated, F.lit("Duplicate"))
    change = F.coalesce(
        duplicate,
        F.when(F.col("n_before") == 0, "Created")
        .when(F.col("n_after") == 0, "Deleted")
        .when(F.col("before.fingerprint") != F.col("after.fingerprint"), "Changed"))
    return both.select(*keys, change.alias("change"), F.col("before.path").alias("old_path"),
                       F.col("after.path").alias("new_path")).filter("change IS NOT NULL")


def flag_suspect_deletions(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Mark Deleted rows below a container whose listing failed: its children were not seen rather than gone."""
    failed = (EVIDENCE_STATES.index("Failed"), EVIDENCE_STATES.index("AccessDenied"))
    containers = current.filter(F.col("acl_state").isin(*failed)).select(
        "host", fs_identity(F.col("path")).alias("__root")).distinct()
    gone = changes.filter("change = 'Deleted'").select("host", "identity_key", "old_path")
    suspects = (gone.select("host", "identity_key", F.explode(ancestors(F.col("old_path"))).alias("__root"))
                .join(containers, ["host", "__root"], "left_semi").select("host", "identity_key").distinct()
                .withColumn("__suspect", F.lit(True)))
    joined = changes.join(suspects, ["host", "identity_key"], "left")
    return joined.select(*changes.columns,
                         (F.coalesce("__suspect", F.lit(False)) & (F.col("change") == "Deleted")).alias("suspect"))


def convergence(passes: DataFrame, keys: Sequence[str] = IDENTITY, maximum_passes: int = 3) -> DataFrame:
    """First observation pass that agrees with the one before it, per host; null pass when none does.

    ``passes`` is (host, ..., pass, fingerprint). A pass agrees when it has the same identities and fingerprints.
    """
    if maximum_passes < 2:
        raise ValueError("convergence needs at least two passes")
    numbers = range(1, maximum_passes + 1)
    per_identity = passes.groupBy(*keys).agg(
        *[F.count_if(F.col("pass") == p).alias(f"n{p}") for p in numbers],
        *[F.max(F.when(F.col("pass") == p, F.col("fingerprint"))).alias(f"f{p}") for p in numbers])
    differs = {p: (F.col(f"n{p}") != F.col(f"n{p - 1}")) | ~F.col(f"f{p}").eqNullSafe(F.col(f"f{p - 1}"))
               for p in numbers if p > 1}
    per_host = per_identity.groupBy(keys[0]).agg(
        *[F.count_if(d).alias(f"differs{p}") for p, d in differs.items()],
        *[F.sum(f"n{p}").alias(f"items{p}") for p in numbers])
    agreed, items = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for p in reversed(list(differs)):
        agrees = F.col(f"differs{p}") == 0
        agreed = F.when(agrees, F.lit(p)).otherwise(agreed)
        items = F.when(agrees, F.col(f"items{p}")).otherwise(items)
    return per_host.select(keys[0], agreed.alias("agreed_pass"), items.alias("item_count"),
                           agreed.isNull().alias("unstable"))


def inventory_equality(left: DataFrame, right: DataFrame, keys: Sequence[str] = IDENTITY) -> DataFrame:
    """Per host, how many (identity, fingerprint) entries only one side has; both zero means equal."""
    sides = (left.select(*keys, "fingerprint", F.lit(1).alias("__d"))
             .unionByName(right.select(*keys, "fingerprint", F.lit(-1).alias("__d"))))
    entries = sides.groupBy(*keys, "fingerprint").agg(F.sum("__d").alias("d"))
    return entries.groupBy(keys[0]).agg(
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("d"))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.when(F.col("d") < 0, -F.col("d"))), F.lit(0)).alias("only_right"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


# Hash prefixes of the digest tree, leaf level first. 16^6 leaves keep a leaf near 6,000 rows at 10^11 members.
DIGEST_LEVELS = (6, 3, 0)


def member_digest(members: DataFrame, fields: Sequence[Column]) -> Column:
    """SHA-256 over the length-prefixed fields; null and empty differ."""
    return F.sha2(length_prefixed(*fields), 256)


def manifest_digest(members: DataFrame, fields: Sequence[Column], keys: Sequence[str] = ("host",),
                    metadata: Sequence[Column] = (), levels: Sequence[int] = DIGEST_LEVELS) -> DataFrame:
    """Order-independent digest of an inventory, over every member field, its size and its metadata.

    A hash tree: equal member hashes are counted first, then grouped by a prefix of the hash, and each level hashes
    the ordered hashes below it. No group grows beyond one leaf, whatever one host holds.
    """
    hashed = members.select(*keys, member_digest(members, fields).alias("h"), *[m.alias(f"__m{i}") for i, m in enumerate(metadata)])
    meta = [f"__m{i}" for i in range(len(metadata))]
    nodes = hashed.groupBy(*keys, *meta, "h").agg(F.count("*").alias("n"))
    nodes = nodes.select(*keys, *meta, F.substring("h", 1, levels[0]).alias("p"), "n",
                         F.concat("h", F.lit(":"), F.col("n").cast("string")).alias("v"))
    for depth, prefix in enumerate(levels):
        grouped = nodes.groupBy(*keys, *meta, "p").agg(
            F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("v")), ","), 256).alias("d"))
        following = levels[depth + 1] if depth + 1 < len(levels) else 0
        nodes = grouped.select(*keys, *meta, F.col("p").substr(1, following).alias("p"), "n",
                               F.concat("p", F.lit(":"), "d").alias("v"), "d")
    text = length_prefixed(*[F.col(m).cast("string") for m in meta], F.col("n").cast("string"), F.col("d"))
    return nodes.select(*keys, F.col("n").alias("item_count"), F.sha2(text, 256).alias("digest"))


def verify_manifest(computed: DataFrame, recorded: DataFrame, keys: Sequence[str] = ("host",)) -> DataFrame:
    """Keys whose recomputed digest is not the recorded one. A run must not compare against these.

    An empty inventory has no computed row; its recorded digest is "".
    """
    return (recorded.select(*keys, F.col("digest").alias("recorded_digest"))
            .join(computed.select(*keys, F.col("digest").alias("computed_digest")), list(keys), "left")
            .withColumn("computed_digest", F.coalesce("computed_digest", F.lit("")))
            .filter(~F.col("recorded_digest").eqNullSafe(F.col("computed_digest"))))


class IntegrityError(Exception):
    """A stored inventory no longer matches its recorded digest."""


def gated_diff(previous: DataFrame, current: DataFrame, computed: DataFrame, recorded: DataFrame) -> DataFrame:
    """Diff that refuses to use a previous inventory whose digest does not verify."""
    failed = verify_manifest(computed, recorded).select("host").limit(10).collect()
    if failed:
        raise IntegrityError("previous inventory failed verification on " + ", ".join(str(r.host) for r in failed))
    return diff(previous, current)
