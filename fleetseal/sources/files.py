"""Content scan of file trees that Spark can read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetseal.functions.evidence import hash_state
from fleetseal.functions.paths import ancestors, fs_identity
from fleetseal.schemas import HASH_STATES, NODE_TYPES

DEFAULT_CAP = 1024 * 1024 * 1024


def distinct_roots(roots: Sequence[str]) -> list[str]:
    """Roots without repeats, ignoring case; the first spelling stays."""
    seen: dict[str, str] = {}
    for root in roots:
        seen.setdefault(root.upper(), root)
    return list(seen.values())


def content_columns(length: Column, content: Column, cap: int = DEFAULT_CAP, readable: Column | None = None) -> list[Column]:
    """content_hash (upper-case SHA-256, none above the cap or where ``readable`` is false) and the code of hash_state."""
    failed = F.lit(None).cast("string") if readable is None else F.when(~readable, "Vanished")
    state = hash_state(F.coalesce(length, F.lit(0)), F.lit(cap), failed, F.lit(True))
    return [F.when(state == HASH_STATES.index("Hashed"), F.upper(F.sha2(content, 256))).alias("content_hash"), state.alias("hash_state")]


def scan_files(spark: SparkSession, roots: Sequence[str], host: str, cap: int = DEFAULT_CAP, pattern: str = "*") -> DataFrame:
    """One member per file below the roots: upper-case SHA-256 of the content, no hash above the cap.

    Only files within the cap have their content read; for the others the scan stays with the listing.
    """
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", pattern).load(distinct_roots(roots)))
    path = F.regexp_replace("path", r"^file:/*", "/")

    def members(files: DataFrame, content: Column) -> DataFrame:
        return files.select(
            F.lit(host).alias("host"), fs_identity(path).alias("identity_key"), path.alias("path"),
            F.lit(NODE_TYPES.index("File")).alias("node_type"), F.col("length").alias("size_bytes"),
            *content_columns(F.col("length"), content, cap))

    within = members(listing.filter(F.col("length") <= cap), F.col("content"))
    above = members(listing.filter(F.col("length") > cap), F.lit(None).cast("binary"))
    return within.unionByName(above)


def directories_of(files: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Directory members implied by the scanned files, from the roots down."""
    below = F.lit(False)
    for root in distinct_roots(roots):
        key = root.rstrip("/\\").upper()
        below = below | (F.col("identity_key") == key) | F.col("identity_key").startswith(key + "/")
    return (files.select("host", F.explode(ancestors(F.col("path"))).alias("identity_key")).filter(below).distinct()
            .select("host", "identity_key", F.col("identity_key").alias("path"), F.lit(NODE_TYPES.index("Directory")).alias("node_type"),
                    F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("string").alias("content_hash"),
                    F.lit(HASH_STATES.index("NotApplicable")).alias("hash_state")))
