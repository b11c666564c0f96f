"""Evidence states and the member fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.schemas import EVIDENCE_STATES, HASH_STATES, NODE_TYPES, enum_name

def _member_columns(members: DataFrame) -> dict[str, Column]:
    defaults = {
        "node_type": F.lit(0),
        "content_hash": F.lit(None).cast("string"),
        "hash_state": F.lit(0),
        "acl_state": F.lit(0),
        "acl_evidence": F.lit(""),
        "stream_names": F.array().cast("array<string>"),
        "link_count": F.lit(None).cast("int"),
        "is_system": F.lit(False),
        "is_sparse": F.lit(False),
        "is_temporary": F.lit(False),
        "is_offline": F.lit(False),
        "registry_value_kind": F.lit(None).cast("string"),
        "registry_value_data": F.lit(None).cast("binary"),
    }
    return {name: members[name] if name in members.columns else default for name, default in defaults.items()}


def _flag(value: Column) -> Column:
    return F.when(value, "True").otherwise("False")


def fingerprint(members: DataFrame, strict: bool = False) -> Column:
    """Text that changes when any recorded evidence of a member changes.

    Fields are joined by ``|`` and null reads as "", so null and empty registry data look alike and a ``|`` inside
    a field is not escaped. ``strict`` prefixes every field with its length and marks null, which tells those apart.
    """
    c = _member_columns(members)
    fields = [
        enum_name(c["node_type"], NODE_TYPES),
        c["content_hash"],
        enum_name(c["hash_state"], HASH_STATES),
        enum_name(c["acl_state"], EVIDENCE_STATES),
        c["acl_evidence"],
        F.array_join(c["stream_names"], "\u001f"),
        c["link_count"].cast("string"),
        _flag(c["is_system"]),
        _flag(c["is_sparse"]),
        _flag(c["is_temporary"]),
        _flag(c["is_offline"]),
        c["registry_value_kind"],
        F.base64(c["registry_value_data"]),
    ]
    if strict:
        return length_prefixed(*fields)
    return F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields])


def length_prefixed(*fields: Column) -> Column:
    """Unambiguous text of a field list: ``length:text`` each, ``-`` for null."""
    parts = [F.when(f.isNull(), F.lit("-;")).otherwise(F.concat(F.length(f).cast("string"), F.lit(":"), f)) for f in fields]
    return F.concat(*parts)


def fingerprint_hash(members: DataFrame, strict: bool = False) -> Column:
    """SHA-256 of the fingerprint: what a diff shuffles instead of the whole evidence."""
    return F.sha2(fingerprint(members, strict), 256)


def hash_state(length: Column, cap: Column, error: Column, is_file: Column, live: bool = False) -> Column:
    """Code of the content-hash state.

    A snapshot hashes up to and including the cap, the live path only below it. ``error`` is null or the failure
    class met while reading.
    """
    fits = length < cap if live else length <= cap
    code = {name: HASH_STATES.index(name) for name in HASH_STATES}
    return (
        F.when(~is_file, code["NotApplicable"])
        .when(error == "AccessDenied", code["AccessDenied"])
        .when(error == "Vanished", code["Vanished"])
        .when(error == "Locked", code["Locked"])
        .when(error.isNotNull(), code["Failed"])
        .when(~fits, code["SkippedBySizeCap"])
        .otherwise(code["Hashed"])
    )


def evidence_state(error: Column) -> Column:
    """Code of the access-list evidence state for a failure class (null means it was read)."""
    code = {name: EVIDENCE_STATES.index(name) for name in EVIDENCE_STATES}
    return (
        F.when(error.isNull(), code["Available"])
        .when(error == "AccessDenied", code["AccessDenied"])
        .when(error == "Vanished", code["Vanished"])
        .otherwise(code["Failed"])
    )


def live_evidence_status(unavailable_reason: Column, *partial_reasons: Column) -> Column:
    """Available, Partial when some evidence failed, Unavailable when the key could not be read."""
    partial = F.coalesce(*partial_reasons) if partial_reasons else F.lit(None).cast("string")
    return (
        F.when(unavailable_reason.isNotNull(), "Unavailable")
        .when(partial.isNotNull(), "Partial")
        .otherwise("Available")
    )


def live_evidence_reason(*reasons_in_order: Column) -> Column:
    """The first reason met stays."""
    return F.coalesce(*reasons_in_order)
