"""Access lists: text form and difference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACL = """struct<owner:string, primary_group:string, aces:array<struct<identity_name:string, rights:bigint,
  ace_type:string, inherited:boolean, inheritance:int, propagation:int>>>"""

# Flag bits in the order they are written.
INHERITANCE_FLAGS = ((2, "ObjectInherit"), (1, "ContainerInherit"))
PROPAGATION_FLAGS = ((1, "NoPropagateInherit"), (2, "InheritOnly"))


def _flags(value: Column, flags: tuple[tuple[int, str], ...]) -> Column:
    names = [F.when(value.bitwiseAND(bit) == bit, name) for bit, name in flags]
    return F.when(value == 0, "None").otherwise(F.concat_ws("|", *names))


def render_ace(ace: Column) -> Column:
    """One entry in brackets."""
    return F.concat(
        F.lit("; ACE: [Identity: "), F.coalesce(ace["identity_name"], F.lit("None")),
        F.lit("; Rights: 0x"), F.lpad(F.hex(ace["rights"]), 8, "0"),
        F.lit("; Type: "), F.when(ace["ace_type"] == "Allow", "Allow").otherwise("Deny"),
        F.lit("; Inherited: "), F.when(ace["inherited"], "true").otherwise("false"),
        F.lit("; Inheritance: "), _flags(ace["inheritance"], INHERITANCE_FLAGS),
        F.lit("; Propagation: "), _flags(ace["propagation"], PROPAGATION_FLAGS),
        F.lit("]"),
    )


def render_acl(owner: Column, primary_group: Column, aces: Column) -> Column:
    """Owner, group, entry count and every entry in the order of the list."""
    return F.concat(
        F.lit("Owner: "), F.coalesce(owner, F.lit("None")),
        F.lit("; PrimaryGroup: "), F.coalesce(primary_group, F.lit("None")),
        F.lit("; AceCount: "), F.size(aces).cast("string"),
        F.array_join(F.transform(aces, render_ace), ""),
    )


def acl_changed(previous: Column, current: Column) -> Column:
    """Both lists are known and their texts differ."""
    return F.coalesce(previous != current, F.lit(False))


def aces_added(previous: Column, current: Column) -> Column:
    """Entries only the current list has."""
    return F.array_except(current, previous)


def aces_removed(previous: Column, current: Column) -> Column:
    """Entries only the previous list has."""
    return F.array_except(previous, current)
