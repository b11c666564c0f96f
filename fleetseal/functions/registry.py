"""Registry names, values and trace opcodes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetseal.functions.paths import has_content

# Trace opcodes that carry a change.
CREATED_OPCODES = (10,)
CHANGED_OPCODES = (14, 20)
DELETED_OPCODES = (12, 15)
# Opcodes of the handle-to-path stream (22 creates or runs down a binding, 23 removes it).
BIND_OPCODES = (22,)
UNBIND_OPCODES = (23,)


def registry_identity(path: Column, is_value: Column) -> Column:
    """Identity key; a key and a value with the same path stay different."""
    return F.concat(F.when(is_value, F.lit("VALUE|")).otherwise(F.lit("KEY|")), F.upper(path))


def hive_prefix(name: Column) -> Column:
    """Replace kernel hive prefixes by the documented hive names, wherever they occur, in any case."""
    machine = F.regexp_replace(name, r"(?i)\\REGISTRY\\MACHINE", "HKEY_LOCAL_MACHINE")
    return F.regexp_replace(machine, r"(?i)\\REGISTRY\\USER", "HKEY_USERS")


def _non_blank(part: Column) -> Column:
    return F.when(has_content(part), part)


def full_key_name(cached: Column, key: Column, value: Column) -> Column:
    r"""Join the non-blank parts with ``\`` and resolve the hive prefix; "" when every part is blank."""
    return hive_prefix(F.concat_ws("\\", _non_blank(cached), _non_blank(key), _non_blank(value)))


def strip_full_name(full_name: Column, value_name: Column) -> Column:
    r"""Subkey path: without a trailing ``\value`` (case-sensitive) and without the hive.

    A name that is only a hive stays as it is.
    """
    full = F.coalesce(full_name, F.lit(""))
    value = F.coalesce(value_name, F.lit(""))
    tail = F.concat(F.lit("\\"), value)
    has_value = (value != "") & (F.length(full) > F.length(value)) & F.endswith(full, tail)
    path = F.when(has_value, F.substring(full, F.lit(1), F.length(full) - F.length(tail))).otherwise(full)
    at = F.instr(path, "\\")
    keeps = (at <= 1) | (at == F.length(path))
    return F.when(keeps, path).otherwise(F.substring(path, at + 1, F.length(path)))


def parse_hive(name: Column) -> Column:
    """Hive of a full name; anything without a known hive name belongs to the users hive."""
    key = F.upper(name)
    return (
        F.when(key.contains("HKEY_LOCAL_MACHINE"), "LocalMachine")
        .when(key.contains("HKEY_CURRENT_USER"), "CurrentUser")
        .when(key.contains("HKEY_CURRENT_CONFIG"), "CurrentConfig")
        .when(key.contains("HKEY_CLASSES_ROOT"), "ClassesRoot")
        .otherwise("Users")
    )


def current_user_form(name: Column) -> Column:
    r"""The ``HKEY_CURRENT_USER`` spelling of a name in a loaded user hive; null for any other name."""
    pattern = r"(?i)^HKEY_USERS\\S-1-[^\\]*(?=\\)"
    return F.when(F.regexp_like(name, F.lit(pattern)), F.regexp_replace(name, pattern, "HKEY_CURRENT_USER"))


def serialise_value(kind: Column, text: Column, number: Column, data: Column, items: Column) -> Column:
    """Bytes kept as evidence: binary as it is, a list joined by NUL, everything else as UTF-8 text."""
    return (
        F.when(kind == "Binary", data)
        .when(kind == "MultiString", F.encode(F.array_join(items, "\u0000"), "UTF-8"))
        .when(kind.isin("DWord", "QWord"), F.encode(number.cast("string"), "UTF-8"))
        .otherwise(F.encode(text, "UTF-8"))
    )


def render_value(kind: Column, text: Column, number: Column, data: Column, items: Column) -> Column:
    """Text shown in a finding: decimal numbers, spaced lower-case hex, space-joined lists, "" as null."""
    return (
        F.when(kind.isin("DWord", "QWord"), number.cast("string"))
        .when(kind == "Binary", F.regexp_replace(F.lower(F.hex(data)), r"(..)(?!$)", "$1 "))
        .when(kind == "MultiString", F.array_join(items, " "))
        .otherwise(F.nullif(text, F.lit("")))
    )


def opcode_category(opcode: Column) -> Column:
    """Change category of a trace opcode; opcodes without an own category count as a change."""
    return (
        F.when(opcode.isin(*CREATED_OPCODES), "Created")
        .when(opcode.isin(*CHANGED_OPCODES), "Changed")
        .when(opcode.isin(*DELETED_OPCODES), "Deleted")
        .otherwise("Changed")
    )
