r"""Path identity and containment as column expressions.

Identity is case-insensitive. Both ``\`` and ``/`` are boundaries in file paths; only ``\`` is one in registry names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_ANY_SEPARATOR = r"[\\/]"
_DRIVE_ROOT = r"^(?:[A-Za-z]:[\\/]|/)"


def normalize_entity(entity: Column) -> Column:
    """Case-insensitive key of an entity name."""
    return F.upper(entity)


def trim_separator(path: Column) -> Column:
    r"""Drop trailing separators, but keep the one of a drive root (``C:\``) or of ``/``."""
    return F.regexp_replace(path, r"(?<=[^:\\/])[\\/]+$", "")


def fs_identity(path: Column) -> Column:
    """Identity key of a file or directory."""
    return F.upper(trim_separator(path))


def _prefixes(path: Column, pattern: str, last: Column) -> Column:
    """Segment-delimited prefixes 1..last of ``path``, with the separators exactly as written."""
    segments = F.split(path, pattern)
    lengths = F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.length(F.array_join(F.slice(segments, F.lit(1), i), "/")),
    )
    return F.transform(lengths, lambda n: F.substring(path, F.lit(1), n))


def _proper_prefixes(key: Column, pattern: str) -> Column:
    count = F.size(F.split(key, pattern)) - 1
    found = F.when(count >= 1, _prefixes(key, pattern, count)).otherwise(F.array().cast("array<string>"))
    return F.filter(found, lambda p: p != "")


def ancestors(path: Column) -> Column:
    """Upper-cased proper ancestors of a file path, outermost first, the path itself not included."""
    return _proper_prefixes(fs_identity(path), _ANY_SEPARATOR)


def registry_ancestors(name: Column) -> Column:
    """Upper-cased proper ancestors of a registry name, outermost first."""
    return _proper_prefixes(F.upper(name), r"\\")


def container_keys(path: Column) -> Column:
    r"""Every root key that contains ``path``: its ancestors, itself, and its drive root (``C:\`` or ``/``).

    A path lies within a root exactly when the root's :func:`root_key` is one of these, so containment becomes an
    equality join. Blank paths lie in nothing.
    """
    key = fs_identity(path)
    drive = F.regexp_extract(key, _DRIVE_ROOT, 0)
    extra = F.when((drive != "") & (drive != key), F.array(drive)).otherwise(F.array().cast("array<string>"))
    keys = F.concat(ancestors(path), F.array(key), extra)
    return F.when(has_content(path), keys).otherwise(F.array().cast("array<string>"))


def has_content(text: Column) -> Column:
    """Not null, and more than white space of any kind (line breaks, tabs and Unicode separators included)."""
    return F.coalesce(text, F.lit("")).rlike(r"[^\s\p{Z}\x85]")


def root_key(root: Column) -> Column:
    """Key of a configured root as :func:`container_keys` spells it; null for a blank root."""
    return F.when(has_content(root), fs_identity(root))


def within(path: Column, root: str) -> Column:
    """``path`` is ``root`` or lies below it, at a separator boundary, case-insensitively."""
    if not root.strip():
        return F.lit(False)
    stripped = root.rstrip("\\/")
    is_drive = root[-1] in "\\/" and (stripped == "" or stripped.endswith(":"))
    key = fs_identity(path)
    not_blank = has_content(path)
    if is_drive:
        # A drive root keeps its separator and then matches as a plain prefix.
        return F.coalesce(not_blank & key.startswith((stripped + root[-1]).upper()), F.lit(False))
    base = stripped.upper()
    below = key.startswith(base) & F.substring(key, len(base) + 1, 1).isin("\\", "/")
    return F.coalesce(not_blank & ((key == base) | below), F.lit(False))


def within_any(path: Column, roots: list[str]) -> Column:
    """``path`` lies within one of the roots. For configured lists; large root tables go through a join instead."""
    return reduce(lambda a, b: a | b, [within(path, r) for r in roots], F.lit(False))


def has_suffix(path: Column, suffixes: list[str]) -> Column:
    """``path`` ends with one of the suffixes, literally and case-insensitively."""
    key = F.upper(path)
    return reduce(lambda a, b: a | b, [key.endswith(s.upper()) for s in suffixes if s], F.lit(False))


def in_scope(path: Column, monitored: list[str], excluded: list[str], suffixes: list[str]) -> Column:
    """Within a monitored root, within no excluded root, and without an excluded suffix."""
    return within_any(path, monitored) & ~within_any(path, excluded) & ~has_suffix(path, suffixes)
