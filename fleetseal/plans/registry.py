"""Registered queries: a name, a function of the inputs, and the SQL its result is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from fleetseal.plans.inputs import Inputs

QUERIES: dict[str, Callable[[Inputs], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None):
    """Register a function under its own name; ``check`` is plain SQL over the (derived) tables in braces."""
    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[build.__name__] = build
        if check is not None:
            CHECKS[build.__name__] = check
        return build
    return register
