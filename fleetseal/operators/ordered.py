"""Ordered computations per key that stay balanced when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(t)`` sends a whole key to one task. :func:`running` cuts the order of each
key into time chunks, runs the window inside (key, chunk), and adds what earlier chunks carry over. The chunk totals
are one row per (key, chunk), and are themselves scanned the same way with the next, wider chunk.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DEFAULT_WIDTHS = (HOUR_MS, 1000 * HOUR_MS)

_WHOLE = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Scan:
    """One running value.

    ``how`` is sum, max, min, last (newest non-null) or since (sum of a value that is never negative, starting anew at
    every row where ``reset`` holds; that row's own value is the first it adds). With ``inclusive=False`` a row sees
    only the rows before it.
    """

    how: str
    value: Column
    inclusive: bool = True
    reset: Column | None = None


def _frame(keys: Sequence[str], order: Sequence[str], inclusive: bool):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)


def _local(df: DataFrame, scans: dict[str, Scan], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Running values inside (keys); all of them share one shuffle and one sort."""
    columns, resets = {}, {}
    for name, scan in scans.items():
        window, value = _frame(keys, order, scan.inclusive), F.col(f"__in_{name}")
        if scan.how == "last":
            columns[f"__local_{name}"] = F.last(value, ignorenulls=True).over(window)
        elif scan.how == "since":
            # What was summed before the newest reset; the sum never falls, so it is the greatest such mark.
            resets[f"__upto_{name}"] = F.sum(value).over(_frame(keys, order, True))
            columns[f"__local_{name}"] = F.sum(value).over(window)
        else:
            columns[f"__local_{name}"] = _WHOLE[scan.how](value).over(window)
    df = df.withColumns({**columns, **resets})
    marks = {f"__mark_{n}": F.max(F.when(F.col(f"__reset_{n}"), F.col(f"__upto_{n}") - F.col(f"__in_{n}"))).over(_frame(keys, order, s.inclusive))
             for n, s in scans.items() if s.how == "since"}
    return df.withColumns(marks) if marks else df


def _finished(name: str, scan: Scan, carried: Column | None) -> Column:
    """Local value and what earlier chunks carry over, put together."""
    local = F.col(f"__local_{name}")
    if scan.how == "since":
        mark = F.col(f"__mark_{name}")
        here = F.coalesce(local, F.lit(0)) - F.coalesce(mark, F.lit(0))
        before = F.lit(0) if carried is None else F.coalesce(carried, F.lit(0))
        return F.when(mark.isNull(), here + before).otherwise(here)
    if carried is None:
        return local
    if scan.how == "sum":
        return F.when(local.isNull() & carried.isNull(), None).otherwise(F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0)))
    return {"max": F.greatest, "min": F.least}.get(scan.how, F.coalesce)(local, carried)


def _totals(chunked: DataFrame, scans: dict[str, Scan], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per (keys): what a whole chunk adds."""
    position = F.struct(*order)
    whole = Window.partitionBy(*keys)
    newest = {f"__at_{n}": F.max(F.when(F.col(f"__reset_{n}"), position)).over(whole) for n, s in scans.items() if s.how == "since"}
    if newest:
        chunked = chunked.withColumns(newest)
    aggregates = []
    for name, scan in scans.items():
        value = F.col(f"__in_{name}")
        if scan.how == "last":
            aggregates.append(F.max_by(value, F.when(value.isNotNull(), position)).alias(f"__total_{name}"))
        elif scan.how == "since":
            at = F.col(f"__at_{name}")
            aggregates.append(F.sum(F.when(at.isNull() | (position >= at), value)).alias(f"__total_{name}"))
            aggregates.append(F.bool_or(F.coalesce(f"__reset_{name}", F.lit(False))).alias(f"__had_{name}"))
        else:
            aggregates.append(_WHOLE[scan.how](value).alias(f"__total_{name}"))
    return chunked.groupBy(*keys).agg(*aggregates)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Scan | tuple[str, Column]],
            widths: Sequence[int] = DEFAULT_WIDTHS, inclusive: bool = True) -> DataFrame:
    """Add running values per key.

    ``order`` names columns that order the rows of a key completely; the first one is an integer (milliseconds or a
    sequence number) and is what the chunks are cut from. ``values`` are :class:`Scan` or (how, column) pairs, which
    take ``inclusive`` from the call.
    """
    scans = {n: v if isinstance(v, Scan) else Scan(v[0], v[1], inclusive) for n, v in values.items()}
    inputs = {f"__in_{n}": s.value for n, s in scans.items()}
    inputs |= {f"__reset_{n}": s.reset for n, s in scans.items() if s.how == "since"}
    # Keys that are never null let the join below compare with plain equality and so reuse the window's partitioning.
    never_null = {f"__key{i}": _never_null(df, k) for i, k in enumerate(keys)}
    return _running(df.withColumns({**inputs, **never_null}), list(never_null), order, scans, widths).select(*df.columns, *scans)


def _never_null(df: DataFrame, key: str) -> Column:
    text = F.col(key) if dict(df.dtypes)[key] == "string" else F.col(key).cast("string")
    return F.coalesce(text, F.lit("\u0000null"))


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[str], scans: dict[str, Scan], widths: Sequence[int]) -> DataFrame:
    if not widths:
        return _local(df, scans, keys, order).withColumns({n: _finished(n, s, None) for n, s in scans.items()})
    time, width, level = F.col(order[0]), F.lit(widths[0]), f"__chunk{len(widths)}"
    chunked = df.withColumn(level, F.coalesce(time - F.pmod(time, width), F.lit(-(2**63))))
    local = _local(chunked, scans, [*keys, level], order)
    totals = _totals(chunked, scans, [*keys, level], order)
    carries = {f"__carry_{n}": Scan(s.how, s.value, False, s.reset) for n, s in scans.items()}
    renamed = {f"__in___carry_{n}": F.col(f"__total_{n}") for n in scans}
    renamed |= {f"__reset___carry_{n}": F.col(f"__had_{n}") for n, s in scans.items() if s.how == "since"}
    carried = _running(totals.select(*keys, level, *[c.alias(n) for n, c in renamed.items()]), keys, [level], carries, widths[1:])
    joined = local.join(carried.select(*keys, level, *carries), [*keys, level], "left")
    return joined.withColumns({n: _finished(n, s, F.col(f"__carry_{n}")) for n, s in scans.items()})


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], into: str,
                 widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """Add a struct of ``columns`` taken from the row just before; null on the first row of a key."""
    value = F.struct(*[F.col(c) for c in columns])
    return running(df, keys, order, {into: ("last", value)}, widths, inclusive=False)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the one with the greatest ``order``. Combines before the shuffle, so hot keys stay cheap."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return best.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others]).select(*df.columns)


def as_of_within(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
                 right_order: Sequence[str], right_columns: Sequence[str], into: str, back: int,
                 ahead: int = 0) -> DataFrame:
    """For each left row the newest right row of the same key with time in [t - back, t + ahead]; null if none.

    Both sides are merged into one time order and cut into chunks as wide as the interval. A match then lies in the
    row's own chunk or the one before, so no pairs are formed and no key is gathered whole.
    """
    width = back + ahead + 1
    carry = [c for c in left.columns if c not in keys]
    null_row = F.lit(None)
    left_side = left.select(
        *keys, (F.col(left_time) + ahead).alias("__t"), F.lit(1).alias("__side"),
        F.struct(*carry).alias("__left"))
    right_row = F.struct(F.col(right_time).alias("__rt"), *[F.col(c) for c in right_order if c != right_time],
                         *[F.col(c) for c in right_columns if c not in right_order and c != right_time])
    right_side = right.select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), right_row.alias("__right"))
    merged = left_side.withColumn("__right", null_row.cast(right_side.schema["__right"].dataType)).unionByName(
        right_side.withColumn("__left", null_row.cast(left_side.schema["__left"].dataType)))
    merged = merged.withColumn("__chunk", F.floor(F.col("__t") / width).cast("long"))
    tie = [F.col(f"__right.{c}") for c in right_order if c != right_time]
    window = (Window.partitionBy(*keys, "__chunk").orderBy("__t", "__side", *tie)
              .rowsBetween(Window.unboundedPreceding, 0))
    local = (merged.withColumn("__near", F.last("__right", ignorenulls=True).over(window))
             .filter(F.col("__side") == 1))
    newest = (right_side.withColumn("__chunk", F.floor(F.col("__t") / width).cast("long"))
              .groupBy(*keys, "__chunk")
              .agg(F.max_by("__right", F.struct("__t", *tie)).alias("__before"))
              .withColumn("__chunk", F.col("__chunk") + 1))
    joined = local.join(newest, [*keys, "__chunk"], "left")
    found = F.coalesce(F.col("__near"), F.col("__before"))
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    found = F.when(named & (found["__rt"] >= F.col("__t") - (back + ahead)), found)
    struct = F.struct(*[(found["__rt"] if c == right_time else found[c]).alias(c) for c in
                        dict.fromkeys([*right_order, *right_columns])])
    return joined.select(
        *keys, *[F.col(f"__left.{c}").alias(c) for c in carry],
        F.when(found.isNotNull(), struct).alias(into)).select(*left.columns, into)
