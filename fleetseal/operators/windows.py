"""Windows that the first arrival opens and nothing extends.

An arrival opens a window unless it falls into an open one, so each window depends on the one before and a host would have to be read in
order from its beginning. What a chunk of time hands on is little, though: by how many milliseconds the window that is open at its end
reaches beyond it, fewer than a window is wide. A chunk is therefore a function from a few small numbers to small numbers, worked out
from its distinct arrival times alone. The functions of many chunks are composed, level by level, and once each chunk knows what reaches into
it, its windows are known. No host is read by one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.operators.bursts import WINDOW_MS
from fleetseal.session import staged

CHUNK_MS = 60_000
CHUNKS_TOGETHER = 1000


def _last_starts(times: np.ndarray, width: int) -> np.ndarray:
    """Per arrival the place of the last window start of the chain that begins there."""
    following = np.searchsorted(times, times + width)
    last = np.arange(len(times))
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            last[i] = last[following[i]]
    return last


def _reaches(width: int, chunk_ms: int):
    """Add ``reach``: for each carry 0 .. width-1 into a chunk, the carry out of it."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = []
            for times in batch["times"]:
                t = np.asarray(times.as_py(), np.int64)
                entry, last = np.searchsorted(t, np.arange(width)), _last_starts(t, width)
                ends = np.append(t[last] + width - chunk_ms, 0)  # no arrival from the carry on: nothing is open at the end
                reach.append(np.maximum(ends[entry], 0).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reach, pa.list_(pa.int32()))], [*batch.schema.names, "reach"])
    return work


def _starts(width: int, chunk_ms: int, keys: Sequence[str]):
    """One row per distinct arrival time with the start of its window, from the carry into its chunk."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                begin, carry = batch["__chunk"][row].as_py() * chunk_ms, batch["carry"][row].as_py()
                t = np.asarray(batch["times"][row].as_py(), np.int64)
                start, opened = np.empty(len(t), np.int64), carry - width
                at = int(np.searchsorted(t, carry))
                start[:at] = opened
                while at < len(t):
                    end = int(np.searchsorted(t, t[at] + width))
                    start[at:end], at = t[at], end
                of = [pa.repeat(batch[k][row], len(t)) for k in keys]
                yield pa.RecordBatch.from_arrays([*of, pa.array(t + begin), pa.array(start + begin)], [*keys, "__t", "window_ms"])
    return work


def _composed(parts: Column, last: Column, width: int) -> Column:
    """The function of consecutive (place, reach) rows put together; a missing place hands on nothing."""
    identity = F.sequence(F.lit(0), F.lit(width - 1))
    zero = F.array_repeat(F.lit(0), width)
    first = F.struct(F.get(parts, F.lit(0))["place"].alias("place"), identity.alias("reach"))

    def step(before: Column, part: Column) -> Column:
        into = F.when(part["place"] - before["place"] > 1, zero).otherwise(before["reach"])
        return F.struct(part["place"].alias("place"), F.transform(into, lambda c: F.get(part["reach"], c)).alias("reach"))
    done = F.aggregate(parts, first, step)
    return F.when(done["place"] == last, done["reach"]).otherwise(zero)


def _carried(parts: Column, into: Column) -> Column:
    """(place, carry) of every part: what reaches into it, ``into`` being what reaches into the first place of all."""
    start = F.struct(F.lit(None).cast("bigint").alias("place"), into.alias("carry"), F.array().cast("array<struct<place:bigint,carry:int>>").alias("seen"))

    def step(before: Column, part: Column) -> Column:
        here = F.when(before["place"].isNotNull() & (part["place"] - before["place"] > 1), 0).otherwise(before["carry"])
        return F.struct(part["place"].alias("place"), F.get(part["reach"], here).alias("carry"),
                        F.concat(before["seen"], F.array(F.struct(part["place"].alias("place"), here.alias("carry")))).alias("seen"))
    return F.aggregate(parts, start, step)["seen"]


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls equal each other."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def first_arrival_windows(notifications: DataFrame, keys: Sequence[str], time: str = "t_ms", width: int = WINDOW_MS,
                          chunk_ms: int = CHUNK_MS, together: int = CHUNKS_TOGETHER) -> DataFrame:
    """Add ``window_ms``, the start of the window each notification is in, per ``keys``; null for a null time.

    The first arrival of a key opens a window of ``width`` ms. The next one at or after its end opens another, and so on. Chunks are longer
    than windows; a column ``window_ms`` is replaced. Only distinct arrival times of a chunk come together in one row.
    """
    if chunk_ms < width:
        raise ValueError("a chunk must be as long as a window at least")
    keys = list(keys)
    chunk = F.floor(F.col(time) / chunk_ms).cast("bigint")
    at = (F.col(time) - chunk * chunk_ms).cast("int")
    timed = notifications.filter(F.col(time).isNotNull()).select(*keys, chunk.alias("__chunk"), at.alias("__at"))
    chunks = timed.groupBy(*keys, "__chunk").agg(F.array_sort(F.collect_set("__at")).alias("times"))
    own = staged(chunks.mapInArrow(_reaches(width, chunk_ms), f"{_typed(chunks, [*keys, '__chunk', 'times'])}, reach array<int>"), "arrivals")
    block = F.floor(F.col("__chunk") / together).cast("bigint").alias("__block")
    parts = own.groupBy(*keys, block).agg(F.array_sort(F.collect_list(F.struct(F.col("__chunk").alias("place"), "reach"))).alias("parts"))
    whole = parts.select(*keys, F.struct(F.col("__block").alias("place"), _composed_block(width, together).alias("reach")).alias("part"))
    above = whole.groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("blocks"))
    into = above.select(*keys, F.explode(_carried(F.col("blocks"), F.lit(0))).alias("c")).select(*keys, F.col("c.place").alias("__block"), F.col("c.carry").alias("__into"))
    placed = _same(parts, into, [*keys, "__block"])
    # A block that does not begin with its first chunk receives nothing.
    first = F.get("parts", F.lit(0))["place"] == F.col("__block") * together
    carries = placed.select(*keys, F.explode(_carried(F.col("parts"), F.when(first, F.col("__into")).otherwise(F.lit(0)))).alias("c")).select(
        *keys, F.col("c.place").alias("__chunk"), F.col("c.carry").alias("carry"))
    known = _same(own.select(*keys, "__chunk", "times"), carries, [*keys, "__chunk"])
    starts = known.mapInArrow(_starts(width, chunk_ms, keys), f"{_typed(known, keys) + ', ' if keys else ''}__t bigint, window_ms bigint")
    rows = notifications.drop("window_ms").withColumn("__t", F.col(time).cast("bigint"))
    return _same(rows, starts, [*keys, "__t"], "left").drop("__t")


def _composed_block(width: int, together: int) -> Column:
    """The function of a block of chunks. If its first chunk has no arrival, what reaches into the block ends there."""
    made = _composed(F.col("parts"), F.col("__block") * together + together - 1, width)
    begins = F.get("parts", F.lit(0))["place"] == F.col("__block") * together
    return F.when(begins, made).otherwise(F.array_repeat(F.get(made, F.lit(0)), width))


def _typed(df: DataFrame, names: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{n}` {types[n]}" for n in names)
