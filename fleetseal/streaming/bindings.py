"""Live state per key: what is bound to it right now, and what a use of it finds.

One state processor serves three streams: handles bound to registry paths, process instances between start and stop,
and recent file activity per path (a binding that expires). Keys are spread over the cluster; a key keeps one value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetseal.operators.attribution import LOOKBACK_MS


class _LatestBinding(StatefulProcessor):
    def __init__(self, keys: Sequence[str], lifetime_ms: int | None):
        self.keys, self.lifetime_ms = list(keys), lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bound = handle.getValueState("bound", "value string, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, at = self.bound.get() if self.bound.exists() else (None, None)
        ordered = pd.concat(list(rows)).sort_values(["t_ms", "rank", "seq"], kind="stable")
        found = []
        for t_ms, seq, op, given in zip(ordered["t_ms"], ordered["seq"], ordered["op"], ordered["value"]):
            if op == "bind":
                value, at = given, int(t_ms)
            elif op == "unbind":
                value, at = None, int(t_ms)
            else:
                fresh = value is not None and (self.lifetime_ms is None or t_ms - at <= self.lifetime_ms)
                found.append((int(seq), value if fresh else None))
        if value is not None:
            self.bound.update((value, at))
        elif at is not None:
            # Nothing is bound any more: the key leaves the state.
            self.bound.clear()
        if found:
            out = pd.DataFrame(found, columns=["seq", "found"])
            for name, part in zip(self.keys, key):
                out.insert(0, name, part)
            yield out[[*self.keys, "seq", "found"]]

    def close(self) -> None:
        pass


def latest_binding(operations: DataFrame, keys: Sequence[str], lifetime_ms: int | None = None) -> DataFrame:
    """For every ``use`` row the value bound to its key at that time (null when none): (keys, seq, found).

    ``operations`` is (keys, seq, t_ms, op, value) with ``op`` bind, unbind or use. At equal times a binding comes
    before a use. Needs the RocksDB state store.
    """
    ranked = operations.withColumn("rank", F.when(F.col("op") == "use", 1).otherwise(0))
    types = dict(operations.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", seq bigint, found string"
    return ranked.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_LatestBinding(keys, lifetime_ms), outputStructType=schema, outputMode="Append", timeMode="None")


def handle_uses(operations: DataFrame) -> DataFrame:
    """Live handle resolution from (host, handle, seq, t_ms, op, path) with op create, delete or use."""
    ops = operations.filter("handle <> 0").select(
        "host", "handle", "seq", "t_ms",
        F.when(F.col("op") == "create", "bind").when(F.col("op") == "delete", "unbind").otherwise("use").alias("op"),
        F.col("path").alias("value"))
    return latest_binding(ops.filter("op <> 'bind' OR value <> ''"), ["host", "handle"])


def process_uses(trace: DataFrame) -> DataFrame:
    """Live process instances: starts and rundowns bind (host, process id, sequence), stops unbind, file activity uses.

    Rows without a sequence name no instance and are left out.
    """
    opcode = F.col("opcode")
    lifecycle = F.upper("task") == "PROCESS"
    op = (F.when(lifecycle & opcode.isin("Start", "DCStart"), "bind").when(lifecycle & (opcode == "Stop"), "unbind")
          .when(F.upper("task") == "FILEIO", "use"))
    ops = trace.filter("process_sequence_number IS NOT NULL").select(
        "host", "process_id", F.col("process_sequence_number").cast("string").alias("process_sequence_number"), "seq", "t_ms",
        op.alias("op"), F.col("process_name").alias("value")).filter("op IS NOT NULL")
    return latest_binding(ops, ["host", "process_id", "process_sequence_number"])


def file_uses(activity: DataFrame, notifications: DataFrame, lifetime_ms: int = LOOKBACK_MS) -> DataFrame:
    """Live file attribution: the newest activity on the path of each notification, unless it is older than the lifetime.

    ``activity`` is (host, path, seq, t_ms, process_name), ``notifications`` is (host, full_path, seq, t_ms).
    """
    bound = activity.select("host", F.upper("path").alias("path_key"), "seq", "t_ms", F.lit("bind").alias("op"), F.col("process_name").alias("value"))
    used = notifications.select("host", F.upper("full_path").alias("path_key"), "seq", "t_ms", F.lit("use").alias("op"),
                                F.lit(None).cast("string").alias("value"))
    return latest_binding(bound.unionByName(used), ["host", "path_key"], lifetime_ms)
