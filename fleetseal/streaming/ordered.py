"""Streams taken in the order of event time, and live state that such an order needs.

A processor keeps the rows of a key until the watermark has passed them, then takes them one by one in order, woken by one timer per key.
A row that arrives behind the watermark is not dropped: it comes out marked late, or is answered from what the state still knows. State
goes by event time too: what no later row can ask for is cleared by the same timer.

The watermark column is dropped again before the rows are grouped. Timers follow the watermark all the same, and Spark does not filter
late rows out ahead of the processor. All of this needs the RocksDB state store.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from fleetseal.operators.attribution import LOOKBACK_MS, POLL_MS
from fleetseal.operators.bursts import WINDOW_MS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 16
# So many rows lie in one value on the way to a processor and from it.
_PACKED = 1 << 16
# So many rows are put in order at once, and make so many runs unless these would be short.
_ORDERED, _RUNS, _SHORT = 1 << 18, 16, 1 << 10
# What is bound is read and written by so many parts of the names.
_NAME_PARTS = 256
# Due of a row without a time: always late.
_NO_TIME = -(2**62)


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def clocked(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Let the watermark follow ``time`` (milliseconds), without keeping a column that would filter late rows."""
    return stream.withColumn("__at", F.timestamp_millis(F.col(time).cast("bigint"))).withWatermark("__at", delay).drop("__at")


class InOrder(StatefulProcessor):
    """Rows of a key in order of ``due`` and then ``tie``; subclasses say what a row means.

    ``tie`` names columns of the rows; ``due`` (milliseconds) is never null. Rows come and go many to a value, as :func:`_run` packs them.

    Rows wait in runs: many are ordered together and cut into runs, each of them a narrow part of their time and one value of the state. A
    release reads the runs in order of where they begin, some at a time, so it holds few of a key's rows at once, and asks the state per
    run and not per row. What subclasses keep is read once per call of Spark and written once, too.
    """

    def __init__(self, df: DataFrame, tie: Sequence[str]):
        self.at = {n: i for i, n in enumerate(df.columns)}
        self.due, self.ties = self.at["due"], [self.at[n] for n in tie]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "low bigint, number bigint", "rows binary")
        self.wake = handle.getValueState("wake", "at bigint")
        self.open()

    # What subclasses fill in.

    def open(self) -> None:
        """Make the state variables of the key."""

    def load(self) -> None:
        """Take over what the state holds for the key."""

    def save(self) -> None:
        """Put it back if it changed."""

    def take(self, key: tuple, row: tuple) -> Iterator[tuple]:
        """The next row in order."""
        raise NotImplementedError

    def late(self, key: tuple, row: tuple) -> Iterator[tuple]:
        """A row that the watermark had passed when it came."""
        raise NotImplementedError

    def ripe(self, row: tuple, mark: int) -> bool:
        """Whether the next row in order, which the watermark has passed, may be taken now; if not, those after it wait as well."""
        return True

    def rest(self, mark: int) -> int | None:
        """Clear what nobody can ask for any more; give the time at which to look again."""
        return None

    # Called by Spark.

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        given = (row for packed in rows for row in pickle.loads(packed["rows"]))
        return _packed_rows(self._given(key, given, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return _packed_rows(self._expired(key, timerValues.getCurrentWatermarkInMs()))

    def _expired(self, key: tuple, mark: int) -> Iterator[tuple]:
        self.load()
        yield from self._release(key, mark)
        self.save()

    def _given(self, key: tuple, rows: Iterator[tuple], mark: int) -> Iterator[tuple]:
        self.load()
        # What waits comes before what is late by now.
        yield from self._release(key, mark)
        fresh, wake = [], self._woken()
        for row in rows:
            due = row[self.due]
            # Before the first watermark nothing is late.
            if due <= mark if mark > 0 else due == _NO_TIME:
                yield from self.late(key, row)
                due = mark + 1  # to look at what it left in the state
            else:
                fresh.append(row)
                if len(fresh) == _ORDERED:
                    self._hold(fresh)
                    fresh = []
            wake = max(due, 1) if wake is None else min(wake, max(due, 1))
        self._hold(fresh)
        self.save()
        self._wake(wake)

    def _place(self, row: tuple) -> tuple:
        # Nulls come first among ties.
        return (row[self.due], *[x for i in self.ties for x in (row[i] is not None, row[i])])

    def _hold(self, rows: list[tuple]) -> None:
        """Let rows wait."""
        if not rows:
            return
        rows.sort(key=self._place)
        length = max(-(-len(rows) // _RUNS), _SHORT)
        held = Counter(low for low, _ in self.runs.keys())
        for i in range(0, len(rows), length):
            low = rows[i][self.due]
            self.runs.updateValue((low, held[low]), (pickle.dumps(rows[i:i + length], pickle.HIGHEST_PROTOCOL),))
            held[low] += 1

    def _release(self, key: tuple, mark: int) -> Iterator[tuple]:
        """Take the rows that the watermark has passed, if it is time to, and say when to look again."""
        woken = self._woken()
        if woken is None or woken > mark:
            return
        runs = sorted(tuple(k) for k in self.runs.keys())
        passed = [k for k in runs if k[0] <= mark]
        rows, read, waits = [], 0, False
        while read < len(passed) and not waits:
            for run in passed[read:read + _RUNS]:
                rows += pickle.loads(self.runs.getValue(run)[0])
                self.runs.removeKey(run)
            read += _RUNS
            rows.sort(key=self._place)
            # What begins later may come between the rows behind its begin.
            upto, done = passed[read][0] if read < len(passed) else mark + 1, 0
            for row in rows:
                if row[self.due] >= upto:
                    break
                if not self.ripe(row, mark):
                    waits = True
                    break
                yield from self.take(key, row)
                done += 1
            del rows[:done]
        lows = [low for low, _ in [*passed[read:], *runs[len(passed):]]] + [row[self.due] for row in rows[:1]]
        self._hold(rows)
        at = [x for x in (min(lows) if lows else None, self.rest(mark)) if x is not None]
        self._wake(max(min(at), mark + 1) if at else None)

    def close(self) -> None:
        pass

    def _woken(self) -> int | None:
        return self.wake.get()[0] if self.wake.exists() else None

    def _wake(self, at: int | None) -> None:
        """Keep one timer per key, or none."""
        now = self._woken()
        if at == now:
            return
        if now is not None:
            self.handle.deleteTimer(now)
            self.wake.clear()
        if at is not None:
            self.handle.registerTimer(at)
            self.wake.update((at,))


def _packed_rows(rows: Iterator[tuple]) -> Iterator[Row]:
    return (Row(rows=pickle.dumps(part, pickle.HIGHEST_PROTOCOL)) for part in batched(rows, _PACKED))


def _pack(keys: list[int]):
    """Rows of one key, out of up to ``_PACKED`` rows that lie together, as one value: Spark hands a processor row by row what it gets."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in groups], schema.field(at).type) for i, at in enumerate(keys)]
            values = pa.array([pickle.dumps(rows, pickle.HIGHEST_PROTOCOL) for rows in groups.values()], pa.binary())
            return pa.RecordBatch.from_arrays([*columns, values], [*(schema.field(at).name for at in keys), "rows"])

        groups, held, schema = {}, 0, None
        for batch in batches:
            schema = batch.schema
            for row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                groups.setdefault(tuple(row[at] for at in keys), []).append(row)
            held += batch.num_rows
            if held >= _PACKED:
                yield packed()
                groups, held = {}, 0
        if groups:
            yield packed()
    return work


def _unpack(schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                columns = zip(*pickle.loads(value.as_py()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    return work


def _run(rows: DataFrame, keys: Sequence[str], processor: InOrder, schema: str) -> DataFrame:
    types = dict(rows.dtypes)
    packed = rows.mapInArrow(_pack([rows.columns.index(k) for k in keys]), ", ".join(f"`{k}` {types[k]}" for k in keys) + ", rows binary")
    found = packed.groupBy(*keys).transformWithState(processor, "rows binary", "Append", "EventTime")
    return found.mapInArrow(_unpack(to_arrow_schema(StructType.fromDDL(schema))), schema)


# Windows opened by the first arrival.

class _Windows(InOrder):
    """Rows leave with their window once it is over; a row behind the watermark leaves without one."""

    def __init__(self, df: DataFrame, tie: Sequence[str], width: int):
        own = [n for n in df.columns if n not in ("due", "__key")]
        super().__init__(df, tie)
        self.width, self.own = width, [self.at[n] for n in own]

    def open(self) -> None:
        self.kept = self.handle.getValueState("start", "at bigint")

    def load(self) -> None:
        self.start = self.before = self.kept.get()[0] if self.kept.exists() else None

    def save(self) -> None:
        if self.start != self.before:
            self.kept.clear() if self.start is None else self.kept.update((self.start,))

    def _opened(self, due: int) -> int:
        return due if self.start is None or due >= self.start + self.width else self.start

    def ripe(self, row: tuple, mark: int) -> bool:
        return self._opened(row[self.due]) + self.width - 1 <= mark

    def take(self, key: tuple, row: tuple) -> Iterator[tuple]:
        self.start = self._opened(row[self.due])
        yield (*[row[i] for i in self.own], self.start, False)

    def late(self, key: tuple, row: tuple) -> Iterator[tuple]:
        yield (*[row[i] for i in self.own], None, True)

    def rest(self, mark: int) -> int | None:
        if self.start is not None and self.start + self.width - 1 <= mark:
            self.start = None  # over: whatever comes opens a window of its own
        return None if self.start is None else self.start + self.width


def window_stream(notifications: DataFrame, delay: str = "10 seconds", width: int = WINDOW_MS, time: str = "captured_ms",
                  key: str = "host", order: str = "seq") -> DataFrame:
    """Notifications with ``window_ms`` and ``late``: per key a window opens with the first arrival and is never extended.

    All rows of a window leave in one micro-batch, after the watermark has passed its end. A row behind the watermark has
    late = true and no window, so rows out plus rows still held are rows in. Rows without a time are late as well.
    """
    taken = {"due", "window_ms", "late", "__key"} & set(notifications.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here")
    rows = clocked(notifications, time, delay).withColumns({"due": F.coalesce(F.col(time), F.lit(_NO_TIME)).cast("bigint"), "__key": F.coalesce(F.col(key).cast("string"), F.lit(""))})
    schema = ", ".join(f"`{n}` {t}" for n, t in notifications.dtypes) + ", window_ms bigint, late boolean"
    return _run(rows, ["__key"], _Windows(rows, [order], width), schema)


# Live attribution of file notifications.

class _Newest(InOrder):
    """The newest activity on a path, for notifications that wait until activity a little late has come."""

    def __init__(self, df: DataFrame, back: int, ahead: int):
        super().__init__(df, ["asks", "tie"])
        self.back, self.ahead = back, ahead

    def open(self) -> None:
        self.kept = self.handle.getValueState("newest", "at bigint, tie bigint, io string")

    def load(self) -> None:
        self.newest = self.before = tuple(self.kept.get()) if self.kept.exists() else None

    def save(self) -> None:
        if self.newest != self.before:
            self.kept.clear() if self.newest is None else self.kept.update(self.newest)

    def take(self, key: tuple, row: tuple) -> Iterator[tuple]:
        return self._apply(row, False)

    def late(self, key: tuple, row: tuple) -> Iterator[tuple]:
        return self._apply(row, True)

    def _apply(self, row: tuple, late: bool) -> Iterator[tuple]:
        value = lambda n: row[self.at[n]]
        if value("asks"):
            found = self.newest is not None and value("due") - (self.back + self.ahead) <= self.newest[0] <= value("due")
            yield (value("id"), self.newest[2] if found else None, late)
        elif self.newest is None or (value("due"), value("tie")) > self.newest[:2]:
            # Late activity counts if it is newer than what is known; older one can change no answer to come.
            self.newest = (value("due"), value("tie"), value("io"))

    def rest(self, mark: int) -> int | None:
        """Activity goes once no notification that is not late can be near enough."""
        if self.newest is None:
            return None
        end = self.newest[0] + self.back + self.ahead
        if end < mark:
            self.newest = None
            return None
        return end + 1


def attribution_stream(notifications: DataFrame, activity: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str,
                       delay: str = "10 seconds", back: int = LOOKBACK_MS, ahead: int = POLL_MS, time: str = "t_ms", id_column: str = "id") -> DataFrame:
    """(id, io, late) per notification: the newest activity on its ``keys`` at most ``back`` ms old or ``ahead`` ms late, else null.

    The live form of :func:`fleetseal.operators.attribution.attribute_files`. A notification waits ``ahead`` ms of event time for its answer.
    One that arrives behind the watermark is answered at once from what is known, and says so. ``order`` decides among
    activity of one moment. State holds the newest activity per key and is cleared ``back + ahead`` ms after it. Keys are never null.
    """
    evidence = F.struct(F.col(time).cast("bigint").alias(time), *[F.col(c) for c in columns if c != time])
    types = dict(activity.select(evidence.alias("io")).dtypes)["io"]
    id_type = dict(notifications.dtypes)[id_column]
    done = clocked(activity, time, delay).select(*keys, F.col(time).cast("bigint").alias("due"), F.lit(False).alias("asks"), F.col(order).cast("bigint").alias("tie"),
                                                 F.lit(None).cast(id_type).alias("id"), F.to_json(evidence).alias("io"))
    asked = clocked(notifications, time, delay).select(*keys, (F.col(time) + ahead).cast("bigint").alias("due"), F.lit(True).alias("asks"), F.lit(0).cast("bigint").alias("tie"),
                                                       F.col(id_column).alias("id"), F.lit(None).cast("string").alias("io"))
    rows = done.unionByName(asked).filter("due IS NOT NULL")
    # The evidence of an activity is one text in the state.
    found = _run(rows, keys, _Newest(rows, back, ahead), f"id {id_type}, io string, late boolean")
    return found.select("id", F.from_json("io", types).alias("io"), "late")


# What is bound on a host: process instances and registry handles. A host is spread over buckets; what concerns all of it goes to each.

def _bucketed(rows: DataFrame, everywhere: Column, by: Column, buckets: int) -> DataFrame:
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    own = F.array(F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    return rows.withColumn("bucket", F.explode(F.when(everywhere, every).otherwise(own)))


class _Bound(InOrder):
    """A map of what is bound, and whether the whole host has been marked."""

    def __init__(self, df: DataFrame):
        super().__init__(df, ["rank", "seq"])

    def open(self) -> None:
        self.bound = self.handle.getMapState("bound", "part int", "names binary")
        self.kept = self.handle.getValueState("marked", "at bigint")

    def load(self) -> None:
        self.parts, self.changed, self.cleared = {}, set(), False
        self.marked = self.before = self.kept.get()[0] if self.kept.exists() else None

    def save(self) -> None:
        if self.cleared:
            self.bound.clear()
        for part in self.changed:
            if self.parts[part]:
                self.bound.updateValue((part,), (pickle.dumps(self.parts[part], pickle.HIGHEST_PROTOCOL),))
            elif not self.cleared and self.bound.containsKey((part,)):
                self.bound.removeKey((part,))
        if self.marked != self.before:
            self.kept.update((self.marked,))

    def _part(self, name: str, changes: bool = False) -> dict[str, str]:
        """The part of what is bound that a name belongs to."""
        part = zlib.crc32(name.encode()) % _NAME_PARTS
        if part not in self.parts:
            stored = not self.cleared and self.bound.containsKey((part,))
            self.parts[part] = pickle.loads(self.bound.getValue((part,))[0]) if stored else {}
        if changes:
            self.changed.add(part)
        return self.parts[part]

    def take(self, key: tuple, row: tuple) -> Iterator[tuple]:
        op, name, value = (row[self.at[n]] for n in ("op", "name", "value"))
        if op in ("bind", "unbind") and name is None:
            return
        if op == "bind":
            self._part(name, True)[name] = value
        elif op == "unbind":
            if name in self._part(name):
                del self._part(name, True)[name]
        elif op == "clear":
            self.parts, self.changed, self.cleared = {}, set(), True
        elif op == "mark":
            if self.marked is None:
                self.marked = row[self.due]
        elif op == "use":
            yield self._answer(key, row, False)

    def late(self, key: tuple, row: tuple) -> Iterator[tuple]:
        """A late use is answered from what is bound now; a late change of what is bound is made now. Both are reported."""
        if row[self.at["op"]] == "use":
            yield self._answer(key, row, True)
        else:
            yield from self.take(key, row)
            if row[self.at["op"]] in ("bind", "unbind"):
                yield (key[0], row[self.at["seq"]], row[self.at["op"]], None, False, True, self.marked is not None, True)

    def _answer(self, key: tuple, row: tuple, late: bool) -> tuple:
        name = row[self.at["name"]]
        known = name is not None and name in self._part(name)
        return (key[0], row[self.at["seq"]], "use", self._part(name)[name] if known else None, known, name is not None, self.marked is not None, late)


_BOUND = "host string, seq bigint, op string, value string, known boolean, named boolean, marked boolean, late boolean"


def _bound_stream(rows: DataFrame, buckets: int, everywhere: Column, by: Column) -> DataFrame:
    timed = rows.withColumn("due", F.col("t_ms").cast("bigint")).filter("due IS NOT NULL")
    # At one moment what is bound comes first, then what ends everything, then uses.
    rank = F.when(F.col("op").isin("bind", "unbind", "mark"), 0).when(F.col("op") == "clear", 1).otherwise(2)
    spread = _bucketed(timed, everywhere, by, buckets).select(F.coalesce("host", F.lit("")).alias("host"), "bucket", "due", rank.alias("rank"), "seq", "op", "name", "value")
    return _run(spread, ["host", "bucket"], _Bound(spread), _BOUND)


def process_stream(trace: DataFrame, delay: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(host, seq, process_name, status, missing_reason, late) for each file activity of a trace.

    The live form of :func:`fleetseal.operators.attribution.resolve_process`: an instance (process id and sequence) is alive from its start
    or rundown to its stop. Activity without a sequence is Unavailable, or RundownMissing as long as its host has shown no rundown
    event that carries one. A start or stop behind the watermark still changes the state and comes out with status LateLifecycle.
    """
    opcode, lifecycle, has_sequence = F.col("opcode"), F.upper("task") == "PROCESS", F.col("process_sequence_number").isNotNull()
    started = lifecycle & opcode.isin("Start", "DCStart") & has_sequence
    ops = F.array_compact(F.array(
        F.when(started, F.lit("bind")), F.when(started & (opcode == "DCStart"), F.lit("mark")),
        F.when(lifecycle & (opcode == "Stop") & has_sequence, F.lit("unbind")), F.when(F.upper("task") == "FILEIO", F.lit("use"))))
    name = F.when(has_sequence, F.concat_ws("/", F.col("process_id").cast("string"), F.col("process_sequence_number").cast("string")))
    rows = clocked(trace, "t_ms", delay).select("host", "t_ms", F.col("seq").cast("bigint").alias("seq"), F.explode(ops).alias("op"), name.alias("name"),
                        F.coalesce("process_name", F.lit("")).alias("value"), F.col("process_id").alias("pid"))
    found = _bound_stream(rows, buckets, F.col("op") == "mark", F.col("pid"))
    use, named, known = F.col("op") == "use", F.col("named"), F.col("known")
    status = (F.when(~use, "LateLifecycle").when(~named & ~F.col("marked"), "RundownMissing").when(known, "Attributed").otherwise("Unavailable"))
    reason = (F.when(~use | known, None).when(~named & ~F.col("marked"), "ProcessRundownMissing").when(~named, "ProcessSequenceNumberMissing")
              .otherwise("ProcessInstanceNotFound"))
    return found.select("host", "seq", F.col("value").alias("process_name"), status.alias("status"), reason.alias("missing_reason"), "late")


def handle_stream(trace: DataFrame, clears: DataFrame, delay: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(host, seq, resolved_path, late) for each use of a handle: the path bound to it, null when unbound or not trusted any more.

    The live form of :func:`fleetseal.operators.attribution.resolve_handles`. ``trace`` is (host, handle, seq, t_ms, op, path), ``clears`` (host,
    t_ms) are losses: what was bound on the host until then, in any bucket, is forgotten. Late bindings are made and come out without a path.
    """
    op = F.when((F.col("op") == "create") & (F.col("path") != ""), "bind").when(F.col("op") == "delete", "unbind").when(F.col("op") == "use", "use")
    rows = clocked(trace, "t_ms", delay).select("host", "t_ms", F.col("seq").cast("bigint").alias("seq"), op.alias("op"), F.when(F.col("handle") != 0, F.col("handle").cast("string")).alias("name"),
                        F.col("path").alias("value"), F.col("handle").alias("by"))
    lost = clocked(clears, "t_ms", delay).select("host", "t_ms", F.lit(0).cast("bigint").alias("seq"), F.lit("clear").alias("op"), F.lit(None).cast("string").alias("name"),
                         F.lit(None).cast("string").alias("value"), F.lit(None).cast(dict(rows.dtypes)["by"]).alias("by"))
    found = _bound_stream(rows.unionByName(lost), buckets, F.col("op") == "clear", F.col("by"))
    return found.select("host", "seq", F.col("value").alias("resolved_path"), "late")
