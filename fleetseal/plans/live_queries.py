"""Live runs over the given tables: several micro-batches out of time order, first-arrival windows, state in event-time order."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetseal.operators import bursts
from fleetseal.operators.windows import first_arrival_windows
from fleetseal.plans import change_queries  # noqa: F401  (its checks are reused here)
from fleetseal.plans.inputs import arriving
from fleetseal.plans.registry import CHECKS, query
from fleetseal.session import checkpoint_dir
from fleetseal.streaming import ordered

_PARTS = 4
_FAR_MS = 10**15


@dataclass
class _Feed:
    """A table as a stream of files, and how far its rows are out of order at most."""

    stream: DataFrame
    delay: str


def _folder(t) -> str:
    return f"{checkpoint_dir(t.spark)}/live-{uuid.uuid4().hex}"


def _feed(df: DataFrame, time: str, folder: str) -> _Feed:
    """Write ``df`` as files that arrive one part after the other, each row up to half a part later than its time says.

    A last row far ahead lets the watermark pass everything; the caller leaves it out of the result.
    """
    low, high = df.agg(F.min(time), F.max(time)).first()
    span = ((high or 0) - (low or 0)) // _PARTS + 2
    jitter = span // 2
    arrives = F.col(time) + F.pmod(F.xxhash64(*df.columns), F.lit(jitter))
    part = F.least(F.floor((arrives - F.lit(low or 0)) / span), F.lit(_PARTS - 1))
    files = arriving(df, part, _PARTS, folder)
    closing = df.sparkSession.range(1).select(*[F.lit(_FAR_MS if n == time else 0).cast(kind).alias(n) for n, kind in df.dtypes])
    closing.write.mode("append").parquet(folder)
    return _Feed(df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder), f"{jitter + 1} milliseconds")


def _drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream until its files are used up, and read back what came out."""
    with ordered.rocksdb(stream.sparkSession):
        (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


_STARTS = """starts AS (SELECT host, min(t_ms) AS s FROM {raw_notifications} GROUP BY host
    UNION ALL SELECT n.host, min(n.t_ms) FROM starts o JOIN {raw_notifications} n ON n.host = o.host AND n.t_ms >= o.s + 75 GROUP BY n.host),
  windowed AS (SELECT n.host, n.seq, n.category, n.full_path, n.old_path, max(s.s) AS win FROM {raw_notifications} n JOIN starts s ON s.host = n.host AND s.s <= n.t_ms
    GROUP BY n.host, n.seq, n.category, n.full_path, n.old_path)"""


@query(f"WITH RECURSIVE {_STARTS} SELECT host, seq, win AS window_ms FROM windowed")
def window_first_arrival(t):
    """The window of every notification; windows are opened by the first arrival of a host and never extended."""
    return first_arrival_windows(t.raw_notifications, ["host"]).select("host", "seq", "window_ms")


_BY_ARRIVAL = (CHECKS["burst_collapse"].replace("WITH touch", f"WITH RECURSIVE {_STARTS}, touch", 1)
               .replace("FROM {raw_notifications} WHERE", "FROM windowed WHERE").replace("AS ren FROM {raw_notifications}", "AS ren FROM windowed")
               .replace("FROM {raw_notifications} r)", "FROM windowed r)").replace("SELECT host, win, seq, category", "SELECT host, win AS window_ms, seq, category"))


@query(_BY_ARRIVAL)
def burst_first_arrival(t):
    """What is left of every burst, within windows opened by the first arrival."""
    windowed = first_arrival_windows(t.raw_notifications, ["host"])
    return bursts.collapse(windowed, ["host", "window_ms"]).select("host", "window_ms", "seq", "category", "full_path", "old_path")


def _notes(t, folder: str) -> _Feed:
    notes = t.raw_notifications.select("host", "seq", F.col("t_ms").alias("captured_ms"), "category", "full_path", "old_path")
    return _feed(notes, "captured_ms", f"{folder}/in")


@query(_BY_ARRIVAL)
def stream_first_arrival(t):
    """The same from a stream of several batches out of order: a window leaves whole, and each micro-batch is collapsed by itself."""
    folder = _folder(t)
    fed = _notes(t, folder)

    def collapse(batch: DataFrame, batch_id: int) -> None:
        closed = bursts.collapse(batch.filter(f"NOT late AND captured_ms < {_FAR_MS}"), ["host", "window_ms"])
        closed.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    with ordered.rocksdb(t.spark):
        (ordered.window_stream(fed.stream, fed.delay).writeStream.foreachBatch(collapse).option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.parquet(f"{folder}/out").select("host", "window_ms", "seq", "category", "full_path", "old_path")


@query("SELECT host, count(*) AS n_rows, CAST(sum(seq) AS BIGINT) AS sum_seq FROM {raw_notifications} GROUP BY host")
def stream_late_rows(t):
    """Rows that left a stream in time or late, whose watermark follows more closely than its rows are in order: none is missing."""
    folder = _folder(t)
    out = _drained(ordered.window_stream(_notes(t, folder).stream, "1 millisecond"), folder)
    whole = out.filter(f"captured_ms < {_FAR_MS}")
    return whole.groupBy("host").agg(F.count("*").alias("n_rows"), F.sum("seq").alias("sum_seq"))


@query("""WITH best AS (SELECT n.id, max(i.io_id) AS io_id FROM {notif} n JOIN {file_io} i ON i.path_id = n.path_id AND i.t_ms BETWEEN n.t_ms - 10000 AND n.t_ms + 50 GROUP BY n.id)
  SELECT n.id, b.io_id, i.pid, i.t_ms AS source_ms FROM {notif} n LEFT JOIN best b ON n.id = b.id LEFT JOIN {file_io} i ON i.io_id = b.io_id""")
def stream_file_attribution(t):
    """The activity that each notification is put down to, from two streams out of order; state expires by event time."""
    folder = _folder(t)
    asked, seen = _feed(t.notif, "t_ms", f"{folder}/asked"), _feed(t.file_io, "t_ms", f"{folder}/seen")
    found = ordered.attribution_stream(asked.stream, seen.stream, ["path_id"], ["io_id", "pid"], "io_id", max(asked.delay, seen.delay, key=lambda d: int(d.split()[0])))
    io = F.col("io")
    return _drained(found, folder).filter("NOT late AND id > 0").select("id", io["io_id"].alias("io_id"), io["pid"].alias("pid"), io["t_ms"].alias("source_ms"))


@query("""WITH life AS (SELECT * FROM {file_trace} WHERE task = 'Process' AND process_sequence_number IS NOT NULL),
  done AS (SELECT host, min(t_ms) AS at FROM life WHERE opcode = 'DCStart' GROUP BY host),
  uses AS (SELECT * FROM {file_trace} WHERE task = 'fileio'),
  newest AS (SELECT u.seq, arg_max(l.opcode, l.seq) AS op, arg_max(l.process_name, l.seq) AS name FROM uses u JOIN life l
    ON l.host = u.host AND l.process_id = u.process_id AND l.process_sequence_number = u.process_sequence_number AND l.t_ms <= u.t_ms GROUP BY u.seq),
  judged AS (SELECT u.host, u.seq, u.process_sequence_number IS NULL AS unnamed, coalesce(d.at <= u.t_ms, false) AS rundown, coalesce(n.op <> 'Stop', false) AS alive, n.name
    FROM uses u LEFT JOIN newest n ON n.seq = u.seq LEFT JOIN done d ON d.host = u.host)
  SELECT host, seq, CASE WHEN alive THEN name END AS process_name,
    CASE WHEN unnamed AND NOT rundown THEN 'RundownMissing' WHEN alive THEN 'Attributed' ELSE 'Unavailable' END AS status,
    CASE WHEN unnamed AND NOT rundown THEN 'ProcessRundownMissing' WHEN unnamed THEN 'ProcessSequenceNumberMissing' WHEN NOT alive THEN 'ProcessInstanceNotFound' END AS missing_reason
  FROM judged""")
def stream_process_state(t):
    """The process instance of each file activity, from a stream out of order; hosts without a rundown say so."""
    folder = _folder(t)
    fed = _feed(t.file_trace, "t_ms", f"{folder}/in")
    return _drained(ordered.process_stream(fed.stream, fed.delay), folder).filter("NOT late").select("host", "seq", "process_name", "status", "missing_reason")


@query(CHECKS["handle_path_resolution"])
def stream_handle_resolution(t):
    """The path of each handle use from two streams out of order; a loss ends what was bound on its host."""
    folder = _folder(t)
    trace = _feed(t.kcb.withColumn("t_ms", F.col("seq") + 1), "t_ms", f"{folder}/trace")
    clears = _feed(t.kcb_clears.select("host", (F.col("seq") + 1).alias("t_ms")), "t_ms", f"{folder}/clears")
    found = ordered.handle_stream(trace.stream, clears.stream, max(trace.delay, clears.delay, key=lambda d: int(d.split()[0])))
    # The handle is no part of what a stream answers; it comes from the trace.
    return _drained(found, folder).filter("NOT late").join(t.kcb.select("host", "seq", "handle"), ["host", "seq"]).select("seq", "host", "handle", "resolved_path")
