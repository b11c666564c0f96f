"""Who did it: actor filters, as-of joins to file activity and process instances, handles, accounts, audit records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.functions.paths import has_content
from fleetseal.operators.ordered import DEFAULT_WIDTHS, as_of_within, running

# File operations that change something, and how long their evidence may be correlated.
MUTATIONS = ("Create", "Write", "Delete", "Rename", "SetInfo", "SetInformation")
LOOKBACK_MS = 10_000
POLL_MS = 50
AUDIT_EVENT_IDS = (4663, 4657)


def file_mutations(trace: DataFrame, own_pid: int = -2) -> DataFrame:
    """File activity worth correlating: a real foreign process, a changing operation, a path."""
    return trace.filter(
        (F.col("process_id") > 0) & (F.col("process_id") != own_pid) & (F.upper("task") == "FILEIO")
        & F.col("opcode").isin(*MUTATIONS) & has_content(F.col("path")))


def registry_actors(trace: DataFrame, name: str = "entity", own_pid: int = -2) -> DataFrame:
    """Registry activity of foreign processes with a key name."""
    return trace.filter((F.col("process_id") != -1) & (F.col("process_id") != own_pid) & (F.col(name) != ""))


def attribute_files(notifications: DataFrame, activity: DataFrame, keys: Sequence[str], order: Sequence[str],
                    columns: Sequence[str], time: str = "t_ms", back: int = LOOKBACK_MS, ahead: int = POLL_MS) -> DataFrame:
    """Newest file activity on the same path, at most ``back`` ms old or ``ahead`` ms late; struct ``io`` or null."""
    return as_of_within(notifications, activity, keys, time, time, order, columns, "io", back, ahead)


def attribution_fields(attributed: DataFrame) -> DataFrame:
    """Attribution columns of a file change from its ``io`` struct (status and reason as recorded with it)."""
    io = F.col("io")
    present = attributed.schema["io"].dataType.fieldNames()
    status = F.coalesce(io["status"], F.lit("Unattributed"))
    copied = {"process_id": "process_id", "process_sequence_number": "process_sequence_number", "username": "username",
              "user_sid": "user_sid", "t_ms": "attribution_source_ms"}
    return attributed.select(
        *[c for c in attributed.columns if c != "io"],
        status.alias("attribution_status"), F.lit("KernelETWProcessSequence").alias("attribution_method"),
        F.when(status == "Attributed", "High").otherwise("None").alias("attribution_confidence"),
        F.when(io.isNull(), "NoCorrelatedFileEvent").otherwise(io["missing_reason"]).alias("attribution_missing_reason"),
        io["process_name"].alias("process_name"),
        *[io[field].alias(name) for field, name in copied.items() if field in present and name not in attributed.columns])


def registry_attribution(status: Column) -> dict[str, Column]:
    """Attribution columns of a registry change from the outcome of the process lookup."""
    return {
        "attribution_method": F.lit("RegistryETWPostEventPid"),
        "attribution_confidence": F.when(status == "Attributed", "Low").otherwise("None"),
        "attribution_missing_reason": F.when(status == "Unavailable", "ProcessExitedOrAccessDenied"),
    }


def process_intervals(lifecycle: DataFrame) -> DataFrame:
    """(host, process_id, sequence) instances with start and end, from start, rundown and stop events."""
    started = F.col("opcode").isin("Start", "DCStart")
    named = lifecycle.filter(F.col("process_sequence_number").isNotNull())
    newest = F.when(started, F.struct("t_ms", "seq"))
    return named.groupBy("host", "process_id", "process_sequence_number").agg(
        F.min(F.when(started, F.col("t_ms"))).alias("start_ms"),
        F.max(F.when(F.col("opcode") == "Stop", F.col("t_ms"))).alias("end_ms"),
        F.max_by("process_name", newest).alias("process_name"),
        F.max_by("username", newest).alias("username"),
        F.max_by("user_sid", newest).alias("user_sid")).filter("start_ms IS NOT NULL")


def rundown_times(lifecycle: DataFrame) -> DataFrame:
    """Per host, when the first rundown event that carries a sequence was seen."""
    seen = (F.col("opcode") == "DCStart") & F.col("process_sequence_number").isNotNull()
    return lifecycle.groupBy("host").agg(F.min(F.when(seen, F.col("t_ms"))).alias("rundown_ms"))


def resolve_process(activity: DataFrame, instances: DataFrame, keys: Sequence[str], pid: str = "pid",
                    sequence: str = "seq", time: str = "t_ms", rundown: Column | None = None,
                    evidence: Sequence[str] = ()) -> DataFrame:
    """Attach the process instance alive at the time of the activity; a process id alone identifies nothing.

    ``instances`` is (keys, pid, sequence, start_ms, end_ms, process_name), one row per instance; ``evidence`` names
    further columns to take from it. Without an instance the reported ``process_name`` of the activity stays.
    """
    done = F.lit(True) if rundown is None else rundown
    known = instances.select(
        *keys, pid, sequence, F.col("start_ms").alias("__start"), F.col("end_ms").alias("__end"),
        F.col("process_name").alias("__name"), *[F.col(c).alias(f"__{c}") for c in evidence])
    joined = activity.join(known, [*keys, pid, sequence], "left")
    alive = F.coalesce((F.col("__start") <= F.col(time)) & (F.col("__end").isNull() | (F.col(time) < F.col("__end"))),
                       F.lit(False))
    missing = F.col(sequence).isNull()
    status = (F.when(missing & ~done, "RundownMissing").when(missing, "Unavailable")
              .when(alive, "Attributed").otherwise("Unavailable"))
    reason = (F.when(missing & ~done, "ProcessRundownMissing").when(missing, "ProcessSequenceNumberMissing")
              .when(~alive, "ProcessInstanceNotFound"))
    reported = F.col("process_name") if "process_name" in activity.columns else F.lit(None).cast("string")
    return joined.select(*activity.columns, F.when(alive, F.col("__name")).when(~missing, reported).alias("resolved_name"),
                         status.alias("status"), reason.alias("missing_reason"),
                         *[F.when(alive, F.col(f"__{c}")).alias(c) for c in evidence])


def resolve_handles(trace: DataFrame, clears: DataFrame | None = None, order: Sequence[str] = ("seq",),
                    widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """Path bound to the handle of each ``use`` row when it happened; null when unbound or unbound since.

    ``trace`` is (host, handle, op, path) with ``op`` create, delete or use. ``clears`` (host and the first order
    column) are loss events, after which no earlier binding of the host is trusted.
    """
    real = F.col("handle") != 0
    binding = F.when(real & (F.col("op") == "create") & (F.col("path") != ""), F.struct("path", F.col(order[0]).alias("at")))
    binding = F.coalesce(binding, F.when(real & (F.col("op") == "delete"), F.struct(
        F.lit(None).cast("string").alias("path"), F.col(order[0]).alias("at"))))
    bound = running(trace, ["host", "handle"], order, {"__bound": ("last", binding)}, widths).filter("op = 'use'")
    if clears is not None:
        bound = with_last_clear(bound, clears, order[0], widths)
    path, at = F.col("__bound.path"), F.col("__bound.at")
    if clears is not None:
        path = F.when(F.col("__cleared").isNull() | (at > F.col("__cleared")), path)
    return bound.select(*[c for c in trace.columns if c != "path"], F.when(real, path).alias("resolved_path"))


def with_last_clear(rows: DataFrame, clears: DataFrame, time: str, widths: Sequence[int] = DEFAULT_WIDTHS) -> DataFrame:
    """Add ``__cleared``: the newest clear of the host up to the time of each row, that time included.

    Clears and rows are put into one order per host, and the time of the last clear is carried along it; however many clears there are, a
    row compares with one.
    """
    side = rows.select("*", F.lit(1).alias("__side"), F.lit(None).cast("bigint").alias("__clear"))
    marks = clears.select("host", F.col(time), F.lit(0).alias("__side"), F.col(time).cast("bigint").alias("__clear"))
    both = side.unionByName(marks, allowMissingColumns=True)
    carried = running(both, ["host"], [time, "__side"], {"__cleared": ("max", F.col("__clear"))}, widths)
    return carried.filter("__side = 1").select(*rows.columns, "__cleared")


def resolve_accounts(rows: DataFrame, local: DataFrame, translated: DataFrame, sid: str = "sid") -> DataFrame:
    """Account name of a SID: the local session name, else the translated one, else the SID itself.

    ``local`` and ``translated`` are (sid, account).
    """
    joined = (rows.join(local.select(F.col("sid").alias(sid), F.col("account").alias("__local")), sid, "left")
              .join(translated.select(F.col("sid").alias(sid), F.col("account").alias("__translated")), sid, "left"))
    named = F.when(has_content(F.col("__local")), F.col("__local"))
    return joined.select(*rows.columns, F.coalesce(named, F.col("__translated"), F.col(sid)).alias("account"))


AUDIT_FIELDS = ("SubjectUserSid", "SubjectUserName", "ObjectName", "KeyName", "OldValue", "NewValue")


def parse_audit(records: DataFrame) -> DataFrame:
    """Fields of audit records, of repeated names the last; the XML stays as evidence."""
    data = F.from_xml(F.col("xml"), "Data array<struct<_Name:string,_VALUE:string>>, "
                      "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>")
    items = F.coalesce(F.col("__data.EventData.Data"), F.col("__data.Data"))

    def last_value(name: str) -> Column:
        matching = F.filter(items, lambda d: F.upper(d["_Name"]) == name.upper())
        return F.when(F.size(matching) > 0, F.coalesce(F.try_element_at(matching, F.lit(-1))["_VALUE"], F.lit("")))

    # Out of a generator, so that the text is parsed once however often the fields are used and filtered.
    wanted = records.filter(F.col("native_event_id").isin(*AUDIT_EVENT_IDS)).select("*", F.explode(F.array(data)).alias("__data"))
    scope_name = F.try_element_at(
        F.filter(items, lambda d: d["_Name"].isin("ObjectName", "KeyName")), F.lit(1))["_VALUE"]
    return wanted.select(
        *records.columns, last_value("SubjectUserSid").alias("subject_user_sid"),
        last_value("SubjectUserName").alias("subject_user_name"),
        F.coalesce(last_value("ObjectName"), last_value("KeyName")).alias("object_name"),
        last_value("OldValue").alias("old_value"), last_value("NewValue").alias("new_value"),
        scope_name.alias("scope_name"))
