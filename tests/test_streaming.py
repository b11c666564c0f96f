import json

import pytest
from pyspark.sql import functions as F
from test_operators import NOTE, random_notes, rows

from fleetseal import schemas
from fleetseal.operators import bursts, projection
from fleetseal.operators.attribution import resolve_handles
from fleetseal.plans import jobs
from fleetseal.sources import tables
from fleetseal.sources.state import StateStore
from fleetseal.streaming import bindings, delivery, pipelines
from fleetseal.streaming.bursts import collapse_stream

CHANGES = ("host string, id string, seq bigint, t_ms bigint, entity string, full_path string, change_category string, old_path string, new_path string, "
           "current_hash string, current_size_bytes bigint, acls string, object_type string")


def drain(stream, path, name):
    """Run an append stream over what there is and return its rows as a table."""
    out, checkpoint = f"{path}/{name}-out", f"{path}/{name}-checkpoint"
    query = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out)
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def as_stream(df, path, name, files=3, **options):
    folder = f"{path}/{name}"
    df.repartition(files).write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).options(maxFilesPerTrigger=1, **options).parquet(folder)


@pytest.mark.parametrize("chain", [False, True])
def test_collapse_on_a_batch_equals_the_window_operator(spark, chain):
    df = spark.createDataFrame(random_notes(5), NOTE)
    expected = bursts.collapse(df.withColumn("win", bursts.fixed_window(F.col("captured_ms"))), ["host", "win"], keep_rename_chain=chain)
    assert rows(collapse_stream(df, keep_rename_chain=chain), "seq") == rows(expected, "seq")


def test_collapse_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(random_notes(6, windows=20), NOTE)
    # A last row far ahead moves the watermark past every window.
    tail = spark.createDataFrame([("h", 999, 10**6, 10**6, "Created", "z", None)], NOTE)
    folder = f"{tmp_path}/notes"
    df.repartition(2).write.parquet(folder)
    spark.createDataFrame([], NOTE).write.mode("append").parquet(folder)
    tail.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    got = drain(collapse_stream(stream, "100 seconds"), tmp_path, "collapse")
    expected = bursts.collapse(df.withColumn("win", bursts.fixed_window(F.col("captured_ms"))), ["host", "win"])
    assert rows(got, "seq") == rows(expected, "seq")


def change_rows(spark, *items):
    return spark.createDataFrame([("h", i, n, t, e, e, c, o, e if o else None, f"hash-{i}", n, f"acl-{i}", "File")
                                  for n, (i, t, e, c, o) in enumerate(items)], CHANGES)


def test_projection_and_outbox_commit_together_and_replay_changes_nothing(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    first = change_rows(spark, ("R1", 1, "C:\\a", "Created", None), ("R2", 2, "c:\\A", "Changed", None), ("R3", 3, "C:\\x", "Discovery", None))
    second = change_rows(spark, ("R4", 4, "C:\\b", "Changed", "C:\\A"), ("R5", 5, "C:\\x", "Deleted", None))
    pipelines.write_file_changes(store, first, 0)
    pipelines.write_file_changes(store, second, 1)
    expected_state = [("C:\\B", "R4", "hash-R2"), ("C:\\X", "R5", "hash-R3")]
    assert rows(pipelines.read_projection(store), "normalized_entity", "id", "previous_hash") == expected_state
    expected_ids = [("R1",), ("R2",), ("R4",), ("R5",)]
    assert rows(pipelines.current_outbox(store), "id") == expected_ids
    pipelines.write_file_changes(store, second, 1)
    pipelines.compact_projection(store)
    pipelines.compact_outbox(store, 10)
    assert store.read("outbox").count() == 4
    assert rows(pipelines.read_projection(store), "normalized_entity", "id", "previous_hash") == expected_state
    assert rows(pipelines.current_outbox(store), "id") == expected_ids


def test_projection_stream_matches_batch(spark, tmp_path):
    items = [(f"R{i}", i, f"C:\\f{i % 4}", "Changed", None) for i in range(24)]
    df = change_rows(spark, *items)
    folder = f"{tmp_path}/changes"
    for part in range(3):
        df.filter(F.floor(F.col("t_ms") / 8) == part).coalesce(1).write.mode("append").parquet(folder)
    store = StateStore(spark, f"{tmp_path}/state")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    failures = []
    pipelines.start_projection(stream, store, f"{tmp_path}/cp", on_failure=lambda r, a: failures.append(r)).awaitTermination()
    assert failures == []
    assert rows(pipelines.read_projection(store), "normalized_entity", "id") == rows(projection.latest_state(df), "normalized_entity", "id")
    assert pipelines.current_outbox(store).count() == 24


def test_registry_batch_sees_the_state_before_it(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    schema = "host string, id string, seq bigint, t_ms bigint, entity string, change_category string, acls string"
    batch = lambda *r: spark.createDataFrame([("h", *x) for x in r], schema)
    pipelines.write_registry_changes(store, batch(("G1", 1, 1, "K", "Created", "a1"), ("G2", 2, 2, "k", "Changed", "a2")), 0)
    pipelines.write_registry_changes(store, batch(("G3", 3, 3, "K", "Changed", "a3"), ("G4", 4, 4, "K", "Changed", "a4")), 1)
    got = pipelines.current_outbox(store).select("id", F.col("fields")["previousAcl"].alias("p"))
    assert rows(got) == [("G1", ""), ("G2", ""), ("G3", "a2"), ("G4", "a2")]


def test_failed_writes_are_reported_and_the_batch_stays(spark):
    seen, calls = [], []

    def write():
        calls.append(1)
        raise OSError("disk")
    with pytest.raises(OSError):
        pipelines.with_retries(write, lambda reason, attempt: seen.append((reason, attempt)))
    assert seen == [("OSError", 1), ("OSError", 2), ("OSError", 3)] and len(calls) == 3


def test_live_bindings_match_batch_handles(spark, tmp_path):
    data = [("h", 1, "create", "K1"), ("h", 2, "use", None), ("h", 3, "delete", None), ("h", 4, "use", None), ("h", 5, "create", "K2"), ("h", 7, "use", None)]
    df = spark.createDataFrame([(h, s, 5, o, p) for h, s, o, p in data], "host string, seq bigint, handle bigint, op string, path string")
    ops = df.select("host", "handle", "seq", F.col("seq").alias("t_ms"),
                    F.when(F.col("op") == "create", "bind").when(F.col("op") == "delete", "unbind").otherwise("use").alias("op"), F.col("path").alias("value"))
    folder = f"{tmp_path}/ops"
    ops.filter("seq <= 3").coalesce(1).write.parquet(folder)
    ops.filter("seq > 3").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    got = drain(bindings.latest_binding(stream, ["host", "handle"]), tmp_path, "bind")
    assert rows(got, "seq", "found") == rows(resolve_handles(df, widths=(2,)), "seq", "resolved_path")


def test_activity_expires_after_its_lifetime(spark, tmp_path):
    ops = spark.createDataFrame([("p", 1, 0, "bind", "x.exe"), ("p", 2, 9_000, "use", None), ("p", 3, 10_001, "use", None)],
                                "path string, seq bigint, t_ms bigint, op string, value string")
    got = drain(bindings.latest_binding(as_stream(ops, tmp_path, "ops", 1), ["path"], 10_000), tmp_path, "ttl")
    assert rows(got, "seq", "found") == [(2, "x.exe"), (3, None)]


def test_consumer_dedupe_and_heartbeats(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "record_id string, t bigint").withColumn("occurred_at", F.timestamp_seconds("t"))
    got = drain(delivery.dedupe_records(as_stream(df, tmp_path, "records", 2)), tmp_path, "dedupe")
    assert rows(got, "record_id") == [("a",), ("b",)]
    log = spark.createDataFrame([("h", 1000, "accepted"), ("h", 2000, "dropped"), ("h", 61_000, "processed")], "host string, t_ms bigint, kind string")
    beats = delivery.heartbeat_stream(log)
    assert rows(beats, "t_ms", "accepted", "processed", "dropped") == [(120_000, 0, 1, 0), (60_000, 1, 0, 1)]
    tail = log.unionByName(spark.createDataFrame([("h", 10**7, "accepted")], log.schema))
    live = drain(delivery.heartbeat_stream(as_stream(tail, tmp_path, "log", 1)), tmp_path, "beats")
    assert rows(live, "t_ms", "accepted", "processed", "dropped") == rows(beats, "t_ms", "accepted", "processed", "dropped")
    notes = log.select("host", F.col("t_ms").alias("captured_ms"))
    assert rows(delivery.gap_stream(notes, 1, "60 seconds"), "t_ms", "lost_count") == [(0, 1)]


def test_sources_read_with_their_schema(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"host": "h", "seq": 1, "captured_ms": 5, "full_path": "p", "category": "Created", "extra": 1}))
    got = drain(tables.read_notifications(spark, str(folder)), tmp_path, "notes")
    assert rows(got, "host", "seq", "full_path", "old_path") == [("h", 1, "p", None)]
    trace = spark.createDataFrame([("h", 1, 22, "K"), ("h", 2, 14, "K"), ("h", 3, 23, None)], "host string, seq bigint, opcode int, key_name string")
    assert [r.op for r in tables.handle_operations(trace).orderBy("seq").collect()] == ["create", "use", "delete"]
    assert len(spark.createDataFrame([], schemas.MEMBERS).columns) == 17


def test_commits_are_atomic(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/s")
    df = spark.range(3)
    store.commit(append={"a": df, "b": df})
    with pytest.raises(Exception):
        store.commit(append={"a": df, "b": df.select(F.raise_error(F.lit("no")).alias("id"))})
    assert (store.read("a").count(), store.read("b").count()) == (3, 3)
    store.commit(append={"a": df}, replace={"b": df.limit(1)}, batch_id=7, writer="w")
    assert store.commit(append={"a": df}, batch_id=7, writer="w") == -1
    assert (store.read("a").count(), store.read("b").count()) == (6, 1)
    store.commit(keep={"a": store.segments("a")[1:]})
    assert store.read("a").count() == 3
    with pytest.raises(LookupError):
        store.read("missing")


def test_live_processes_and_file_activity(spark, tmp_path):
    data = [("h", "Process", "Start", 4, 100, 1, 0, "first.exe", None), ("h", "FileIO", "Write", 4, 100, 2, 5, "", "C:/a"), ("h", "Process", "Stop", 4, 100, 3, 6, "", None),
            ("h", "FileIO", "Write", 4, 100, 4, 7, "", "C:/a"), ("h", "FileIO", "Write", 4, 99, 5, 8, "", "C:/a"), ("h", "FileIO", "Write", 4, None, 6, 9, "", "C:/a")]
    trace = spark.createDataFrame(data, "host string, task string, opcode string, process_id int, process_sequence_number bigint, seq bigint, t_ms bigint, process_name string, path string")
    got = drain(bindings.process_uses(as_stream(trace, tmp_path, "trace", 1)), tmp_path, "procs")
    assert rows(got, "seq", "found") == [(2, "first.exe"), (4, None), (5, None)]
    seen = spark.createDataFrame([("h", "c:/A", 7, 3), ("h", "C:/z", 8, 3)], "host string, full_path string, seq bigint, t_ms bigint")
    io = trace.filter("seq = 2").withColumns({"process_name": F.lit("x"), "t_ms": F.lit(1).cast("bigint")})
    both = drain(bindings.file_uses(as_stream(io, tmp_path, "io", 1), as_stream(seen, tmp_path, "seen", 1)), tmp_path, "uses")
    assert rows(both, "seq", "found") == [(7, "x"), (8, None)]
    handles = spark.createDataFrame([("h", 0, 1, 1, "create", "Z"), ("h", 0, 2, 2, "use", None), ("h", 5, 3, 3, "create", "K"), ("h", 5, 4, 4, "use", None)],
                                    "host string, handle bigint, seq bigint, t_ms bigint, op string, path string")
    assert rows(drain(bindings.handle_uses(as_stream(handles, tmp_path, "handles", 1)), tmp_path, "keys"), "seq", "found") == [(4, "K")]


def test_live_file_pipeline_from_raw_notifications(spark, tmp_path):
    raw = spark.createDataFrame(
        [("h", 1, 10, "s", "C:/a", "Created", None, None), ("h", 2, 20, "s", "c:/A", "Changed", None, None), ("h", 3, 500, "s", "C:/b", "Changed", "C:/a", "C:/b"),
         ("h", 4, 10**7, "s", "C:/z", "Created", None, None)],
        "host string, seq bigint, captured_ms bigint, scope string, full_path string, category string, old_path string, new_path string")
    activity = spark.createDataFrame([("h", 1, 5, "C:/A", "Attributed", None, "x.exe")],
                                     "host string, seq bigint, t_ms bigint, path string, status string, missing_reason string, process_name string")
    facts = spark.createDataFrame([("h", 1, "H", 5, "acl", "File")], "host string, seq bigint, current_hash string, current_size_bytes bigint, acls string, object_type string")
    store = StateStore(spark, f"{tmp_path}/state")
    write = jobs.run_on_batches(lambda batch: jobs.live_file_changes(batch, activity, facts, collapsed=True))
    stream = collapse_stream(as_stream(raw, tmp_path, "raw", 1), "1 second")
    pipelines.start_projection(stream, store, f"{tmp_path}/cp", write).awaitTermination()
    # The Changed after the Created is folded; the last window stays open.
    assert rows(pipelines.current_outbox(store).select("event_id", F.col("fields")["operation"].alias("o"), F.col("fields")["processName"].alias("p"))) == [
        (7776, "Created", "x.exe"), (7777, "RenamedOrMoved", None)]
    # Both changes came in one batch, so the rename finds no stored evidence yet, but it removes the old path.
    assert rows(pipelines.read_projection(store), "normalized_entity", "previous_hash") == [("C:/B", "")]


def test_failed_tries_become_sink_failures(spark, tmp_path):
    store, left = StateStore(spark, f"{tmp_path}/state"), [1, 2]

    def write():
        if left:
            left.pop()
            raise OSError("full")
    pipelines.with_retries(write, pipelines.failure_log(store, "files", "h"))
    got = pipelines.current_outbox(store).select("host", "event_id", "error", F.col("fields")["reason"], F.col("fields")["attempt"])
    assert rows(got) == [("h", 7793, True, "OSError", "1"), ("h", 7793, True, "OSError", "2")]
