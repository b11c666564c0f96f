"""Windows opened by the first arrival, and live state in event-time order, against plain loops and batch operators."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import rows

from fleetseal.operators import attribution, bursts
from fleetseal.operators.windows import first_arrival_windows
from fleetseal.streaming import ordered

NOTE = "host string, seq bigint, captured_ms bigint, category string, full_path string, old_path string"


def feed(batches, schema, path, name, spark):
    """A stream that gets one batch of rows at a time."""
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}")


def run(stream, path, name="out"):
    """Drain a stream; give its rows and the number of rows that its state held after every micro-batch."""
    query = (stream.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-cp")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/{name}"), held


def chained(times, width=75):
    start, out = None, {}
    for i, t in sorted(times, key=lambda x: (x[1], x[0])):
        if start is None or t >= start + width:
            start = t
        out[i] = start
    return out


def arrivals(seed, host, n=300, gaps=(1, 3, 10, 40, 74, 75, 76, 200, 2000)):
    rng, t, out = random.Random(seed), -700 + 13 * seed, []
    for i in range(n):
        t += rng.choice(gaps)
        out.append((host, i, t))
    return out


@pytest.mark.parametrize("chunk, together", [(80, 3), (500, 4), (60_000, 1000)])
def test_first_arrival_windows_against_a_loop(spark, chunk, together):
    hosts = {"a": arrivals(1, "a"), "dense": arrivals(2, "dense", gaps=(1, 5, 9)), None: arrivals(3, None), "twins": [("twins", i, i // 5 * 30) for i in range(60)]}
    given = [r for part in hosts.values() for r in part] + [("a", 9999, None)]
    random.Random(0).shuffle(given)
    df = spark.createDataFrame(given, "host string, seq bigint, t_ms bigint").withColumn("window_ms", F.lit("clash"))
    expected = {(h, i): s for h, part in hosts.items() for i, s in chained([(i, t) for _, i, t in part]).items()} | {("a", 9999): None}
    got = first_arrival_windows(df, ["host"], chunk_ms=chunk, together=together)
    assert got.columns == ["host", "seq", "t_ms", "window_ms"]
    assert {(r.host, r.seq): r.window_ms for r in got.collect()} == expected and got.count() == len(given)


def test_first_arrival_windows_cross_the_grid(spark):
    # The grid would part 70 and 80; the window that 70 opens holds both, and 145 opens the next.
    df = spark.createDataFrame([("h", 1, 70), ("h", 2, 80), ("h", 3, 144), ("h", 4, 145)], "host string, seq bigint, t_ms bigint")
    assert rows(first_arrival_windows(df, ["host"]), "seq", "window_ms") == [(1, 70), (2, 70), (3, 70), (4, 145)]
    assert first_arrival_windows(df.filter("false"), ["host"]).count() == 0
    with pytest.raises(ValueError):
        first_arrival_windows(df, ["host"], chunk_ms=10)


def test_window_stream_over_batches_out_of_order(spark, tmp_path):
    notes = [(h, i, t + 10_000, "Changed", f"p{i % 3}", None) for h in ("a", "b") for _, i, t in arrivals(4 if h == "a" else 5, h, 120)]
    rng = random.Random(1)
    shuffled = sorted(notes, key=lambda r: r[2] + rng.randrange(3000))
    batches = [shuffled[k * 40:(k + 1) * 40] for k in range(6)] + [[("", -1, 10**9, "Changed", "", None)]]
    stream = feed(batches, NOTE, tmp_path, "notes", spark)
    with ordered.rocksdb(spark):
        got, held = run(ordered.window_stream(stream, "4 seconds"), tmp_path)
    out = got.filter("host <> ''").collect()
    expected = {(h, i): s for h in ("a", "b") for i, s in chained([(r[1], r[2]) for r in notes if r[0] == h]).items()}
    assert {(r.host, r.seq): r.window_ms for r in out} == expected and len(out) == len(notes) and not any(r.late for r in out)
    assert len(held) > 5 and held[-1] <= 4  # only the closing row is left


def test_late_rows_are_counted_not_dropped(spark, tmp_path):
    batches = [[("h", 1, 1000, "Changed", "p", None), ("h", 2, 50_000, "Changed", "p", None)], [("h", 3, 60_000, "Changed", "p", None)],
               [("h", 4, 2000, "Created", "q", None), ("h", 5, 90_000, "Changed", "p", None), ("h", 6, None, "Changed", "p", None)], [("", 7, 10**9, "Changed", "", None)]]
    with ordered.rocksdb(spark):
        got, _ = run(ordered.window_stream(feed(batches, NOTE, tmp_path, "notes", spark), "1 second"), tmp_path)
    found = {r.seq: (r.window_ms, r.late) for r in got.filter("host <> ''").collect()}
    assert found == {1: (1000, False), 2: (50_000, False), 3: (60_000, False), 4: (None, True), 5: (90_000, False), 6: (None, True)}


def test_windows_collapse_whole_batch_by_batch(spark, tmp_path):
    rng = random.Random(9)
    notes = [("h", i, 1000 + i * 20, rng.choice(["Created", "Changed", "Changed", "Deleted"]), f"c:\\{rng.randrange(3)}", None) for i in range(90)]
    batches = [notes[k * 15:(k + 1) * 15] for k in range(6)] + [[("", -1, 10**9, "Changed", "", None)]]
    kept = []

    def collapse(batch, _):
        kept.extend(tuple(r) for r in bursts.collapse(batch.filter("NOT late"), ["host", "window_ms"]).select("host", "seq").collect())
    stream = feed(batches, NOTE, tmp_path, "notes", spark)
    with ordered.rocksdb(spark):
        (ordered.window_stream(stream, "100 milliseconds").writeStream.foreachBatch(collapse).option("checkpointLocation", f"{tmp_path}/cp")
         .trigger(availableNow=True).start().awaitTermination())
    df = spark.createDataFrame(notes, NOTE)
    expected = bursts.collapse(first_arrival_windows(df, ["host"], "captured_ms"), ["host", "window_ms"])
    assert sorted(kept) == sorted(rows(expected, "host", "seq"))


def test_live_attribution_equals_the_batch_join(spark, tmp_path):
    rng = random.Random(3)
    io = [(rng.choice("xyz"), i, rng.randrange(60_000), f"p{i}", None if i % 5 else "why") for i in range(150)]
    asks = [(rng.choice("xyz"), 1000 + i, rng.randrange(60_000)) for i in range(120)]
    io_schema, ask_schema = "path string, io_id bigint, t_ms bigint, process_name string, missing_reason string", "path string, id bigint, t_ms bigint"
    left, right = spark.createDataFrame(asks, ask_schema), spark.createDataFrame(io, io_schema)
    expected = attribution.attribute_files(left, right, ["path"], ["t_ms", "io_id"], ["process_name", "missing_reason"])
    expected = {r.id: (r.io.io_id, r.io.process_name, r.io.missing_reason) if r.io else None for r in expected.collect()}
    slot = lambda r: min((r[2] + rng.randrange(4000)) // 10_000, 6)
    far = ("", -1, 10**9)
    spot = {r: slot(r) for r in io}
    io_batches = [[r for r in io if spot[r] == k] + [("q", -9, k * 10_000, "", None)] for k in range(7)] + [[(*far, "", None)]]
    ask_spot = {r: slot(r) for r in asks}
    ask_batches = [[r for r in asks if ask_spot[r] == k] + [("q", -9 - k, k * 10_000)] for k in range(7)] + [[far]]
    live = ordered.attribution_stream(feed(ask_batches, ask_schema, tmp_path, "asks", spark), feed(io_batches, io_schema, tmp_path, "io", spark),
                                      ["path"], ["io_id", "process_name", "missing_reason"], "io_id", "5 seconds")
    with ordered.rocksdb(spark):
        got, held = run(live, tmp_path)
    out = [r for r in got.collect() if r.id >= 0]
    assert not any(r.late for r in out) and len(out) == len(asks)
    assert {r.id: (r.io.io_id, r.io.process_name, r.io.missing_reason) if r.io else None for r in out} == expected
    assert max(held) > 6 >= held[-1]  # all evidence expired but that of the closing rows


def test_late_notifications_are_answered_and_say_so(spark, tmp_path):
    ask = feed([[("x", 1, 1000)], [("y", 2, 100_000)], [("x", 3, 95_000), ("x", 4, 40_000)], [("", -1, 10**9)]], "path string, id bigint, t_ms bigint", tmp_path, "asks", spark)
    io = feed([[("x", 7, 1040, "p")], [("x", 8, 92_000, "q")], [("x", 9, 1050, "old")], [("", -1, 10**9, "")]], "path string, io_id bigint, t_ms bigint, process_name string", tmp_path, "io", spark)
    with ordered.rocksdb(spark):
        got, _ = run(ordered.attribution_stream(ask, io, ["path"], ["io_id", "process_name"], "io_id", "1 second"), tmp_path)
    found = {r.id: (r.io.process_name if r.io else None, r.late) for r in got.filter("id > 0").collect()}
    # 1 waits for activity 40 ms later; 4 comes behind the watermark (of the slower stream) and is too old for what is known by then.
    assert found == {1: ("p", False), 2: (None, False), 3: ("q", False), 4: (None, True)}


TRACE = "host string, seq bigint, t_ms bigint, task string, opcode string, process_id int, process_sequence_number bigint, process_name string"


def test_live_processes(spark, tmp_path):
    use = lambda seq, t, pid, n: ("h", seq, t, "FileIO", "Write", pid, n, "reported")
    life = lambda seq, t, op, pid, n, name: ("h", seq, t, "Process", op, pid, n, name)
    batches = [
        [use(1, 1000, 5, None), life(2, 1500, "Start", 321, 100, "first.exe"), use(3, 2000, 5, None)],
        [life(4, 2500, "DCStart", 321, 101, "second.exe"), use(5, 2600, 321, 100), use(6, 2700, 321, 99), use(7, 2800, 999, None)],
        [life(8, 3000, "Stop", 321, 100, None), use(10, 3100, 321, 101), use(9, 3050, 321, 100)],
        [life(11, 50_000, "Start", 1, 1, "x.exe")], [life(12, 1200, "Start", 7, 1, "late.exe"), use(13, 51_000, 7, 1), use(14, 1300, 7, 1)],
        [("", -1, 10**9, "x", "x", 0, None, None)]]
    stream = feed(batches, TRACE, tmp_path, "trace", spark)
    with ordered.rocksdb(spark):
        got, _ = run(ordered.process_stream(stream, "500 milliseconds", buckets=3), tmp_path)
    found = {r.seq: (r.process_name, r.status, r.missing_reason, r.late) for r in got.collect()}
    assert found == {
        1: (None, "RundownMissing", "ProcessRundownMissing", False), 3: (None, "RundownMissing", "ProcessRundownMissing", False),
        5: ("first.exe", "Attributed", None, False), 6: (None, "Unavailable", "ProcessInstanceNotFound", False),
        7: (None, "Unavailable", "ProcessSequenceNumberMissing", False), 9: (None, "Unavailable", "ProcessInstanceNotFound", False),
        10: ("second.exe", "Attributed", None, False), 12: (None, "LateLifecycle", None, True), 13: ("late.exe", "Attributed", None, False),
        14: ("late.exe", "Attributed", None, True)}


def test_live_handles_equal_batch(spark, tmp_path):
    rng = random.Random(8)
    trace = [(rng.choice("ab"), rng.randrange(6), n, n + 60, rng.choice(["create", "create", "delete", "use", "use", "use"]), rng.choice(["", f"K{n}"])) for n in range(240)]
    lost = [("a", 120), ("b", 121), ("a", 190), ("a", 260)]
    schema, clear_schema = "host string, handle int, seq bigint, t_ms bigint, op string, path string", "host string, t_ms bigint"
    batch = attribution.resolve_handles(spark.createDataFrame(trace, schema), spark.createDataFrame(lost, clear_schema), order=("t_ms",), widths=(32, 256))
    expected = {r.seq: r.resolved_path for r in batch.collect()}
    cut = lambda rows_, at: [[r for r in rows_ if r[at] // 60 == k] for k in range(1, 5)]
    parts = cut(trace, 3)
    for part in parts:
        rng.shuffle(part)
    stream = feed([*parts, [("", 0, -1, 10**9, "use", None)]], schema, tmp_path, "trace", spark)
    clears = feed([*[c + [("z", 60 * k)] for k, c in enumerate(cut(lost, 1), 1)], [("", 10**9)]], clear_schema, tmp_path, "clears", spark)
    with ordered.rocksdb(spark):
        got, _ = run(ordered.handle_stream(stream, clears, "70 milliseconds", buckets=2), tmp_path)
    out = got.filter("host IN ('a', 'b')").collect()
    assert {r.seq: r.resolved_path for r in out} == expected and len(out) == len(expected) and not any(r.late for r in out)
    assert any(v for v in expected.values()) and None in expected.values()
