"""Tables written batch by batch: replays, folds, pruned buckets, and a change stream with failures."""

import shutil

import pytest
from pyspark.sql import functions as F
from test_operators import rows
from test_streaming import CHANGES, change_rows

from fleetseal.functions.events import EVENT_CATALOG
from fleetseal.operators import projection
from fleetseal.sources.buckets import BatchTable
from fleetseal.streaming import changes, delivery

SCHEMA = "host string, k bigint, v bigint"


def newest(rows_):
    return rows_.groupBy("host", "k").agg(F.max_by("v", "batch_id").alias("v"), F.max("batch_id").alias("batch_id"))


@pytest.fixture
def table(spark, tmp_path):
    return BatchTable(spark, f"{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["host", "k"], newest, buckets=8, fold_every=4)


def put(spark, table, batch, *items):
    table.write(batch, spark.createDataFrame([("h", k, v) for k, v in items], SCHEMA))


def test_a_batch_sees_only_earlier_ones_and_a_replay_changes_nothing(spark, table):
    assert table.current().count() == 0 and table.before(0).count() == 0
    put(spark, table, 0, (1, 10), (2, 20))
    put(spark, table, 1, (1, 11))
    assert rows(newest(table.before(1)), "k", "v") == [(1, 10), (2, 20)]
    for _ in range(2):  # the second try of a batch replaces what the first one wrote
        put(spark, table, 1, (1, 12), (3, 30))
    assert rows(table.current(), "k", "v") == [(1, 12), (2, 20), (3, 30)]
    assert rows(table.current(0), "k", "v") == [(1, 10), (2, 20)]
    assert rows(newest(table.before(1)), "k", "v") == [(1, 10), (2, 20)]


def test_what_a_batch_reads_does_not_grow(spark, table):
    sizes, expected = [], {}
    for b in range(14):
        put(spark, table, b, (b % 3, b), (100 + b % 2, b))
        expected |= {b % 3: b, 100 + b % 2: b}
        before = table.before(b + 1)
        sizes.append(len(before.inputFiles()))
        assert dict(rows(newest(before), "k", "v")) == expected
    # From the first fold on: one fold and three batches at most.
    assert max(sizes[4:]) <= 5 + 3 * 2 and sizes[3] <= 5 and sizes[7] <= 5 and sizes[11] <= 5


def test_only_touched_buckets_are_read(spark, table):
    put(spark, table, 0, *[(k, k) for k in range(200)])
    whole = table.before(1)
    one = table.before(1, spark.createDataFrame([("h", 7)], "host string, k bigint"))
    assert len(whole.inputFiles()) == 8
    text = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "bucket" in text.split("PartitionFilters")[1].split("]")[0]
    assert 0 < one.count() < 60 and (7, 7) in rows(one, "k", "v")


def test_an_empty_batch_is_a_batch(spark, table):
    put(spark, table, 0, (1, 1))
    table.write(1, spark.createDataFrame([], SCHEMA))
    put(spark, table, 2, (2, 2))
    assert rows(table.current(), "k", "v") == [(1, 1), (2, 2)]


def feed(spark, path, parts):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_change_stream_matches_batch_and_knows_what_was(spark, tmp_path):
    items = [(f"R{i}", i, f"C:\\f{i % 4}", "Changed", "C:\\f9" if i == 13 else None) for i in range(24)] + [("R3", 3, "C:\\f3", "Changed", None)]
    df = change_rows(spark, *items)
    stream = feed(spark, f"{tmp_path}/in", [df.filter(F.floor(F.col("t_ms") / 4) == p) for p in range(6)])
    tables = changes.ChangeTables(spark, f"{tmp_path}/state", df.schema, buckets=4, fold_every=2)
    changes.start(stream, tables, f"{tmp_path}/cp").awaitTermination()
    assert rows(tables.projection.current(), "normalized_entity", "id") == rows(projection.latest_state(df), "normalized_entity", "id")
    sent = tables.outbox.current().select("id", F.col("fields")["previousHash"].alias("p")).collect()
    assert len(sent) == 24 and tables.failures().count() == 0
    assert {r.id: r.p for r in sent if r.id in ("R0", "R4", "R23")} == {"R0": "", "R4": "hash-R0", "R23": "hash-R19"}


def test_failed_tries_are_recorded_and_leave_no_trace(spark, tmp_path):
    df = change_rows(spark, *[(f"R{i}", i, f"C:\\f{i % 3}", "Changed", None) for i in range(12)])
    parts = [df.filter(F.floor(F.col("t_ms") / 4) == p) for p in range(3)]
    seen, state = [], {}
    for name, failing in (("plain", {}), ("failing", {1: 2, 2: 9})):
        tries = []

        def fail(batch, tries=tries, failing=failing):
            tries.append(batch)
            if tries.count(batch) <= failing.get(batch, 0):
                raise OSError("no")
        stream = feed(spark, f"{tmp_path}/{name}-in", parts)
        tables = changes.ChangeTables(spark, f"{tmp_path}/{name}", df.schema, buckets=4, fold_every=2)
        for _ in range(5):  # a query that ended with its batch is started again
            try:
                changes.start(stream, tables, f"{tmp_path}/{name}-cp", [fail]).awaitTermination()
                break
            except Exception as error:  # noqa: BLE001
                assert "no" in str(error)
        columns = [c for c in tables.outbox.current().columns if c != "batch_id"]
        state[name] = (rows(tables.projection.current()), rows(tables.outbox.current(), *columns))
        seen.append(sorted((r.batch_id, r.reason, r.attempt) for r in tables.failures().collect()))
    assert state["plain"] == state["failing"] and len(state["plain"][1]) == 12
    assert seen[0] == [] and seen[1] == sorted([(1, "OSError", 1), (1, "OSError", 2)] + [(2, "OSError", a) for a in (1, 2, 3)] * 3)


def test_schema_is_that_of_the_stream(spark, tmp_path):
    tables = changes.ChangeTables(spark, f"{tmp_path}/x", spark.createDataFrame([], CHANGES).schema)
    assert {"host", "normalized_entity", "present", "batch_id"} <= set(tables.projection.schema.names)


OUTBOX = ("host string, id string, schema_version int, event_id int, record_type string, occurred_ms bigint, scope_hash string, fields map<string,string>, "
          "error boolean, created_ms bigint, next_attempt_ms bigint, delivered_ms bigint, delivery_attempts int, last_error string, revision bigint")


def test_delivery_drains_in_rounds_and_a_round_can_be_done_again(spark, tmp_path):
    row = lambda i, kind="FileSystemChange": ("h", f"R{i}", 1, 7776, kind, i, "s", {"k": "v"}, False, i, 0, None, 0, None, 0)
    due = spark.createDataFrame([row(i, EVENT_CATALOG[7776]) for i in range(7)] + [row(7, "Heartbeat")], OUTBOX)
    table = delivery.outbox_table(spark, f"{tmp_path}/outbox", due.schema, buckets=4, fold_every=2)
    table.write(0, due)
    assert delivery.deliver_rounds(table, f"{tmp_path}/sink", 1000, limit=3) == 3
    assert delivery.deliver_rounds(table, f"{tmp_path}/sink", 1000) == 0
    state = rows(table.current(), "id", "delivered_ms", "delivery_attempts", "last_error")
    assert state == [(f"R{i}", 1000, 1, None) for i in range(7)] + [("R7", None, 1, "NotAllocated")]
    # The last round failed after its sink: it is done again under its number, and the sink holds every record once.
    before = sorted(r.record_id for r in spark.read.json(f"{tmp_path}/sink").collect())
    shutil.rmtree(f"{tmp_path}/outbox/batches/batch=3")
    assert delivery.deliver_rounds(table, f"{tmp_path}/sink", 1000, limit=3) == 1
    assert sorted(r.record_id for r in spark.read.json(f"{tmp_path}/sink").collect()) == before == [f"R{i}" for i in range(7)]
    assert rows(table.current(), "id", "delivered_ms", "delivery_attempts", "last_error") == state
