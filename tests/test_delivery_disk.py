"""What delivery in rounds leaves on disk and moves: packed sink files, no staged copies, only a few columns of records whose turn it is not."""

import re
from pathlib import Path

from test_batch_tables import OUTBOX, rows

from fleetseal.functions.events import EVENT_CATALOG
from fleetseal.streaming import delivery


def row(i, host="h", created=0, kind=EVENT_CATALOG[7776], fields=None):
    return (host, i and f"R{i:03}", 1, 7776, kind, 5, "s", fields or {"k": "v", "none": None}, False, created, 0, None, 0, None, 0)


def drained(spark, tmp_path, monkeypatch, items, limit):
    monkeypatch.setattr("fleetseal.session.checkpoint_dir", lambda _: f"{tmp_path}/kept")
    plans, plain = [], delivery.staged

    def staged(df, what):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, what)
    monkeypatch.setattr(delivery, "staged", staged)
    due = spark.createDataFrame(items, OUTBOX)
    table = delivery.outbox_table(spark, f"{tmp_path}/outbox", due.schema, buckets=4, fold_every=3)
    table.write(0, due)
    rounds = delivery.deliver_rounds(table, f"{tmp_path}/sink", 1000, limit=limit)
    return rounds, table, plans


def test_rounds_leave_packed_records_and_nothing_staged(spark, tmp_path, monkeypatch):
    items = [row(i, "ab"[i % 2], i * 1000) for i in range(1, 41)]
    rounds, table, plans = drained(spark, tmp_path, monkeypatch, items, 8)
    assert rounds == 3 and table.current().filter("delivered_ms = 1000").count() == 40
    assert sorted(r.record_id for r in spark.read.json(f"{tmp_path}/sink").collect()) == [f"R{i:03}" for i in range(1, 41)]
    files = [p for p in Path(f"{tmp_path}/sink").rglob("part-*")]
    assert files and all(p.name.endswith(".json.gz") for p in files)
    assert [p for p in Path(f"{tmp_path}/kept").glob("*")] == []
    # Every second plan finds whose turn it is, the last one that nobody's is.
    read = [" ".join(re.findall(r"FileScan parquet \[([^\]]*)\]", p)) for p in plans]
    assert len(read) == 7 and all("record_type" in r and "fields" in r for r in read[1::2])
    assert all(r and not re.search("fields|record_type|scope_hash", r) for r in read[::2])


def test_odd_records_are_delivered_once(spark, tmp_path, monkeypatch):
    items = [row(1), row(1), row(2, None), row(2, None), row(None), row(3, "h", None), row(4, "h", 10**15), row(5, "g", 7, "Heartbeat"), row(6, "g", 8, " \t")]
    rounds, table, _ = drained(spark, tmp_path, monkeypatch, items, 2)
    assert rounds == 2
    state = rows(table.current().fillna("-", ["host", "id"]), "host", "id", "delivered_ms", "delivery_attempts", "last_error")
    assert state == [("-", "R002", 1000, 1, None), ("g", "R005", None, 1, "NotAllocated"), ("g", "R006", 1000, 1, "EmptyRecordType"),
                     ("h", "-", 1000, 1, None), ("h", "R001", 1000, 1, None), ("h", "R003", 1000, 1, None), ("h", "R004", 1000, 1, None)]
    sunk = spark.read.schema("host string, record_id string").json(f"{tmp_path}/sink").fillna("-")
    assert rows(sunk, "host", "record_id") == [("-", "R002"), ("h", "-"), ("h", "R001"), ("h", "R003"), ("h", "R004")]


def test_columns_of_a_table_are_all_that_is_read(spark, tmp_path):
    due = spark.createDataFrame([row(1), row(2)], OUTBOX)
    table = delivery.outbox_table(spark, f"{tmp_path}/outbox", due.schema, buckets=2)
    table.write(0, due)
    table.write(1, spark.createDataFrame([row(2)[:-4] + (1000, 1, None, 1)], OUTBOX))
    some = table.current(columns=["host", "id", "delivered_ms", "revision", "batch_id"])
    assert rows(some, "id", "delivered_ms", "batch_id") == [("R001", None, 0), ("R002", 1000, 1)]
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", some._jdf.queryExecution().executedPlan().toString()))
    assert read == {"host:string,id:string,delivered_ms:bigint,revision:bigint,batch_id:bigint"}
