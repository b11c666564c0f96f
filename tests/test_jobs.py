import pytest
from pyspark.sql import functions as F
from test_operators import rows

from fleetseal.functions import events
from fleetseal.operators import inventory
from fleetseal.plans import jobs
from fleetseal.sources import files
from fleetseal.sources.state import StateStore
from fleetseal.streaming import pipelines

RUN = ("host string, id string, source string, scope_hash string, source_identity string, schema_version int, algorithm int, started_ms bigint")
FILE = "host string, pass int, identity_key string, path string, node_type int, content_hash string"


def run(spark, number, scope_hash="s", hosts=("h", "g"), source="FileSystem"):
    return spark.createDataFrame([(h, f"{h}{number}", source, scope_hash, "V", 1, 1, number) for h in hosts], RUN)


def passes(spark, *per_pass):
    data = [(h, n, p.upper(), p, 0, c) for n, items in enumerate(per_pass, 1) for h, p, c in items]
    return spark.createDataFrame(data, FILE)


def test_recurring_file_runs(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    one = [("h", "C:/a", "1"), ("h", "C:/b", "1"), ("g", "C:/a", "1")]
    jobs.reconcile_files(store, passes(spark, one, one), run(spark, 1), 1000)
    assert store.read("results").count() == 0
    two = [("h", "C:/a", "2"), ("h", "C:/c", "1"), ("g", "C:/a", "1")]
    jobs.reconcile_files(store, passes(spark, two, two), run(spark, 2), 2000)
    assert rows(store.read("results"), "host", "identity", "change") == [("h", "C:/A", "Changed"), ("h", "C:/B", "Deleted"), ("h", "C:/C", "Created")]
    # Host h does not converge: it gets an Invalid baseline that nothing is compared with, g goes on.
    a, b, c = ([("h", "C:/a", str(n)), ("g", "C:/a", "9")] for n in (1, 2, 3))
    jobs.reconcile_files(store, passes(spark, a, b, c), run(spark, 3), 3000)
    assert rows(store.read("baselines").filter("completed_ms IS NULL OR completed_ms = 3000"), "id", "status", "invalid_reason") == [
        ("g3", "Complete", None), ("h3", "Invalid", "Unstable")]
    assert rows(store.read("results").filter("detected_ms = 3000"), "host", "change") == [("g", "Changed")]
    # The next run of h compares with its second one; old generations are retired.
    jobs.reconcile_files(store, passes(spark, two, two), run(spark, 4), 4000)
    assert rows(store.read("results").filter("detected_ms = 4000"), "host", "change") == [("g", "Changed")]
    kept = rows(store.read("baselines").filter("host = 'g' AND status = 'Complete'"), "id")
    assert ("g3",) in kept and ("g4",) in kept and ("g1",) not in kept
    jobs.collect_member_segments(store)
    assert store.read("members").filter("baseline_id = 'g4'").count() == 1
    # A replay changes nothing.
    assert jobs.reconcile_files(store, passes(spark, two, two), run(spark, 4), 4000) == -1


def test_new_scope_is_not_compared_with_the_old_one(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    one = [("h", "C:/a", "1")]
    jobs.reconcile_files(store, passes(spark, one, one), run(spark, 1, "old", ["h"]), 1000)
    none = [("h", "C:/z", "1")]
    jobs.reconcile_files(store, passes(spark, none, none), run(spark, 2, "new", ["h"]), 2000)
    assert store.read("results").count() == 0
    assert dict(rows(store.read("baselines"), "id", "applicability")) == {"h1": "Superseded", "h2": "Current"}


def test_duplicates_and_tampering_reject_a_run(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    one = spark.createDataFrame([("h", "A", "A", "1"), ("g", "A", "A", "1")], "host string, identity_key string, path string, fingerprint string")
    jobs.reconcile(store, one, run(spark, 1), 1000)
    twice = one.unionByName(one.filter("host = 'h'"))
    jobs.reconcile(store, twice, run(spark, 2), 2000)
    assert rows(store.read("baselines"), "id", "status", "invalid_reason") == [
        ("g1", "Complete", None), ("g2", "Complete", None), ("h1", "Complete", None), ("h2", "Invalid", "DuplicateIdentity")]
    segment = store.segments("members")[1]
    held = store.read_segments([segment], jobs._MEMBERS).withColumn("fingerprint", F.lit("changed"))
    spark.createDataFrame(held.collect(), held.schema).write.mode("overwrite").parquet(f"{store.root}/{segment}")
    jobs.reconcile(store, one.withColumn("fingerprint", F.lit("9")), run(spark, 3), 3000)
    assert rows(store.read("results").filter("detected_ms = 3000"), "host") == [("h",)]


def test_publish_and_deliver(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    make = lambda f: spark.createDataFrame([("h", k, k, f) for k in "AB"], "host string, identity_key string, path string, fingerprint string")
    jobs.reconcile(store, make("1"), run(spark, 1, hosts=["h"]), 1000)
    jobs.reconcile(store, make("2"), run(spark, 2, hosts=["h"]), 2000)
    jobs.publish_baseline_findings(store, 3000)
    assert rows(jobs.current_results(store), "delivery_attempts", "delivered_ms") == [(1, 3000), (1, 3000)]
    assert store.read("results").count() == 4
    assert rows(pipelines.current_outbox(store), "event_id", "delivered_ms") == [(7795, None), (7795, None)]
    jobs.publish_baseline_findings(store, 3500)
    assert pipelines.current_outbox(store).count() == 2
    first_fails = F.col("fields")["identity"] == "A"
    jobs.deliver_outbox(store, f"{tmp_path}/sink", 4000, fails=first_fails)
    jobs.deliver_outbox(store, f"{tmp_path}/sink", 4500)
    assert rows(pipelines.current_outbox(store), "delivery_attempts", "delivered_ms", "last_error") == [(1, 4000, None), (1, None, "SinkError")]
    jobs.deliver_outbox(store, f"{tmp_path}/sink", 5000)
    delivered = spark.read.json(f"{tmp_path}/sink")
    assert delivered.count() == 2 and delivered.select("record_id").distinct().count() == 2
    assert rows(delivered, "severity") == [("Warning",), ("Warning",)]
    pipelines.compact_outbox(store, 5000 + 8 * 86_400_000)
    assert pipelines.current_outbox(store).count() == 0


def outbox_of(spark, *items):
    schema = ("host string, id string, schema_version int, event_id int, record_type string, occurred_ms bigint, scope_hash string, fields map<string,string>, error boolean, "
              "created_ms bigint, next_attempt_ms bigint, delivered_ms bigint, delivery_attempts int, last_error string, revision bigint")
    return spark.createDataFrame([("h", i, 1, 7790, kind, t, "", {"a": "b"}, False, t, 0, None, 0, None, 0) for i, kind, t in items], schema)


def test_a_rejected_record_fails_and_nothing_is_lost(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    store.commit(append={"outbox": outbox_of(spark, ("good", events.EVENT_CATALOG[7790], 1), ("wrong", "NoSuchType", 2), ("blank", "\t\n", 3))})
    jobs.deliver_outbox(store, f"{tmp_path}/sink", 4000)
    assert rows(pipelines.current_outbox(store), "id", "delivered_ms", "last_error") == [
        ("blank", 4000, "EmptyRecordType"), ("good", 4000, None), ("wrong", None, "NotAllocated")]
    assert rows(spark.read.json(f"{tmp_path}/sink"), "record_id") == [("good",)]


def test_rounds_at_one_time_do_not_overwrite_each_other(spark, tmp_path):
    store, kind = StateStore(spark, f"{tmp_path}/state"), events.EVENT_CATALOG[7790]
    store.commit(append={"outbox": outbox_of(spark, *[(f"r{i}", kind, i) for i in range(5)])})
    jobs.deliver_outbox(store, f"{tmp_path}/sink", 4000, limit=2)
    store.commit(append={"outbox": outbox_of(spark, ("late", kind, 9))})
    jobs.deliver_outbox(store, f"{tmp_path}/sink", 4000)
    assert jobs.deliver_outbox(store, f"{tmp_path}/sink", 4000) == -1
    assert rows(spark.read.json(f"{tmp_path}/sink"), "record_id") == [("late",), *[(f"r{i}",) for i in range(5)]]


def test_only_a_missing_folder_reads_as_nothing_committed(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    assert store.snapshot().txn == 0
    unfinished = tmp_path / "state" / "_meta" / "txn=000000000001"
    unfinished.mkdir(parents=True)
    assert store.snapshot().txn == 0
    (unfinished / "part-0.parquet").write_text("not parquet")
    (unfinished / "_SUCCESS").write_text("")
    with pytest.raises(Exception):
        store.snapshot()


def test_many_commits_cost_the_same_and_fold(spark, tmp_path):
    import time
    store, took = StateStore(spark, f"{tmp_path}/state"), []
    for i in range(60):
        began = time.perf_counter()
        store.commit(append={"t": spark.range(i, i + 1)}, writer="w", batch_id=i)
        took.append(time.perf_counter() - began)
        store.fold("t", 20)
    assert store.commit(append={"t": spark.range(1)}, writer="w", batch_id=30) == -1
    assert sorted(r.id for r in store.read("t").collect()) == list(range(60))
    assert len(store.segments("t")) <= 21 and len(store._commits()) <= 16
    assert len(list((tmp_path / "state" / "t").iterdir())) < 60
    assert sum(took[-15:]) < 2 * sum(took[15:30])


def test_registry_run(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    keys = spark.createDataFrame([("h", "HKEY_USERS\\S-1-5\\Software\\A", 0, "acl"), ("h", "HKEY_LOCAL_MACHINE\\X", 0, "acl")],
                                 "host string, path string, acl_state int, acl_evidence string")
    values = spark.createDataFrame([("h", "HKEY_USERS\\S-1-5\\Software\\A", "v", "String", "t", None, None, None)],
                                   "host string, key_path string, value_name string, kind string, text_value string, int_value bigint, data binary, items array<string>")
    root = lambda r: spark.createDataFrame([("h", r)], "host string, root string")
    sids = spark.createDataFrame([("h", "S-1-5")], "host string, sid string")
    args = (root("HKEY_CURRENT_USER\\Software"), root("HKEY_LOCAL_MACHINE\\Skip"), sids)
    jobs.reconcile_registry(store, keys, values, run(spark, 1, hosts=["h"], source="Registry"), 1000, *args)
    changed = values.withColumn("text_value", F.lit("u"))
    jobs.reconcile_registry(store, keys, changed, run(spark, 2, hosts=["h"], source="Registry"), 2000, *args)
    assert rows(store.read("members").filter("baseline_id = 'h2'"), "identity_key") == [
        ("KEY|HKEY_USERS\\S-1-5\\SOFTWARE\\A",), ("VALUE|HKEY_USERS\\S-1-5\\SOFTWARE\\A\\V",)]
    assert rows(store.read("results"), "identity", "change") == [("VALUE|HKEY_USERS\\S-1-5\\SOFTWARE\\A\\V", "Changed")]


def test_live_file_changes(spark, tmp_path):
    notes = spark.createDataFrame([("h", 1, 100, "s", "C:/a", "Created", None, None), ("h", 2, 110, "s", "C:/A", "Changed", None, None),
                                   ("h", 3, 20_000, "s", "C:/b", "Deleted", None, None)],
                                  "host string, seq bigint, captured_ms bigint, scope string, full_path string, category string, old_path string, new_path string")
    activity = spark.createDataFrame([("h", 1, 90, "c:/a", "Attributed", None, "x.exe", "S-1")],
                                     "host string, seq bigint, t_ms bigint, path string, status string, missing_reason string, process_name string, user_sid string")
    facts = spark.createDataFrame([("h", 1, "H", 5, "acl", "File")], "host string, seq bigint, current_hash string, current_size_bytes bigint, acls string, object_type string")
    got = jobs.live_file_changes(notes, activity, facts)
    assert rows(got, "seq", "change_category", "process_name", "attribution_confidence", "attribution_missing_reason", "user_sid", "attribution_source_ms") == [
        (1, "Created", "x.exe", "High", None, "S-1", 90), (3, "Deleted", None, "None", "NoCorrelatedFileEvent", None, None)]
    store = StateStore(spark, f"{tmp_path}/state")
    jobs.run_on_batches(lambda batch: jobs.live_file_changes(batch, activity, facts))(store, notes, 0)
    assert rows(pipelines.read_projection(store), "normalized_entity") == [("C:/A",), ("C:/B",)]


def test_live_registry_changes(spark):
    trace = spark.createDataFrame([("h", 1, 1, 22, 7, "\\REGISTRY\\MACHINE\\SW", None, 4, "p"), ("h", 2, 2, 14, 7, "", "val", 4, "p"), ("h", 3, 3, 14, 7, "", "val", -1, "p")],
                                  "host string, seq bigint, t_ms bigint, opcode int, handle bigint, key_name string, value_name string, process_id int, process_name string")
    root = lambda r: spark.createDataFrame([(r,)], "root string")
    got = jobs.live_registry_changes(trace, root("HKEY_LOCAL_MACHINE\\SW"), root("HKEY_LOCAL_MACHINE\\SW\\Skip"), widths=(10,))
    assert rows(got, "seq", "entity", "change_category", "key_name", "hive", "attribution_confidence") == [
        (2, "HKEY_LOCAL_MACHINE\\SW\\val", "Changed", "SW", "LocalMachine", "Low")]
    facts = spark.createDataFrame([("h", 2, "DWord", None, 7, None, None, "acl", None, "SecurityException")],
                                  "host string, seq bigint, kind string, text_value string, int_value bigint, data binary, items array<string>, acls string, "
                                  "unavailable_reason string, partial_reason string")
    known = jobs.live_registry_changes(trace, root("HKEY_LOCAL_MACHINE\\SW"), root("HKEY_LOCAL_MACHINE\\SW\\Skip"), facts=facts, widths=(10,))
    assert rows(known, "value_data", "acls", "evidence_status", "evidence_missing_reason") == [("7", "acl", "Partial", "SecurityException")]


def test_audit_health_discovery_and_migration(spark, tmp_path):
    store = StateStore(spark, f"{tmp_path}/state")
    xml = '<Event><Data Name="ObjectName">C:/in/f</Data><Data Name="SubjectUserSid">S</Data></Event>'
    records = spark.createDataFrame([("h", "1", 4663, "p", 5, xml), ("h", "2", 4663, "p", 6, xml.replace("in", "out"))],
                                    "host string, record_id string, native_event_id int, provider string, t_ms bigint, xml string")
    jobs.ingest_audit(store, records, ["c:/in"])
    assert [(r.id, r.fields["nativeEvidence"]) for r in pipelines.current_outbox(store).collect()] == [("1", xml)]
    log = spark.createDataFrame([("h", 1, "accepted"), ("h", 2, "dropped")], "host string, t_ms bigint, kind string")
    report = jobs.health_report(log, store, 1000).collect()
    assert sorted((r.record_type, r.fields.get("lostCount"), r.fields.get("eventOutboxPending")) for r in report) == [
        ("CoverageGap", "1", None), ("Health", None, "1")]
    assert all(len(r.fields) == 18 for r in report if r.record_type == "Health")
    state = spark.createDataFrame([("h", "FileSystem", True, 2, 1000, 5)], "host string, source string, running boolean, consecutive_failures bigint, last_success_ms bigint, last_duration_ms bigint")
    checks = spark.createDataFrame([("h", "FileSystem", t, None, 0) for t in (5, 50)], "host string, source string, t_ms bigint, success_ms bigint, started_ms bigint")
    moved = spark.createDataFrame([("h", 9, "a", "b")], "host string, t_ms bigint, previous_scope_hash string, new_scope_hash string")
    full = jobs.health_report(log, store, 1000, snapshots=state, settings=moved, checks=checks, snapshot_interval_ms=10)
    assert sorted(str((r.event_id, r.fields.get("reason"), r.fields.get("fileSystemSnapshotFailures"))) for r in full.collect()) == [
        "(7790, None, '2')", "(7791, 'BaselineOverdue', None)", "(7791, 'CaptureQueueFull', None)", "(7794, None, None)"]
    found = spark.createDataFrame([("h", "C:/w/new", 32, "A"), ("h", "C:/w/old", 32, "B"), ("h", "C:/w/sys", 4, "C"), ("h", "D:/x", 32, "D")],
                                  "host string, path string, attributes int, content_hash string")
    known = spark.createDataFrame([("h", "c:/W/OLD", "B")], "host string, entity string, content_hash string")
    changed, stats = jobs.discover(found, jobs.Scope(spark.createDataFrame([("C:/w",)], "root string")), known)
    assert rows(changed, "path") == [("C:/w/new",)]
    assert rows(stats, "total", "kept", "filtered_out", "percentage") == [(4, 1, 3, 75.0)]
    legacy = spark.createDataFrame([("1", "registry-v1", "Complete")], "id string, algorithm_version string, status string")
    old = spark.createDataFrame([("h", "a", 1, 1, "X"), ("h", "b", 2, 2, "x")], "host string, id string, seq bigint, t_ms bigint, entity string")
    jobs.migrate(legacy, old, store)
    assert rows(store.read("fs_changes"), "normalized_entity", "id") == [("X", "b")]
    assert jobs.migrate(legacy, old, store) == -1


def test_content_scan(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "small.txt").write_bytes(b"abc")
    (tmp_path / "d" / "exact.txt").write_bytes(b"abcd")
    (tmp_path / "d" / "large.txt").write_bytes(b"abcde")
    got = files.scan_files(spark, [str(tmp_path)], "h", cap=4, pattern="*.txt")
    listed = {r.path.split("/")[-1]: (r.content_hash, r.hash_state) for r in got.collect()}
    assert listed["small.txt"] == ("BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD", 0)
    assert listed["exact.txt"][1] == 0 and listed["large.txt"] == (None, 1)
    folders = files.directories_of(got, [str(tmp_path)])
    assert rows(folders, "identity_key") == sorted([(str(tmp_path).upper(),), (str(tmp_path / "d").upper(),)])
    assert files.distinct_roots(["/A", "/a", "/b"]) == ["/A", "/b"]


def test_scoped_files(spark):
    m = spark.createDataFrame([("h", "C:/w/a.log", 1), ("h", "C:/w/a.log/f", 0), ("h", "C:/w/link", 2), ("h", "C:/w/link/f", 0), ("h", "C:/w/t", 0), ("h", "C:/o/t", 0)],
                              "host string, path string, node_type int")
    area = jobs.Scope(spark.createDataFrame([("C:/w",)], "root string"), None, [".log"])
    assert rows(jobs.scoped_files(m, area), "path") == [("C:/w/link",), ("C:/w/t",)]
    assert inventory.item_counts(m, ["host"]).collect()[0].item_count == 6
    with pytest.raises(LookupError):
        StateStore(spark, "/tmp/fleetseal-none").read("x")
