"""Streaming runs over the given tables: read as a stream until nothing is left, results read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetseal.operators import findings, inventory, outbox
from fleetseal.plans import change_queries, inventory_queries, jobs  # noqa: F401  (its checks are reused here)
from fleetseal.plans.inputs import arriving
from fleetseal.plans.registry import CHECKS, query
from fleetseal.session import checkpoint_dir
from fleetseal.sources.buckets import BatchTable
from fleetseal.sources.files import DEFAULT_CAP, content_columns
from fleetseal.sources.state import StateStore
from fleetseal.streaming import pipelines
from fleetseal.streaming.bursts import collapse_stream
from fleetseal.streaming.changes import ChangeTables, start
from fleetseal.streaming.delivery import deliver_rounds, outbox_table


def _folder(t) -> str:
    return f"{checkpoint_dir(t.spark)}/run-{uuid.uuid4().hex}"


def in_parts(df, time: str, folder: str, parts: int = 4):
    """A table as a stream whose files arrive in order of time, one part after the other."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    part = F.floor((F.col(time) - F.lit(low or 0)) / (((high or 0) - (low or 0)) // parts + 1))
    files = arriving(df, part, parts, folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _changes(t):
    return t.fs_changes.withColumnRenamed("size_bytes", "current_size_bytes").withColumns({
        "full_path": F.col("entity"), "new_path": F.when(F.col("old_path").isNotNull(), F.col("entity"))})


@query(CHECKS["projection_state"])
def stream_latest_state(t):
    """The projection after a stream of changes in one micro-batch."""
    changes = _changes(t)
    folder = _folder(t)
    stream = in_parts(changes, "t_ms", f"{folder}/in", 1)
    tables = ChangeTables(t.spark, f"{folder}/state", changes.schema)
    start(stream, tables, f"{folder}/checkpoint").awaitTermination()
    return tables.projection.current().select("host", "normalized_entity", "id", "change_category")


# Of every batch the newest change of an entity counts, and what its rename leaves is gone; later batches win.
_BY_BATCH = """
  WITH parted AS (SELECT *, upper(entity) AS k, upper(old_path) AS away, (t_ms - (SELECT min(t_ms) FROM {fs_changes})) // ((SELECT max(t_ms) - min(t_ms) FROM {fs_changes}) // 4 + 1) AS b
    FROM {fs_changes}),
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, k, b ORDER BY t_ms DESC, seq) AS rn FROM parted) x WHERE rn = 1),
  ops AS (SELECT host, k, b, t_ms, seq, id, change_category, true AS present FROM latest
    UNION ALL SELECT host, away, b, t_ms, seq, id, change_category, false FROM latest WHERE away IS NOT NULL AND away <> k),
  resolved AS (SELECT *, row_number() OVER (PARTITION BY host, k ORDER BY b DESC, t_ms DESC, seq DESC, present) AS rn FROM ops)
  SELECT host, k AS normalized_entity, id, change_category FROM resolved WHERE rn = 1 AND present"""


@query(_BY_BATCH)
def stream_state_by_batch(t):
    """The projection after a stream of changes in several micro-batches."""
    changes, folder = _changes(t), _folder(t)
    tables = ChangeTables(t.spark, f"{folder}/state", changes.schema, fold_every=2)
    start(in_parts(changes, "t_ms", f"{folder}/in"), tables, f"{folder}/checkpoint").awaitTermination()
    return tables.projection.current().select("host", "normalized_entity", "id", "change_category")


@query(f"""SELECT host, normalized_entity, id, change_category, 'kept' AS kind FROM ({_BY_BATCH}) p
  UNION ALL SELECT host, NULL, id, change_category, 'sent' FROM {{fs_changes}} WHERE change_category <> 'Discovery'
  UNION ALL SELECT 'driver', NULL, 'batch ' || b || ' try ' || a, NULL, 'failed' FROM (VALUES (0, 1), (2, 1), (2, 2)) v(b, a)""")
def stream_failed_batches(t):
    """Projection, outbox and failures of a stream of which two batches fail once and twice: as without failures, and each is recorded."""
    changes, folder = _changes(t), _folder(t)
    tables, tries = ChangeTables(t.spark, f"{folder}/state", changes.schema), []

    def fail(batch_id: int) -> None:
        tries.append(batch_id)
        if tries.count(batch_id) <= {0: 1, 2: 2}.get(batch_id, 0):
            raise OSError("injected")
    start(in_parts(changes, "t_ms", f"{folder}/in"), tables, f"{folder}/checkpoint", [fail]).awaitTermination()
    none = F.lit(None).cast("string")
    kept = tables.projection.current().select("host", "normalized_entity", "id", "change_category", F.lit("kept").alias("kind"))
    category = changes.select("host", "id", "change_category")
    sent = tables.outbox.current().select("host", "id").join(category, ["host", "id"]).select("host", none.alias("normalized_entity"), "id", "change_category", F.lit("sent").alias("kind"))
    failed = tables.failures().select("host", none.alias("normalized_entity"), F.concat(F.lit("batch "), "batch_id", F.lit(" try "), "attempt").alias("id"),
                                      none.alias("change_category"), F.lit("failed").alias("kind"))
    return kept.unionByName(sent).unionByName(failed)


@query(CHECKS["burst_collapse"].replace(
    "WITH touch", "WITH notes AS (SELECT host, cast(t_ms // 75 AS bigint) AS win, seq, category, full_path, old_path FROM {raw_notifications}), touch", 1)
    .replace("FROM {raw_notifications} WHERE", "FROM notes WHERE").replace("AS ren FROM {raw_notifications}", "AS ren FROM notes")
    .replace("FROM {raw_notifications} r)", "FROM notes r)").replace("SELECT host, win, seq, category, full_path", "SELECT host, seq, category, full_path"))
def stream_burst_collapse(t):
    folder = _folder(t)
    notes = lambda inputs: inputs.raw_notifications.select("host", "seq", F.col("t_ms").alias("captured_ms"), "category", "full_path", "old_path")
    stream = notes(t.streaming("events"))
    # One row far ahead in time closes the last windows; its own window stays open and is never emitted.
    end = t.spark.createDataFrame([("", -1, 10**15, "Created", "", None)], stream.schema)
    end.write.parquet(f"{folder}/end")
    both = stream.unionByName(t.spark.readStream.schema(stream.schema).parquet(f"{folder}/end"))
    (collapse_stream(both).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out").drop("captured_ms")


@query("SELECT id, min(seq) AS seq FROM {outbox_inserts} GROUP BY id")
def stream_outbox(t):
    """The first record of every id, admitted over several micro-batches."""
    folder, rows = _folder(t), t.outbox_inserts
    first = lambda r: r.groupBy("id").agg(F.min_by(F.struct(*[c for c in r.columns if c != "id"]), "batch_id").alias("r")).select("id", "r.*").select(*r.columns)
    table = BatchTable(t.spark, f"{folder}/outbox", rows.schema, ["id"], first)

    def admit(batch, batch_id):
        table.write(batch_id, outbox.admit(batch, table.before(batch_id, batch.select("id"))))

    (in_parts(rows, "seq", f"{folder}/in").writeStream.foreachBatch(admit).option("checkpointLocation", f"{folder}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return table.current().select("id", "seq")


def _runs(t, number: int):
    return t.documents.select(F.col("source").alias("host")).distinct().select(
        "host", F.concat(F.lit(f"{number}-"), "host").alias("id"), F.lit("FileSystem").alias("source"), F.lit("S").alias("scope_hash"),
        F.lit("V").alias("source_identity"), F.lit(1).alias("schema_version"), F.lit(1).alias("algorithm"), F.lit(number).cast("bigint").alias("started_ms"))


@query(CHECKS["snapshot_diff"])
def reconcile_runs(t):
    """Two inventory runs through the state store; the second finds what the direct comparison finds."""
    store = StateStore(t.spark, f"{_folder(t)}/state")
    jobs.reconcile(store, inventory.with_identity(t.members_prev), _runs(t, 1), 1000)
    jobs.reconcile(store, inventory.with_identity(t.members_curr), _runs(t, 2), 2000)
    return store.read("results").select("host", F.col("identity").alias("identity_key"), "change", "old_path", "new_path")


@query("""WITH f AS (SELECT host, id, CASE substr(md5(id), 1, 1) WHEN '0' THEN 'wrong' WHEN '1' THEN 'blank' ELSE 'fine' END AS kind
    FROM {fs_changes} WHERE change_category <> 'Discovery')
  SELECT host, id, 1 AS delivery_attempts, kind <> 'wrong' AS delivered, CASE kind WHEN 'wrong' THEN 'NotAllocated' WHEN 'blank' THEN 'EmptyRecordType' END AS last_error,
    kind = 'fine' AS in_sink FROM f""")
def delivery_run(t):
    """Changes become findings, some of them with a wrong or blank type; two deliveries at one time drain the outbox in rounds."""
    folder = _folder(t)
    events = findings.file_findings(t.fs_changes)
    mark = F.substring(F.md5("record_id"), 1, 1)
    altered = events.withColumn("record_type", F.when(mark == "0", "Heartbeat").when(mark == "1", " \t").otherwise(F.col("record_type")))
    rows = pipelines.outbox_rows(altered)
    table = outbox_table(t.spark, f"{folder}/outbox", rows.schema)
    table.write(0, rows)
    largest = table.current().groupBy("host").count().agg(F.max("count")).first()[0] or 1
    deliver_rounds(table, f"{folder}/sink", 10**12, limit=-(-largest // 3))
    deliver_rounds(table, f"{folder}/sink", 10**12)
    sunk = t.spark.read.schema("host string, record_id string").json(f"{folder}/sink").select("host", F.col("record_id").alias("id"), F.lit(True).alias("in_sink"))
    state = table.current(columns=["host", "id", "delivery_attempts", "delivered_ms", "last_error", "revision", "batch_id"])
    return state.join(sunk.hint("merge"), ["host", "id"], "left").select(
        "host", "id", "delivery_attempts", F.col("delivered_ms").isNotNull().alias("delivered"), "last_error", F.coalesce("in_sink", F.lit(False)).alias("in_sink"))


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN strlen(text) > 4096 THEN NULL ELSE upper(sha256(text)) END AS content_hash,
  CASE WHEN text IS NULL THEN 2 WHEN strlen(text) > 4096 THEN 1 ELSE 0 END AS hash_state FROM documents""")
def content_scan(t):
    """State and hash of every document taken for a file, with a size cap of 4096 bytes."""
    content = F.encode("text", "UTF-8")
    return t.documents.select("doc_id", *content_columns(F.octet_length("text"), content, 4096, F.col("text").isNotNull()))


@query(f"""SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN strlen(text) > {DEFAULT_CAP} THEN NULL ELSE upper(sha256(text)) END AS content_hash,
  CASE WHEN text IS NULL THEN 2 WHEN strlen(text) > {DEFAULT_CAP} THEN 1 ELSE 0 END AS hash_state FROM documents""")
def content_scan_whole(t):
    """State and hash of every document taken for a file, with the size cap of an inventory."""
    return t.documents.select("doc_id", *content_columns(F.octet_length("text"), F.encode("text", "UTF-8"), DEFAULT_CAP, F.col("text").isNotNull()))
