"""Runs of whole jobs over the given tables: migration, audit, discovery, and the consumer of an at-least-once stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fleetseal.plans import jobs
from fleetseal.plans.registry import CHECKS, query
from fleetseal.plans.stream_queries import in_parts
from fleetseal.session import checkpoint_dir
from fleetseal.sources.state import StateStore
from fleetseal.streaming.delivery import dedupe_records


def _folder(t) -> str:
    return f"{checkpoint_dir(t.spark)}/job-{uuid.uuid4().hex}"


@query("SELECT host, id FROM {fs_changes}")
def stream_dedupe_records(t):
    """Each record of a stream that delivers every one two or three times, over several micro-batches."""
    folder = _folder(t)
    times = F.when(F.pmod(F.col("seq"), F.lit(3)) == 0, 3).otherwise(2)
    sent = t.fs_changes.select("host", F.col("id").alias("record_id"), F.explode(F.transform(F.sequence(F.lit(1), times), lambda k: F.col("t_ms") + k * 700)).alias("sent_ms"))
    stream = in_parts(sent, "sent_ms", f"{folder}/in").withColumn("occurred_at", F.timestamp_millis("sent_ms"))
    (dedupe_records(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.parquet(f"{folder}/out").select("host", F.col("record_id").alias("id"))


@query("""SELECT host, normalized_entity, id FROM (SELECT host, upper(entity) AS normalized_entity, id,
  row_number() OVER (PARTITION BY host, upper(entity) ORDER BY t_ms DESC, seq) AS rn FROM {fs_changes}) x WHERE rn = 1""")
def migration_run(t):
    """The projection that a migration leaves, which is made once however often it is asked for."""
    store = StateStore(t.spark, f"{_folder(t)}/state")
    first = jobs.migrate(t.legacy_baselines, t.fs_changes, store)
    again = jobs.migrate(t.legacy_baselines, t.fs_changes.filter("false"), store)
    if (first, again) != (1, -1):
        raise AssertionError(f"migrated as {first}, then {again}")
    return store.read("fs_changes").select("host", "normalized_entity", "id")


@query("SELECT a.host, CAST(a.record_id AS VARCHAR) AS id, p.subject_user_sid, p.object_name, p.new_value FROM {audit_xml} a JOIN (" + CHECKS["audit_xml"] + ") p ON p.record_id = a.record_id")
def audit_run(t):
    """Audit records of declared scopes as findings in the outbox."""
    store = StateStore(t.spark, f"{_folder(t)}/state")
    jobs.ingest_audit(store, t.audit_xml, ["c:/s1", "C:/S2"])
    f = F.col("fields")
    return store.read("outbox").select("host", "id", f["subjectUserSid"].alias("subject_user_sid"), f["objectName"].alias("object_name"), f["newValue"].alias("new_value"))


@query("""SELECT d.source AS host, concat('c:/data/', d.source, '/', d.lang, '/doc', cast(d.doc_id AS varchar)) AS path, upper(sha256(d.text)) AS content_hash FROM documents d
  WHERE (d.doc_id % 8192) & 5972 = 0 AND d.source <> 'src1'
    AND NOT EXISTS (SELECT 1 FROM {members_prev} m WHERE m.host = d.source AND m.identity_key = upper(concat('c:/data/', d.source, '/', d.lang, '/doc', cast(d.doc_id AS varchar))))""")
def discovery_run(t):
    """What a full listing finds in scope that the projection does not know."""
    path = F.concat(F.lit("c:/data/"), "source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"))
    found = t.documents.select(F.col("source").alias("host"), path.alias("path"), (F.col("doc_id") % 8192).alias("attributes"), F.upper(F.sha2("text", 256)).alias("content_hash"))
    known = t.members_prev.select("host", F.col("path").alias("entity"), "content_hash")
    return jobs.discover(found, jobs.Scope(["C:/Data"], ["C:/DATA/src1"]), known)[0].select("host", "path", "content_hash")
