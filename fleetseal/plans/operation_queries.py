"""Queries over delivery and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetseal.functions.delivery import backoff_seconds
from fleetseal.operators import findings, health, outbox
from fleetseal.plans.registry import query

SECOND = 1000
SCAN = (600 * SECOND, 600_000 * SECOND)
BEATS = (50, 50_000)
AS_OF = 5_000_000


@query("""SELECT host, id, created_ms FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY created_ms, id) AS rn FROM {outbox}
    WHERE delivered_ms IS NULL AND next_attempt_ms <= 5000000) x WHERE rn <= 200""")
def outbox_ready(t):
    return outbox.ready_batch(t.outbox, AS_OF).select("host", "id", "created_ms")


@query("SELECT id, min(seq) AS seq, arg_min(host, seq) AS host FROM {outbox_inserts} i WHERE id NOT IN (SELECT id FROM {fs_changes} WHERE change_category = 'Discovery') GROUP BY id")
def outbox_dedupe(t):
    existing = t.fs_changes.filter("change_category = 'Discovery'").select("id")
    return outbox.admit(t.outbox_inserts, existing).select("id", "seq", "host")


@query("""
  WITH r AS (SELECT *, delivered_ms IS NULL AND next_attempt_ms <= 5000000 AS tried FROM {outbox}),
  s AS (SELECT *, tried AND record_type <> '' AND sink_fails AS failed FROM r)
  SELECT id, delivery_attempts + CASE WHEN tried THEN 1 ELSE 0 END AS delivery_attempts,
    CASE WHEN tried AND NOT failed THEN 5000000 ELSE delivered_ms END AS delivered_ms,
    CASE WHEN failed THEN 5000000 + least(300, 1 << least(delivery_attempts, 8)::int)::bigint * 1000 ELSE next_attempt_ms END AS next_attempt_ms,
    CASE WHEN tried AND record_type = '' THEN 'EmptyRecordType' WHEN failed THEN 'IOException' END AS last_error FROM s""")
def outbox_delivery(t):
    state = outbox.apply_delivery(t.outbox, ~F.col("sink_fails"), F.lit("IOException"), AS_OF)
    return state.select("id", "delivery_attempts", F.col("delivered_ms").cast("long").alias("delivered_ms"),
                        "next_attempt_ms", "last_error")


@query("SELECT id, delivered_ms FROM {outbox} WHERE delivered_ms IS NULL OR delivered_ms >= 2000000")
def outbox_retention(t):
    return outbox.retain_since(t.outbox, 2_000_000).select("id", "delivered_ms")


@query("""SELECT host, count(*) FILTER (delivered_ms IS NULL) AS pending, min(created_ms) FILTER (delivered_ms IS NULL) AS oldest_ms,
    coalesce(5000000 - min(created_ms) FILTER (delivered_ms IS NULL), 0) AS oldest_age_ms FROM {outbox} GROUP BY host""")
def outbox_backlog(t):
    return outbox.backlog(t.outbox, AS_OF)


@query("""SELECT event_id, cast(CASE event_id % 12 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 8 WHEN 5 THEN 16 WHEN 6 THEN 32
    WHEN 7 THEN 64 WHEN 8 THEN 128 ELSE 256 END AS integer) AS delay FROM events""")
def retry_backoff(t):
    return t.events.select("event_id", backoff_seconds(F.col("event_id") % 12).alias("delay"))


@query("""SELECT p.host, p.id AS record_id, b.scope_hash, b.source, p.change, p.old_path, p.new_path FROM {pending_source} p
  JOIN {baselines} b ON b.host = p.host AND b.id = p.baseline_id WHERE p.delivered_ms IS NULL""")
def pending_findings(t):
    f = F.col("fields")
    return findings.baseline_findings(t.pending_source, t.baselines).select(
        "host", "record_id", "scope_hash", f["source"].alias("source"), f["change"].alias("change"),
        f["oldPath"].alias("old_path"), f["newPath"].alias("new_path"))


@query("""SELECT host, id, delivery_attempts + 1 AS delivery_attempts FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY detected_ms, id) AS rn
    FROM {pending_source} WHERE delivered_ms IS NULL) x WHERE rn <= 500""")
def pending_batch(t):
    batch = outbox.pending_results(t.pending_source)
    return outbox.record_attempts(batch, F.lit(True), AS_OF).select("host", "id", "delivery_attempts")


@query("""
  WITH w AS (SELECT host, t_ms - t_ms % 60000 AS window_ms, count(*) FILTER (kind = 'accepted') AS accepted, count(*) FILTER (kind = 'processed') AS processed,
    count(*) FILTER (kind = 'dropped') AS dropped, count(*) FILTER (kind = 'failed') AS enrichment_failures FROM {pipeline_log} GROUP BY ALL)
  SELECT *, cast(sum(accepted - processed - enrichment_failures) OVER (PARTITION BY host ORDER BY window_ms) AS bigint) AS queue_depth FROM w""")
def health_counters(t):
    return health.pipeline_counters(t.pipeline_log, widths=SCAN)


@query("""SELECT host, coalesce(99999999 - min(t_ms) FILTER (kind = 'accepted'), 0) AS oldest_age_ms FROM {pipeline_log} GROUP BY host""")
def queue_oldest_age(t):
    queue = t.pipeline_log.select("host", F.col("t_ms").alias("captured_ms"),
                                  F.when(F.col("kind") != "accepted", F.col("t_ms")).alias("completed_ms"))
    return health.oldest_item_age(queue, 99_999_999)


@query("""SELECT host, beat, events_lost, lost_count FROM (SELECT host, beat, events_lost,
    events_lost - coalesce(lag(events_lost) OVER (PARTITION BY host ORDER BY beat), 0) AS lost_count FROM {heartbeats}) x WHERE lost_count > 0""")
def loss_delta(t):
    deltas = health.loss_deltas(t.heartbeats, ["host"], ["beat"], "events_lost", BEATS)
    return deltas.select("host", "beat", "events_lost", "lost_count")


@query("""
  WITH b AS (SELECT *, lag(t_ms) OVER w AS pt, lag(dropped) OVER w AS pd, lag(enrichment_failures) OVER w AS pf FROM {heartbeats} WINDOW w AS (PARTITION BY host ORDER BY t_ms))
  SELECT host, t_ms, 'MissingHeartbeat' AS reason, t_ms - pt AS amount FROM b WHERE t_ms - pt > 80000
  UNION ALL SELECT host, t_ms, 'QueueAge', oldest_age_ms FROM b WHERE oldest_age_ms > 40000
  UNION ALL SELECT host, t_ms, 'Dropped', cast(dropped - pd AS bigint) FROM b WHERE dropped > pd
  UNION ALL SELECT host, t_ms, 'EnrichmentFailures', cast(enrichment_failures - pf AS bigint) FROM b WHERE enrichment_failures > pf
  UNION ALL SELECT host, max(t_ms), 'MissingHeartbeat', 1000000000000 - max(t_ms) FROM b GROUP BY host HAVING 1000000000000 - max(t_ms) > 80000""")
def heartbeat_gap(t):
    return health.heartbeat_gaps(t.heartbeats, 40_000, 1_000_000_000_000, SCAN)


@query("""SELECT seq, host, scope FROM {gap_events} g WHERE record_type = 'CoverageGap' AND NOT EXISTS (SELECT 1 FROM {gap_events} r
    WHERE r.record_type = 'SourceRecovered' AND r.host = g.host AND r.scope = g.scope AND r.seq >= g.seq)""")
def unresolved_gaps(t):
    return health.unresolved_gaps(t.gap_events).select("seq", "host", "scope")


@query("""
  WITH c AS (SELECT host, t_ms, started_ms, max(success_ms) OVER (PARTITION BY host ORDER BY t_ms) AS last_success_ms FROM {checks}),
  o AS (SELECT host, t_ms, CASE WHEN last_success_ms IS NOT NULL THEN t_ms - last_success_ms > 40000 ELSE t_ms - started_ms > 20000 END AS overdue FROM c),
  e AS (SELECT *, coalesce(lag(overdue) OVER (PARTITION BY host ORDER BY t_ms), false) AS was FROM o)
  SELECT host, t_ms, CASE WHEN overdue THEN 'CoverageGap' ELSE 'SourceRecovered' END AS record_type,
    CASE WHEN overdue THEN 'BaselineOverdue' ELSE 'BaselineCurrent' END AS reason FROM e WHERE overdue <> was""")
def overdue_inventory(t):
    return health.overdue_transitions(t.checks, ["host"], ["t_ms"], 20_000, SCAN).select("host", "t_ms", "record_type", "reason")


@query("""
  WITH m AS (SELECT host, count(*) AS events, max(latency_ms) AS max_ms, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95,
      quantile_cont(latency_ms, 0.99) AS p99 FROM {latencies} GROUP BY host),
  b AS (SELECT host, max(n) AS burst_events FROM (SELECT host, count(*) AS n FROM {latencies} GROUP BY host, t_ms // 60000) x GROUP BY host),
  s AS (SELECT host, max(n) AS sustained_events FROM (SELECT host, count(*) AS n FROM {latencies} GROUP BY host, t_ms // 1800000) x GROUP BY host)
  SELECT * FROM m JOIN b USING (host) JOIN s USING (host)""")
def qualification_report(t):
    return health.qualification(t.latencies).join(health.peak_rates(t.latencies), "host")


@query("""SELECT host, cast(max(depth) AS bigint) AS max_depth FROM (SELECT host, sum(CASE kind WHEN 'accepted' THEN 1 WHEN 'dropped' THEN 0 ELSE -1 END)
    OVER (PARTITION BY host ORDER BY t_ms) AS depth FROM {pipeline_log}) x GROUP BY host""")
def peak_queue_depth(t):
    change = F.when(F.col("kind") == "accepted", 1).when(F.col("kind") == "dropped", 0).otherwise(-1).cast("long")
    return health.peak_depth(t.pipeline_log, ["host"], ["t_ms"], change, SCAN)


@query("""
  WITH n AS (SELECT r.*, (SELECT count(*) FROM {run_starts} s WHERE s.host = r.host AND s.source = r.source AND s.t_ms < r.t_ms) AS run_number FROM {requests} r)
  SELECT host, source, run_number, min(t_ms) AS first_ms, arg_min(reason, t_ms) AS reason, count(*) AS requests FROM n GROUP BY host, source, run_number""")
def request_coalescing(t):
    return health.coalesce_requests(t.requests, t.run_starts, widths=SCAN)


@query("""
  WITH c AS (SELECT host, t_ms, started_ms, max(success_ms) OVER (PARTITION BY host ORDER BY t_ms) AS last_success_ms FROM {checks}),
  o AS (SELECT host, t_ms, CASE WHEN last_success_ms IS NOT NULL THEN t_ms - last_success_ms > 40000 ELSE t_ms - started_ms > 20000 END AS overdue FROM c),
  e AS (SELECT *, coalesce(lag(overdue) OVER (PARTITION BY host ORDER BY t_ms), false) AS was FROM o)
  SELECT host, CASE WHEN overdue THEN 7791 ELSE 7792 END AS event_id, t_ms AS occurred_ms, 'FileSystemSnapshot' AS source,
    CASE WHEN overdue THEN 'BaselineOverdue' END AS reason, CASE WHEN NOT overdue THEN 'BaselineCurrent' END AS action FROM e WHERE overdue <> was
  UNION ALL SELECT host, 7791, t_ms, 'RegistryETW', 'EventsLost', NULL FROM (SELECT host, t_ms, events_lost,
    coalesce(lag(events_lost) OVER (PARTITION BY host ORDER BY beat), 0) AS b FROM {heartbeats}) x WHERE events_lost > b""")
def coverage_records(t):
    moved = health.overdue_transitions(t.checks, ["host"], ["t_ms"], 20_000, SCAN)
    lost = health.loss_deltas(t.heartbeats, ["host"], ["beat"], "events_lost", BEATS).withColumns({
        "source": F.lit("RegistryETW"), "scope": F.lit("ConfiguredRegistryKeys"), "reason": F.lit("EventsLost")})
    f = F.col("fields")
    return findings.unify(findings.overdue_records(moved, F.lit("FileSystemSnapshot")), findings.coverage_gaps(lost)).select(
        "host", "event_id", "occurred_ms", f["source"].alias("source"), f["reason"].alias("reason"), f["action"].alias("action"))


@query("""
  WITH w AS (SELECT host, t_ms - t_ms % 60000 AS window_ms, count(*) FILTER (kind = 'accepted') AS accepted, count(*) FILTER (kind = 'processed') AS processed,
    count(*) FILTER (kind = 'dropped') AS dropped, count(*) FILTER (kind = 'failed') AS failures FROM {pipeline_log} GROUP BY ALL),
  b AS (SELECT host, count(*) FILTER (delivered_ms IS NULL) AS pending FROM {outbox} GROUP BY host)
  SELECT host, window_ms + 60000 AS occurred_ms, cast(sum(accepted - processed - failures) OVER (PARTITION BY host ORDER BY window_ms) AS varchar) AS queue_depth,
    cast(dropped AS varchar) AS dropped, cast(pending AS varchar) AS pending, cast(18 AS integer) AS metrics FROM w JOIN b USING (host)""")
def heartbeat_records(t):
    beats = health.pipeline_counters(t.pipeline_log, widths=SCAN).withColumn("t_ms", F.col("window_ms") + 60_000)
    f = F.col("fields")
    return findings.heartbeats(beats, backlog=outbox.backlog(t.outbox, AS_OF)).select(
        "host", "occurred_ms", f["queueDepth"].alias("queue_depth"), f["dropped"].alias("dropped"), f["eventOutboxPending"].alias("pending"),
        F.size(f).alias("metrics"))
