"""End-to-end jobs: the operators put together over the state store."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetseal.functions import registry
from fleetseal.functions.evidence import live_evidence_reason, live_evidence_status
from fleetseal.functions.events import is_allocated
from fleetseal.functions.paths import has_suffix
from fleetseal.operators import attribution, bursts, discovery, findings, health, inventory, lineage, migration, outbox, scope
from fleetseal.operators.ordered import HOUR_MS, latest_by
from fleetseal.operators.projection import dedupe_projection
from fleetseal.sources import sinks, tables
from fleetseal.sources.state import Snapshot, StateStore
from fleetseal.streaming import pipelines

BASELINE_COLUMNS = ("host", "id", *lineage.LINEAGE, "status", "applicability", "started_ms", "completed_ms", "item_count",
                    "observation_passes", "consistency_method", "invalid_reason", "manifest_digest", "segment")
_BASELINES = ("host string, id string, source string, scope_hash string, source_identity string, schema_version int, algorithm int, "
              "status string, applicability string, started_ms bigint, completed_ms bigint, item_count bigint, observation_passes int, "
              "consistency_method string, invalid_reason string, manifest_digest string, segment string")
_RESULTS = ("host string, id string, baseline_id string, previous_baseline_id string, identity string, change string, old_path string, "
            "new_path string, detected_ms bigint, delivered_ms bigint, delivery_attempts int, revision bigint")
_MEMBERS = "host string, baseline_id string, identity_key string, path string, fingerprint string"


@dataclass
class Scope:
    """What belongs to an inventory: roots as a list, or as tables with a ``root`` column; suffixes as a list."""

    monitored: DataFrame | Sequence[str] | None = None
    excluded: DataFrame | Sequence[str] | None = None
    suffixes: Sequence[str] = field(default_factory=tuple)


def scoped_files(members: DataFrame, area: Scope) -> DataFrame:
    """Members in scope; excluded directories and reparse points take what lies below them along."""
    kept = members
    if area.monitored is not None:
        kept = scope.select_paths(kept, "path", area.monitored, area.excluded, area.suffixes)
    if area.suffixes:
        folders = members.filter((F.col("node_type") == 1) & has_suffix(F.col("path"), list(area.suffixes)))
        kept = scope.prune_subtrees(kept, "path", folders.select("host", F.col("path").alias("root")), ["host"])
    return scope.prune_reparse_points(kept)


def agreed_members(passes: DataFrame, agreement: DataFrame) -> DataFrame:
    """Members of the agreeing pass of each host; hosts without one have none.

    ``passes`` is the columns of a comparison plus ``pass``, ``agreement`` what
    :func:`fleetseal.operators.inventory.convergence` says about them.
    """
    chosen = agreement.filter("NOT unstable").select("host", F.col("agreed_pass").alias("pass"))
    return passes.join(chosen, ["host", "pass"], "left_semi").drop("pass")


def reconcile(store: StateStore, current: DataFrame, runs: DataFrame, as_of_ms: int, unstable: DataFrame | None = None,
              generations: int = 2, name: str = "reconcile") -> int:
    """Compare new inventories with the last comparable ones, store them, and retire old generations.

    ``current`` is (host, identity_key, path, fingerprint), ``runs`` one row per host with its baseline id and
    lineage. A host whose inventory repeats an identity, did not converge, or whose previous inventory fails its
    digest gets an Invalid baseline, kept until the next run, and nothing is compared. Everything becomes visible in one
    commit, once per ``name`` and ``as_of_ms``; members of rejected baselines are in the segment but no Complete baseline leads to them.
    """
    if store.is_committed(name, as_of_ms):
        return -1
    # Staging the members first means scan, hashing and convergence run once; every step below reads the narrow copy.
    at = store.snapshot()
    staged, current = store.stage("members", current.join(runs.select("host", F.col("id").alias("baseline_id")), "host").select(
        "host", "baseline_id", "identity_key", "path", "fingerprint"), at)
    baselines = store.read("baselines", _BASELINES, at)
    superseded = lineage.supersede(baselines, runs, ["host", "source"])
    pairs = lineage.comparable_pairs(runs, superseded)
    earlier = pairs.select("host", F.col("previous_baseline_id").alias("baseline_id"))
    # Only segments that hold a previous inventory are read: one name per earlier run.
    needed = superseded.join(earlier.withColumnRenamed("baseline_id", "id"), ["host", "id"], "left_semi").select("segment").distinct()
    previous = store.read_segments([r.segment for r in needed.collect()], _MEMBERS).join(earlier, ["host", "baseline_id"], "left_semi")

    repeated = inventory.duplicate_identities(current).select("host").distinct().withColumn("reason", F.lit("DuplicateIdentity"))
    fields = [F.col("identity_key"), F.col("path"), F.col("fingerprint")]
    digests = inventory.manifest_digest(current, fields)
    recorded = (superseded.join(pairs.select("host", F.col("previous_baseline_id").alias("id")), ["host", "id"], "left_semi")
                .select("host", F.col("manifest_digest").alias("digest")))
    tampered = (inventory.verify_manifest(inventory.manifest_digest(previous, fields), recorded)
                .select("host", F.lit("PriorIntegrity").alias("reason")))
    rejected = repeated.unionByName(tampered)
    if unstable is not None:
        rejected = rejected.unionByName(unstable.select("host", F.lit("Unstable").alias("reason")))
    rejected = rejected.groupBy("host").agg(F.min("reason").alias("invalid_reason"))
    # One row per host, used by the comparison and by the metadata: staged, so guards and digests are computed once.
    judged, verdicts = store.stage("verdicts", runs.select("host").join(rejected, "host", "left").join(digests, "host", "left"), at)

    comparable = pairs.join(verdicts.filter("invalid_reason IS NULL").select("host"), "host", "left_semi")
    changes = inventory.diff(previous.join(comparable, "host", "left_semi"), current.join(comparable, "host", "left_semi"))
    results = changes.join(comparable.select("host", "baseline_id", "previous_baseline_id"), "host").select(
        "host", F.sha2(F.concat_ws("|", "host", "baseline_id", "identity_key"), 256).alias("id"), "baseline_id",
        "previous_baseline_id", F.col("identity_key").alias("identity"), "change", "old_path", "new_path",
        F.lit(as_of_ms).cast("bigint").alias("detected_ms"), F.lit(None).cast("bigint").alias("delivered_ms"),
        F.lit(0).alias("delivery_attempts"), F.lit(0).cast("bigint").alias("revision"))

    valid = F.col("invalid_reason").isNull()
    finished = runs.join(verdicts, "host").select(
        "host", "id", *lineage.LINEAGE, F.when(valid, "Complete").otherwise("Invalid").alias("status"),
        F.lit("Current").alias("applicability"), "started_ms", F.when(valid, F.lit(as_of_ms)).cast("bigint").alias("completed_ms"),
        F.coalesce("item_count", F.lit(0).cast("bigint")).alias("item_count"),
        F.lit(1).alias("observation_passes"), F.lit("").alias("consistency_method"), "invalid_reason",
        F.coalesce(F.col("digest"), F.lit("")).alias("manifest_digest"), F.lit(staged).alias("segment"))
    columns = list(BASELINE_COLUMNS)
    every = superseded.select(*columns).unionByName(finished.select(*columns))
    # Results of this run belong to its own baselines, which stay anyway; only earlier ones can hold metadata back.
    action = lineage.retention(every, current_results(store, at).select("host", "baseline_id", "delivered_ms"), generations,
                               ["host", *lineage.LINEAGE])
    return store.commit(append={"results": results}, adopt={"members": staged}, keep={"verdicts": [judged]},
                        replace={"baselines": action.filter((F.col("action") != "delete") | (F.col("segment") == staged)).select(*columns)},
                        writer=name, batch_id=as_of_ms)


def reconcile_files(store: StateStore, passes: DataFrame, runs: DataFrame, as_of_ms: int, area: Scope | None = None,
                    name: str = "files") -> int:
    """File inventory run: scope each observation pass, take the first two that agree, compare."""
    scoped = scoped_files(passes, area) if area else passes
    key = F.col("identity_key") if "identity_key" in scoped.columns else F.upper("identity")
    observed = scoped.select("host", "pass", key.alias("identity_key"), "path",
                             inventory.fingerprint_hash(scoped).alias("fingerprint"))
    # Agreement is one row per host; staged, the passes are compared once and then read once to pick the members.
    _, agreement = store.stage("agreements", inventory.convergence(observed))
    members = agreed_members(observed, agreement)
    return reconcile(store, members, runs, as_of_ms, agreement.filter("unstable"), name=name)


def reconcile_registry(store: StateStore, keys: DataFrame, values: DataFrame, runs: DataFrame, as_of_ms: int,
                       included: DataFrame, excluded: DataFrame, sids: DataFrame, name: str = "registry") -> int:
    """Registry inventory run: roots of all loaded users without overlaps, one observation pass, compare."""
    roots = scope.remove_overlaps(scope.expand_current_user(included, sids), ["host"])
    members = scope.filter_registry(tables.registry_members(keys, values), "path", roots, excluded, ["host"])
    return reconcile(store, inventory.with_identity(members), runs, as_of_ms, name=name)


def live_file_changes(notifications: DataFrame, activity: DataFrame, facts: DataFrame, collapsed: bool = False) -> DataFrame:
    """Changes of a batch of notifications: collapsed, attributed, with what was observed at the path.

    ``collapsed`` says that :func:`fleetseal.streaming.bursts.collapse_stream` already ran upstream, which also handles
    windows that spread over two micro-batches.

    ``activity`` carries the process outcome (status, missing_reason, process_name), ``facts`` is (host, seq,
    current_hash, current_size_bytes, acls, object_type).
    """
    kept = notifications
    if not collapsed:
        windowed = notifications.withColumn("win", bursts.fixed_window(F.col("captured_ms")))
        kept = bursts.collapse(windowed, ["host", "win"])
    kept = kept.withColumn("path_key", F.upper("full_path"))
    seen = kept.select("host", "path_key", F.col("captured_ms").alias("t_ms"), "seq", "full_path", "category", "old_path", "new_path", "scope")
    more = [c for c in ("process_id", "process_sequence_number", "username", "user_sid") if c in activity.columns]
    evidence = ["status", "missing_reason", "process_name", *more]
    io = activity.select("host", F.upper("path").alias("path_key"), "t_ms", F.col("seq").alias("io_seq"), *evidence)
    found = attribution.attribution_fields(attribution.attribute_files(seen, io, ["host", "path_key"], ["t_ms", "io_seq"], evidence))
    identity = F.sha2(F.concat_ws("|", "host", F.col("seq").cast("string"), "full_path"), 256)
    return (found.join(facts, ["host", "seq"], "left")
            .select("host", identity.alias("id"), "seq", "t_ms", F.col("full_path").alias("entity"), "full_path",
                    F.col("category").alias("change_category"), "old_path", "new_path",
                    F.coalesce("current_hash", F.lit("")).alias("current_hash"), "current_size_bytes",
                    F.coalesce("acls", F.lit("")).alias("acls"), F.coalesce("object_type", F.lit("Unknown")).alias("object_type"),
                    "attribution_status", "attribution_method", "attribution_confidence", "attribution_missing_reason",
                    "attribution_source_ms", "process_name", *more))


def live_registry_changes(trace: DataFrame, included: DataFrame, excluded: DataFrame, own_pid: int = -2,
                          clears: DataFrame | None = None, facts: DataFrame | None = None,
                          widths: Sequence[int] = (HOUR_MS, 1000 * HOUR_MS)) -> DataFrame:
    """Changes of a batch of registry trace rows: handles resolved, named, in scope, categorised, with evidence.

    ``facts`` is what was read at the key: (host, seq, kind, text_value, int_value, data, items, acls,
    unavailable_reason, partial_reason).
    """
    resolved = attribution.resolve_handles(tables.handle_operations(trace), clears, ["t_ms", "seq"], widths)
    named = attribution.registry_actors(tables.registry_names(resolved), "entity", own_pid)
    kept = scope.filter_registry(named, "entity", included, excluded)
    category = registry.opcode_category(F.col("opcode"))
    if facts is None:
        evidence = {"acls": F.lit(""), "value_data": F.lit(None).cast("string"), "evidence_status": F.lit("Available"),
                    "evidence_missing_reason": F.lit(None).cast("string")}
    else:
        kept = kept.join(facts, ["host", "seq"], "left")
        shown = registry.render_value(F.col("kind"), F.col("text_value"), F.col("int_value"), F.col("data"), F.col("items"))
        gone, partial = F.col("unavailable_reason"), F.col("partial_reason")
        evidence = {
            "acls": F.coalesce("acls", F.lit("")),
            "value_data": F.when((category != "Deleted") & (F.col("value_name") != "") & gone.isNull(), shown),
            "evidence_status": live_evidence_status(gone, partial),
            "evidence_missing_reason": live_evidence_reason(partial, gone)}
    status = F.when(F.col("process_name").isNotNull(), "Attributed").otherwise("Unavailable")
    identity = F.sha2(F.concat_ws("|", "host", F.col("seq").cast("string"), "entity"), 256)
    return kept.select(
        "host", identity.alias("id"), "seq", "t_ms", "entity", category.alias("change_category"),
        registry.parse_hive(F.col("entity")).alias("hive"), registry.strip_full_name(F.col("entity"), F.col("value_name")).alias("key_name"),
        "value_name", "process_id", "process_name", status.alias("attribution_status"), F.col("t_ms").alias("attribution_source_ms"),
        *[v.alias(k) for k, v in {**evidence, **attribution.registry_attribution(status)}.items()])


def current_results(store: StateStore, at: Snapshot | None = None) -> DataFrame:
    """Newest revision of every reconciliation result."""
    return latest_by(store.read("results", _RESULTS, at), ["host", "id"], [F.col("revision")])


def publish_baseline_findings(store: StateStore, as_of_ms: int, limit: int | None = None) -> int:
    """Move pending reconciliation results into the outbox and append their new state, in one commit.

    A result whose baseline is unknown, or whose event is not in the catalog, stays pending. ``limit`` bounds a call per host.
    """
    at = store.snapshot()
    _, batch = store.stage("publishing", outbox.pending_results(current_results(store, at), limit), at)
    valid, _ = findings.catalog_gate(findings.baseline_findings(batch, store.read("baselines", _BASELINES, at)))
    sent = valid.select("host", F.col("record_id").alias("id"), F.lit(True).alias("__ok"))
    marked = outbox.record_attempts(batch.join(sent, ["host", "id"], "left_semi"), F.lit(True), as_of_ms)
    revised = marked.withColumn("revision", F.col("revision") + 1).select(*batch.columns)
    return store.commit(append={"outbox": pipelines.admit_new(store, valid, at=at), "results": revised})


def deliver_outbox(store: StateStore, sink: str, as_of_ms: int, limit: int | None = None, fails: Column | None = None) -> int:
    """Deliver until nothing is due: each round writes due records, then appends their new state as a revision.

    Every round has a folder of its own in the sink, named by the transaction that closes it. A record whose id and type the
    catalog does not allocate to each other fails like one the sink rejects, and is due again after its back-off. ``limit`` is
    the size of a round per host, for a sink that takes no more at once. ``fails`` marks records whose write is known
    to fail. Returns the last transaction, -1 if nothing was due.
    """
    last = -1
    while True:
        at = store.snapshot()
        _, ready = store.stage("deliveries", outbox.ready_batch(pipelines.current_outbox(store, at), as_of_ms, limit), at)
        if ready.isEmpty():
            return last
        allocated = F.coalesce(is_allocated(F.col("event_id"), F.col("record_type")), F.lit(False))
        outcome = allocated if fails is None else allocated & ~F.coalesce(fails, F.lit(False))
        error = F.when(~allocated, "NotAllocated").otherwise("SinkError")
        state = outbox.apply_delivery(ready, outcome, error, as_of_ms).withColumn("revision", F.col("revision") + 1)
        sinks.deliver(ready.filter(outcome).select(
            "host", "schema_version", "event_id", "record_type", "occurred_ms", F.col("id").alias("record_id"), "scope_hash", "fields", "error"),
            sink, at.txn + 1)
        last = store.commit(append={"outbox": state.select(*ready.columns)})


def ingest_audit(store: StateStore, records: DataFrame, scopes: Sequence[str]) -> int:
    """Audit records of declared scopes become attribution findings."""
    parsed = attribution.parse_audit(records)
    kept = scope.audit_scope(parsed, "scope_name", scopes)
    return store.commit(append={"outbox": pipelines.admit_new(store, findings.audit_findings(kept))})


def discover(found: DataFrame, area: Scope, projection: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries not known yet or with another hash, statistics per host) of a full listing.

    ``found`` is (host, path, attributes, content_hash), ``projection`` is (host, entity, content_hash).
    """
    plain = found.filter(discovery.is_plain_file(F.col("attributes")))
    scoped = scope.select_paths(plain, "path", area.monitored, area.excluded, area.suffixes)
    fresh = discovery.new_entities(scoped, projection)
    keyed = fresh.withColumn("normalized_entity", F.upper("path"))
    known = projection.select("host", F.upper("entity").alias("normalized_entity"), "content_hash")
    changed = discovery.hash_changed(keyed, known, ["host", "normalized_entity"])
    marks = found.join(fresh.select("host", "path").withColumn("__kept", F.lit(True)), ["host", "path"], "left")
    return changed, discovery.statistics(marks, F.coalesce("__kept", F.lit(False)), ["host"])


def health_report(log: DataFrame, store: StateStore, as_of_ms: int, interval_ms: int = health.HEARTBEAT_MS,
                  snapshots: DataFrame | None = None, storage: DataFrame | None = None, settings: DataFrame | None = None,
                  checks: DataFrame | None = None, snapshot_interval_ms: int = 21_600_000) -> DataFrame:
    """Heartbeat, gap, recovery and configuration records of a pipeline log, as findings.

    ``snapshots`` is run health per (host, source), ``settings`` the generation changes with ``t_ms``, ``checks`` the
    inventory checks of :func:`fleetseal.operators.health.overdue_transitions` per (host, source).
    """
    counters = health.pipeline_counters(log, interval_ms)
    beats = counters.withColumn("t_ms", F.col("window_ms") + interval_ms)
    records = [findings.heartbeats(beats, snapshots, outbox.backlog(pipelines.current_outbox(store), as_of_ms), storage)]
    records.append(findings.coverage_gaps(beats.filter("dropped > 0").withColumns({
        "source": F.lit("FileSystemWatcher"), "scope": F.lit("ConfiguredPaths"), "reason": F.lit("CaptureQueueFull"),
        "lost_count": F.col("dropped")})))
    if checks is not None:
        moved = health.overdue_transitions(checks, ["host", "source"], ["t_ms"], snapshot_interval_ms)
        records.append(findings.overdue_records(moved, F.concat("source", F.lit("Snapshot"))))
    if settings is not None:
        records.append(findings.configuration_changes(settings))
    return findings.unify(*records)


def migrate(legacy_baselines: DataFrame, legacy_changes: DataFrame, store: StateStore) -> int:
    """Decode legacy baselines and remove case duplicates from a projection, once."""
    if store.is_committed("migration", 1):
        return -1
    projected = dedupe_projection(legacy_changes).withColumns({"present": F.lit(True), "batch_id": F.lit(-1).cast("bigint")})
    return store.commit(append={"fs_changes": projected, "legacy_baselines": migration.decode_baselines(legacy_baselines)},
                        writer="migration", batch_id=1)


def collect_member_segments(store: StateStore) -> int:
    """Give up member segments no retained baseline needs. Metadata only: no member is read or rewritten."""
    needed = {r.segment for r in store.read("baselines", _BASELINES).select("segment").distinct().collect()}
    return store.commit(keep={"members": [s for s in store.segments("members") if s in needed]})


def run_on_batches(notify: Callable[[DataFrame], DataFrame],
                   write_changes: Callable[[StateStore, DataFrame, int], None] = pipelines.write_file_changes,
                   ) -> Callable[[StateStore, DataFrame, int], None]:
    """A writer for :func:`fleetseal.streaming.pipelines.start_projection` that first turns raw rows into changes."""
    def write(store: StateStore, batch: DataFrame, batch_id: int) -> None:
        write_changes(store, notify(batch), batch_id)
    return write
