import random

import pytest
from pyspark.sql import functions as F

from fleetseal.operators import (attribution, bursts, discovery, findings, health, inventory, lineage, migration, outbox,
                                 projection, scope, settings)
from fleetseal.operators.ordered import Scan, as_of_within, running

MEMBER = "host string, identity_key string, path string, fingerprint string"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# --- ordered scans -------------------------------------------------------------------------------------------------

def test_running_equals_a_sequential_scan_with_a_hot_key(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(5)}", rng.randrange(-50, 400), i, rng.choice([None, rng.randrange(9)]))
            for i in range(600)]
    df = spark.createDataFrame(data, "k string, t bigint, seq bigint, v bigint")
    for inclusive in (True, False):
        got = running(df, ["k"], ["t", "seq"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))},
                      (7, 50), inclusive)
        expected, state = [], {}
        for k, t, seq, v in sorted(data, key=lambda r: (r[1], r[2])):
            before = state.get(k, (None, None, None))
            after = before if v is None else ((before[0] or 0) + v, max(v, before[1] if before[1] is not None else v), v)
            state[k] = after
            expected.append((k, t, seq, v, *(after if inclusive else before)))
        assert rows(got) == sorted(expected, key=repr)


def test_running_since_a_reset(spark):
    rng = random.Random(4)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(3)}", rng.randrange(300), i, rng.randrange(4), rng.random() < 0.1) for i in range(500)]
    df = spark.createDataFrame(data, "k string, t bigint, seq bigint, v bigint, reset boolean")
    for inclusive in (True, False):
        got = running(df, ["k"], ["t", "seq"], {"s": Scan("since", F.col("v"), inclusive, F.col("reset"))}, (9, 80))
        expected, state = [], {}
        for k, t, seq, v, reset in sorted(data, key=lambda r: (r[1], r[2])):
            before = state.get(k, 0)
            state[k] = v if reset else before + v
            expected.append((seq, state[k] if inclusive else before))
        assert rows(got, "seq", "s") == sorted(expected, key=repr)


def test_as_of_join_equals_all_pairs(spark):
    rng = random.Random(2)
    left = [("hot" if rng.random() < 0.5 else "cold", i, rng.randrange(300)) for i in range(150)]
    right = [("hot" if rng.random() < 0.5 else "cold", i, rng.randrange(300)) for i in range(150)]
    got = as_of_within(spark.createDataFrame(left, "k string, id bigint, t bigint"), spark.createDataFrame(right, "k string, rid bigint, t bigint"),
                       ["k"], "t", "t", ["t", "rid"], ["rid"], "m", back=10, ahead=3)
    expected = []
    for k, i, t in left:
        near = [(rt, r) for rk, r, rt in right if rk == k and t - 10 <= rt <= t + 3]
        expected.append((i, max(near)[1] if near else None))
    assert rows(got.select("id", "m.rid")) == sorted(expected, key=repr)


# --- inventories ---------------------------------------------------------------------------------------------------

def members(spark, *items):
    return spark.createDataFrame([("h", k.upper(), k, f) for k, f in items], MEMBER)


def test_diff_reports_created_changed_deleted(spark):
    before, after = members(spark, ("A", "a"), ("B", "b")), members(spark, ("a", "a2"), ("C", "c"))
    assert rows(inventory.diff(before, after), "identity_key", "change", "old_path", "new_path") == [
        ("A", "Changed", "A", "a"), ("B", "Deleted", "B", None), ("C", "Created", None, "C")]
    swapped = {r.identity_key: r.change for r in inventory.diff(after, before).collect()}
    assert swapped == {"A": "Changed", "B": "Created", "C": "Deleted"}
    assert inventory.diff(before, before).count() == 0


def test_first_baseline_reports_nothing_but_an_empty_one_everything(spark):
    current = members(spark, ("A", "a"))
    assert inventory.diff(None, current).count() == 0
    assert rows(inventory.diff(current.limit(0), current), "change") == [("Created",)]


def test_duplicate_identities_reject_the_inventory(spark):
    twice = members(spark, ("A", "a"), ("a", "b"))
    assert rows(inventory.duplicate_identities(twice)) == [("h", "A", 2)]
    with pytest.raises(Exception, match="duplicate identities"):
        inventory.diff(twice, twice).collect()
    assert rows(inventory.diff(twice, members(spark, ("B", "b")), on_duplicate="report"), "identity_key", "change") == [
        ("A", "Duplicate"), ("B", "Created")]


def test_convergence_takes_the_first_two_that_agree(spark):
    data = [("two", p, f) for p, f in ((1, "x"), (2, "x"), (3, "y"))] + [("three", p, f) for p, f in ((1, "a"), (2, "b"), (3, "b"))] + \
           [("never", p, str(p)) for p in (1, 2, 3)]
    passes = spark.createDataFrame([(h, "K", p, f) for h, p, f in data], "host string, identity_key string, pass int, fingerprint string")
    assert rows(inventory.convergence(passes)) == [("never", None, None, True), ("three", 3, 1, False), ("two", 2, 1, False)]
    with pytest.raises(ValueError):
        inventory.convergence(passes, maximum_passes=1)


def test_manifest_digest_ignores_order_and_sees_null_and_count(spark):
    def digest(*values):
        df = spark.createDataFrame([("h", k, v) for k, v in values], "host string, k string, v string")
        return inventory.manifest_digest(df, [F.col("k"), F.col("v")], metadata=[F.lit("S")]).collect()[0].digest

    base = digest(("a", "1"), ("b", "2"))
    assert base == digest(("b", "2"), ("a", "1"))
    assert len({base, digest(("a", "1")), digest(("a", "1"), ("b", None)), digest(("a", "1"), ("b", "")), digest(("a", "1"), ("b", "2"), ("b", "2"))}) == 5


def test_gated_diff_refuses_a_tampered_inventory(spark):
    data = members(spark, ("A", "a"))
    good = inventory.manifest_digest(data, [F.col("path"), F.col("fingerprint")])
    bad = good.withColumn("digest", F.lit("x"))
    assert inventory.gated_diff(data, data, good, good).count() == 0
    with pytest.raises(inventory.IntegrityError):
        inventory.gated_diff(data, data, good, bad)


def test_suspect_deletions_lie_below_a_failed_container(spark):
    changes = spark.createDataFrame([("h", "C:/D/X/F", "Deleted", "C:/d/x/f"), ("h", "C:/E/F", "Deleted", "C:/e/f")],
                                    "host string, identity_key string, change string, old_path string")
    current = spark.createDataFrame([("h", "C:/d", 3), ("h", "C:/e", 0)], "host string, path string, acl_state int")
    assert rows(inventory.flag_suspect_deletions(changes, current), "identity_key", "suspect") == [("C:/D/X/F", True), ("C:/E/F", False)]


# --- lineage -------------------------------------------------------------------------------------------------------

def baselines(spark, *items, host="h"):
    schema = ("host string, id string, source string, scope_hash string, source_identity string, schema_version int, algorithm int, status string, "
              "applicability string, completed_ms bigint")
    return spark.createDataFrame([(host, i, "FileSystem", s, "V", 1, a, st, ap, t) for i, s, a, st, ap, t in items], schema)


def test_lineage_change_leaves_nothing_to_compare_with(spark):
    table = baselines(spark, ("1", "old", 1, "Complete", "Current", 1))
    begun = baselines(spark, ("2", "new", 1, "Building", "Current", 2))
    after = lineage.supersede(table, begun)
    assert rows(after, "id", "applicability") == [("1", "Superseded")]
    assert lineage.latest_complete(after).count() == 0
    assert lineage.latest_complete(table.unionByName(begun)).count() == 1


def test_retention_keeps_two_generations_per_lineage(spark):
    table = baselines(spark, *[(str(i), "s", 1, "Complete", "Current", i) for i in range(1, 5)], ("9", "s", 3, "Complete", "Current", 0),
                      ("b", "s", 1, "Building", "Current", None))
    pending = spark.createDataFrame([("h", "1", None), ("h", "2", 5), ("g", "2", None)], "host string, baseline_id string, delivered_ms bigint")
    assert dict(rows(lineage.retention(table, pending), "id", "action")) == {
        "1": "drop_members", "2": "delete", "3": "keep", "4": "keep", "9": "keep", "b": "delete"}
    # The same ids on another host are other baselines.
    both = table.unionByName(baselines(spark, ("1", "s", 1, "Complete", "Current", 9), ("2", "s", 1, "Invalid", "Current", 1), host="g"))
    assert rows(lineage.retention(both, pending).filter("host = 'g'"), "id", "action") == [("1", "keep"), ("2", "drop_members")]
    assert lineage.retention(both, pending).count() == both.count()


def test_fallback_becomes_current_again(spark):
    table = baselines(spark, ("1", "s", 1, "Complete", "Superseded", 1), ("2", "s", 1, "Complete", "Superseded", 2), ("3", "s", 1, "Building", "Current", None))
    after = lineage.reinstate_fallback(table, table.filter("id = '3'"))
    assert dict(rows(after, "id", "applicability")) == {"1": "Superseded", "2": "Current", "3": "Current"}
    both = table.unionByName(baselines(spark, ("2", "s", 1, "Complete", "Superseded", 5), host="g"))
    other = lineage.reinstate_fallback(both, table.filter("id = '3'")).filter("host = 'g'")
    assert rows(other, "id", "applicability") == [("2", "Superseded")]


def test_pending_results_meet_the_baseline_of_their_own_host(spark):
    from fleetseal.operators import findings
    held = spark.createDataFrame([("g", "1", "FileSystem", "G"), ("h", "1", "Registry", "H")], "host string, id string, source string, scope_hash string")
    results = spark.createDataFrame([("h", "r", "1", "Changed", "X", None, None, 5, None)], "host string, id string, baseline_id string, change string, "
                                    "identity string, old_path string, new_path string, detected_ms bigint, delivered_ms bigint")
    assert rows(findings.baseline_findings(results, held), "host", "scope_hash") == [("h", "H")]


def test_lifecycle_and_run_health(spark):
    log = spark.createDataFrame([("a", 1, "Building"), ("a", 2, "Complete"), ("b", 1, "Building"), ("b", 2, "Reconciling"), ("b", 3, "Complete")],
                                "b string, t bigint, status string")
    assert rows(lineage.lifecycle_violations(log, "b", ["t"], (2,)), "b", "t", "previous_status") == [("a", 2, "Building")]
    runs = spark.createDataFrame([("s", t, ok) for t, ok in enumerate([False, False, True, False, False, False])], "s string, t bigint, ok boolean")
    got = lineage.run_health(runs, ["s"], ["t"], F.col("ok"), ~F.col("ok"), widths=(2, 4))
    assert rows(got, "t", "consecutive_failures", "last_success_ms") == [(0, 1, None), (1, 2, None), (2, 0, 2), (3, 1, 2), (4, 2, 2), (5, 3, 2)]


# --- scope ---------------------------------------------------------------------------------------------------------

def roots(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "root string")


def test_registry_scope(spark):
    names = ["HKEY_USERS\\S-1-5-21\\Software\\Contoso", "HKEY_USERS\\.DEFAULT\\Software\\Contoso", "HKEY_CURRENT_USER\\Software\\Contoso\\x",
             "HKEY_LOCAL_MACHINE\\A\\B", "HKEY_LOCAL_MACHINE\\A\\Skip\\x", "HKEY_LOCAL_MACHINE\\AB", "HKEY_LOCAL_MACHINE\\C", "HKEY_LOCAL_MACHINE\\C\\d"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    kept = scope.filter_registry(df, "name", roots(spark, "hkey_current_user\\software", "HKEY_LOCAL_MACHINE\\A", "HKEY_LOCAL_MACHINE\\C\\", " "),
                                 roots(spark, "HKEY_LOCAL_MACHINE\\A\\SKIP"))
    assert rows(kept) == sorted([(names[0],), (names[2],), (names[3],), (names[7],)], key=repr)


def test_overlapping_roots_keep_siblings(spark):
    got = scope.remove_overlaps(roots(spark, "SOFT", "SOFTWARE", "SOFT\\Child", "soft", "SYSTEM\\", ""))
    assert rows(got) == [("SOFT",), ("SOFTWARE",), ("SYSTEM",)]


def test_current_user_roots_expand_per_loaded_hive(spark):
    r = spark.createDataFrame([("h", "HKEY_CURRENT_USER\\x"), ("h", "HKEY_CURRENT_USER"), ("h", "HKEY_LOCAL_MACHINE\\y"), ("g", "HKEY_CURRENT_USER\\x")], "host string, root string")
    s = spark.createDataFrame([("h", "S-1-5"), ("h", "S-1-5_Classes"), ("h", ".DEFAULT")], "host string, sid string")
    assert rows(scope.expand_current_user(r, s)) == [("h", "HKEY_LOCAL_MACHINE\\y"), ("h", "HKEY_USERS\\S-1-5"), ("h", "HKEY_USERS\\S-1-5\\x")]


def test_pruning_takes_the_subtree_where_the_predicate_would_not(spark):
    m = spark.createDataFrame([("h", "C:\\a\\x.log", 1), ("h", "C:\\a\\x.log\\f.txt", 0), ("h", "C:\\a\\y", 2), ("h", "C:\\a\\y\\z", 0), ("h", "C:\\a\\t", 0)],
                              "host string, path string, node_type int")
    excluded = F.upper("path").endswith(".LOG")
    assert rows(scope.prune_excluded_members(m, excluded), "path") == [("C:\\a\\t",), ("C:\\a\\y",), ("C:\\a\\y\\z",)]
    assert rows(scope.prune_reparse_points(m), "path") == [("C:\\a\\t",), ("C:\\a\\x.log",), ("C:\\a\\x.log\\f.txt",), ("C:\\a\\y",)]


def test_filter_paths_and_first_configured_scope(spark):
    df = spark.createDataFrame([("C:\\w\\a\\f.txt",), ("C:\\w\\b.tmp",), ("C:\\w\\x\\f",), ("D:\\f",)], "path string")
    monitored = spark.createDataFrame([("C:\\w\\a", 2), ("C:\\W", 1)], "root string, ordinal int")
    assert rows(scope.filter_paths(df, "path", monitored, roots(spark, "c:\\w\\X\\"), [".TMP"])) == [("C:\\w\\a\\f.txt",)]
    excluded = roots(spark, "c:\\w\\X\\")
    for inside, outside in ((monitored, excluded), (["C:\\w\\a", "C:\\W"], ["c:\\w\\X\\"]), (monitored, ["c:\\w\\X\\"])):
        assert rows(scope.select_paths(df, "path", inside, outside, [".TMP"])) == [("C:\\w\\a\\f.txt",)]
    assert dict(rows(scope.assign_scope(df, "path", monitored))) == {"C:\\w\\a\\f.txt": "C:\\W", "C:\\w\\b.tmp": "C:\\W", "C:\\w\\x\\f": "C:\\W", "D:\\f": ""}


def test_wildcards_variables_and_redirected_downloads(spark):
    s = spark.createDataFrame([("h", "%SystemDrive%\\Users\\*\\Downloads"), ("h", "C:\\logs\\*"), ("h", "C:\\plain"), ("h", "*bad")], "host string, root string")
    env = spark.createDataFrame([("h", "SYSTEMDRIVE", "C:")], "host string, name string, value string")
    inv = spark.createDataFrame([("h", p, d) for p, d in (
        ("C:\\Users\\Alice", True), ("C:\\Users\\Bob", True), ("C:\\Users\\Bob\\Downloads", True), ("D:\\Redirected", True), ("C:\\logs\\a.txt", False),
        ("C:\\logs\\sub", True), ("C:\\logs\\sub\\b.txt", False))], "host string, path string, is_directory boolean")
    profiles = spark.createDataFrame([("h", "C:\\Users\\Alice", "D:\\Redirected"), ("h", "C:\\Users\\Bob", None), ("h", "C:\\Users\\Carol", "C:\\Missing\\Downloads")],
                                     "host string, profile_path string, downloads string")
    got = scope.resolve_wildcards(scope.expand_environment(s, env), inv, profiles)
    assert rows(got, "root") == [("C:\\Users\\Bob\\Downloads",), ("C:\\logs\\a.txt",), ("C:\\plain",), ("D:\\Redirected",)]


def test_scope_hash_ignores_order_case_and_repeats(spark):
    def digest(*values):
        df = spark.createDataFrame([("h", n, v) for n, v in values], "host string, list_name string, value string")
        return scope.scope_hash(df).collect()[0].scope_hash
    a = digest(("MP", "C:\\b"), ("MP", " c:\\A\\ "), ("XK", "x"))
    assert a == digest(("XK", "X"), ("MP", "C:\\a"), ("MP", "C:\\B"), ("MP", "c:\\b"), ("XP", " "))
    assert a != digest(("XP", "C:\\b"), ("MP", "C:\\A"), ("XK", "x"))


def test_audit_scope_has_no_boundary_and_takes_any_number(spark):
    df = spark.createDataFrame([("C:/S1/f",), ("c:/s10/f",), ("C:/T",), (" ",)], "name string")
    assert rows(scope.audit_scope(df, "name", ["C:/S1"])) == [("C:/S1/f",), ("c:/s10/f",)]
    assert rows(scope.audit_scope(df, "name", [f"x{i}(" for i in range(100)] + ["c:/t"])) == [("C:/T",)]
    assert rows(scope.audit_scope(df, "name", [])) == []


# --- projection ----------------------------------------------------------------------------------------------------

CHANGE = ("host string, id string, seq bigint, t_ms bigint, entity string, change_category string, old_path string, current_hash string, "
          "acls string, size_bytes bigint, object_type string")


def changes(spark, *items):
    return spark.createDataFrame([("h", f"R{i}", i, t, e, c, o, f"hash{i}", f"acl{i}", i, "File") for i, (t, e, c, o) in enumerate(items)], CHANGE)


def test_projection_keeps_the_newest_and_forgets_renamed_paths(spark):
    df = changes(spark, (1, "C:\\Evidence.txt", "Created", None), (2, "c:\\evidence.txt", "Changed", None), (3, "C:\\b", "Changed", "C:\\EVIDENCE.txt"),
                 (4, "C:\\gone", "Deleted", None), (4, "C:\\GONE", "Changed", None))
    assert rows(projection.latest_by_entity(df), "normalized_entity", "id") == [("C:\\B", "R2"), ("C:\\EVIDENCE.TXT", "R1"), ("C:\\GONE", "R3")]
    assert rows(projection.latest_state(df), "normalized_entity", "id") == [("C:\\B", "R2"), ("C:\\GONE", "R3")]


def test_previous_evidence_follows_renames(spark):
    df = changes(spark, (1, "C:\\a", "Created", None), (2, "C:\\b", "Changed", "C:\\A"), (3, "C:\\a", "Created", None), (4, "C:\\B", "Deleted", None))
    got = projection.previous_evidence(df, widths=(2, 4))
    assert rows(got, "id", "previous_hash", "previous_size_bytes") == [("R0", "", None), ("R1", "hash0", 0), ("R2", "", None), ("R3", "hash1", 1)]


def test_previous_acl_is_that_of_the_batch_start(spark):
    df = changes(spark, (1, "K", "Created", None), (2, "k", "Changed", None), (3, "K", "Changed", None), (4, "K", "Changed", None))
    got = projection.previous_acl_by_batch(df, F.floor(F.col("seq") / 2).cast("long"))
    assert rows(got, "id", "previous_acl") == [("R0", ""), ("R1", ""), ("R2", "acl1"), ("R3", "acl1")]


# --- bursts --------------------------------------------------------------------------------------------------------

def fold(window, keep_chain=False):
    """The rule, row by row."""
    out = []
    for row in window:
        seq, category, path, old = row
        if old is not None:
            out = [r for r in out if not (r[1] == "Changed" and r[2].upper() == old.upper() and not (keep_chain and r[3] is not None))]
            out.append(row)
            continue
        if category == "Changed":
            same = [r for r in out if r[2].upper() == path.upper()]
            if same and (same[-1][1] in ("Created", "Changed") or same[-1][3] is not None):
                continue
        out.append(row)
    return out


NOTE = "host string, win bigint, seq bigint, captured_ms bigint, category string, full_path string, old_path string"


def random_notes(seed, windows=60, size=14):
    rng = random.Random(seed)
    data = []
    for w in range(windows):
        for i in range(size):
            rename = rng.random() < 0.3
            category = "Changed" if rename else rng.choice(["Created", "Changed", "Changed", "Deleted"])
            data.append(("h", w, w * size + i, w * 75 + i, category, rng.choice("abAc"), rng.choice("abc") if rename else None))
    return data


@pytest.mark.parametrize("chain", [False, True])
def test_collapse_equals_the_row_by_row_rule(spark, chain):
    data = random_notes(3)
    expected = []
    for w in {d[1] for d in data}:
        expected += [r[0] for r in fold([(d[2], d[4], d[5], d[6]) for d in data if d[1] == w], chain)]
    got = bursts.collapse(spark.createDataFrame(data, NOTE), ["host", "win"], keep_rename_chain=chain)
    assert [r[0] for r in rows(got, "seq")] == [r[0] for r in sorted([(s,) for s in expected], key=repr)]


def test_collapse_cases(spark):
    def kept(*items):
        df = spark.createDataFrame([("h", 0, i, i, c, p, o) for i, (c, p, o) in enumerate(items)], NOTE)
        return [r[0] for r in rows(bursts.collapse(df, ["host", "win"]), "seq")]
    assert kept(("Created", "a", None), ("Changed", "A", None), ("Changed", "a", None)) == [0]
    assert kept(("Created", "a", None), ("Deleted", "a", None)) == [0, 1]
    assert kept(("Changed", "a", None), ("Changed", "b", "a"), ("Changed", "b", None)) == [1]
    assert kept(("Changed", "b", "a"), ("Changed", "c", "b")) == [1]


def test_rename_halves(spark):
    pairs = spark.createDataFrame([(1, "in/a", "in/b"), (2, "in/a", "out/b"), (3, "out/a", "in/b"), (4, None, "in/b"), (5, "out/a", None)],
                                  "seq bigint, old_path string, new_path string")
    got = bursts.normalize_renames(pairs, F.col("old_path").startswith("in"), F.col("new_path").startswith("in"))
    assert rows(got, "seq", "category", "full_path", "old_path") == [
        (1, "Changed", "in/b", "in/a"), (2, "Deleted", "in/a", None), (3, "Created", "in/b", None), (4, "Created", "in/b", None)]


def test_admission_counts_what_is_shed(spark):
    df = spark.createDataFrame([("h", 0, i) for i in range(5)] + [("h", 1, 9)], "host string, win bigint, t_ms bigint")
    assert rows(bursts.admission_gaps(df, ["host", "win"], capacity=3), "win", "admitted", "lost_count") == [(0, 3, 2)]


# --- attribution ---------------------------------------------------------------------------------------------------

def test_process_identity_needs_the_sequence(spark):
    inst = spark.createDataFrame([("h", 321, 100, 0, 50, "first.exe"), ("h", 321, 101, 50, None, "second.exe")],
                                 "host string, pid int, seq bigint, start_ms bigint, end_ms bigint, process_name string")
    io = spark.createDataFrame([("h", 321, 100, 10), ("h", 321, 101, 60), ("h", 321, 99, 60), ("h", 321, None, 60), ("h", 321, 100, 50)],
                               "host string, pid int, seq bigint, t_ms bigint")
    got = attribution.resolve_process(io, inst, ["host"])
    assert rows(got, "seq", "t_ms", "resolved_name", "missing_reason") == sorted([
        (100, 10, "first.exe", None), (101, 60, "second.exe", None), (99, 60, None, "ProcessInstanceNotFound"),
        (None, 60, None, "ProcessSequenceNumberMissing"), (100, 50, None, "ProcessInstanceNotFound")], key=repr)
    early = attribution.resolve_process(io.filter("seq IS NULL"), inst, ["host"], rundown=F.lit(False))
    assert rows(early, "status", "missing_reason") == [("RundownMissing", "ProcessRundownMissing")]


def test_process_intervals_and_rundown(spark):
    df = spark.createDataFrame([("h", "DCStart", 1, None, 5, 1, "x"), ("h", "DCStart", 1, 7, 6, 2, "x"), ("h", "Stop", 1, 7, 9, 3, None), ("h", "Stop", 2, 8, 9, 4, None)],
                               "host string, opcode string, process_id int, process_sequence_number bigint, t_ms bigint, seq bigint, process_name string")
    df = df.withColumns({"process_sequence_number": F.col("process_sequence_number").cast("decimal(20,0)"), "username": F.lit("u"), "user_sid": F.lit("s")})
    assert rows(attribution.process_intervals(df), "process_id", "start_ms", "end_ms", "process_name") == [(1, 6, 9, "x")]
    assert rows(attribution.rundown_times(df)) == [("h", 6)]


def test_handles_follow_binds_removals_and_losses(spark):
    data = [(1, 5, "create", "K1"), (2, 5, "use", None), (3, 5, "delete", None), (4, 5, "use", None), (5, 5, "create", "K2"), (7, 5, "use", None),
            (8, 0, "create", "Z"), (9, 0, "use", None), (10, 6, "create", "K6"), (11, 6, "create", ""), (12, 6, "use", None)]
    df = spark.createDataFrame([("h", *d) for d in data], "host string, seq bigint, handle bigint, op string, path string")
    assert rows(attribution.resolve_handles(df, widths=(3, 6)), "seq", "resolved_path") == sorted(
        [(2, "K1"), (4, None), (7, "K2"), (9, None), (12, "K6")], key=repr)
    clears = spark.createDataFrame([("h", 6)], "host string, seq bigint")
    assert rows(attribution.resolve_handles(df, clears, widths=(3, 6)), "seq", "resolved_path") == sorted(
        [(2, "K1"), (4, None), (7, None), (9, None), (12, "K6")], key=repr)


def test_accounts_prefer_the_local_name(spark):
    sids = spark.createDataFrame([("a",), ("b",), ("c",)], "sid string")
    local = spark.createDataFrame([("a", "LOCAL"), ("b", " ")], "sid string, account string")
    named = spark.createDataFrame([("a", "D\\a"), ("b", "D\\b")], "sid string, account string")
    assert rows(attribution.resolve_accounts(sids, local, named)) == [("a", "LOCAL"), ("b", "D\\b"), ("c", "c")]


def test_audit_xml_last_value_wins_in_both_layouts(spark):
    flat = '<Event><Data Name="ObjectName">C:/a</Data><Data Name="NewValue">1</Data><Data Name="newvalue">2</Data></Event>'
    nested = '<Event><System/><EventData><Data Name="KeyName">K</Data><Data Name="SubjectUserSid">S</Data></EventData></Event>'
    df = spark.createDataFrame([("h", "1", 4663, flat), ("h", "2", 4657, nested), ("h", "3", 1, flat)], "host string, record_id string, native_event_id int, xml string")
    got = attribution.parse_audit(df)
    assert rows(got, "record_id", "object_name", "new_value", "subject_user_sid", "scope_name") == [("1", "C:/a", "2", None, "C:/a"), ("2", "K", None, "S", "K")]


def test_actor_filters(spark):
    df = spark.createDataFrame([(4, "FileIO", "Write", "p"), (0, "FileIO", "Write", "p"), (4, "FileIO", "Read", "p"), (9, "FileIO", "Write", "p"), (4, "FileIO", "Create", " ")],
                               "process_id int, task string, opcode string, path string")
    assert attribution.file_mutations(df, own_pid=9).count() == 1


# --- findings, delivery, health, settings, discovery, migration ----------------------------------------------------

def test_discovery_rows_are_no_findings_and_renames_are_named(spark):
    df = changes(spark, (1, "b", "Changed", "a"), (2, "c", "Discovery", None)).withColumn("new_path", F.lit("b"))
    got = findings.file_findings(df).collect()
    assert len(got) == 1 and got[0].event_id == 7777
    assert (got[0].fields["operation"], got[0].fields["renameCorrelationConfidence"], len(got[0].fields)) == ("RenamedOrMoved", "Low", 24)
    reg = findings.registry_findings(changes(spark, (1, "K", "Deleted", None))).collect()[0]
    assert (reg.event_id, reg.fields["operation"], len(reg.fields)) == (7788, "Deleted", 19)


def test_gates(spark):
    df = spark.createDataFrame([(0, 7790, "Health"), (1, 7790, "Health"), (2, 7790, "Health"), (1, 7790, "CoverageGap")], "schema_version int, event_id int, record_type string")
    ok, bad = findings.version_gate(df)
    assert (ok.count(), bad.count()) == (2, 2)
    ok, bad = findings.catalog_gate(df)
    assert (ok.count(), bad.count()) == (3, 1)


def test_service_event_ids_are_stable(spark):
    df = spark.createDataFrame([("h", 5)], "host string, t_ms bigint")
    ids = {findings.service_events(df, 7791, {"source": F.lit("x")}).collect()[0].record_id for _ in range(2)}
    assert len(ids) == 1


BOX = ("host string, id string, record_type string, created_ms bigint, next_attempt_ms bigint, delivered_ms bigint, delivery_attempts int, "
       "last_error string, bad boolean")


def test_delivery_round(spark):
    box = spark.createDataFrame([("h", "ok", "Health", 1, 0, None, 0, "old", False), ("h", "fail", "Health", 2, 0, None, 1, None, True),
                                 ("h", "blank", " ", 3, 0, None, 0, None, False), ("h", "later", "Health", 4, 99999, None, 0, None, False)], BOX)
    assert [r.id for r in outbox.ready_batch(box, 1000, 2).orderBy("created_ms").collect()] == ["ok", "fail"]
    after = outbox.apply_delivery(box, ~F.col("bad"), F.lit("IOException"), 1000)
    assert rows(after, "id", "delivery_attempts", "delivered_ms", "next_attempt_ms", "last_error") == [
        ("blank", 1, 1000, 0, "EmptyRecordType"), ("fail", 2, None, 3000, "IOException"), ("later", 0, None, 99999, None), ("ok", 1, 1000, 0, None)]


def test_retention_keeps_pending_and_recent(spark):
    day = outbox.DAY_MS
    box = spark.createDataFrame([("h", "old", 70 * day), ("h", "new", 99 * day), ("h", "pending", None)], "host string, id string, delivered_ms bigint")
    assert rows(outbox.retain(box, 100 * day), "id") == [("new",), ("pending",)]
    assert rows(outbox.retain(box, 100 * day, 0), "id") == [("new",), ("pending",)]


def test_admission_is_once_per_id(spark):
    new = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "id string, seq bigint, v string")
    assert rows(outbox.admit(new, new.filter("id = 'b'"))) == [("a", 1, "x")]


def test_health_alerts(spark):
    beats = spark.createDataFrame([("h", 0, 0, 0, 0), ("h", 60, 0, 0, 0), ("h", 300, 2, 0, 70)], "host string, t_ms bigint, dropped bigint, enrichment_failures bigint, oldest_age_ms bigint")
    got = health.heartbeat_gaps(beats, 60, 1000, (100,))
    assert rows(got, "t_ms", "reason", "amount") == [(300, "Dropped", 2), (300, "MissingHeartbeat", 240), (300, "MissingHeartbeat", 700), (300, "QueueAge", 70)]
    counters = spark.createDataFrame([("h", 1, 0), ("h", 2, 3), ("h", 3, 3), ("h", 4, 5)], "host string, t bigint, lost bigint")
    assert rows(health.loss_deltas(counters, ["host"], ["t"], "lost", (2,)), "t", "lost_count") == [(2, 3), (4, 2)]


def test_overdue_is_reported_on_the_edge_only(spark):
    checks = spark.createDataFrame([("h", t, s, 0) for t, s in ((5, None), (15, None), (20, None), (30, 30), (45, None), (51, None), (60, None), (70, 70))],
                                   "host string, t_ms bigint, success_ms bigint, started_ms bigint")
    got = health.overdue_transitions(checks, ["host"], ["t_ms"], 10, (7, 20))
    assert rows(got, "t_ms", "record_type") == [(15, "CoverageGap"), (30, "SourceRecovered"), (51, "CoverageGap"), (70, "SourceRecovered")]


def test_requests_coalesce_until_the_next_run(spark):
    asked = spark.createDataFrame([("h", "s", 1, "first"), ("h", "s", 2, "second"), ("h", "s", 11, "third")], "host string, source string, t_ms bigint, reason string")
    runs = spark.createDataFrame([("h", "s", 10)], "host string, source string, t_ms bigint")
    assert rows(health.coalesce_requests(asked, runs, widths=(5,)), "run_number", "reason", "requests") == [(0, "first", 2), (1, "third", 1)]


def test_settings_precedence_and_reports(spark):
    layer = lambda *v: spark.createDataFrame([("h", n, x) for n, x in v], "host string, name string, value string")
    got = settings.effective(layer(("a", "p"), ("b", None)), layer(("a", "q"), ("b", "q")), layer(("c", "l")))
    assert rows(got) == [("h", "a", "p", "policy"), ("h", "b", "q", "preference"), ("h", "c", "l", "legacy")]
    lists = spark.createDataFrame([("h", "MonitoredPaths", "C:\\ok"), ("h", "ExcludedPaths", ""), ("h", "MonitoredKeys", "HKLM\\x"),
                                   ("h", "ExcludedKeys", "HKEY_LOCAL_MACHINE\\software")], "host string, list_name string, value string")
    bad = settings.validate(lists, spark.createDataFrame([("h",), ("g",)], "host string"))
    assert rows(bad, "host", "list_name", "reason") == [
        ("g", "MonitoredKeys", "no-values"), ("g", "MonitoredPaths", "no-values"),
        ("h", "ExcludedKeys", "hides-settings"), ("h", "MonitoredKeys", "unknown-hive")]


def test_variables_are_expanded_before_a_path_is_judged(spark):
    lists = spark.createDataFrame([("h", "MonitoredPaths", "%BASE%\\x"), ("h", "ExcludedPaths", "%none%\\x"), ("h", "MonitoredKeys", "HKEY_USERS\\a")],
                                  "host string, list_name string, value string")
    known = spark.createDataFrame([("h", "base", "D:\\root")], "host string, name string, value string")
    got = settings.validate(lists, spark.createDataFrame([("h",)], "host string"), environment=known)
    assert rows(got, "value", "reason") == [("%none%\\x", "not-absolute")]


@pytest.mark.parametrize("path, fine", [("relative\\path", False), ("C:\\Us*ers\\x", False), ("C:\\Users\\*\\*\\x", False), ("", False),
                                        ("C:\\Users\\*\\x", True), ("\\\\server\\share\\x", True), ("C:\\a?b", False)])
def test_path_problems(one, path, fine):
    assert (one(settings.path_problem(F.col("p")), p=path) is None) is fine


@pytest.mark.parametrize("key, fine", [("HKLM\\x", False), ("HKEY_USERS\\*\\x", False), ("", False), ("hkey_users\\x", True), ("HKEY_USERSX", False)])
def test_key_problems(one, key, fine):
    assert (one(settings.key_problem(F.col("k")), k=key) is None) is fine


def test_discovery(spark):
    found = spark.createDataFrame([("h", "C:\\a", 0x20), ("h", "C:\\b", 0x24)], "host string, path string, attributes int")
    assert rows(found.filter(discovery.is_plain_file(F.col("attributes"))), "path") == [("C:\\a",)]
    stats = discovery.statistics(found.limit(0), F.lit(True)).collect()[0]
    assert (stats.total, stats.percentage) == (0, 0.0)


def test_legacy_rows(spark):
    legacy = spark.createDataFrame([("1", "registry-v1", "Complete", "0A", "AQI="), ("2", "sha256-v1", "Complete", None, None)],
                                   "id string, algorithm_version string, status string, integrity_manifest_hash string, integrity_public_key string")
    got = {r.id: r for r in migration.decode_baselines(legacy).collect()}
    assert (got["1"].algorithm, got["1"].status, bytes(got["1"].integrity_manifest_hash), bytes(got["1"].integrity_public_key)) == (2, "Invalid", b"\n", b"\x01\x02")
    assert (got["2"].algorithm, got["2"].status) == (1, "Complete")
    with pytest.raises(Exception, match="unsupported legacy"):
        migration.decode_baselines(legacy.withColumn("algorithm_version", F.lit("md5"))).collect()
