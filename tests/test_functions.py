import pytest
from pyspark.sql import functions as F

from fleetseal.functions import acl, delivery, events, evidence, paths, registry
from fleetseal.schemas import NODE_TYPES, enum_code, enum_name

C = F.col


@pytest.mark.parametrize("root, path, inside", [
    ("C:\\Watch", "C:\\Watch\\evidence.txt", True),
    ("C:\\Watch", "C:\\Watch", True),
    ("C:\\Watch", "C:\\WatchBackup\\evidence.txt", False),
    ("C:\\Watch", "c:\\watch/child\\evidence.txt", True),
    ("C:\\Watch\\", "C:\\Watch\\child", True),
    ("C:\\", "C:\\a", True),
    ("C:\\", "D:\\a", False),
    ("", "C:\\a", False),
    ("C:\\", "  ", False),
])
def test_containment_needs_a_boundary(one, root, path, inside):
    assert one(paths.within(C("p"), root), p=path) is inside
    keys = one(paths.container_keys(C("p")), p=path)
    key = one(paths.root_key(C("p")), p=root)
    assert (key in keys) is inside


def test_ancestors(one):
    assert one(paths.ancestors(C("p")), p="C:\\a\\b/c") == ["C:", "C:\\A", "C:\\A\\B"]
    assert one(paths.ancestors(C("p")), p="x") == []
    assert one(paths.ancestors(C("p")), p="/r/a.txt") == ["/R"]
    assert one(paths.registry_ancestors(C("p")), p="HKLM\\a/b\\c") == ["HKLM", "HKLM\\A/B"]


def test_identity_trims_the_separator_but_not_of_a_drive(one):
    assert one(paths.fs_identity(C("p")), p="c:\\data\\") == "C:\\DATA"
    assert one(paths.fs_identity(C("p")), p="c:\\") == "C:\\"


def test_scope_predicate(one):
    predicate = paths.in_scope(C("p"), ["C:\\w"], ["C:\\w\\x"], [".LOG"])
    assert one(predicate, p="c:\\w\\a.txt") is True
    assert one(predicate, p="c:\\w\\a.log") is False
    assert one(predicate, p="c:\\w\\X\\a.txt") is False


@pytest.mark.parametrize("cached, key, value, expected", [
    ("\\Registry\\Machine\\System\\Pumps", "", "", "HKEY_LOCAL_MACHINE\\System\\Pumps"),
    ("\\REGISTRY\\USER\\S-1-5-19", "Panel", "Colour", "HKEY_USERS\\S-1-5-19\\Panel\\Colour"),
    ("\\registry\\user\\S-1-5-20\\Env", "", "Path", "HKEY_USERS\\S-1-5-20\\Env\\Path"),
    (None, " ", None, ""),
])
def test_full_key_name(one, cached, key, value, expected):
    got = one(registry.full_key_name(C("a").cast("string"), C("b"), C("c").cast("string")), a=cached, b=key, c=value)
    assert got == expected


@pytest.mark.parametrize("full, value, expected", [
    ("HKEY_USERS\\S-1-5-19\\Panel\\(x|y)*", "(x|y)*", "S-1-5-19\\Panel"),
    ("HKEY_USERS\\S-1-5-19\\Panel\\colour", "Colour", "S-1-5-19\\Panel\\colour"),
    ("HKEY_USERS\\Top", "Top", "HKEY_USERS"),
    ("plain", "v", "plain"),
    ("", "v", ""),
])
def test_strip_full_name(one, full, value, expected):
    assert one(registry.strip_full_name(C("f"), C("v")), f=full, v=value) == expected


def test_registry_values(one):
    def render(kind, text=None, number=None, data=None, items=None):
        return one(registry.render_value(F.lit(kind), F.lit(text).cast("string"), F.lit(number).cast("bigint"),
                                         F.lit(data).cast("binary"), F.array(*[F.lit(i) for i in items or []]).cast("array<string>")))
    assert render("Binary", data=bytearray([0, 15, 165, 255])) == "00 0f a5 ff"
    assert render("Binary", data=bytearray()) == ""
    assert render("DWord", number=7) == "7"
    assert render("MultiString", items=["a", "b"]) == "a b"
    assert render("String", text="") is None
    stored = registry.serialise_value(F.lit("MultiString"), F.lit(None).cast("string"), F.lit(None).cast("bigint"),
                                      F.lit(None).cast("binary"), F.array(F.lit("a"), F.lit("b")))
    assert bytes(one(stored)) == b"a\0b"


def test_registry_identity_and_hives(one):
    assert one(registry.registry_identity(C("p"), F.lit(True)), p="HKLM\\a") == "VALUE|HKLM\\A"
    assert one(registry.registry_identity(C("p"), F.lit(False)), p="HKLM\\a") == "KEY|HKLM\\A"
    assert one(registry.parse_hive(C("p")), p="x\\hkey_current_user\\a") == "CurrentUser"
    assert one(registry.parse_hive(C("p")), p="anything") == "Users"
    assert one(registry.opcode_category(F.lit(15))) == "Deleted"
    assert one(registry.opcode_category(F.lit(13))) == "Changed"


def test_enum_codes(one):
    assert one(enum_code(C("n"), NODE_TYPES), n="File") == 0
    assert one(enum_code(C("n"), NODE_TYPES), n="RegistryValue") == 4
    assert one(enum_code(C("n"), NODE_TYPES), n="nothing") is None
    assert one(enum_name(F.lit(1), NODE_TYPES)) == "Directory"


def test_fingerprint_text_and_strict(spark):
    rows = spark.createDataFrame(
        [(4, None, 6, 0, "acl", None), (4, None, 6, 0, "acl", bytearray())],
        "node_type int, content_hash string, hash_state int, acl_state int, acl_evidence string, registry_value_data binary")
    texts = [r.t for r in rows.select(evidence.fingerprint(rows).alias("t")).collect()]
    assert texts[0] == "RegistryValue||NotApplicable|Available|acl|||False|False|False|False||"
    assert texts[0] == texts[1]
    strict = [r.t for r in rows.select(evidence.fingerprint(rows, strict=True).alias("t")).collect()]
    assert strict[0] != strict[1]


def test_hash_state_differs_at_the_cap(one):
    none = F.lit(None).cast("string")
    at_cap = lambda live: one(evidence.hash_state(F.lit(10), F.lit(10), none, F.lit(True), live))
    assert (at_cap(False), at_cap(True)) == (0, 1)
    assert one(evidence.hash_state(F.lit(1), F.lit(10), F.lit("Locked"), F.lit(True))) == 2
    assert one(evidence.hash_state(F.lit(1), F.lit(10), F.lit("Odd"), F.lit(True))) == 5
    assert one(evidence.hash_state(F.lit(1), F.lit(10), none, F.lit(False))) == 6
    assert one(evidence.evidence_state(F.lit("Vanished"))) == 2
    assert one(evidence.live_evidence_status(none, F.lit("x"))) == "Partial"
    assert one(evidence.live_evidence_status(F.lit("KeyNotAvailable"), F.lit("x"))) == "Unavailable"
    assert one(evidence.live_evidence_reason(none, F.lit("b"))) == "b"


def test_backoff_doubles_up_to_256(one):
    assert [one(delivery.backoff_seconds(F.lit(a))) for a in (0, 1, 2, 3, 9, 10, 100)] == [1, 1, 2, 4, 256, 256, 256]


def test_event_ids_and_severity(one):
    assert one(events.finding_event_id(F.lit("Registry"), F.lit("Deleted"))) == 7788
    assert one(events.finding_event_id(F.lit("FileSystem"), F.lit("Discovery"))) is None
    none, no = F.lit(None).cast("string"), F.lit(False)
    assert one(events.log_event_id(F.lit(12), F.lit(True), no, none, none)) == 12
    assert one(events.log_event_id(F.lit(0), F.lit(True), no, none, none)) == 7770
    assert one(events.log_event_id(F.lit(70000), no, F.lit(True), F.lit("fileSystem"), F.lit("DELETED"))) == 7778
    assert one(events.log_event_id(F.lit(0), no, no, F.lit("FileSystem"), F.lit("Created"))) == 7780
    assert one(events.severity(F.lit(7790), F.lit(True))) == "Error"
    assert one(events.severity(F.lit(7794), F.lit(True))) == "Warning"
    assert one(events.is_allocated(F.lit(7776), F.lit("filesystemfinding"))) is False


def test_render_and_parse(one):
    fields = F.map_from_arrays(F.array(F.lit("lostCount"), F.lit("isOpen"), F.lit("note")), F.array(F.lit("42"), F.lit("true"), F.lit(None)))
    text = one(events.render_event(F.lit(1), F.lit(7791), F.lit("CoverageGap"), F.lit(1500).cast("bigint"), F.lit("r"), F.lit("s"), fields))
    assert text.split("\n") == [
        "Schema Version: 1", "Event Id: 7791", "Record Type: CoverageGap", "Occurred At: 1970-01-01T00:00:01.5000000+00:00",
        "Record Id: r", "Scope Hash: s", "Lost Count: 42", "Is Open: true", "Note: None"]
    assert one(events.parse_event(F.lit(text)))["Record Type"] == "CoverageGap"
    assert one(events.parse_event(F.lit("A: b: c")))["A"] == "b: c"


@pytest.mark.parametrize("value", ["first\nRecord Id: forged", "\n", "a\n\tb\n\n", "x: y\nNote: z", "tab\there"])
def test_a_value_with_line_breaks_comes_back_whole(one, value):
    fields = F.map_from_arrays(F.array(F.lit("note")), F.array(F.lit(value)))
    text = events.render_event(F.lit(1), F.lit(7791), F.lit("CoverageGap"), F.lit(0).cast("bigint"), F.lit("r"), F.lit("s"), fields)
    got = one(events.parse_event(text))
    assert got["Note"] == value and got["Record Id"] == "r" and len(got) == 7
    assert one(events.parse_event(F.lit("A: 1\nA: 2"))) == {"A": "1"}


@pytest.mark.parametrize("text, filled", [(None, False), ("", False), (" \t\r\n", False), ("\u00a0\u2003", False), (" x", True), (".", True)])
def test_content_is_more_than_white_space(one, text, filled):
    assert one(paths.has_content(C("t").cast("string")), t=text) is filled


def test_acl_text(one):
    ace = F.struct(F.lit(None).cast("string").alias("identity_name"), F.lit(0x001F01FF).cast("bigint").alias("rights"), F.lit("Allow").alias("ace_type"),
                   F.lit(True).alias("inherited"), F.lit(3).alias("inheritance"), F.lit(0).alias("propagation"))
    none = F.lit(None).cast("string")
    text = one(acl.render_acl(none, none, F.array(ace)))
    assert text == ("Owner: None; PrimaryGroup: None; AceCount: 1; ACE: [Identity: None; Rights: 0x001F01FF; Type: Allow; "
                    "Inherited: true; Inheritance: ObjectInherit|ContainerInherit; Propagation: None]")
    assert one(acl.render_acl(none, none, F.array().cast("array<struct<identity_name:string,rights:bigint,ace_type:string,inherited:boolean,inheritance:int,propagation:int>>"))) == \
        "Owner: None; PrimaryGroup: None; AceCount: 0"
    assert one(acl.acl_changed(none, F.lit("a"))) is False
