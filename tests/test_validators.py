"""Each rule set on tables that break every rule once, and on clean ones."""

import hashlib
import time
from collections import Counter

import pytest

from kgspark.operators import validators as v


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def broken(df):
    return Counter((r["rule"], r["subject"]) for r in df.collect())


def rules_of(df):
    return Counter(r["rule"] for r in df.collect())


LINK = "id string, setup string, src string, dst string, medium string, status string, confirmed string"
ITEM = "id string, in_use boolean, hp int, format string, has_specs boolean, kind string"
CASE = "setup string, id string, supply string, mounted array<string>, rows array<struct<format:string,hp:int>>"
PLACE = "setup string, module string, case string, powered_by string, row_index int, position int, status string, confirmed string"


def test_links(frame):
    items, setups = frame([("a",), ("b",)], "id string"), frame([("live",)], "id string")
    good = [("l1", "live", "a", "b", "audio", "confirmed", "2025-01-02"), ("l2", None, "a", None, "midi", "unconfirmed", None)]
    assert rules_of(v.links(frame(good, LINK), items, setups)) == {"link unconfirmed": 1}
    bad = [("x1", "live", "zz", "b", "audio", "confirmed", "d"), ("x2", "live", "a", "zz", "audio", "confirmed", "d"), ("x3", "home", "a", "b", "audio", "confirmed", "d"), ("x4", "live", "a", "b", "light", "confirmed", "d"), ("x5", "live", "a", "b", "cv", "maybe", "d"), ("x6", "live", "a", "b", "cv", "confirmed", None)]
    assert broken(v.links(frame(bad, LINK), items, setups)) == {("link src is no item", "x1"): 1, ("link dst is no item", "x2"): 1, ("link setup unknown", "x3"): 1, ("link medium", "x4"): 1, ("link status", "x5"): 1, ("confirmed link without date", "x6"): 1}


def test_cases(frame):
    items, setups = frame([("rack",), ("psu",), ("m",), ("box",)], "id string"), frame([("live", "box"), ("old", "gone")], "id string, interface string")
    good = frame([("live", "rack", "psu", ["m"], None)], CASE)
    assert rules_of(v.cases(good, setups.where("id = 'live'"), items)) == {}
    bad = frame([("home", "rack", "psu", [], None), ("live", "shed", "psu", [], None), ("live", "rack", "sun", ["ghost"], None), ("live", "rack", "psu", None, None)], CASE)
    assert rules_of(v.cases(bad, setups, items)) == {"setup interface is no item": 1, "case setup unknown": 1, "case is no item": 1, "case supply is no item": 1, "mounted item unknown": 1, "case recorded twice": 1}


def world(frame):
    items = frame([("m1", True, 10, "3U", True, "module"), ("m2", True, 90, "3U", True, "module"), ("m3", False, None, "1U", True, "module"), ("m4", True, 8, "3U", True, "module"), ("m5", True, 4, "3U", False, "module"), ("m6", True, 800, "2U", False, "module"), ("psu", True, None, None, True, "supply")], ITEM)
    cases = frame([("live", "rack", "psu", ["m1", "m3"], [("1U", 84), ("3U", 84)])], CASE)
    return items, cases


def test_placements(frame):
    items, cases = world(frame)
    good = frame([("live", "m1", "rack", "psu", 2, 0, "confirmed", "d"), ("live", "m4", "rack", None, None, None, "unconfirmed", None)], PLACE)
    assert rules_of(v.placements(good, cases, items)) == {} and rules_of(v.rows(good, cases, items)) == {}
    assert rules_of(v.capacity(good, cases.withColumn("mounted", v.F.array(v.F.lit("m1"))), items.where("id <> 'm2'"))) == {}
    bad = frame([("live", "zz", "rack", "psu", 0, 0, "confirmed", "d"), ("live", "m1", "tent", "psu", 0, 1, "confirmed", "d"), ("live", "m2", "rack", "sun", 5, 1, "confirmed", "d"), ("live", "m3", "rack", "psu", 1, 3, "odd", "d"), ("live", "m2", "rack", "psu", 1, 3, "confirmed", None), ("live", "m4", "rack", "psu", -1, 9, "unconfirmed", None)], PLACE)
    assert rules_of(v.placements(bad, cases, items)) == {"placed module unknown": 1, "placement case unknown": 1, "powered by another supply": 1, "placement status": 1, "confirmed placement without date": 1, "placed but not in use": 1, "placed without width": 1}


def test_rows_are_counted_from_one(frame):
    items, cases = world(frame)
    put = lambda module, row, position: ("live", module, "rack", "psu", row, position, "confirmed", "d")
    one = frame([put("m1", 2, 1), put("m5", 0, 1), put("m4", None, 1)], PLACE)
    assert rules_of(v.rows(one, cases, items)) == {}
    bad = frame([put("m2", 3, 1), put("m1", 1, 3), put("m4", 2, 3), put("m5", 2, 3), put("m3", 9, 1), put("m6", -1, 1)], PLACE)
    assert broken(v.rows(bad, cases, items)) == {("row out of bounds", "live/m2"): 1, ("row out of bounds", "live/m6"): 1, ("row of another format", "live/m1"): 1, ("position taken twice", "live/rack/2/3"): 1}
    own = bad.where("module = 'm1'").withColumn("row", v.F.lit("1U"))  # the placement's own format goes before the item's
    assert rules_of(v.rows(own, cases, items)) == {}


def test_capacity_of_rows_and_formats(frame):
    items, cases = world(frame)
    put = lambda module, row, box="rack": ("live", module, box, "psu", row, None, "confirmed", "d")
    two = cases.union(frame([("home", "bag", "psu", [], [("3U", 84)])], CASE))
    bad = frame([put("m2", 2), put("m2", None), put("m6", None), put("m1", 2, "tent")], PLACE)
    assert broken(v.capacity(bad, two, items)) == {
        ("module placed more than once", "live/m2"): 1, ("mounted without placement", "live/m1"): 1, ("mounted without placement", "live/m3"): 1, ("row too full", "live/rack/2"): 1, ("format too full", "live/rack/3U"): 1, ("format too full", "live/rack/2U"): 1,
        ("module in use is nowhere placed", "live/m1"): 1, ("module in use is nowhere placed", "live/m4"): 1, ("module in use is nowhere placed", "home/m1"): 1, ("module in use is nowhere placed", "home/m2"): 1, ("module in use is nowhere placed", "home/m4"): 1,
    }


def test_ports_in_text(frame):
    ports = frame([("d", "MIDI  IN"), ("d", "CV"), ("e", "OUT")], "device string, name string")
    warn, totals = v.ports_in_text(ports, frame([("d", "The midi in\njack"), ("d", "more")], "device string, text string"))
    assert broken(warn) == {("port not in the text", "d/CV"): 1} and tuple(totals.first()) == (1, 1, 1)


CHANNEL = "setup string, device string, in string, out string, status string, confirmed string"


def test_channels_and_controllers(frame):
    items, wired = frame([("a",), ("b",), ("c",)], "id string"), frame([("live", "a"), ("live", "b")], "setup string, device string")
    good = frame([("live", "a", "omni", "16", "confirmed", "d"), ("live", "b", "1", None, "unconfirmed", None)], CHANNEL)
    assert rules_of(v.channels(good, items, wired)) == {}
    bad = frame([("live", "zz", "1", "1", "confirmed", "d"), ("live", "a", "17", "omni", "confirmed", "d"), ("live", "b", "x", "0", "odd", "d"), ("live", "c", "1", "2", "confirmed", None), ("live", "c", "1", "2", "confirmed", "d")], CHANNEL)
    assert rules_of(v.channels(bad, items, wired)) == {"channel device unknown": 1, "in channel": 2, "out channel": 2, "channel status": 1, "confirmed channel without date": 1, "channel recorded twice": 1, "channel but no midi link": 3}
    maps = "setup string, controller string, target string, channel int, cc int, parameter string, doc string"
    lines = frame([("m", 3, "CC 74 Filter"), ("m", 4, "CC 174"), ("m", 5, "filter 12")], "doc string, line int, text string")
    assert rules_of(v.controllers(frame([("live", "a", "b", 16, 74, "Filter (cutoff)", "m"), ("live", "a", "b", 16, 12, "FILTER", None)], maps), good.withColumn("in", v.F.lit("16")), items, lines)) == {}
    wrong = frame([("live", "a", "b", 2, 74, "resonance", "m"), ("live", "a", "zz", 16, 128, "filter", None), ("live", "b", "a", 1, 74, "filter", "n"), ("live", "a", "b", 16, 17, "filter", "m")], maps)
    assert rules_of(v.controllers(wrong, good, items, lines)) == {"controller sends on another channel": 2, "controller target unknown": 1, "controller number": 1, "target does not listen": 4, "cited section unknown": 1, "no line names parameter and number": 2}


def test_controllers_are_looked_up_by_number(frame):
    """Numbers stand whole, signs included; 20,000 controls of one section of 20,000 lines are no 400 million comparisons."""
    maps = "setup string, controller string, target string, channel int, cc int, parameter string, doc string"
    channels, items = frame([("live", "a", "16", "16")], "setup string, device string, in string, out string"), frame([("a",)], "id string")
    lines = frame([("m", 1, "Cut 007 x-12 3-9 --4"), ("m", 2, "Cut 5, 1270"), ("o", 3, "cut 99")], "doc string, line int, text string")
    absent = [cc for cc in (-12, -9, -7, -4, 0, 3, 4, 5, 7, 9, 12, 99, 127) if v.controllers(frame([("live", "a", "a", 16, cc, "cut (x)", "m")], maps), channels, items, lines).where("rule = 'no line names parameter and number'").count()]
    assert absent == [-9, -7, 0, 7, 99, 127]
    began = time.time()
    spark = channels.sparkSession
    many = spark.range(20_000).selectExpr("'live' AS setup", "'a' AS controller", "'a' AS target", "16 AS channel", "cast(id % 100 AS int) AS cc", "'Filter' AS parameter", "'m' AS doc")
    text = spark.range(20_000).selectExpr("'m' AS doc", "cast(id AS int) AS line", "concat('the long line of a filter, number ', id % 90, ', value ', 1000 + id) AS text")
    assert rules_of(v.controllers(many, channels, items, text)) == {"no line names parameter and number": 2000}
    assert time.time() - began < 40


CONCEPT = "id string, pref string, alt array<string>, broader array<string>, close array<string>, tag string"


def test_terminology(frame):
    predicates = frame([("shapes", ["sound"], ["sound"])], "id string, domain array<string>, range array<string>")
    tags = frame([("t",)], "id string")
    homographs, relation = "label string, senses array<string>", "s string, p string, o string"
    facets = frame([("sound",), ("time",)], "id string")
    good = frame([("pitch", "Pitch", ["tone"], ["sound"], [], "t"), ("tone2", "Tone height", [], ["sound"], ["pitch"], None)], CONCEPT)
    clean = v.terminology(good, predicates, frame([("pitch", "shapes", "tone2"), ("sound", "shapes", "pitch")], relation), frame([("solo", ["pitch", "tone2"])], homographs), tags, facets)
    assert rules_of(clean) == {}
    bad = frame([
        ("free", "Free", None, None, None, "odd"), ("twice", "Twice", [], ["sound"], [], None), ("twice", "Twice", [], ["sound"], [], None), ("time", "Time", [], ["sound"], [], None),
        ("lost", "Lost", [], ["nowhere"], ["nothing"], None), ("c1", "C1", [], ["c2"], [], None), ("c2", "C2", [], ["c3"], [], None), ("c3", "C3", [], ["c1"], [], None),
        ("both", "Both", [], ["sound", "beat"], ["both"], None), ("same", "Both", [], ["beat"], ["beat"], None), ("beat", "Solo", [], ["time2"], [], None),
    ], CONCEPT)
    facets = frame([("sound",), ("time",), ("time2",)], "id string")
    told = frame([("twice", "hums", "sound"), ("beat", "shapes", "sound"), ("sound", "shapes", "both"), ("ghost", "shapes", "sound"), ("sound", "shapes", "beat"), ("sound", "shapes", "beat")], relation)
    out = v.terminology(bad, predicates, told, frame([("solo", ["twice"]), ("odd", ["twice", "ghost"])], homographs), tags, facets)
    assert rules_of(out) == {"concept id twice": 1, "concept is a facet as well": 1, "concept without a broader one": 1, "broader concept unknown": 1, "close match unknown": 1, "tag not in the vocabulary": 1, "hierarchy has a cycle": 1, "more than one facet": 1, "no facet": 5, "label of several concepts": 1, "homograph is a concept's label": 1, "homograph with fewer than two senses": 1, "homograph sense unknown": 1, "close match within the hierarchy": 2, "predicate not declared": 1, "relation end unknown": 1, "subject outside the domain": 1, "object outside the range": 3, "relation twice": 1}
    assert [r["detail"] for r in out.where("rule = 'hierarchy has a cycle'").collect()] == ["c1 > c2 > c3 > c1"]


def test_sections(frame):
    body = "A section that is long enough, with a [link](../b/two.md#top) and [mail](mailto:x@y.z)."
    schema = "id string, doc string, title string, body string, tags array<string>, sha256 string, path string"
    docs, tags, files = frame([("d",)], "id string"), frame([("t",)], "id string"), frame([("docs/b/two.md",)], "path string")
    good = frame([("s1", "d", "One", body, ["t"], hashlib.sha256(body.encode()).hexdigest(), "docs/a/one.md")], schema)
    assert rules_of(v.sections(good, docs, tags, files)) == {}
    bad = frame([("s1", "d", "One", body, ["odd"], "00", "docs/one.md"), ("s2", "zz", "", "short", None, None, "x.md"), ("s3", "d", "ONE", "y" * 30_001, [], None, "z.md")], schema)
    assert broken(v.sections(bad, docs, tags, files)) == {("section without title", "s2"): 1, ("section tag not in the vocabulary", "s1"): 1, ("section document unknown", "s2"): 1, ("section length", "s2"): 1, ("section length", "s3"): 1, ("title twice in a document", "d/one"): 1, ("section changed since its digest", "s1"): 1, ("broken link", "s1"): 1}


def test_pictures(frame):
    schema = "id string, device string, file string, type string, source string"
    items, files = frame([("a", True), ("b", True), ("c", False)], "id string, in_use boolean"), frame([("a.jpg",), ("spare.jpg",)], "path string")
    assert rules_of(v.pictures(frame([("p", "a", "a.jpg", "photo", "own")], schema), items.where("id = 'a'"), files.where("path = 'a.jpg'"))) == {}
    bad = frame([("p", "a", "a.jpg", "photo", "own"), ("q", "zz", "gone.jpg", "film", None)], schema)
    assert rules_of(v.pictures(bad, items, files)) == {"picture device unknown": 1, "picture file missing": 1, "picture type": 1, "picture without source": 1, "file of no picture": 1, "item without picture": 1}


def test_code(frame):
    vertices = frame([("save", "ui_action"), ("open", "ui_action"), ("app.py", "code_file")], "id string, type string")
    edges = frame([("fn", "route:/a", "REQUESTS"), ("route:/a", "fn2", "SERVED_BY"), ("fn", "route:/b", "REQUESTS"), ("app.py", "data", "WRITES")], "src string, dst string, rel string")
    covers = frame([("s1", "save", "Press Save-as."), ("s2", "gone", "x"), ("s3", "save", "nothing here")], "section string, action string, body string")
    out = v.code(vertices, edges, covers, frame([("save", "Save as")], "action string, label string"), frame([("app.py",), ("old.py",)], "path string"), frame([("app.py", "data"), ("app.py", "log")], "file string, dataset string"))
    assert broken(out) == {("route that nothing serves", "route:/b"): 1, ("action without documentation", "open"): 1, ("documented action does not exist", "s2"): 1, ("label not in the section", "s3"): 1, ("path that is no file", "old.py"): 1, ("declared write not performed", "app.py"): 1}
    clean = v.code(vertices.where("id <> 'open'"), edges.where("dst <> 'route:/b'"), covers.where("section = 's1'"), frame([("save", "Save as")], "action string, label string"), frame([("app.py",)], "path string"), frame([("app.py", "data")], "file string, dataset string"))
    assert rules_of(clean) == {}


def test_sessions(frame):
    sessions, ports = frame([("live-1",), ("Bad Name",)], "name string"), frame([("d", 1, "IN", "in", "cv"), ("d", 2, "in ", "up", "steam"), ("d", 3, " ", "in", "cv")], "device string, ord int, name string, dir string, medium string")
    nodes = frame([("live-1", "n1", "d"), ("live-1", "n2", None), ("live-1", "n1", "d"), ("live-1", None, "d")], "session string, uid string, device string")
    cables = frame([("live-1", "c1", "n1", "n2", "cv"), ("live-1", "c2", "n1", "n9", "cv"), ("live-1", "c3", "n1", "n1", "fog")], "session string, uid string, from_uid string, to_uid string, medium string")
    assert rules_of(v.session(sessions, nodes, cables, ports)) == {"session name": 1, "node without uid or device": 2, "node uid twice": 1, "cable end is no node": 1, "cable to its own node": 1, "cable medium": 1, "port direction": 1, "port medium": 1}
    assert rules_of(v.session(sessions.limit(1), frame([("live-1", "n1", "d"), ("live-1", "n2", "d")], nodes.schema), cables.limit(1), ports.where("ord = 1"))) == {}
    assert [r["ord"] for r in v.named_once(ports).collect()] == [1]


def test_receive_clashes_and_coverage(frame):
    nodes = frame([("n1", "a"), ("n2", "b"), ("n3", "c"), ("n4", "a"), ("n5", "e")], "uid string, device string")
    cables = frame([("n1", "n2", "midi"), ("n2", "n3", "audio"), ("n1", "n4", "usb"), ("n4", "n5", "midi")], "from_node string, to_node string, medium string")
    channels = frame([("a", "1"), ("b", "1"), ("c", "1"), ("e", "omni")], "device string, in string")
    assert [(r["subject"], r["detail"]) for r in v.receive_clashes(nodes, cables, channels).collect()] == [("n1/1", "a, b")]
    recall = frame([("x", 0.9), ("y", 0.96)], "id string, occurrence_recall double")
    assert broken(v.low_coverage(recall, "id")) == {("conversion lost text", "x"): 1}


def test_channel_and_controller_records(frame):
    items, setups = frame([("a",), ("b",), ("c",)], "id string"), frame([("live",)], "id string")
    wired = frame([("live", "a"), ("live", "b"), ("live", "c")], "setup string, device string")
    schema = CHANNEL + ", thru string"
    texts = frame([("a", "no such thing"), ("a", "MIDI In"), ("b", "audio only"), ("b", None), ("zz", "x")], "device string, text string")
    good = frame([("live", "a", "1", "2", "confirmed", "d", "true"), ("live", "c", "3", None, "confirmed", "d", None)], schema)
    assert rules_of(v.channel_records(good, items, wired, setups, texts)) == {}
    bad = frame([("gone", "a", "1", "2", "confirmed", "d", "FALSE"), ("live", "b", "1", "2", "unconfirmed", None, "yes"), ("live", "zz", "1", "2", "confirmed", "d", None)], schema)
    assert broken(v.channel_records(bad, items, wired, setups, texts)) == {("channel device unknown", "live/zz"): 1, ("channel but no midi link", "gone/a"): 1, ("channel but no midi link", "live/zz"): 1, ("channel setup unknown", "gone/a"): 1, ("thru is not true or false", "live/b"): 1, ("channel unconfirmed", "live/b"): 1, ("texts never mention it", "b"): 1}
    assert sorted((r.device, r.found) for r in v.mentions(bad, texts).collect() if r.found is not None) == [("a", True), ("b", False), ("zz", False)]
    record = "id string, setup string, device string, status string, program int"
    fine = frame([("m", "live", "a", "confirmed", 2), ("n", "live", "b", "confirmed", None)], record)
    targets = frame([("m", "b"), ("m", "c")], "id string, device string")
    assert rules_of(v.controller_records(fine, targets, good, items, setups)) == {}
    wrong = frame([("m", "gone", "zz", "odd", 2), ("n", "live", "a", "unconfirmed", 3), ("o", "live", "b", None, 1)], record)
    assert broken(v.controller_records(wrong, frame([("m", "yy")], targets.schema), good, items, setups)) == {("controller unknown", "m"): 1, ("controller setup unknown", "m"): 1, ("controller status", "m"): 1, ("controller status", "o"): 1, ("controller unconfirmed", "n"): 1, ("program changes on another channel", "m"): 1, ("program changes on another channel", "n"): 1, ("program changes on another channel", "o"): 1, ("controller's target unknown", "m"): 1}
