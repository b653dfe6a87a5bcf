"""Consumer records and views, code as a graph, readers of corpora and records, published pages."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kgspark.operators import consumer as c
from kgspark.sources import code, readers, sinks


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(df, *cols):
    return sorted((tuple(r[x] for x in cols or df.columns) for r in df.collect()), key=repr)


def test_names_groups_search(frame):
    d = frame([("a", "Acme Drum 1U", "Acme", "Drum Machine", True), ("b", "Keys", None, None, False)], "id string, name string, manufacturer string, category string, in_use boolean")
    d = d.withColumn("group", c.group_of(F.col("category"), {"rhythm": ["drum machine"], "keys": ["piano"]}))
    assert rows(d, "id", "group") == [("a", "rhythm"), ("b", "other")]
    assert rows(d.select(c.short_name(F.col("name"), F.col("manufacturer")).alias("n"))) == [("Drum",), ("Keys",)]
    assert rows(c.search(d, "MACHINE"), "id") == [("a",)] and rows(c.search(d, "", "other", False), "id") == [("b",)] and rows(c.search(d, "", None, True), "id") == [("a",)]


PORT = "device string, name string, dir string, medium string, ord int, hidden boolean"


def test_link_ends_are_resolved_named_ones_first(frame):
    ports = frame([("a", "OUT 1", "out", "audio", 1, None), ("a", "OUT 2", "out", "audio", 2, None), ("a", "GHOST", "out", "audio", 0, True), ("b", "IN", "in", "audio", 1, None), ("b", "USB", "bidir", "usb", 2, None)], PORT)
    links = frame([(1, "a", None, "b", None, "audio"), (2, "a", "OUT 1", "b", None, "audio"), (3, "a", None, "b", None, "usb")], "id int, src string, src_port string, dst string, dst_port string, medium string")
    assert rows(c.resolved_ends(links, ports), "id", "src_port", "dst_port") == [(1, "OUT 2", "IN"), (2, "OUT 1", None), (3, None, "USB")]


def test_records_and_dataset(frame):
    devices = frame([("a", "A"), ("b", "B")], "id string, name string")
    ports = frame([("a", "OUT", "out", "audio", 1, None), ("a", "IN", "in", "audio", 2, None), ("a", "X", "in", "cv", 3, True)], PORT)
    out = c.records(devices, frame([("a", "hp", 8.0), ("a", "depth", None)], "device string, field string, value double"), ports, frame([("live", "a", "rack", 0)], "setup string, module string, case string, row_index int"), frame([("a", "1")], "device string, in string"), frame([("b", 100.0)], "supply string, draw double"))
    r = {x["id"]: x for x in out.collect()}
    assert r["a"]["specs"] == {"hp": 8.0} and [p["name"] for p in r["a"]["ports"]] == ["IN", "OUT"] and r["a"]["placed"][0]["case"] == "rack" and r["a"]["midi"][0]["in"] == "1" and r["a"]["load"] is None
    assert r["b"]["specs"] == {} and r["b"]["ports"] == [] and r["b"]["load"][0]["draw"] == 100.0
    whole = c.dataset(out, frame([(1, "a", "b")], "id int, src string, dst string"), frame([("all",)], "name string")).collect()
    assert sorted((x["section"], x["key"]) for x in whole) == [("devices", "a"), ("devices", "b"), ("links", "1"), ("templates", "all")]
    assert json.loads(next(x["value"] for x in whole if x["key"] == "a"))["specs"] == {"hp": 8.0}


def test_views(frame):
    df = frame([({"hp": "8", "draw": "20"},), ({"hp": "8"},), ({"hp": "", "draw": "1"},)], "v map<string,string>")
    assert [r[0] for r in df.select(c.summary(F.col("v"), "{hp} HP, {draw} mA")).collect()] == ["8 HP, 20 mA", None, None]
    nodes = frame([("s", 10.0, 20.0), ("s", 40.0, 5.0), ("t", None, 1.0)], "session string, x double, y double")
    assert rows(c.bounding_box(nodes, ["session"], 10, 20, 1)) == [("s", 9.0, 4.0, 42.0, 37.0)]
    grid = c.wrapped(frame([("b", i) for i in range(9)], "band string, i int"), ["band"], ["i"])
    assert rows(grid, "i", "row", "column")[6:] == [(6, 0, 6), (7, 1, 0), (8, 1, 1)]
    ports = frame([("d", "O", "out", "cv", 1, None), ("d", "I", "in", "cv", 2, None), ("d", "B", "bidir", "cv", 0, None)], PORT)
    assert rows(c.inputs_first(ports), "place", "name") == [(1, "I"), (2, "B"), (3, "O")]
    cases = frame([("live", "rack", [("1U", 84), ("3U", 84)])], "setup string, id string, rows array<struct<format:string,hp:int>>")
    free = c.free_width(cases, frame([("live", "m", "rack", 0), ("live", "n", "rack", 0)], "setup string, module string, case string, row_index int"), frame([("m", 10), ("n", None)], "id string, hp int"))
    assert rows(free, "row_index", "used", "free") == [(0, 14, 70), (1, 0, 84)]
    maps = frame([("keys", 1, "box", 74, "cutoff"), ("keys", 1, "box", 7, "level")], "controller string, channel int, target string, cc int, name string")
    assert rows(c.controller_section(maps, frame([("box", "1")], "device string, in string"))) == [("keys", 1, "box", "1", "7 level, 74 cutoff")]


SCRIPT = """// the start
async function save() { await fetch(`/api/kit/${id}`, { method: 'PUT' }); }
const open = () => { fetch("/api/list"); switch (x) { case 'copy': break; case "cut": } }
/* two
 * lines */
<button class="b" data-action="save">Save <i>now</i></button>
"""
SERVER = '''"""Serves."""
# first note
def handle(path):
    """Handles."""
    if path == "/api/list":
        return listed()
    return re.match(r"/api/kit/(.+)$", path)

def listed():
    return 1  # one
'''


def test_code_as_a_graph(spark, tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web/app.js").write_text(SCRIPT)
    (tmp_path / "web/serve.py").write_text(SERVER)
    (tmp_path / "web/spare.py").write_text("def broken(:")
    every = code.files(spark, str(tmp_path))
    assert every.count() == 3
    df = code.files(spark, str(tmp_path), ["web/app.js", "web/serve.py"])
    assert rows(df, "file") == [("web/app.js",), ("web/serve.py",)]
    assert rows(code.api_calls(df), "method", "route") == [("GET", "api/list"), ("PUT", "api/kit/:id")]
    assert rows(code.served_routes(df), "route") == [("api/kit/:id",), ("api/list",)]
    assert rows(code.switch_cases(df), "case") == [("copy",), ("cut",)] and rows(code.labels(df), "action", "label") == [("save", "Save now")]
    assert rows(code.docstrings(every), "name", "text") == [("", "Serves."), ("handle", "Handles.")]
    got = {r["file"]: r for r in df.select("file", code.comments(F.col("text"), "python").alias("p"), code.comments(F.col("text"), "javascript").alias("j")).collect()}
    assert got["web/serve.py"]["p"] == "first note\none" and got["web/app.js"]["j"] == "the start\ntwo\nlines"
    e = code.graph_edges(code.api_calls(df), code.served_routes(df), code.symbols(every.where("file like '%spare.py'").union(df)))
    assert ("fn:web/serve.py:handle", "fn:web/serve.py:listed", "CALLS") in rows(e) and ("route:api/list", "file:web/serve.py", "SERVED_BY") in rows(e) and ("file:web/app.js", "route:api/kit/:id", "REQUESTS") in rows(e)


def test_corpus_records_overlays(spark, tmp_path, frame):
    (tmp_path / "docs/m").mkdir(parents=True)
    for name, text in (("02-b.md", "---\ntitle: B\n---\nbody b"), ("01-a.md", "body a"), ("index.md", "not a section")):
        (tmp_path / "docs/m" / name).write_text(text)
    assert rows(readers.section_corpus(spark, f"{tmp_path}/docs/*/*.md"), "ord", "file", "body") == [(1, "01-a.md", "body a"), (2, "02-b.md", "body b")]
    got = readers.rows(spark, [{"id": 7, "n": "12", "ok": True, "d": "x", "l": ["a"]}, {"n": "twelve"}], StructType.fromDDL("id string, n int, ok boolean, d double, l array<string>"))
    assert rows(got) == [("7", 12, True, None, ["a"]), (None, None, None, None, None)]
    seed = frame([("d", "MIDI IN", "in"), ("d", "OUT", "out")], "device string, name string, dir string")
    (tmp_path / "ports.yaml").write_text("- {device: d, name: midi in, dir: bidir}\n- {device: d, name: NEW, dir: in}\n")
    schema = "device string, name string, dir string"
    assert rows(readers.overlaid(seed, f"{tmp_path}/ports.yaml", schema, ["device"], "name", ["dir"]), "name", "dir", "origin") == [("NEW", "in", "edit"), ("OUT", "out", "seed"), ("midi in", "bidir", "both")]
    assert rows(readers.overlaid(seed, f"{tmp_path}/none.yaml", schema, ["device"], "name", ["dir"]), "name", "origin") == [("MIDI IN", "seed"), ("OUT", "seed")]


def test_reports_pages_and_replaced_files(spark, tmp_path, frame):
    df = frame([("live", "psu", "+12V", 1), ("live", "psu", "-12V", 2), ("live", "box", "+5V", 3)], "setup string, supply string, rail string, n int")
    out = json.loads(sinks.nested_report(df, ["setup", "supply"]).first()["value"])
    assert out == {"setup": "live", "by_supply": [{"supply": "box", "rows": [{"rail": "+5V", "n": 3}]}, {"supply": "psu", "rows": [{"rail": "+12V", "n": 1}, {"rail": "-12V", "n": 2}]}]}
    p = sinks.pages(df, ["supply"], ["rail", "n"], F.concat(F.lit("Supply "), F.col("supply")), ["rail"])
    assert next(r["page"] for r in p.collect() if r["supply"] == "psu") == "# Supply psu\n\n| rail | n |\n|-|-|\n| +12V | 1 |\n| -12V | 2 |\n"
    assert sinks.index(p, F.concat("supply", F.lit(".md")), F.col("supply")).first()["value"] == "- [box](box.md)\n- [psu](psu.md)"
    for text in ("one", "two"):
        sinks.replace_file(spark, f"file://{tmp_path}/f.yaml", text)
        assert (tmp_path / "f.yaml").read_text() == text
    assert not list(tmp_path.glob("f.yaml.*.part"))
