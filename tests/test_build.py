"""A small world built, gated, published and asked."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from kgspark.operators import build, golden
from kgspark.operators.graph import PropertyGraph
from kgspark.schema import EDGE, VERTEX


@pytest.fixture(scope="module")
def world(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    return build.World(
        items=f([("keys", "Keys", "Keyboard", "Acme", "owned", True, None, None, None), ("box", "Box", "Module", "Acme", "owned", True, "3U", None, None), ("drum", "Drum", "Module", "Bolt", "owned", True, "3U", None, None), ("bass", "Bass", "Module", "Bolt", "owned", True, "3U", None, None), ("attic", "Attic", "Keyboard", "Bolt", "sold", False, None, None, "private"), ("psu", "Supply", None, None, "owned", True, None, None, None), ("idle", "Idle", "Module", "Acme", "owned", True, None, None, None)], "id string, name string, category string, manufacturer string, status string, in_use boolean, format string, role string, visibility string"),
        evidence=f([("box", "hp", "maker", "http://a", "200", 8, "8 HP"), ("box", "hp", "shop", "http://b", "200", 8, "8hp"), ("drum", "hp", "shop", "http://b", "200", 10, "10hp"), ("bass", "hp", "shop", "http://c", "404", None, None)], "item string, field string, tier string, url string, http string, value int, line string"),
        overrides=f([("drum", "depth", 25)], "item string, field string, value int"),
        manuals=f([("m-acme", "box", "manual", "1"), ("m-bolt", "drum", "manual", "2")], "id string, item string, doc_type string, version string"),
        sections=f([("m-acme", "01.md", "Start", ["setup"]), ("m-bolt", "01.md", "Begin", ["setup", "midi"])], "manual string, file string, title string, tags array<string>"),
        concepts=f([("sound", "Sound", [], [], [], "setup", "sound"), ("filter", "Filter", ["VCF"], ["sound"], [], None, None), ("cutoff", "Cutoff", ["Frequency"], [], ["filter"], None, None)], "id string, pref string, alt array<string>, broader array<string>, close array<string>, tag string, facet string"),
        relations=f([("cutoff", "shapes", "filter")], "s string, p string, o string"),
        uses=f([("manual:m-acme", "filter", "VCF", 5), ("manual:m-acme", "cutoff", "Cutoff", 2), ("manual:m-bolt", "filter", "Filter", 3), ("manual:m-bolt", "cutoff", "Frequency", 1), ("doc:d1", "sound", "Sound", 1), ("doc:d1", "filter", "Filter", 1)], "src string, concept string, label string, n int"),
        links=f([("live", "keys", "box", "OUT", "IN", "midi", "confirmed", "2025", False, False, None), ("live", "keys", "drum", "OUT", "IN", "midi", "confirmed", "2025", False, False, None), ("live", "box", "bass", "OUT", "IN", "audio", "confirmed", "2025", True, True, None), ("live", "bass", "attic", "OUT", "IN", "audio", "unconfirmed", None, False, False, None), ("home", "keys", "bass", "OUT", "IN", "midi", "confirmed", "2025", False, False, None)], "setup string, src string, dst string, src_port string, dst_port string, medium string, status string, confirmed string, swappable boolean, bidirectional boolean, note string"),
        placements=f([("live", "box", "psu", "psu", "1U", 0, 1, "confirmed", "2025"), ("live", "psu", "psu", "psu", "1U", 0, 0, "confirmed", "2025")], "setup string, module string, case string, powered_by string, row string, row_index int, position int, status string, confirmed string"),
        channels=f([("box", "1", None, True, "confirmed", "2025"), ("drum", "1", None, False, "confirmed", "2025")], "device string, in string, out string, thru boolean, status string, confirmed string"),
        questions=f([("q1", "How to start?", ["m-acme/01.md"])], "id string, question string, expected array<string>"),
        datasets=f([("inventory", "defines", ["box", "drum", "nothing"])], "id string, rel string, entities array<string>"),
    )


@pytest.fixture(scope="module")
def graph(spark, world):
    code = [("app:site", "app", "site"), ("doc:d1", "doc_section", "d1"), ("doc:d2", "doc_section", "d2"), ("system:kb", "system", "kb"), ("file:site/a.py", "code_file", "a.py"), ("action:save", "ui_action", "save"), ("action:open", "ui_action", "open"), ("fn:save", "function", "save"), ("fn:put", "function", "put"), ("route:/api/kit", "api_route", "kit")]
    edges = [("app:site", "doc:d1", "CONTAINS"), ("app:site", "action:open", "CONTAINS"), ("action:save", "fn:save", "HANDLED_BY"), ("fn:save", "fn:put", "CALLS"), ("fn:put", "route:/api/kit", "REQUESTS"), ("doc:d1", "action:save", "DOCUMENTS"), ("doc:d2", "action:open", "DOCUMENTS"), ("doc:d1", "fn:put", "DOCUMENTS"), ("data:inventory", "system:kb", "PART_OF"), ("file:site/a.py", "data:inventory", "READS")]
    more = PropertyGraph(build.wide(spark.createDataFrame(code, "id string, type string, name string"), VERTEX).withColumn("visibility", F.lit("public")).withColumn("role", F.when(F.col("id") == "doc:d1", "user")), build.wide(spark.createDataFrame(edges, "src string, dst string, rel string"), EDGE))
    g = build.joined(build.build(world), more)
    return PropertyGraph(g.vertices.cache(), g.edges.cache())


def test_tables_are_wide_and_ids_typed(graph):
    assert graph.vertices.columns == VERTEX.fieldNames() and graph.edges.columns == EDGE.fieldNames()
    v = {r["id"]: r for r in graph.vertices.collect()}
    assert v["item:box"]["midi_in_ch"] == "1" and v["item:box"]["midi_thru_pass"] is True and v["spec:box.hp"]["value"] == 8.0 and v["spec:box.hp"]["status"] == "confirmed"
    assert v["spec:drum.depth"]["status"] == "override" and v["spec:bass.hp"]["status"] == "missing" and v["section:m-acme/01.md"]["visibility"] == "private"
    e = {(r["src"], r["rel"], r["dst"]): r for r in graph.edges.collect()}
    assert ("item:psu", "POWERED_BY", "item:psu") not in e and ("item:box", "POWERED_BY", "item:psu") in e
    assert e[("item:bass", "CONNECTS", "item:attic")]["visibility"] == "private" and e[("item:box", "CONNECTS", "item:bass")]["visibility"] == "public"
    assert ("data:inventory", "DEFINES", "item:box") in e and ("term:cutoff", "SHAPES", "term:filter") in e and ("q:q1", "EXPECTS", "section:m-acme/01.md") in e


def test_gates_and_publication(spark, world, graph, tmp_path):
    assert build.gates(graph, ["Attic"]).count() == 0
    assert [r["subject"] for r in build.gates(graph, ["bass"]).where("subject = 'item:bass'").collect()] == ["item:bass"]
    twice = PropertyGraph(graph.vertices.union(graph.vertices.where("id = 'item:box'")), graph.edges.union(graph.edges.where("src = 'item:keys' and setup = 'home'").withColumn("dst", F.lit("item:ghost"))))
    assert {(r["rule"], r["subject"]) for r in build.gates(twice).collect()} == {("vertex id twice", "item:box"), ("edge end is no vertex", "item:ghost")}
    with pytest.raises(ValueError, match="vertex id twice"):
        build.publish(twice, f"file://{tmp_path}/bad")
    build.publish(graph, f"file://{tmp_path}/out", ["Attic"])
    at = build.current(spark, f"file://{tmp_path}/out")
    back = build.published(spark, f"file://{tmp_path}/out").vertices
    assert back.exceptAll(graph.vertices).count() == 0 and back.count() == graph.vertices.count()
    public = [json.loads(r[0]) for r in spark.read.text(f"{at}/public/vertices.json").collect()]
    ids = [p["id"] for p in public]
    assert ids == sorted(ids) and "item:attic" not in ids and not any(i.startswith("section:") for i in ids)
    assert build.sample(build.gates(twice), 1).count() == 2 and "datasets" in build.tables(world)


def test_readers_see_one_version(spark, graph, world, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/v"
    first = build.publish(graph, path, inputs=build.inputs_digest(world))
    small = PropertyGraph(graph.vertices.where("type = 'item'"), graph.edges.where("rel = 'CONNECTS'"))
    real = build.sinks.ordered_json

    def stops(*a):  # the writer dies between two tables
        raise OSError("lost")

    monkeypatch.setattr(build.sinks, "ordered_json", stops)
    with pytest.raises(OSError):
        build.publish(small, path)
    assert build.current(spark, path).endswith(first) and build.published(spark, path).vertices.count() == graph.vertices.count()
    assert build.published(spark, path, build.inputs_digest(world)).edges.count() == graph.edges.count()
    changed = dataclasses.replace(world, links=world.links.where("medium = 'midi'"))
    with pytest.raises(ValueError, match="stale"):
        build.published(spark, path, build.inputs_digest(changed))
    monkeypatch.setattr(build.sinks, "ordered_json", real)
    second = build.publish(small, path)
    assert second != first and build.published(spark, path).edges.count() == small.edges.count()


def test_first_channel_record_counts(spark, world):
    rows = [("box", 2, "9", None, True, "confirmed", "2025"), ("box", 1, "4", None, False, "confirmed", "2024"), ("drum", 1, "1", "2", False, "confirmed", "2025")]
    w = build.World(items=world.items, channels=spark.createDataFrame(rows, "device string, ord int, in string, out string, thru boolean, status string, confirmed string"))
    v = {r["id"]: r["midi_in_ch"] for r in build.build(w).vertices.where("type = 'item'").collect()}
    assert v["item:box"] == "4" and v["item:drum"] == "1" and v["item:keys"] is None


EXPECTED = {
    "feeds": ({"item": "keys", "setup": "live"}, [("midi", "box"), ("midi", "drum")]),
    "reach": ({"item": "keys", "media": ["midi", "audio"], "setup": "live"}, [("1", "box"), ("1", "drum"), ("2", "bass")]),
    "support": ({}, [("none", "2"), ("one shop", "1"), ("two or more", "1")]),
    "midi_conflicts": ({}, [("keys/1", "box"), ("keys/1", "drum"), ("keys/not recorded", "bass")]),
    "unrecorded": ({}, [("Module", "idle"), ("Keyboard", "attic")]),
    "naming": ({"show": ["filter", "cutoff"]}, [("filter", "Acme: VCF"), ("filter", "Bolt: Filter"), ("cutoff", "Acme: Cutoff"), ("cutoff", "Bolt: Frequency")]),
    "inherits": ({"param": "filter", "predicate": "SHAPES"}, [("box", "cutoff"), ("drum", "cutoff")]),
    "undocumented": ({}, [("site", "open")]),
    "doc_impact": ({"route_prefix": "/api"}, [("function", "put"), ("section", "d1")]),
    "kb_reach": ({"system": "kb", "reader": "site/"}, [("inventory", "2")]),
    "concept_where": ({"concept": "sound"}, [("manuals", "2"), ("sections of site", "d1")]),
    "vocabulary": ({"concept": "sound"}, [("vcf", "Acme"), ("filter", "Bolt"), ("filter", "site"), ("sound", "site")]),
    "term_gaps": ({}, [("left_only", "cutoff"), ("right_only", "sound"), ("shared", "filter")]),
}


@pytest.mark.parametrize("kind", sorted(EXPECTED))
def test_each_kind_of_question(graph, kind):
    params, want = EXPECTED[kind]
    assert sorted((r["key"], r["value"]) for r in golden.KINDS[kind](graph, **params).collect()) == sorted(want)


def test_every_kind_is_covered_and_verdicts_tell(spark, graph):
    assert set(EXPECTED) == set(golden.KINDS) and len(EXPECTED) == 13
    found = golden.answers(graph, [{"id": "a", "query": "feeds", "params": {"item": "keys", "setup": "live"}}, {"id": "b", "query": "kb_reach", "params": {"system": "kb"}}])
    expected = spark.createDataFrame([("a", "midi", "box"), ("a", "midi", "drum"), ("b", "inventory", "3")], "id string, key string, value string")
    assert sorted(map(tuple, golden.verdicts(found, expected).collect())) == [("a", 0, 0, True), ("b", 1, 1, False)]
    assert {r["id"]: r["answer"] for r in golden.lines(found).collect()}["a"] == ["midi: box, drum"]
    with pytest.raises(ValueError):
        golden.answers(graph, [{"id": "c", "query": "nothing"}])
