"""Retrieval by bounds, prefix joins by keys, YAML as a data source, character references and statuses."""

import html
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kgspark.operators import evidence, relational, retrieval, text
from kgspark.sources import yaml_source


def corpus(spark, seed, docs=900, questions=12):
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.paretovariate(0.7)), 400)}"
    d = [(k, w, n) for k in range(docs) for w, n in Counter(word() for _ in range(r.randint(0, 60))).items()]
    texts = {k: [w for i, w, n in d if i == k for _ in range(n)] for k in r.sample(range(docs), questions)}
    q = [(i, w, n) for i, k in enumerate(texts) for w, n in Counter(texts[k][:25] or ["none"]).items()]
    return spark.createDataFrame(d, "doc_id long, token string, n long"), spark.createDataFrame(q, "qid long, token string, n long")


@pytest.mark.parametrize("seed", [1, 2])
def test_bounded_ranks_equal_ranks_of_all_scores(spark, seed, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_DOCS", 4)
    d, q = corpus(spark, seed)
    every = retrieval.bm25(d, q)
    want = retrieval.ranked(every, 5)
    blocks = retrieval.bm25_blocks(d, q)
    told = lambda df: Counter((r["qid"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in df.collect())
    assert told(blocks.top(q, 5)) == told(want)
    least = want.where("rank = 5").select("qid", "score")
    assert 0 < blocks.reaching(q, least).count() < every.count() / 3  # what is scored, of all that share a word
    assert told(blocks.top(q, 2000)) == told(retrieval.ranked(every, 2000))


def test_bounded_ranks_of_wanted_documents(spark):
    d, q = corpus(spark, 3)
    variants = {"base": (1.2, 0.75), "flat": (1.2, 0.0), "steep": (2.0, 1.0)}
    wanted = spark.createDataFrame([(i, k) for i in range(12) for k in range(i, 900, 97)] + [(50, 1), (3, 10**6)], "qid long, doc_id long")
    want = Counter(map(tuple, retrieval.ranks_of(retrieval.bm25(d, q, variants), wanted, list(variants)).collect()))
    assert Counter(map(tuple, retrieval.bm25_blocks(d, q, variants).ranks(q, wanted).collect())) == want


def test_nearest_cover_by_bounds(spark):
    d, q = corpus(spark, 4)
    rows, best = {}, {}
    for r in q.join(d.withColumnRenamed("n", "m"), "token").collect():
        rows[r["qid"], r["doc_id"]] = rows.get((r["qid"], r["doc_id"]), 0) + min(r["n"], r["m"])
    for (i, k), hits in rows.items():
        best[i] = min(best.get(i, (0, 0)), (-hits, k))
    got = retrieval.covering(d, q).top(q, 1).collect()
    assert {r["qid"]: (-r["score"], r["doc_id"]) for r in got} == best


def test_no_documents_and_no_questions(spark):
    d, q = corpus(spark, 5, 20, 3)
    assert retrieval.bm25_blocks(d.limit(0), q).top(q, 3).collect() == [] and retrieval.bm25_blocks(d, q.limit(0)).top(q.limit(0), 3).collect() == []


def test_prefix_pairs_by_keys(spark):
    r = random.Random(1)
    name = lambda: "".join(r.choice("ab") for _ in range(r.randint(0, 6)))
    a, b = [(k, name()) for k in range(60)] + [(99, None)], [(k, name()) for k in range(40)] + [(98, None)]
    got = relational.prefix_pairs(spark.createDataFrame(a, "x int, a string"), "a", spark.createDataFrame(b, "y int, b string"), "b")
    assert Counter(map(tuple, got.collect())) == Counter((x, s, y, u) for x, s in a for y, u in b if s is not None and u is not None and (s.startswith(u) or u.startswith(s)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Cross", "") and "CartesianProduct" not in plan
    first = relational.first_prefix(spark.createDataFrame([(1, "red wide"), (2, "re"), (3, "x")], "id int, t string"), "t", spark.createDataFrame([(2, "red"), (1, "red w")], "ord int, name string"), "name", ["id"], "ord")
    assert {r["id"]: r["name"] for r in first.collect()} == {1: "red w", 2: "red w", 3: None}


@pytest.fixture
def yaml_folder(spark, tmp_path):
    yaml_source.register(spark)
    (tmp_path / "a.yaml").write_text("- {id: a, n: 1, tags: [x, y], day: 2024-05-01}\n- {id: b, n: many}\n- just words\n")
    (tmp_path / "b.yaml").write_text("- {id: c\n  n: [")
    (tmp_path / "c.yml").write_text("first: {n: 3}\nsecond: {n: 4.0, tags: [yes]}\n---\n- {id: d}\n")
    (tmp_path / "d.yaml").write_text("")
    (tmp_path / "e.yaml").write_bytes(b"- {id: \xff}\n")
    (tmp_path / "notes.txt").write_text("no yaml")
    return str(tmp_path)


SCHEMA = "key string, id string, n int, tags array<string>, day date, file string, _corrupt_record string"


def test_yaml_records_of_a_folder_with_broken_files(spark, yaml_folder):
    df = spark.read.format("yaml_records").schema(SCHEMA).load(yaml_folder)
    assert df.rdd.getNumPartitions() == 5
    rows = sorted((r["file"], r["id"] or r["key"] or "", r["n"], r["tags"], str(r["day"]), r["_corrupt_record"] is not None) for r in df.collect())
    assert rows == [
        ("a.yaml", "", None, None, "None", True), ("a.yaml", "a", 1, ["x", "y"], "2024-05-01", False), ("a.yaml", "b", None, None, "None", True), ("b.yaml", "", None, None, "None", True),
        ("c.yml", "d", None, None, "None", False), ("c.yml", "first", 3, None, "None", False), ("c.yml", "second", 4, ["true"], "None", False), ("e.yaml", "", None, None, "None", True),
    ]
    good = spark.read.format("yaml_records").schema("id string, n int").option("mode", "DROPMALFORMED").load(yaml_folder)
    assert sorted((r["id"] or "", r["n"] or 0) for r in good.collect()) == [("", 3), ("", 4), ("a", 1), ("d", 0)]
    with pytest.raises(Exception, match="b.yaml"):
        spark.read.format("yaml_records").schema("id string").option("mode", "FAILFAST").load(f"file://{yaml_folder}/b.yaml").collect()


def test_yaml_records_paths_keys_and_filters(spark, yaml_folder, tmp_path):
    (tmp_path / "k.yaml").write_text("items:\n  x: {n: 1}\n  y: 2\nother: [1]\n")
    at = spark.read.format("yaml_records").schema("key string, n int, value int").option("at", "items").load(f"{yaml_folder}/k.yaml")
    assert sorted(map(tuple, at.collect())) == [("x", 1, None), ("y", None, 2)]
    plain = spark.read.format("yaml_records").load(f"{yaml_folder}/[ac].y*ml").where("_corrupt_record is null")
    assert Counter(r["file"] for r in plain.collect()) == {"a.yaml": 3, "c.yml": 3}
    few = spark.read.format("yaml_records").schema(SCHEMA).load(yaml_folder).where("file = 'c.yml' and n > 3")
    assert few.rdd.getNumPartitions() == 1 and [r["key"] for r in few.collect()] == ["second"]
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("yaml_records").schema("id string").load(f"{yaml_folder}/nowhere").collect()


def test_character_references_equal_html_5(spark):
    r = random.Random(7)
    bits = ["&", "amp", "lt;", "notit;", "not", "copy", "&#", "&#x", "x", "1", "41", "80", "150;", "0;", "55555;", "D800;", "1114112;", "99999999999999;", ";", " ", "é", "Eacute", "eacute;", "ngE;", "NotEqualTilde;", "frac14", "hearts", "hearts;", "zwj;", "13;", "11;", "FDD0;", "1FFFF;", "\n", "#"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 9))) for _ in range(3000)] + ["&" + n for n in list(html.entities.html5)] + ["&" + n + "x1" for n in list(html.entities.html5)[::7]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", text.unescape(F.col("t")).alias("u"))
    got = {r["k"]: r["u"] for r in df.collect()}
    assert [(t, got[k], html.unescape(t)) for k, t in enumerate(texts) if got[k] != html.unescape(t)] == []


def test_rails_and_figures_become_one_line(spark):
    page = "<tr><td>+12V</td><td>130 mA</td></tr><p>5 v :</p><p>20mA</p><p>+12V</p><p>rail</p><p>-12 V<br>1,000mA</p>"
    df = spark.createDataFrame([(page,)], "h string").select(text.html_to_text(F.col("h")).alias("t"))
    assert df.first()["t"] == "+12V: 130 mA\n5 v: 20mA\n+12V\nrail\n-12 V: 1000mA"


def test_statuses_and_overrides(spark):
    ev = spark.createDataFrame([("m", "hp", 4), ("m", "mm", 20), ("m", "mm", 20), ("k", "hp", 3)], "id string, field string, value int")
    want = spark.createDataFrame([(i, f) for i in "mkz" for f in ("hp", "mm", "p5")], "id string, field string")
    over = spark.createDataFrame([("m", "hp", None, None), ("k", "hp", 9, "inferred"), ("z", "mm", 1, None)], "id string, field string, value int, status string")
    got = evidence.resolve(ev, ["id", "field"], want, over)
    rows = {(r["id"], r["field"]): (r["value"], r["status"]) for r in got.collect()}
    assert rows[("m", "hp")] == (None, "override") and rows[("k", "hp")] == (9, "inferred") and rows[("m", "mm")] == (20, "confirmed") and rows[("z", "p5")] == (None, "missing")
    worst = evidence.worst_status(got, ["id"], F.col("field") == "p5")
    assert {r["id"]: r["worst"] for r in worst.collect()} == {"m": "override", "k": "missing", "z": "missing"}
    two = spark.createDataFrame([("a", "single"), ("a", "override"), ("b", "missing")], "id string, status string")
    assert {r["id"]: r["worst"] for r in evidence.worst_status(two, ["id"], F.col("id") == "b").collect()} == {"a": "override", "b": None}
