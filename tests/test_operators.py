import re
import time

import pytest
from pyspark.sql import functions as F

from kgspark.operators import evidence as ev
from kgspark.operators import relational as rel
from kgspark.operators import retrieval, rules, terms
from kgspark.operators import text as tx
from kgspark.sources import readers, sinks


def rows(df, *cols):
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


# evidence ------------------------------------------------------------------------------------------------------------
def test_resolution(spark):
    e = spark.createDataFrame([("single", 5), ("conf", 4), ("conf", 4), ("major", 1), ("major", 1), ("major", 9), ("tie", 2), ("tie", 7), ("over", 3)], "item string, value int")
    want = spark.createDataFrame([(x,) for x in ("single", "conf", "major", "tie", "over", "none")], "item string")
    over = spark.createDataFrame([("over", 0)], "item string, value int")
    got = {r[0]: (r[1], r[2]) for r in rows(ev.resolve(e, ["item"], want, over), "item", "value", "status")}
    assert got == {"single": (5, "single"), "conf": (4, "confirmed"), "major": (1, "conflict"), "tie": (7, "conflict"), "over": (0, "override"), "none": (None, "missing")}
    assert rows(ev.agreement(e, ["item"])) == [("conf", "agree"), ("major", "DISAGREE"), ("over", "single"), ("single", "single"), ("tie", "DISAGREE")]


def test_load_keeps_unknown_zero_and_empty_apart(spark):
    d = spark.createDataFrame([("a", 1.0, True), ("a", None, False), ("b", 0.0, False), ("h", 5.0, False)], "k string, draw double, attested boolean")
    c = spark.createDataFrame([("a", 8.0), ("b", None), ("c", 5.0), ("h", 8.0)], "k string, capacity double")
    assert rows(ev.load(d, c, ["k"])) == [("a", 2, 1.0, 1, 1, 8.0, 12.0), ("b", 1, 0.0, 0, 0, None, None), ("c", 0, 0.0, 0, 0, 5.0, 0.0), ("h", 1, 5.0, 0, 0, 8.0, 62.0)]


def test_worst_status_and_rules(spark):
    s = spark.createDataFrame([("a", "x", "confirmed"), ("a", "y", "conflict"), ("b", "x", "single")], "item string, field string, status string")
    assert rows(ev.worst_status(s, ["item"])) == [("a", "conflict", 1), ("b", "single", 0)]


# terms ---------------------------------------------------------------------------------------------------------------
LABELS = [("gate length", "gate-length"), ("gate", "gate"), ("sub oscillator", "sub"), ("oscillator", "osc"), ("EG", "envelope"), ("note off", None)]


def by_hand(text):
    order = sorted(range(len(LABELS)), key=lambda i: (-len(LABELS[i][0]), i))
    py = lambda p: p.replace(r"\p{L}\p{N}", r"^\W_")
    pats = [(i, py(terms.label_regex(LABELS[i][0])).replace("(?<![^\\W_])", "(?<![^\\W_])")) for i in order]
    every, out = re.compile("|".join(f"({p})" for _, p in pats)), {}
    for m in every.finditer(text):
        i = next(pats[k][0] for k, x in enumerate(m.groups()) if x is not None)
        if LABELS[i][1]:
            out[LABELS[i][0]] = out.get(LABELS[i][0], 0) + 1
    return out


@pytest.mark.parametrize("text", ["The Gate length of gates; gate-length.", "Sub-oscillator and oscillators, suboscillator", "eg EG Eg eG EGs", "note off, note offs, gate"])
def test_longest_label_wins(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert {r["label"]: r["n"] for r in terms.match_labels(df, LABELS, "id").collect()} == by_hand(text)


def test_ties_decide_nothing(spark):
    u = spark.createDataFrame([("t", "a", "x", 3), ("t", "a", "y", 3), ("t", "b", "x", 2), ("t", "c", "y", 1)], "term string, maker string, label string, n int")
    w = terms.dominant(u, ["term", "maker"], "label", "n")
    assert rows(w, "maker", "winner", "tied") == [("a", "x = y (tie)", True), ("b", "x", False), ("c", "y", False)]
    assert terms.differing(w, "term").count() == 3
    assert [one(spark, terms.fold(F.lit(x))) for x in ("Sub-Oscillators", "gates", "bus", "Low  pass")] == ["sub oscillator", "gat", "bus", "low pas"]


# text ----------------------------------------------------------------------------------------------------------------
def test_html(spark):
    html = "<p>a &amp; b</p><script>var t='<p>';</script><style>x</style><!-- c --><p>1,000 &lt;mA&gt;</p>"
    assert one(spark, tx.html_to_text(F.lit(html))) == "a & b\n1000 <mA>"


def test_fields_take_the_first_pattern_that_fits(spark):
    v = tx.extract(F.lit("width: 8 HP\n+12V: 55 mA"), {"hp": [r"(\d+)\s*TE", r"(\d+)\s*HP"], "none": [r"zzz (\d+)"]})
    assert one(spark, v["hp"][0]) == 8 and one(spark, v["hp"][1]) == "width: 8 HP" and one(spark, v["none"][0]) is None


def test_sections(spark):
    body = "intro text that is long enough here\n# One\nsome body text that is long enough\n# stub\nx\n# One\nanother body text long enough too\n"
    df = spark.createDataFrame([(1, body)], "id int, text string")
    assert rows(tx.sections(df, "id", r"# [^\n]*\n"), "ord", "title") == [(1, None), (2, "# One"), (3, "# One (continued)")]


def test_heading_path(spark):
    df = spark.createDataFrame([(1, 1, 1, "A"), (1, 2, 2, "B"), (1, 3, 2, "C"), (1, 4, 1, "D"), (1, 5, 2, "E")], "id int, at int, level int, title string")
    assert [r[1] for r in rows(tx.heading_path(df, ["id"], "at", "level", "title"), "at", "path")] == [["A"], ["A", "B"], ["A", "C"], ["D"], ["D", "E"]]


def test_recall(spark):
    s = spark.createDataFrame([("d", "one", 2), ("d", "two", 2)], "id string, token string, n int")
    t = spark.createDataFrame([("d", "one", 1)], "id string, token string, n int")
    assert rows(tx.recall(s, t, ["id"])) == [("d", 0.5, 0.25)]
    assert rows(tx.most_missing(s, t, ["id"], 1)) == [("d", "two", 2)]


def test_describe_slug_links_tags_lines(spark):
    long = "word " * 60
    assert one(spark, tx.describe(F.lit("short\n" + long))).endswith("...") and len(one(spark, tx.describe(F.lit(long)))) <= 200
    wrapped = "## 1. **A wrapped paragraph** of\nshort lines that `go on`\nover three of them"
    assert one(spark, tx.describe(F.lit("short\n\n<!-- a comment that is long enough to be taken for text -->\n \n" + wrapped + "\n\nlast"))) == "A wrapped paragraph of short lines that go on over three of them"
    assert one(spark, tx.describe(F.lit("short\n\nlines"))) == "" and one(spark, tx.describe(F.lit(None).cast("string"))) is None
    exact = "w" * 150 + " " + "x" * 60
    assert one(spark, tx.describe(F.lit(exact))) == "w" * 150 + "..." and one(spark, tx.describe(F.lit("y" * 201))) == "y" * 197 + "..."
    assert one(spark, tx.slug(F.lit("  Hello, World! 2 "))) == "hello-world-2"
    p = spark.createDataFrame([(1, "https://a.org/x?y", '<a href="/b"></a><a href="https://c.org/d#e"></a>')], "id int, url string, html string")
    assert rows(tx.links(p, "id", "html", "url"), "href", "host") == [("/b", "a.org"), ("https://c.org/d#e", "c.org")]
    d = spark.createDataFrame([(1, "cutoff here", "x"), (2, "no", "filter filters filtering"), (3, "no", "filter twice filter")], "id int, h string, b string")
    assert rows(tx.auto_tags(d, "id", "h", "b", {"filter": ["filter", "cutoff"]})) == [(1, "filter"), (2, "filter")]
    assert rows(tx.auto_tags(d, "id", "h", "b", {"filter": ["filter", "cutoff"]}, heading_only=("filter",))) == [(1, "filter")]
    e = spark.createDataFrame([(1, "a.b", ""), (2, "axb", ""), (3, "", "midi midi in"), (4, None, None)], "id int, h string, b string")
    assert rows(tx.auto_tags(e, "id", "h", "b", {"dot": ["a.b"], "midi": ["midi", "midi in"]})) == [(1, "dot"), (3, "midi")]
    t = spark.createDataFrame([(1, "cutoff cc 74\nother"), (2, "cutoff cc 174"), (3, "cutoff\ncc 74")], "id int, text string")
    assert rows(tx.same_line(t, "id", F.lit("cutoff"), F.lit(74))) == [(1,)]


# retrieval -----------------------------------------------------------------------------------------------------------
def test_containing_equals_brute_force(spark):
    import random

    r = random.Random(4)
    word = lambda: r.choice(["aa", "b", "cc d", "é", "ef", "g\n", "h  i"])
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 40)))) for i in range(60)] + [(100, None)]
    texts = [t for _, t in docs if t]
    cut = lambda t, n: t[(a := r.randint(0, max(0, len(t) - n))) : a + n]
    asked = [(k, cut(r.choice(texts), r.choice([1, 3, 8, 20, 40]))) for k in range(80)] + [(200, "nowhere to be found at all"), (201, "")]
    got = tx.containing(spark.createDataFrame(asked, "qid int, passage string"), spark.createDataFrame(docs, "doc_id int, text string"))
    assert rows(got) == sorted(((q, i) for q, p in asked for i, t in docs if t is not None and p in t), key=repr)


def test_ranks_of_equals_ranking(spark):
    import random

    r = random.Random(5)
    s = spark.createDataFrame([(q, d, float(r.randint(0, 4)), r.random()) for q in range(5) for d in range(12)], "qid int, doc_id int, a double, b double")
    want = spark.createDataFrame([(q, r.randint(0, 11)) for q in range(5) for _ in range(2)] + [(9, 1)], "qid int, doc_id int")
    for v in "ab":
        ranked = retrieval.ranked(s.withColumnRenamed(v, "score")).join(want.distinct(), ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("rank"))
        assert rows(retrieval.ranks_of(s, want, ["a", "b"]).where(f"variant = '{v}' and qid < 9"), "qid", "rank") == rows(ranked)
    assert rows(retrieval.ranks_of(s, want, ["a"]).where("qid = 9"), "rank") == [(None,)]


def test_digest_tells_multisets_apart(spark):
    of = lambda *values: rows(rel.digest(spark.createDataFrame([("g", v) for v in values], "g string, v int").repartition(3), ["g"]))[0][1]
    assert of(1, 2) == of(2, 1) and len({of(1), of(1, 1), of(1, 2), of(2, 2), of(1, 2, 2)}) == 5


def test_measures(spark):
    r = spark.createDataFrame([("v", 1, 1), ("v", 2, 4), ("v", 3, None)], "variant string, qid int, rank int")
    got = retrieval.measures(r, ["variant"]).first()
    assert (got["hit_1"], got["hit_3"], got["hit_5"]) == (1 / 3, 1 / 3, 2 / 3) and abs(got["mrr"] - (1 + 0.25) / 3) < 1e-12


def test_bm25_prefers_rare_words(spark):
    d = spark.createDataFrame([(1, "rare", 1), (1, "common", 1), (2, "common", 3), (3, "common", 1)], "doc_id int, token string, n int")
    q = spark.createDataFrame([(7, "rare"), (7, "common")], "qid int, token string")
    assert rows(retrieval.ranked(retrieval.bm25(d, q), 1), "doc_id", "rank") == [(1, 1)]


# relational ----------------------------------------------------------------------------------------------------------
def test_overlay(spark):
    s = spark.createDataFrame([("d", "In 1", "in", "audio"), ("d", "Out", "out", "audio")], "k string, name string, dir string, medium string")
    e = spark.createDataFrame([("d", "IN 1", None, "cv"), ("d", "New", "in", "midi")], "k string, name string, dir string, medium string")
    assert rows(rel.overlay(s, e, ["k"], "name", ["dir", "medium"])) == [("d", "IN 1", "in", "cv", "both"), ("d", "New", "in", "midi", "edit"), ("d", "Out", "out", "audio", "seed")]


def test_allocation_order_names_and_fit(spark):
    r = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3)], "k string, r int")
    s = spark.createDataFrame([("k", 10), ("k", 11)], "k string, s int")
    assert rows(rel.allocate(r, s, ["k"], ["r"], ["s"]), "r", "s") == [(1, 10), (2, 11), (3, None)]
    n = spark.createDataFrame([("Input 10",), ("Input 2",)], "n string")
    assert [x[0] for x in n.orderBy(rel.natural_key(F.col("n"))).collect()] == ["Input 2", "Input 10"]
    items = spark.createDataFrame([("b", 1, "i1", "3U", 60.0, None), ("b", 2, "i2", "3U", 60.0, None), ("b", 3, "i3", "3U", 60.0, None), ("b", 4, "i4", "1U", 5.0, None), ("b", 5, "i5", "3U", 1.0, 1)], "box string, ord int, item string, format string, size double, row_index int")
    boxes = spark.createDataFrame([("b", 1, "3U", 84.0), ("b", 2, "3U", 84.0)], "box string, row_index int, format string, size double")
    assert rows(rel.first_fit(items, boxes), "item", "row") == [("i1", 1), ("i2", 2), ("i3", 2), ("i4", None), ("i5", 1)]
    odd = [("b", 1, "i1", None, 9.0, None), ("b", 2, "i2", "3U", None, None), ("b", 3, "i3", "3U", 1.0, 7), (None, 1, "i4", "3U", 1.0, None), ("c", 1, "i5", "3U", 1.0, 1)]
    assert rows(rel.first_fit(spark.createDataFrame(odd, items.schema), boxes), "item", "row") == [("i1", None), ("i2", 2), ("i3", 1), ("i4", None), ("i5", None)]
    assert rel.same_rows(r, r).count() == 0 and rel.same_rows(r, r.where("r > 1")).count() == 1


def test_first_fit_of_many_items(spark):
    """40 boxes of 5,000 items each, as placed one after the other; within a minute."""
    items = spark.range(200_000).selectExpr("concat('s', id % 40) AS box", "cast(hash(id) AS bigint) AS ord", "concat('i', id) AS item", "concat('f', id % 7 % 3) AS format", "double(id % 11 + 1) AS size", "CASE WHEN id % 13 = 0 THEN int(id % 5) END AS row_index")
    boxes = spark.range(40 * 4).selectExpr("concat('s', id % 40) AS box", "int(id DIV 40) + 1 AS row_index", "concat('f', id DIV 40 % 2) AS format", "4000.0 AS size")
    began = time.time()
    got = {r["item"]: r["row"] for r in rel.first_fit(items, boxes).collect()}
    assert time.time() - began < 60
    left = {(f"s{b}", r): 4000.0 for b in range(40) for r in range(1, 5)}
    for x in items.orderBy("ord", "item").collect():
        mine = [r for r in range(1, 5) if x["format"] == f"f{(r - 1) % 2}"]
        row = x["row_index"] if (x["box"], x["row_index"]) in left else next((r for r in mine if left[x["box"], r] >= x["size"]), mine[-1] if mine else None)
        if row:
            left[x["box"], row] -= x["size"]
        assert got.pop(x["item"]) == row
    assert not got


# rules ---------------------------------------------------------------------------------------------------------------
def test_rules(spark):
    links = spark.createDataFrame([("l1", "a", "audio"), ("l2", "x", "audio"), ("l3", "a", "smell"), ("l3", "a", None)], "id string, to string, medium string")
    items = spark.createDataFrame([("a",)], "id string")
    v = rules.together([rules.references(links, "to", items, "id", "target", F.col("id")), rules.domain(links, "medium", ["audio"], "medium", F.col("id")), rules.unique(links, ["id"], "twice", "WARN")])
    assert rows(v, "rule", "subject") == [("medium", "l3"), ("medium", "l3"), ("target", "l2"), ("twice", "l3")]
    assert rows(rules.passes(v)) == [(3, 1, False)]
    assert rows(rules.passes(v.where("rule = 'twice'"))) == [(0, 1, True)]


def test_patch_warnings(spark):
    ports = spark.createDataFrame([("a", "o", "out", "audio", None), ("b", "i", "in", "midi", None), ("b", "h", "in", "audio", True)], "node string, name string, dir string, medium string, hidden boolean")
    cables = spark.createDataFrame([("c1", "a", "o", "b", "i"), ("c2", "a", "o", "b", "h"), ("c3", "a", "zz", "b", "i")], "id string, from_node string, from_port string, to_node string, to_port string")
    got = {r[0] for r in rows(rules.patch_warnings(cables, ports), "rule")}
    assert got == {"media differ", "hidden jack", "missing jack", "several cables into one input"}


def test_digest_and_staleness(spark):
    a = spark.createDataFrame([("k", 1), ("k", 2)], "k string, v int")
    assert rules.stale(rel.digest(a, ["k"]), rel.digest(a.orderBy(F.desc("v")), ["k"]), "k").count() == 0
    assert rules.stale(rel.digest(a, ["k"]), rel.digest(a.where("v = 1"), ["k"]), "k").count() == 1


# sources and sinks ---------------------------------------------------------------------------------------------------
def test_files(spark, tmp_path):
    (tmp_path / "m" / "doc").mkdir(parents=True)
    (tmp_path / "m" / "doc" / "01.md").write_text("---\ntitle: 'A b'\npages: [1, 2]\n---\nbody\n# h\n")
    (tmp_path / "m" / "doc" / "02.md").write_text("no header")
    got = {r["file"]: (r["meta"].get("title"), r["body"]) for r in readers.markdown(spark, f"{tmp_path}/m/*/*.md").collect()}
    assert got == {"01.md": ("A b", "body\n# h\n"), "02.md": (None, "no header")}
    (tmp_path / "x.yaml").write_text("items:\n- {id: a, n: 1}\n- {id: b}\n")
    assert rows(readers.yaml_documents(spark, f"{tmp_path}/x.yaml", "id string, n int", at="items")) == [("a", 1), ("b", None)]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "it.json").write_text('{"sources": [{"tier": "official", "url": "u", "http": "200", "values": {"ma": "5", "ma_line": "5 mA"}}]}')
    docs = readers.json_documents(spark, f"{tmp_path}/e", "sources array<struct<tier:string,url:string,http:string,values:map<string,string>>>")
    assert rows(readers.evidence_rows(docs), "item", "tier", "field", "value") == [("it", "official", "ma", "5")]
    (tmp_path / "f.py").write_text('def f(x):\n    "doc"\n    return g(x)\n')
    assert rows(readers.functions(spark, f"{tmp_path}/f.py", "python"), "name", "calls", "doc") == [("f", ["g"], "doc")]
    (tmp_path / "f.js").write_text("function a(){ b(1) }\nconst c = (x) => a(x)\n")
    assert rows(readers.functions(spark, f"{tmp_path}/f.js", "javascript"), "name", "calls") == [("a", ["b"]), ("c", ["a"])]
    empty = readers.optional(spark, f"{tmp_path}/none.json", "a int", lambda p: spark.read.json(p))
    assert empty.columns == ["a"] and empty.count() == 0


def test_sparse_json(spark, tmp_path):
    df = spark.createDataFrame([("b", 2.0, None), ('a"x', 2.5, True)], "id string, v double, f boolean")
    assert sorted(r[0] for r in df.select(sinks.sparse_json(df)).collect()) == ['{"f":true,"id":"a\\"x","v":2.5}', '{"id":"b","v":2}']
    sinks.ordered_json(df, ["id"], f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").count() == 2
