"""Entities, located headings, assembled sections, cleaned pages, stop lists."""

import html
import re

import oracle
import pytest
from pyspark.sql import functions as F

from kgspark.operators import terms
from kgspark.operators import text as tx
from kgspark.plans import registry


def test_entities_equal_the_standard_ones(spark):
    texts = ["a &amp; b &lt;c&gt; &quot;&apos;&#39;", "&eacute;&Eacute;&#233;&#xE9;&#x1F600;&#128512;", "&nosuch; & &; &#; &#xD800; &#0;", "no entity", "&hellip;&ndash;&alpha;&AMP;", "x&nbsp;y&#160;z", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.unescape(F.col("t"))).collect()]
    assert got == [None if t is None else html.unescape(t) for t in texts]


def test_html_to_text_equals_its_steps(spark):
    page = "<html><style>p{}</style><p>1,000 &euro;&nbsp;&#8211; it&#8217;s <b>12,3</b></p><!-- x --><script>a<b</script><li>1,234,567</li></html>"
    x = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ", page)
    x = html.unescape(re.sub(r"<[^>]*>", "\n", re.sub(r"(?s)<!--.*?-->", " ", x)))
    x = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", re.sub("[‐-―−]", "-", x))
    x = re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\x0b\f\r\xa0]+", " ", x)).strip()
    assert spark.createDataFrame([(page,)], "h string").select(tx.html_to_text(F.col("h"))).first()[0] == x


def test_headings_are_located_one_after_the_other(spark):
    text = "Intro about Setup here\n# Setup\nbody\nSetup\nSetup of things\nlate MENU word\n## 2. Menu:\n"
    docs = spark.createDataFrame([("d", text), ("e", None)], "id string, text string")
    wanted = [("d", 1, "Setup", None, None), ("d", 2, "setup", None, None), ("d", 3, "Setup", None, None), ("d", 4, "Setup", None, None), ("d", 5, "Menu", None, 70), ("d", 6, "Nothing", None, None), ("e", 1, "Setup", None, None)]
    out = tx.locate_headings(docs, spark.createDataFrame(wanted, "id string, ord int, title string, lo int, hi int")).collect()
    got = {(r["id"], r["ord"]): (r["at"], r["how"]) for r in out}
    assert got[("d", 1)] == (text.index("# Setup"), "heading") and got[("d", 2)] == (text.index("\nSetup\n") + 1, "line") and got[("d", 3)] == (text.index("Setup of"), "start")
    assert got[("d", 4)] == (text.index("Setup here"), "anywhere") and got[("d", 5)] == (text.index("MENU"), "anywhere") and got[("d", 6)] == (None, None) and got[("e", 1)] == (None, None)


def test_sections_are_assembled(spark):
    head = "ACME Synth Guide"
    body = lambda w: f"{w} is described in this paragraph, which is long enough to be kept."
    text = f"<!-- page 1 -->\n{head}\n# Start\n{body('Start')}\n<!-- page 2 -->\n{head}\nmore of it  \n# Stub\nshort\n<!-- page 3 -->\n{head}\n# Start\n{body('Again')}\n"
    docs = spark.createDataFrame([("m", text)], "id string, text string")
    heads = spark.createDataFrame([("m", 1, "Start", None, None), ("m", 2, "Stub", None, None), ("m", 3, "Start", None, None)], "id string, ord int, title string, lo int, hi int")
    out = [r.asDict() for r in tx.assemble(docs, tx.locate_headings(docs, heads)).orderBy("ord").collect()]
    assert [(r["ord"], r["title"], r["slug"], r["first_page"], r["last_page"]) for r in out] == [(1, "Start", "001-start", 1, 2), (2, "Start (continued)", "002-start-continued", 3, 3)]
    assert out[0]["body"] == f"{body('Start')}\n\nmore of it" and head not in out[1]["body"]
    assert out[0]["file"].startswith('---\ntitle: "Start"\ndocument: m\npages: 1-2\n---\nStart is')


def test_pages_are_cleaned_and_foreign_blocks_dropped(spark):
    raw = "## **Bold Head**\nzero​width <span style='x'>word</span>  \n\n\n\n12\nPage 13\n<!-- figure 3 knobs -->end"
    df = spark.createDataFrame([(raw, "the knob turns\nx\n\nder Knopf und die Taste\n\nlast words here")], "a string, b string")
    a, b = df.select(tx.clean_page(F.col("a")), tx.word_lines(F.col("b"), 2, ["der", "und", "die"])).first()
    assert a == "## Bold Head\nzerowidth word\n\nend" and b == "the knob turns\nlast words here"


def test_everyday_words_count_in_manuals_only(spark):
    c = spark.createDataFrame([("m", "manual", "note", "note", 3), ("c", "code", "note", "note", 5), ("c", "code", "filter", "VCF", 2), ("x", None, "note", "notes", 1)], "id string, source_type string, concept string, label string, n int")
    kept, skipped = terms.source_aware(c, ["note"])
    assert sorted((r["id"], r["n"]) for r in kept.collect()) == [("c", 2), ("m", 3)] and [tuple(r) for r in skipped.collect()] == [("note", 6)]


def test_titles_slugs_and_skipped_headings(spark):
    titles = ["3.1.2 Menu Use", "12", "2. ", None, "# **(EN) Start**", "| (EN) | Controls |", "- item one", "-5 V rail"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r[0] for r in df.select(tx.section_slug(F.col("t"))).collect()] == ["menu-use", "section", "section", "section", "en-start", "en-controls", "item-one", "5-v-rail"]
    assert [r[0] for r in df.select(tx.clean_title(F.col("t"), "EN")).collect()] == ["3.1.2 Menu Use", "12", "2.", None, "Start", "Controls", "item one", "-5 V rail"]
    body = "a body that is long enough to be a section"
    text = f"# Index\n{body} 0\n# Start\n{body} 1\n## **NOTE**\n{body} 2\n# \n{body} 3\n# Stub\nx\n# start\n{body} 4\n# Note"
    docs = spark.createDataFrame([("d", text), ("e", f"{body}"), ("f", None), ("g", "")], "id string, text string")
    got = [(r.id, r.ord, r.title, r.start, r.body) for r in tx.sections(docs, "id", r"#+ [^\n]*(?:\n|$)", skip=["note", "Index"], clean=True).orderBy("id", "ord").collect()]
    start, again = text.index("# Start"), text.index("# start")
    assert got == [
        ("d", 1, None, 0, f"# Index\n{body} 0"),
        ("d", 2, "Start", start, f"{body} 1\n## **NOTE**\n{body} 2\n# \n{body} 3"),
        ("d", 3, "start (continued)", again, f"{body} 4\n# Note"),
        ("e", 1, None, 0, body),
    ]
    heads = spark.createDataFrame([("d", "The  *Note*"), ("d", "Noted"), ("d", None)], "id string, title string")
    assert sorted(str(r.title) for r in tx.kept_headings(heads, ["the note"]).collect()) == ["None", "Noted"]


def test_figures_come_with_the_line_of_their_own_pattern(spark):
    text = "Width here: 30 mm\n  WIDTH:\t 12   HP \U0001f600\nDepth 9999999999 mm\n" + "w" * 200 + " 7 te"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = tx.extract(F.col("t"), {"hp": [r"^\s*width:\s*(\d+)\s*hp", r"width\D+(\d+)"], "mm": [r"none (\d+)", r"width\D+(\d+) mm$"], "deep": [r"depth (\d+)"], "te": [r"(\d+) te"]})
    rows = df.select(*[c for v in got.values() for c in v]).collect()
    assert tuple(rows[0]) == (12, "WIDTH: 12 HP \U0001f600", 30, "Width here: 30 mm", None, "Depth 9999999999 mm", 7, "w" * 160)
    assert all(v is None for r in rows[1:] for v in r)


def test_defaults_covered_both_ways_or_by_name(spark):
    from kgspark.operators import relational as rel

    have = spark.createDataFrame([("d", "THRU", "bidir", "midi"), ("d", "Out", "out", "audio"), (None, "x", "in", "cv")], "device string, name string, dir string, medium string")
    add = spark.createDataFrame([("d", "In", "in", "midi"), ("d", "Out 2", "out", "audio"), ("d", "thru", "in", "cv"), ("d", "CV", "in", "cv"), ("d", "Both", "bidir", "audio"), ("e", "Thru", "in", "midi")], "device string, name string, dir string, medium string")
    on = ["device", "dir", "medium"]
    assert sorted(r.name for r in rel.default_fill(have, add, on, {"dir": {"bidir": ["in", "out"]}}, ["device", "name"]).collect()) == ["Both", "CV", "Thru"]
    assert sorted(r.name for r in rel.default_fill(have, add, on).collect()) == ["Both", "CV", "In", "Thru", "thru"]


@pytest.mark.parametrize("odd", ["le*s.", "les` .", "l  es.", "\tles.", "les\t.", "LES.", " les.", "\u00a0les.", "\u3000les.", "les.\r", "les.\u2028", "les.\u0085", "x\rles.", "x\u2029les.", "les.\x0b", "\x0bnew.", "\x0cnew.", "new.\r", "a.b.\rc."])
def test_skipped_sections_equal_their_sql_on_odd_lines(spark, tmp_path, odd):
    """Lines that look like a heading of the skip list, or like one at another kind of line end, in front, between and last."""
    body = "a body that is long enough to be a section"
    texts = [f"les.\n{body} {k}\nOne.\n{body}\nle  s.\n{body}" for k in range(3)] + [f"h{k}.\n{body}\nh{k}.\n{body}" for k in range(20)]
    texts += [f"{odd}\n{body}\nTwo.\n{body} a\n{odd}\n{body} \x0b\nTwo.\n\x0b{body}\u2028\n{odd}", odd, f"{body}\n{odd}\n{body} \r\n", None, "", "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert oracle.differences(spark, str(tmp_path), registry.QUERIES["sections_skipping"], registry.ORACLES["sections_skipping"]) == ""
