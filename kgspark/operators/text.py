"""Document text: HTML to text, fields with provenance, sections, tags, coverage, leaks, links."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that may stand without a semicolon are at most this long.
SHORT = max(len(n) for n in html5 if not n.endswith(";"))


def unescape(text: Column) -> Column:
    """Character references read as HTML 5 does: decimal, hexadecimal, names with a semicolon, and of old names the longest one that a
    run of characters begins with. Numbers 128 to 159 are meant as Windows-1252; what is no character becomes U+FFFD or
    nothing, unknown names stay as they are."""
    table = F.str_to_map(F.lit("\x01".join(f"{n}\x02{c}" for n, c in html5.items())), F.lit("\x01"), F.lit("\x02"))
    western = F.str_to_map(F.lit("\x01".join(f"{k}\x02{c}" for k in range(0x80, 0xA0) for c in [bytes([k]).decode("cp1252", "replace").replace("\ufffd", chr(k))])), F.lit("\x01"), F.lit("\x02"))
    void = lambda n: n.between(1, 8) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n == 11) | ((n % 65536) >= 65534)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    def numeric(x: Column) -> Column:
        told = F.when(F.lower(F.substring(x, 3, 1)) == "x", F.conv(F.regexp_replace(F.regexp_extract(x, "([0-9A-Fa-f]+);?$", 1), "^0+(?=.)", ""), 16, 10)).otherwise(F.regexp_replace(F.regexp_extract(x, "([0-9]+);?$", 1), "^0+(?=.)", ""))
        n = F.when(F.length(told) < 10, told.try_cast("bigint")).otherwise(F.lit(1 << 40))
        return F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd")).when(n == 13, F.lit("\r")).when(n.between(128, 159), F.try_element_at(western, n.cast("string"))).when(void(n), F.lit("")).otherwise(char(n))

    def named(x: Column) -> Column:
        name = F.substring(x, 2, 33)
        begun = [F.concat(F.try_element_at(table, F.left(name, F.lit(k))), F.substring(name, k + 1, 33)) for k in range(SHORT, 1, -1)]
        return F.coalesce(F.try_element_at(table, name), *[F.when(F.length(name) > k, b) for k, b in zip(range(SHORT, 1, -1), begun, strict=True)], x)

    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda x: F.when(x.startswith("&#"), numeric(x)).otherwise(named(x)))
    whole = F.array_join(F.zip_with(F.split(text, ENTITY, -1), found, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


#: "+12V" over "130mA"
RAIL = r"(?im)^([+-]? ?(?:12|5) ?v) ?:? ?\n(\d{1,4} ?ma)\b"


def html_to_text(html: Column) -> Column:
    """Visible text: scripts and styles dropped, a line for each tag, entities read, dashes and blanks made one kind; a rail's label
    and the figure on the line below it become one line."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"<[^>]*>", "\n")
    x = unescape(x)
    x = F.regexp_replace(x, "[‐-―−]", "-")
    x = F.regexp_replace(x, r"(?<=\d),(?=\d{3}(?!\d))", "")
    x = F.regexp_replace(x, r"[ \t\x0B\f\r ]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")
    return F.regexp_replace(x, RAIL, "$1: $2")


def extract(text: Column, fields: dict[str, list[str]]) -> dict[str, tuple[Column, Column]]:
    """field -> (value, line): of a field's ordered patterns the first that matches, in any case, gives an int and the line that its
    match begins on, blanks drawn together and cut to 160. A figure that is no int is null."""
    low = F.lower(text)
    out = {}
    for field, pats in fields.items():
        hits = []
        for p in pats:
            parts = F.split(low, f"(?im){p}", 2)  # what stands before the match says its line
            line = F.get(F.split(text, "\n"), F.regexp_count(F.get(parts, F.lit(0)), F.lit("\n")))
            value = F.regexp_extract(low, f"(?im){p}", 1).try_cast("int")
            hits.append(F.when(F.size(parts) > 1, F.struct(value.alias("value"), F.left(F.trim(F.regexp_replace(line, r"\s+", " ")), F.lit(160)).alias("line"))))
        first = F.coalesce(*hits)
        out[field] = (first["value"], first["line"])
    return out


def slug(text: Column, most: int = 60) -> Column:
    x = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.left(F.regexp_replace(x, "^-+|-+$", ""), F.lit(most)), "-+$", "")


def section_slug(title: Column, most: int = 60) -> Column:
    """The slug of a section's title without the number it begins with; 'section' where nothing is left."""
    return F.coalesce(F.nullif(slug(F.regexp_replace(title, r"^\s*\d+(?:\.\d+)*\.?\s*", ""), most), F.lit("")), F.lit("section"))


def plain_title(title: Column) -> Column:
    """A title as it is compared: lower case, without marks, blanks drawn together."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(title, "[*_#`]", ""), r"\s+", " ")))


def clean_title(title: Column, language: str | None = None) -> Column:
    """A title without heading, list and bold marks; with a language its mark, as '(EN)', goes too, in a table's cell as well."""
    x = F.regexp_replace(F.regexp_replace(title, r"\*\*", ""), r"^\s*(?:#+|[-*](?=\s))\s*", "")
    if language:
        x = F.regexp_replace(x, rf"^[|\s]*\({re.escape(language)}\)[|\s]*", "")
    return F.regexp_replace(x, r"^[|\s]+|[|\s]+$", "")


def kept_headings(headings: DataFrame, skip: list[str], title: str = "title") -> DataFrame:
    """headings but those with a title of the skip list; what stands under these belongs to the section before."""
    asked = headings.sparkSession.createDataFrame([(s,) for s in skip], "_skip string").select(plain_title(F.col("_skip")).alias("_skip"))
    return headings.join(asked, plain_title(F.col(title)) == F.col("_skip"), "left_anti")


def describe(text: Column, least: int = 40, most: int = 200) -> Column:
    """The first paragraph (empty lines divide them) of 40 characters or more that is no comment, cut at a word to 197 and '...'
    where it is over 200; '' without one. Marks and numbers that it begins with, bold and code marks go."""
    bare = lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+$", ""), r"^[#>*\-\d.\s]+|\*\*|`", "")
    plain = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(bare(p), r"\s+", " "))
    first = F.get(F.filter(plain, lambda p: (F.length(p) >= least) & ~F.startswith(p, F.lit("<!--"))), F.lit(0))
    cut = F.regexp_replace(F.left(first, F.lit(most - 3)), r" \S*$", "")
    found = F.when(F.length(first) > most, F.concat(cut, F.lit("..."))).otherwise(first)
    return F.when(text.isNotNull(), F.coalesce(found, F.lit("")))


def sections(docs: DataFrame, id_col: str, heading: str, least: int = 20, text: str = "text", skip: list[str] | None = None, clean: bool = False, language: str | None = None, plain: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, ord, title, start, body) split where `heading` matches whole lines; stubs are left out before numbering, a
    title met again gets ' (continued)'. Text before the first heading has a null title.

    A heading with a title of the skip list begins no section: it and its text stay with the section before (at the beginning: with
    a null title). With clean, titles are cleaned first, and a heading without any words begins none either. With plain, it is the
    heading's whole line by plain that is compared with the list, not the title by plain_title. Lines end with \\n alone.
    """
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text), rf"(?md)^(?={heading})")).alias("at", "part"))
    w = Window.partitionBy("id").orderBy("at")
    strip = lambda c: F.regexp_replace(c, r"\A[ \t\n\f\r]+|[ \t\n\f\r]+\z", "")
    head = F.nullif(F.regexp_extract("part", rf"(?md)\A({heading})", 1), F.lit(""))
    parts = parts.withColumn("title", clean_title(head, language) if clean else strip(head))
    if skip or clean:
        key, same = (plain(F.regexp_replace(head, r"\n\z", "")), plain) if plain else (plain_title(F.col("title")), plain_title)
        passed = reduce(lambda a, s: a | (key == same(F.lit(s))), skip or [], (F.col("title") == "") if clean else F.lit(False))
        parts = parts.withColumn("_passed", F.coalesce(passed, F.lit(False)))
        parts = parts.withColumn("_at", F.max(F.when(~F.col("_passed"), F.col("at"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", F.coalesce("_at", F.lit(0)))
        own = F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda p: p["part"])  # a document's own text
        parts = parts.groupBy("id", "_at").agg(F.array_join(own, "").alias("part"), F.max(F.when((F.col("at") == F.col("_at")) & ~F.col("_passed"), F.col("title"))).alias("title")).withColumnRenamed("_at", "at")
    parts = parts.withColumn("start", F.coalesce(F.sum(F.length("part")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = parts.withColumn("body", strip(F.when(F.col("title").isNull(), F.col("part")).otherwise(F.regexp_replace("part", rf"(?md)\A(?:{heading})", ""))))
    kept = parts.where(F.length("body") >= least)
    again = F.row_number().over(Window.partitionBy("id", F.lower("title")).orderBy("at")) > 1
    kept = kept.withColumn("title", F.when(F.col("title").isNotNull() & again, F.concat("title", F.lit(" (continued)"))).otherwise(F.col("title")))
    return kept.select("id", F.row_number().over(w).alias("ord"), "title", F.col("start").cast("long").alias("start"), "body")


def next_boundary(df: DataFrame, keys: list[str], at: str, end: Column) -> DataFrame:
    """df with `until`: the next boundary of its group, or end."""
    return df.withColumn("until", F.coalesce(F.lead(at).over(Window.partitionBy(*keys).orderBy(at)), end))


def heading_path(df: DataFrame, keys: list[str], at: str, level: str, title: str, most: int = 6) -> DataFrame:
    """df with `path`: the titles of the headings above each row, its own last."""
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col(level) == i, F.struct(F.col(at).alias("p"), F.col(title).alias("t"))), True).over(w).alias(f"_h{i}") for i in range(1, most + 1)]
    out = df.select("*", *last)
    parts, newest = [], F.lit(-1).cast("long")
    for i in range(1, most + 1):
        h = F.col(f"_h{i}")
        live = h.isNotNull() & (F.lit(i) <= F.col(level)) & (h["p"] >= newest)
        parts.append(F.when(live, h["t"]))
        newest = F.when(live, F.greatest(newest, h["p"].cast("long"))).otherwise(newest)
    return out.withColumn("path", F.array_compact(F.array(*parts))).drop(*[f"_h{i}" for i in range(1, most + 1)])


def auto_tags(docs: DataFrame, id_col: str, heading: str, body: str, vocabulary: dict[str, list[str]], least: int = 3, heading_only: tuple[str, ...] = ()) -> DataFrame:
    """(id, tag): a keyword starts a word of the heading, or keywords start at least 3 words of the body, each keyword counted
    for itself; tags of heading_only go by the heading alone. Keywords are plain text."""
    x = docs.select(F.col(id_col).alias("id"), F.lower(heading).alias("h"), F.lower(body).alias("b"))

    def hits(column: str, keywords: list[str]) -> Column:
        return sum((F.regexp_count(column, F.lit(r"\b" + re.escape(k.lower()))) for k in keywords), F.lit(0))

    tags = [F.when((hits("h", k) > 0) | (F.lit(tag not in heading_only) & (hits("b", k) >= least)), F.lit(tag)) for tag, k in vocabulary.items()]
    return x.select("id", F.explode(F.array_compact(F.array(*tags))).alias("tag"))


def tokens(df: DataFrame, keys: list[str], text: str, pattern: str = "[a-z]{4,}") -> DataFrame:
    """(keys, token, n)"""
    x = df.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("token"))
    return x.groupBy(*keys, "token").agg(F.count("*").alias("n"))


def recall(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """keys, unique_recall, occurrence_recall of source(keys, token, n) in target(keys, token, n)."""
    j = source.join(target.withColumnRenamed("n", "m"), [*keys, "token"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return j.groupBy(*keys).agg((F.count_if(F.col("m") > 0) / F.count("*")).alias("unique_recall"), (F.sum(F.least("n", "m")) / F.sum("n")).alias("occurrence_recall"))


def most_missing(source: DataFrame, target: DataFrame, keys: list[str], top: int = 12) -> DataFrame:
    """keys, token, missing: the words with the largest deficit."""
    j = source.join(target.withColumnRenamed("n", "m"), [*keys, "token"], "left").withColumn("missing", F.col("n") - F.coalesce("m", F.lit(0))).where("missing > 0")
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("missing"), "token"))
    return j.withColumn("_r", r).where(F.col("_r") <= top).select(*keys, "token", "missing")


def leaks(docs: DataFrame, id_col: str, patterns: list[str], text: str = "text") -> DataFrame:
    """(id, found) of texts that hold any of the patterns, in any case."""
    every = "(?i)(" + "|".join(patterns) + ")"
    return docs.where(F.col(text).rlike(every)).select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(every), F.lit(1)))).alias("found"))


def containing(passages: DataFrame, docs: DataFrame, width: int = 3) -> DataFrame:
    """(qid, doc_id) of the documents docs(doc_id, text) that hold the whole of a passage passages(qid, passage).

    A passage's words but its first and last ones stand as they are in any text that holds it. Of their runs of `width` words the
    rarest names the candidates, which are then looked into; passages with fewer words are looked for in every text.
    """
    runs = lambda words: F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.array_join(F.slice(words, i, width), " "))))
    p = passages.select("qid", "passage").distinct().withColumn("_w", F.split("passage", r"\s+", -1))
    p = p.withColumn("_runs", runs(F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0)))))
    asked = p.where("_runs is not null").select("qid", "passage", F.explode("_runs").alias("h"))
    held = docs.select("doc_id", F.split("text", r"\s+", -1).alias("_w")).select("doc_id", F.explode(F.array_distinct(runs(F.col("_w")))).alias("h"))
    held = held.join(asked.select("h").distinct(), "h", "left_semi")
    often = asked.join(held.groupBy("h").agg(F.count("*").alias("n")), "h", "left")
    rarest = often.groupBy("qid", "passage").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h")).alias("x")).where("x.n > 0").select("qid", "passage", F.col("x.h").alias("h"))
    likely = rarest.join(held, "h").select("qid", "passage", "doc_id").join(docs.select("doc_id", "text"), "doc_id")
    short = p.where("_runs is null").select("qid", "passage").join(docs.select("doc_id", "text"), F.contains(F.col("text"), F.col("passage")))
    return likely.where(F.contains(F.col("text"), F.col("passage"))).select("qid", "doc_id").union(short.select("qid", "doc_id"))


def links(pages: DataFrame, id_col: str, html: str, url: str) -> DataFrame:
    """(id, href, host): hosts of relative links are the page's own."""
    x = pages.select(F.col(id_col).alias("id"), F.col(url).alias("_u"), F.explode(F.regexp_extract_all(F.col(html), F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return x.select("id", "href", F.when(F.col("href").rlike("^https?://"), F.regexp_extract("href", "^https?://([^/?#]*)", 1)).otherwise(F.regexp_extract("_u", "^https?://([^/?#]*)", 1)).alias("host"))


def same_line(docs: DataFrame, id_col: str, word: Column, number: Column, text: str = "text") -> DataFrame:
    """(id) of texts with a line that holds the word and the number, the number not as part of a longer one."""
    lines = docs.select(F.col(id_col).alias("id"), word.alias("_w"), number.cast("string").alias("_n"), F.explode(F.split(F.col(text), "\n")).alias("line"))
    return lines.where(F.contains(F.col("line"), F.col("_w")) & F.regexp_like(F.col("line"), F.concat(F.lit(r"(?<!\d)"), F.col("_n"), F.lit(r"(?!\d)")))).select("id").distinct()


def clean_page(text: Column) -> Column:
    """Page text without zero-width characters, figure captions in markers, style tags and bold marks around headings, bare
    page numbers, blanks at line ends and runs of empty lines."""
    steps = [
        ("[\u200b-\u200d\ufeff\u2060\u00ad]", ""),
        (r"(?is)<!--\s*figure\b.*?-->", ""),
        (r"(?is)</?(?:span|font|u|sup|sub|br)\b[^>]*>", ""),
        (r"(?m)^(#{1,6}[ \t]+)\*\*(.+?)\*\*[ \t]*$", "$1$2"),
        (r"(?im)^[ \t]*(?:page[ \t]+)?\d{1,4}[ \t]*(?:\n|\z)", ""),
        (r"(?m)[ \t]+$", ""),
        (r"\n{3,}", "\n\n"),
    ]
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def word_lines(text: Column, least: int = 2, foreign: list[str] | None = None) -> Column:
    """The lines with at least so many words of three letters or more; with foreign words given, a block (what stands between
    empty lines) goes if it holds more of these than lines."""
    kept = text
    if foreign:
        words = r"(?i)(?<!\p{L})(?:" + "|".join(foreign) + r")(?!\p{L})"
        own = lambda block: F.regexp_count(block, F.lit(words)) <= F.size(F.split(block, "\n"))
        kept = F.array_join(F.filter(F.split(kept, r"\n[ \t]*\n"), own), "\n\n")
    return F.array_join(F.filter(F.split(kept, "\n"), lambda line: F.regexp_count(line, F.lit(r"\p{L}{3,}")) >= least), "\n")


LOCATED = "id string, ord int, title string, at int, found int, how string"


def locate_headings(docs: DataFrame, headings: DataFrame) -> DataFrame:
    """(id, ord, title, at, found, how): where each of headings(id, ord, title, lo, hi) stands in docs(id, text).

    Within its window [lo, hi) of the text a heading is looked for as a Markdown heading, as a line of its own, as the start
    of a line, at last anywhere; case and blanks don't count. A place that a heading before it took isn't taken again, so the
    headings of one document go one after the other; what isn't found has nulls. `found` is the length of what was met.
    """
    import re

    import pandas as pd

    def go(texts: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out, taken = [], set()
        text = texts.text.iloc[0] if len(texts) and texts.text.iloc[0] is not None else ""
        for h in wanted.sort_values("ord").itertuples():
            words = r"[ \t]+".join(map(re.escape, (h.title or "").split()))
            forms = [("heading", rf"(?im)^#{{1,6}}[ \t]+\W*{words}\W*$"), ("line", rf"(?im)^[ \t]*{words}[ \t]*$"), ("start", rf"(?im)^[ \t]*{words}\b"), ("anywhere", rf"(?i){words}")]
            lo = 0 if pd.isna(h.lo) else int(h.lo)
            hi = len(text) if pd.isna(h.hi) else min(int(h.hi), len(text))
            hit = None
            for how, pattern in forms if words else []:
                hit = next(((m.start(), m.end() - m.start(), how) for m in re.compile(pattern).finditer(text, lo, hi) if m.start() not in taken), None)
                if hit:
                    taken.add(hit[0])
                    break
            out.append((h.id, h.ord, h.title, *(hit or (None, None, None))))
        return pd.DataFrame(out, columns=["id", "ord", "title", "at", "found", "how"]).astype({"at": "Int32", "found": "Int32"})

    return docs.select("id", "text").groupBy("id").cogroup(headings.groupBy("id")).applyInPandas(go, LOCATED)


def pages_covered(marks: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, ord, first_page, last_page): the pages of marks(id, at, page) inside each section of starts(id, ord, at, until), the
    one in effect at its start among them."""
    both = marks.select("id", "at", "page", F.lit(None).cast("int").alias("ord"), F.lit(0).alias("k")).union(starts.select("id", "at", F.lit(None).cast("int"), F.col("ord").cast("int"), F.lit(1)))
    w = Window.partitionBy("id").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    now = both.withColumn("page", F.last("page", True).over(w)).withColumn("ord", F.last("ord", True).over(w))
    return now.where("ord is not null").groupBy("id", "ord").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


MARK = r"<!-- page (\d+) -->"


def assemble(docs: DataFrame, located: DataFrame, least: int = 60, headers: int = 3) -> DataFrame:
    """(id, ord, title, slug, first_page, last_page, body, file): sections of docs(id, text) cut at located headings.

    Each runs to the next heading found. Its own heading, page marks and running headers (lines that stand `headers` times or
    more in the document, titles or short ones without an end mark) are dropped; stubs shorter than `least` are left out and
    the rest numbered; a title met again gets ' (continued)'. `file` is the section with a header of its fields.
    """
    spots = located.where("at is not null").join(docs.select("id", F.length("text").alias("_n"), "text"), "id")
    spots = next_boundary(spots, ["id"], "at", F.col("_n"))
    lines = docs.select("id", F.explode(F.split("text", "\n")).alias("line")).select("id", F.trim("line").alias("line")).where("line <> '' and length(line) <= 60")
    often = lines.where(~F.col("line").rlike(r"[.!?:;]$|^[-*|#<]")).groupBy("id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= headers)
    running = often.groupBy("id").agg(F.collect_set("line").alias("_running"))  # a document's few headers
    own = F.expr("substring(text, at + 1 + found, until - at - found)")
    kept = F.filter(F.split(F.regexp_replace(own, MARK, ""), "\n"), lambda x: ~F.array_contains(F.coalesce("_running", F.array().cast("array<string>")), F.trim(x)))
    cut = spots.join(running, "id", "left").withColumn("body", F.regexp_replace(clean_page(F.array_join(kept, "\n")), r"^\s+|\s+$", ""))
    marks = docs.select("id", F.posexplode(F.split("text", f"(?={MARK})")).alias("p", "part"))
    before = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy("id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marks = marks.withColumn("at", before.cast("int")).withColumn("page", F.nullif(F.regexp_extract("part", "^" + MARK, 1), F.lit("")).cast("int")).where("page is not null")
    pages = pages_covered(marks.select("id", "at", "page"), spots.select("id", "ord", "at", "until"))
    good = cut.drop("text").where(F.length("body") >= least).join(pages, ["id", "ord"], "left")
    w = Window.partitionBy("id").orderBy("at")
    again = F.row_number().over(Window.partitionBy("id", F.lower("title")).orderBy("at")) > 1
    named = good.withColumn("title", F.when(again, F.concat("title", F.lit(" (continued)"))).otherwise(F.col("title"))).withColumn("ord", F.row_number().over(w))
    named = named.withColumn("slug", F.concat(F.lpad(F.col("ord").cast("string"), 3, "0"), F.lit("-"), section_slug(F.col("title"))))
    page = F.when(F.col("first_page").isNotNull(), F.concat(F.lit("pages: "), F.concat_ws("-", F.col("first_page").cast("string"), F.col("last_page").cast("string")), F.lit("\n"))).otherwise("")
    title = F.concat(F.lit('title: "'), F.regexp_replace("title", '"', "'"), F.lit('"\n'))
    return named.select("id", "ord", "title", "slug", "first_page", "last_page", "body", F.concat(F.lit("---\n"), title, F.lit("document: "), F.col("id"), F.lit("\n"), page, F.lit("---\n"), F.col("body"), F.lit("\n")).alias("file"))
