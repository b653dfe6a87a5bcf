"""Queries over texts: terms, tags, fields, sections, coverage, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, relational, retrieval, terms
from ..operators import text as tx
from ..sources import sinks
from .base import query

#: Java and RE2 differ in what a word boundary is next to other letters, so these become one.
ASCII = "regexp_replace(lower(text), '[^\\x00-\\x7F]', 'x', 'g')"
WORDS = "('with', 'from', 'this', 'that', 'para', 'dans', 'sich', 'queda', 'pour', 'avec')"


def ascii_text():
    return F.regexp_replace(F.lower("text"), r"[^\x00-\x7F]", "x")


def words(t):
    return tx.tokens(t.documents, ["doc_id", "source", "lang"], "text")


WORDS_SQL = "tok AS (SELECT doc_id, source, lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents), tf AS (SELECT doc_id, source, lang, token, count(*) AS n FROM tok GROUP BY ALL)"
LIST = ["with", "from", "this", "that", "para", "dans", "sich", "queda", "pour", "avec"]


#: narrower than what: concepts over words
NARROWER = [("pointer", "word"), ("joint", "word"), ("this", "pointer"), ("that", "pointer"), ("with", "joint"), ("from", "joint"), ("pour", "joint"), ("para", "joint")]


@query(f"""WITH RECURSIVE {WORDS_SQL}, b(child, parent) AS (VALUES {', '.join(map(str, NARROWER))}),
c(concept, word) AS (SELECT parent, parent FROM b UNION SELECT c.concept, b.child FROM c JOIN b ON b.parent = c.word)
SELECT concept, count(DISTINCT doc_id) AS documents, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources FROM c JOIN tf ON token = word GROUP BY 1""")
def where_used(t):
    """Concepts with all that is narrower: documents, languages and sources that use any word of the family."""
    edges = t.documents.sparkSession.createDataFrame(NARROWER, "src string, dst string")
    family = graph.closure(edges).select(F.col("ancestor").alias("concept"), F.col("descendant").alias("token"))
    roots = edges.select(F.col("dst").alias("concept")).distinct()
    used = words(t).join(family.join(roots, "concept", "left_semi"), "token")
    return used.groupBy("concept").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"))


EVERYDAY = ["with", "this", "para"]


@query(f"""WITH {WORDS_SQL} SELECT 'kept' AS part, token, sum(n)::BIGINT AS n FROM tf WHERE token IN {WORDS} AND (lang = 'en' OR token NOT IN ('with', 'this', 'para')) GROUP BY 2
UNION ALL SELECT 'skipped', token, sum(n)::BIGINT FROM tf WHERE lang <> 'en' AND token IN ('with', 'this', 'para') GROUP BY 2""")
def everyday_words(t):
    """Everyday words count in English texts only; what is left out elsewhere is told."""
    c = words(t).where(F.col("token").isin(LIST)).select(F.col("doc_id").alias("id"), F.col("lang").alias("source_type"), F.col("token").alias("concept"), "n")
    kept, skipped = terms.source_aware(c, EVERYDAY, "en")
    kept = kept.groupBy("concept").agg(F.sum("n").alias("n"))
    return kept.select(F.lit("kept").alias("part"), F.col("concept").alias("token"), "n").union(skipped.select(F.lit("skipped"), "concept", "n"))


DOMINANT_SQL = f"""{WORDS_SQL}, u AS (SELECT source, lang, token, sum(n)::BIGINT AS n FROM tf WHERE token IN ('with', 'from', 'this') GROUP BY ALL),
top AS (SELECT *, rank() OVER (PARTITION BY source, lang ORDER BY n DESC) AS r FROM u),
win AS (SELECT source, lang, CASE WHEN count(*) > 1 THEN array_to_string(list_sort(list(token)), ' = ') || ' (tie)' ELSE min(token) END AS winner, count(*) > 1 AS tied, max(n) AS uses FROM top WHERE r = 1 GROUP BY 1, 2)"""


def _dominant(t):
    return terms.dominant(words(t).where(F.col("token").isin("with", "from", "this")), ["source", "lang"], "token", "n")


@query(f"WITH {DOMINANT_SQL} SELECT * FROM win")
def dominant_word(t):
    """The word each source uses most, by language; ties decide nothing."""
    return _dominant(t)


@query(f"WITH {DOMINANT_SQL} SELECT * FROM win WHERE lang IN (SELECT lang FROM win WHERE NOT tied GROUP BY 1 HAVING count(DISTINCT winner) > 1)")
def naming_differences(t):
    """Languages within which sources clearly differ."""
    return terms.differing(_dominant(t), "lang")


@query(f"WITH {WORDS_SQL} SELECT token, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources, array_to_string(list_sort(list(DISTINCT lang)), ', ') AS langs FROM tf WHERE token IN {WORDS} GROUP BY 1")
def vocabulary(t):
    """Who uses which word."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    return words(t).where(F.col("token").isin(LIST)).groupBy("token").agg(listed("source").alias("sources"), listed("lang").alias("langs"))


@query(f"""WITH {WORDS_SQL}, a AS (SELECT DISTINCT token FROM tf WHERE lang = 'en'), b AS (SELECT DISTINCT token FROM tf WHERE lang = 'de')
SELECT CASE WHEN a.token IS NULL THEN 'right_only' WHEN b.token IS NULL THEN 'left_only' ELSE 'shared' END AS side, count(*) AS n FROM a FULL JOIN b ON a.token = b.token GROUP BY 1""")
def term_gaps(t):
    """Words of English texts, of German ones, and of both."""
    w = words(t)
    return terms.gaps(w.where("lang = 'en'"), w.where("lang = 'de'"), "token").groupBy("side").agg(F.count("*").alias("n"))


PLAIN = [("this", "pointer"), ("that", "pointer"), ("with", "joint"), ("from", "joint"), ("the", "article"), ("of the", "of-the")]


@query(f"""WITH x AS (SELECT doc_id AS id, unnest(regexp_extract_all(replace({ASCII}, '_', ' '), '\\b(?:of[\\s-]+the|this|that|with|from|the)(?:e?s)?\\b')) AS w FROM documents),
l AS (SELECT id, CASE WHEN w LIKE 'of%' THEN 'of the' ELSE regexp_extract(w, '^(this|that|with|from|the)', 1) END AS label FROM x)
SELECT id, CASE WHEN label IN ('this', 'that') THEN 'pointer' WHEN label IN ('with', 'from') THEN 'joint' WHEN label = 'the' THEN 'article' ELSE 'of-the' END AS concept, label, count(*) AS n FROM l GROUP BY ALL""")
def term_counts(t):
    """How often each document uses each label of a short list: whole words, plurals, the longer label first."""
    return terms.match_labels(t.documents.select("doc_id", F.translate(ascii_text(), "_", " ").alias("text")), PLAIN, "doc_id")


#: labels with their concepts; null ones consume their text (a homograph, a stop phrase)
LABELS = [("of the", "of-the"), ("the", "article"), ("tion", "suffix"), ("in the", None), ("this", "pointer"), ("that", "pointer"), ("EG", "acronym"), ("die", "article"), ("la", None)]


@query()
def term_match_full(t):
    """Whole labels of several words, longest first, homographs and stop phrases consumed."""
    return terms.match_labels(t.documents, LABELS, "doc_id")


@query()
def vocabulary_match(t):
    """A vocabulary read from the tables: the first two words of each benchmark text and its longer words as labels; what whole
    documents use of it. No SQL: matches are taken leftmost first."""
    first = t.benchmark.select(F.regexp_extract(F.lower("text"), r"^\W*(\w+\s\w+)\s", 1).alias("label")).where("label <> ''").distinct()
    longer = tx.tokens(t.benchmark, [], "text", "[a-z]{7,}").select(F.col("token").alias("label"))
    labels = first.withColumn("concept", F.lit("opening")).union(longer.withColumn("concept", F.lit("word")))
    return terms.match_vocabulary(t.documents, labels, "doc_id").groupBy("concept", "label").agg(F.count("*").alias("documents"), F.sum("n").alias("uses"))


TAGS = {"article": ["the", "der", "les"], "pointer": ["this", "that"], "motion": ["tion", "ment"], "joint": ["and", "und", "con"]}
_TAG_SQL = " UNION ALL ".join(f"SELECT id, '{k}' AS tag FROM x WHERE len(regexp_extract_all(h, '\\b(?:{'|'.join(v)})')) > 0 OR len(regexp_extract_all(b, '\\b(?:{'|'.join(v)})')) >= 3" for k, v in TAGS.items())


@query(f"WITH x AS (SELECT doc_id AS id, split_part({ASCII}, chr(10), 1) AS h, {ASCII} AS b FROM documents) {_TAG_SQL}")
def auto_tags(t):
    """Tags by keyword: in the first line, or three times in the text."""
    d = t.documents.select("doc_id", ascii_text().alias("b")).withColumn("h", F.substring_index("b", "\n", 1))
    return tx.auto_tags(d, "doc_id", "h", "b", TAGS)


@query("""WITH p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '\\s+$', ''), '^[#>*\\-\\d.\\s]+|\\*\\*|`', '', 'g'), '\\s+', ' ', 'g')), lambda x: length(x) >= 40 AND NOT starts_with(x, '<!--'))[1] AS d FROM documents)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN length(d) > 200 THEN regexp_replace(left(d, 197), ' \\S*$', '') || '...' ELSE coalesce(d, '') END AS description FROM p""")
def describe_docs(t):
    """The first longer paragraph of each document."""
    return t.documents.select("doc_id", tx.describe(F.col("text")).alias("description"))


_GROUPED = "regexp_replace({}, '(\\d),(\\d\\d\\d)([^\\d]|$)', '\\1\\2\\3', 'g')"
_READ = [("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("ndash", "\u2013"), ("mdash", "\u2014"), ("#39", "''"), ("eacute", "\u00e9"), ("copy", "\u00a9"), ("middot", "\u00b7")]


def _html_sql() -> str:
    """The steps of text.html_to_text for the references that occur in the pages; grouped digits are joined in two passes."""
    x = "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', chr(10), 'g')"
    for name, char in _READ:
        x = f"replace({x}, '&{name};', '{char}')"
    x = f"regexp_replace({x}, '&amp;?', '&', 'g')"
    x = f"regexp_replace({x}, '[\u2010-\u2015\u2212]', '-', 'g')"
    x = _GROUPED.format(_GROUPED.format(x))
    x = f"regexp_replace({x}, '[ \\t\\x0B\\f\\r\u00a0]+', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '\\s*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
    return f"regexp_replace({x}, '(?im)^([+-]? ?(?:12|5) ?v) ?:? ?\\n(\\d{{1,4}} ?ma)\\b', '\\1: \\2', 'g')"


@query(f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_to_text(t):
    return t.pages.select("page_id", tx.html_to_text(F.col("html")).alias("text"))


#: field -> ordered patterns
FIELDS = {"number": [r"/[a-z]{2}/(\d{1,6})", r"page=(\d+)"], "ad": [r"<!-- ad (\d+) -->"], "track": [r"track\((\d+)\)"]}


def _spec_sql(field: str, patterns: list[str]) -> str:
    """A field's value and line: of its patterns the first that matches."""
    q = ["(?im)" + p.replace("'", "''") for p in patterns]
    before = [f"string_split_regex(low, '{p}')[1]" for p in q]
    value = " ".join(f"WHEN regexp_matches(low, '{p}') THEN try_cast(regexp_extract(low, '{p}', 1) AS INTEGER)" for p in q)
    line = " ".join(f"WHEN regexp_matches(low, '{p}') THEN string_split(x, chr(10))[1 + length({b}) - length(replace({b}, chr(10), ''))]" for p, b in zip(q, before, strict=True))
    return f"CASE {value} END AS {field}_value, left(trim(regexp_replace(CASE {line} END, '\\s+', ' ', 'g')), 160) AS {field}_line"


@query(f"WITH x AS (SELECT page_id, url || chr(10) || html AS x FROM pages), p AS (SELECT *, lower(x) AS low FROM x) SELECT page_id, {', '.join(_spec_sql(k, v) for k, v in FIELDS.items())} FROM p")
def spec_extract(t):
    """Fields of pages with the line each value came from."""
    got = tx.extract(F.concat_ws("\n", "url", "html"), FIELDS)
    return t.pages.select("page_id", *[c.alias(f"{k}_{part}") for k, v in got.items() for part, c in zip(("value", "line"), v, strict=True)])


_HOST = "regexp_extract(u, '^https?://([^/?#]*)', 1)"


@query(f"""WITH x AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT CASE WHEN regexp_matches(href, '^https?://') THEN {_HOST.replace('u,', 'href,')} ELSE {_HOST.replace('u,', 'url,')} END AS host, count(*) AS links, count(DISTINCT href) AS targets FROM x GROUP BY 1""")
def page_links(t):
    """Links of pages by host."""
    return tx.links(t.pages, "page_id", "html", "url").groupBy("host").agg(F.count("*").alias("links"), F.count_distinct("href").alias("targets"))


LEAKS = [r"akia[0-9a-z]{8}", r"token\s*=", r"[0-9]{3}-[0-9]{4}", "@mail[0-9]"]


@query("""WITH x AS (SELECT doc_id AS id, regexp_extract_all(text, '(?i)(akia[0-9a-z]{8}|token\\s*=|[0-9]{3}-[0-9]{4}|@mail[0-9])', 1) AS f FROM documents)
SELECT id, array_to_string(list_sort(list_distinct(f)), ',') AS found FROM x WHERE len(f) > 0""")
def leak_scan(t):
    """Documents that hold what must not be published."""
    return tx.leaks(t.documents, "doc_id", LEAKS).select("id", F.array_join("found", ",").alias("found"))


@query("""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, regexp_matches(line, '^[^\\n]{1,24}\\.$') AS head FROM l),
p AS (SELECT *, sum(head::INT) OVER (PARTITION BY id ORDER BY i) AS part, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM h),
g AS (SELECT id, part, min(start) AS start, min(CASE WHEN head THEN regexp_replace(line, '^\\s+|\\s+$', '', 'g') END) AS title, regexp_replace(coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY i), ''), '^\\s+|\\s+$', '', 'g') AS body FROM p GROUP BY id, part),
k AS (SELECT *, row_number() OVER (PARTITION BY id, lower(title) ORDER BY part) > 1 AS again FROM g WHERE length(body) >= 20)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY part)::INT AS ord, CASE WHEN title IS NOT NULL AND again THEN title || ' (continued)' ELSE title END AS title, start::BIGINT AS start, body FROM k""")
def sections(t):
    """Documents split at short lines that end with a full stop."""
    return tx.sections(t.documents, "doc_id", r"[^\n]{1,24}\.(?:\n|$)")


@query("""WITH a AS (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id, token, count(*) AS m FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents) GROUP BY ALL),
o AS (SELECT item_id, doc_id, count(*) AS kinds, sum(least(n, m)) AS hits FROM a JOIN d USING (token) GROUP BY ALL),
w AS (SELECT item_id, count(*) AS kinds, sum(n) AS n FROM a GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id) AS r FROM o)
SELECT b.item_id, doc_id, round(b.kinds / w.kinds, 6) AS unique_recall, round(hits / w.n, 6) AS occurrence_recall FROM b JOIN w USING (item_id) WHERE r = 1""")
def coverage_recall(t):
    """How much of each benchmark text the document nearest to it covers: of its words, and of their occurrences."""
    a = tx.tokens(t.benchmark, ["item_id"], "text")
    d = tx.tokens(t.documents, ["doc_id"], "text").withColumnRenamed("n", "m")
    asked = a.withColumnRenamed("item_id", "qid")
    best = retrieval.covering(d.withColumnRenamed("m", "n"), asked).top(asked, 1).select(F.col("qid").alias("item_id"), "doc_id")
    target = best.join(d, "doc_id").select("item_id", "token", F.col("m").alias("n"))
    x = tx.recall(a, target, ["item_id"]).join(best, "item_id")
    return x.select("item_id", "doc_id", F.round("unique_recall", 6).alias("unique_recall"), F.round("occurrence_recall", 6).alias("occurrence_recall"))


@query("""WITH a AS (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents) GROUP BY ALL),
b AS (SELECT lang, token, count(*) AS m FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents JOIN labels USING (doc_id) WHERE quality = 1) GROUP BY ALL),
x AS (SELECT lang, token, n - coalesce(m, 0) AS missing FROM a LEFT JOIN b USING (lang, token))
SELECT lang, token, missing FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY missing DESC, token) AS r FROM x WHERE missing > 0) WHERE r <= 12""")
def most_missing(t):
    """The words that most lack in the labelled good texts, by language."""
    good = t.documents.join(t.labels.where("quality = 1"), "doc_id")
    return tx.most_missing(tx.tokens(t.documents, ["lang"], "text"), tx.tokens(good, ["lang"], "text"), ["lang"])


def _bm25_sql(k1: float, b: float, tag: str) -> str:
    return f"""SELECT '{tag}' AS variant, qid, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (n * ({k1} + 1) / (n + {k1} * (1 - {b} + {b} * dl / avgdl)))) AS score
FROM q JOIN f USING (token) JOIN dfs USING (token) JOIN len USING (doc_id), (SELECT count(*) AS docs, avg(dl) AS avgdl FROM len) GROUP BY qid, doc_id"""


_BM25_SQL = """WITH f AS MATERIALIZED (SELECT doc_id, token, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents) GROUP BY ALL),
len AS MATERIALIZED (SELECT doc_id, sum(n) AS dl FROM f GROUP BY 1), dfs AS MATERIALIZED (SELECT token, count(*)::DOUBLE AS df FROM f GROUP BY 1),
q AS MATERIALIZED (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM benchmark),
"""
_RANK_SQL = "r AS (SELECT *, row_number() OVER (PARTITION BY variant, qid ORDER BY round(score, 6) DESC, doc_id) AS rank FROM s)"
VARIANTS = {"base": (1.2, 0.75), "flat": (1.2, 0.0), "steep": (2.0, 1.0)}


def _blocks(t, variants=None):
    d = tx.tokens(t.documents, ["doc_id"], "text")
    q = tx.tokens(t.benchmark, ["item_id"], "text").select(F.col("item_id").alias("qid"), "token")
    return retrieval.bm25_blocks(d, q, variants), q


@query(_BM25_SQL + f"s AS ({_bm25_sql(1.2, 0.75, 'base')}), {_RANK_SQL} SELECT qid, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def bm25_top5(t):
    """The five documents that rank first for each benchmark text."""
    blocks, q = _blocks(t)
    return blocks.top(q, 5).select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_RANKS_SQL = (
    _BM25_SQL
    + "s AS ("
    + " UNION ALL ".join(_bm25_sql(k1, b, v) for v, (k1, b) in VARIANTS.items())
    + f"), {_RANK_SQL}, want AS MATERIALIZED (SELECT item_id AS qid, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), "
    + "ranks AS (SELECT v.variant, w.qid, min(r.rank) AS rank FROM (SELECT DISTINCT qid FROM want) w CROSS JOIN (VALUES ('base'), ('flat'), ('steep')) v(variant) LEFT JOIN (SELECT r.* FROM r JOIN want USING (qid, doc_id)) r ON r.qid = w.qid AND r.variant = v.variant GROUP BY 1, 2)"
)


def _ranks(t):
    """(variant, qid, rank) of the first document that holds the whole text, for the texts that any document holds."""
    blocks, q = _blocks(t, VARIANTS)
    return blocks.ranks(q, _holds(t))


def _holds(t):
    return tx.containing(t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("passage")), t.documents)


@query(_RANKS_SQL + " SELECT variant, count(*) AS questions, avg((coalesce(rank, 9e9) <= 1)::INT) AS hit_1, avg((coalesce(rank, 9e9) <= 3)::INT) AS hit_3, avg((coalesce(rank, 9e9) <= 5)::INT) AS hit_5, round(avg(coalesce(1 / rank, 0)), 9) AS mrr FROM ranks GROUP BY 1")
def hit_mrr(t):
    """hit@1, 3, 5 and mean reciprocal rank of three variants."""
    return retrieval.measures(_ranks(t), ["variant"]).withColumn("mrr", F.round("mrr", 9))


@query(_RANKS_SQL + " SELECT a.qid, a.rank::BIGINT AS rank_a, b.rank::BIGINT AS rank_b FROM ranks a JOIN ranks b ON a.qid = b.qid AND a.variant = 'base' AND b.variant = 'flat' WHERE a.rank IS DISTINCT FROM b.rank")
def rank_changes(t):
    """Texts whose rank moved between two variants."""
    x = retrieval.moved(_ranks(t), "variant", "base", "flat")
    return x.select("qid", F.col("rank_a").cast("long").alias("rank_a"), F.col("rank_b").cast("long").alias("rank_b"))


@query("SELECT item_id AS qid, count(*) AS documents, min(doc_id) AS first FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def contains_join(t):
    """Documents that hold a whole benchmark text."""
    return _holds(t).groupBy("qid").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first"))


@query("""SELECT DISTINCT doc_id AS id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, 'the') AND regexp_matches(line, '(^|[^0-9])555([^0-9]|$)')""")
def line_cooccurrence(t):
    """Documents with a line that holds a word and a whole number."""
    return tx.same_line(t.documents, "doc_id", F.lit("the"), F.lit(555))


@query(f"WITH {WORDS_SQL}, u AS (SELECT lang, token, sum(n)::BIGINT AS n FROM tf WHERE token IN {WORDS} GROUP BY ALL) SELECT lang, token, n, n / sum(n) OVER (PARTITION BY lang) AS share, n / max(n) OVER () AS scaled FROM u")
def share_of_total(t):
    """Each word's share of its language, and scaled by the largest."""
    from pyspark.sql import Window

    u = words(t).where(F.col("token").isin(LIST)).groupBy("lang", "token").agg(F.sum("n").alias("n"))
    most = u.agg(F.max("n").alias("most"))
    return u.crossJoin(F.broadcast(most)).select("lang", "token", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("lang"))).alias("share"), (F.col("n") / F.col("most")).alias("scaled"))


@query("SELECT lang, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS other, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def coverage_groups(t):
    """Labelled good, labelled otherwise, unlabelled, by language."""
    x = t.documents.join(t.labels, "doc_id", "left").groupBy("lang")
    return x.agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("other"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


@query("""SELECT s_suppkey, '{' || array_to_string(list_filter([CASE WHEN s_acctbal > 0 THEN '"s_acctbal":' || CASE WHEN s_acctbal = floor(s_acctbal) THEN s_acctbal::BIGINT::VARCHAR ELSE s_acctbal::VARCHAR END END,
  '"s_name":"' || s_name || '"', '"s_nationkey":' || s_nationkey, '"s_suppkey":' || s_suppkey], lambda x: x IS NOT NULL), ',') || '}' AS value FROM supplier""")
def sparse_json(t):
    """Supplier rows as sparse JSON: nulls left out, whole doubles as integers."""
    s = t.supplier.withColumn("s_acctbal", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")))
    return s.select("s_suppkey", sinks.sparse_json(s).alias("value"))


@query("SELECT sha256(array_to_string(list_sort(list(n_nationkey || ':' || n_name)), ',')) AS digest, n_regionkey AS region FROM nation GROUP BY 2")
def digest(t):
    """A digest of each region's nations: equal content, equal digest."""
    return t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("n_nationkey").cast("string"), "n_name"))), ","), 256).alias("digest"))


_CUT = "('0x' || substr(h, {}, 13))::BIGINT"


@query(f"""WITH r AS (SELECT source, sha256(to_json({{doc_id: doc_id, lang: lang, source: source, text: text}})) AS h FROM documents),
g AS (SELECT source, count(*) AS n, {', '.join(f"sum({_CUT.format(13 * k + 1)}) AS h{k}" for k in range(5))} FROM r GROUP BY 1)
SELECT source, sha256(concat_ws(',', n, h0, h1, h2, h3, h4)) AS digest FROM g""")
def table_digests(t):
    """Digests of whole rows, by source."""
    return relational.digest(t.documents.drop("n_chars"), ["source"])
