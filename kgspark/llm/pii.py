"""Personal data: fixed forms, and contextual extraction that is bootstrapped from what the forms find.

The forms' matches are seed instances. Each stands in lexical contexts (the word before, the two words before, the words on
both sides), which are patterns. In a graph of patterns and instances, a pattern's confidence for a kind is the share of
known confidence among its distinct instances, and an unknown instance's is one minus the chance that all its accepted
patterns are wrong. Each round adds to the graph the contexts of instances accepted in the round before, which are
seeds like the forms' own, with all words that stand in them, and scores the graph once; rounds end when one accepts
neither a pattern nor an instance. So seeds lead to contexts, these to identifiers, these to contexts where no form stands.
What accepted patterns extract at last is reported beside the forms' spans as kind `context`: any word, whatever its
characters, without the punctuation at its ends.

A context enters the graph once SUPPORT distinct known instances stand in it and they are a FLOOR of its distinct words, by a
sketch of their number; it is looked at again whenever instances are added. FLOOR is half of PATTERN_MIN, below which no
pattern is accepted: contexts like `of the` stay out, and the sketch's error of 5 % decides nothing. All words of all texts are
read three times a round (contexts of new instances, sketches, occurrences; the first round needs no contexts), and what is
shuffled are sketches and occurrences of patterns in the graph.

DataFrame functions only. Pattern and instance scores are partially aggregated sums, so a context or an identifier with a
third of all occurrences is summed where it is read. Offsets are code points, ends exclusive.

Edge cases: null or empty text has no spans; a null doc_id is scanned like others; each of repeated rows is reported
(rows are told apart by a row number of the written table, not by doc_id); extra columns are ignored; without seeds
nothing is added; very long texts cost their length; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table
from .native import joined, with_spans

# The forms that the scan must know.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

KINDS = ["email", "ip", "card", "phone", "context"]
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SUPPORT, FLOOR, PATTERN_MIN, INSTANCE_MIN = 3, 0.3, 0.6, 0.8


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


def small_parts(ip: Column) -> Column:
    return F.forall(F.split(ip, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])$"))


def scanned(docs: DataFrame) -> DataFrame:
    """docs(row..., text) with `found`, structs (start, kind, end, text, left, right) of the forms."""
    df = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    has = lambda x: F.contains(F.col("_t"), F.lit(x))
    df = with_spans(df, "_email", "_t", EMAIL, has("@"), sides=True)
    df = with_spans(df, "_ip", "_t", IP, F.col("_t").rlike(r"[0-9]\.[0-9]"), sides=True)
    df = with_spans(df, "_card", "_t", CARD, F.col("_t").rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), sides=True)
    df = with_spans(df, "_phone", "_t", PHONE, has("+"), sides=True)
    digits = lambda x: F.regexp_replace(x["text"], "[^0-9]", "")
    keep = {
        "_email": None,
        "_ip": lambda x: small_parts(x["text"]),
        "_card": lambda x: F.length(digits(x)).between(12, 19) & luhn(digits(x)),
        "_phone": lambda x: F.length(digits(x)).between(9, 15),
    }

    def part(kind: int, name: str, test) -> Column:
        good = F.filter(name, test) if test else F.col(name)
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["text"].alias("text"), x["left"].alias("left"), x["right"].alias("right")))

    parts = [part(kind, name, test) for kind, (name, test) in enumerate(keep.items())]
    return df.withColumn("found", F.array_sort(F.concat(*parts)))


def trimmed(word: Column) -> Column:
    return F.btrim(word, F.lit(PUNCTUATION))


def patterns(before: Column, last: Column, after: Column) -> Column:
    """The lexical patterns of an occurrence with these words around it, null-free."""
    several = F.array(F.concat(F.lit("before "), last), F.concat(F.lit("before2 "), before, F.lit(" "), last), F.concat(F.lit("around "), last, F.lit(" | "), after))
    return F.filter(several, lambda x: x.isNotNull())


def seeds(rows: DataFrame) -> DataFrame:
    """(kind, instance, word, last, patterns) of the forms' matches; word is a match's first word, as words are read below."""
    df = rows.select(F.explode("found").alias("x")).select("x.kind", F.lower("x.text").alias("text"), F.lower("x.left").alias("left"), F.lower("x.right").alias("right"))
    some = lambda c, regex: F.nullif(F.regexp_extract(c, regex, 1), F.lit(""))
    opened = r"\s+[\"'(<\[{]*$"  # the match starts a word
    df = df.withColumn("last", some("left", r"(\S+)" + opened)).withColumn("before", some("left", r"(\S+)\s+\S+" + opened)).withColumn("after", some("right", r"^\p{Punct}*\s+(\S+)"))
    return df.select("kind", trimmed(F.col("text")).alias("instance"), trimmed(F.substring_index("text", " ", 1)).alias("word"), "last", patterns(F.col("before"), F.col("last"), F.col("after")).alias("patterns"))


def words_around(rows: DataFrame) -> DataFrame:
    """(row, i, before, last, instance, after): the words of rows(row, _t), by number, that have one before them."""
    df = rows.select("row", F.regexp_extract_all(F.lower("_t"), F.lit(r"\S+"), F.lit(0)).alias("_w"))
    around = F.transform("_w", lambda x, i: F.struct(i.alias("i"), F.get("_w", i - 2).alias("before"), F.get("_w", i - 1).alias("last"), x.alias("word"), F.get("_w", i + 1).alias("after")))
    return df.select("row", F.explode(around).alias("x")).select("row", "x.*").where("last is not null").withColumn("instance", trimmed(F.col("word"))).drop("word")


def occurrences(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, i, instance, pattern): the words that stand in one of the wanted(pattern, last)."""
    df = words_around(rows).join(wanted.select("last").distinct(), "last", "left_semi").where("instance <> ''")
    df = df.select("row", "i", "instance", F.explode(patterns(F.col("before"), F.col("last"), F.col("after"))).alias("pattern"))
    return df.join(wanted.select("pattern"), "pattern", "left_semi")


def contexts(rows: DataFrame, instances: DataFrame) -> DataFrame:
    """(instance, last, pattern) wherever one of instances(instance) stands, each once."""
    df = words_around(rows).join(instances, "instance", "left_semi")
    return df.select("instance", "last", F.explode(patterns(F.col("before"), F.col("last"), F.col("after"))).alias("pattern")).distinct()


def scores(graph: DataFrame, known: DataFrame) -> DataFrame:
    """(pattern, as, score) of accepted patterns of graph(pattern, instance), given known(instance, as, sure)."""
    hits = graph.join(known, "instance").groupBy("pattern", "as").agg(F.sum("sure").alias("hits"), F.count("*").alias("support")).where(F.col("support") >= SUPPORT)
    scored = hits.join(graph.groupBy("pattern").agg(F.count("*").alias("n")), "pattern").withColumn("score", F.least(F.col("hits") / F.col("n"), F.lit(0.999)))
    best = scored.where(F.col("score") >= PATTERN_MIN).groupBy("pattern").agg(F.max(F.struct("score", (-F.col("as")).alias("k"))).alias("x"))
    return best.select("pattern", (-F.col("x.k")).alias("as"), "x.score")


def discover(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, i): the words that accepted patterns extract, from rows(row, _t, found)."""
    seen = scratch.write(seeds(rows), "seeds")
    first = seen.select("kind", "instance").union(seen.select("kind", "word")).where("instance <> ''").distinct().select("instance", F.col("kind").alias("as"), F.lit(1.0).alias("sure"))
    sources = scratch.write(first, "sources")
    pairs = scratch.write(seen.select("instance", "last", F.explode("patterns").alias("pattern")).distinct(), "pairs0")
    known, wanted, found, graph, patterns_before, turn = sources, None, None, None, 0, 0
    grown = lambda old, new: new if old is None else old.union(new)
    fresh = True
    while True:
        if fresh:  # contexts that the instances known by now are enough for
            support = pairs.groupBy("pattern", "last").agg(F.count_distinct("instance").alias("support")).where(F.col("support") >= SUPPORT)
            support = scratch.write(support if wanted is None else support.join(wanted.select("pattern"), "pattern", "left_anti"), f"support{turn}")
            sketch = occurrences(rows, support).groupBy("pattern").agg(F.approx_count_distinct("instance", 0.05).alias("n"))
            more = scratch.write(support.join(sketch, "pattern").where(F.col("support") >= FLOOR * F.col("n")).select("pattern", "last"), f"wanted{turn}")
            some = scratch.write(occurrences(rows, more), f"occurrences{turn}")
            wanted, found = grown(wanted, more), grown(found, some)
            graph = grown(graph, scratch.write(some.select("pattern", "instance").distinct(), f"graph{turn}"))
        accepted = scratch.write(scores(graph, known), f"patterns{turn}")
        sure = graph.join(accepted, "pattern").groupBy("instance", "as").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("sure")).where(F.col("sure") >= INSTANCE_MIN)
        now = scratch.write(sources.unionByName(sure.join(sources.select("instance"), "instance", "left_anti")), f"known{turn}")
        new = scratch.write(now.select("instance").distinct().join(known.select("instance"), "instance", "left_anti"), f"new{turn}")
        number, fresh = accepted.count(), new.limit(1).count() > 0
        known = now
        if not fresh and number == patterns_before:
            break
        patterns_before, turn = number, turn + 1
        if fresh:
            pairs = pairs.union(scratch.write(contexts(rows, new), f"pairs{turn}"))
    return found.join(accepted.select("pattern"), "pattern", "left_semi").join(known.select("instance"), "instance", "left_semi").select("row", "i").distinct()


def with_pii(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of (start, kind, end) for each row of docs(doc_id, text)."""
    scratch = Scratch(spark, "pii")
    rows = scratch.write(scanned(docs.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "_t", "found"), "rows")  # numbered as written
    words = discover(rows, scratch).groupBy("row").agg(F.collect_set("i").alias("words"))  # those of one document
    told = with_spans(rows.join(words, "row").select("row", "_t", "found", "words"), "_word", "_t", r"\S+")

    def span(i: Column) -> Column:
        w = F.get("_word", i)
        start = w["start"] + F.length(w["text"]) - F.length(F.ltrim(w["text"], F.lit(PUNCTUATION)))
        return F.struct(start.alias("start"), F.lit(4).alias("kind"), (start + F.length(trimmed(w["text"]))).alias("end"))

    apart = F.filter(F.transform("words", span), lambda w: ~F.exists("found", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    more = told.select("row", apart.alias("more"))
    plain = F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    out = rows.select("row", "doc_id", plain.alias("base")).join(more, "row", "left")
    return out.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_pii(spark, read_table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [n(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return df.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))
