"""Document fingerprints: a Merkle tree over phrases, paragraphs and sections.

A paragraph is a line. Its phrases are the tree's leaves: runs that end after a sentence mark or after a word that ends in
s or y, so that each boundary depends on the letters beside it alone, at any length of text. A leaf's digest is the SHA-256 of
its text, a paragraph's that of its phrases' digests; a section is a run of paragraphs that ends after one whose digest
starts with 0 to 3, its digest is that of its paragraphs', and the root's that of the sections'. Equal roots mean equal texts.

The fingerprint is the tree in print: the root, a colon, and of every leaf the first 64 bits, separated by `.` within a
paragraph, by `/` between paragraphs and by `|` between sections. Branches that differ in print locate edits, and the likeness of
two fingerprints is the number of leaves that both hold in the number of leaves of either.

DataFrame functions only. The row that follows each row in the whole table's order is found with one shuffle: rows go to
range buckets, each bucket also gets the first row of the bucket after it, and a window looks one row ahead. A doc_id (or
null) with a large share of the rows is dealt to as many buckets as its share, in order of the texts' hashes.

Edge cases: a null text is the empty text, whose tree has one empty paragraph; rows are ordered by doc_id descending,
nulls last, then by text, so repeated rows follow each other; a table of one row is followed by itself; two texts
without leaves are alike (1); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, shuffle_partitions

LEAF = r"(?s).+?(?:[.!?。！？]+[ \t\r]*|[sySY][ \t\r]+|\z)"
ROOT, CODE = 64, 16  # hexadecimal digits
BUCKETS, STEP = 4096, 64


def with_fingerprint(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with the fingerprint of the string column `text`, which holds no nulls."""
    leaves, lines = f"_{into}_l", f"_{into}_p"
    df = df.withColumn(leaves, F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256))))
    df = df.withColumn(lines, F.transform(leaves, lambda d: F.struct(F.sha2(F.array_join(d, ""), 256).alias("digest"), F.array_join(F.transform(d, lambda x: F.left(x, F.lit(CODE))), ".").alias("codes"))))
    last = lambda x: x["digest"] < "4"  # noqa: E731 of its section
    marked = F.array_join(F.transform(lines, lambda x: F.when(last(x), F.concat(x["digest"], F.lit("|"))).otherwise(x["digest"])), "")
    sections = F.transform(F.filter(F.split(marked, r"\|", -1), lambda x: x != ""), lambda x: F.sha2(x, 256))
    printed = F.transform(lines, lambda x, i: F.concat(x["codes"], F.when(i == F.size(lines) - 1, "").when(last(x), "|").otherwise("/")))
    return df.withColumn(into, F.concat(F.sha2(F.array_join(sections, ""), 256), F.lit(":"), F.array_join(printed, ""))).drop(leaves, lines)


def _print(fingerprint: Column) -> Column:
    return F.substring(fingerprint, ROOT + 2, 2147483647)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: leaves that both hold, in the leaves of either."""
    codes = lambda x: F.array_distinct(F.filter(F.split(_print(x), r"[./|]"), lambda c: c != ""))
    x, y = codes(a), codes(b)
    either = F.size(F.array_union(x, y))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / either)


def edits(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs of fingerprints with `edited_sections` and `edited_paragraphs`: numbers (from 0) of the branches of b that a
    doesn't have. Both are empty where the roots agree."""
    new = lambda cut: F.filter(F.transform(F.split(_print(F.col(b)), cut), lambda x, i: F.when(~F.array_contains(F.split(_print(F.col(a)), cut), x), i)), lambda i: i.isNotNull())
    return pairs.withColumns({"edited_sections": new(r"\|"), "edited_paragraphs": new(r"[/|]")})


def _before(cuts: list[int], beyond) -> Column:
    """How many of the descending cuts satisfy a comparison that holds for the first ones only: steps of STEP, then singly."""
    array = lambda v: F.array(*map(F.lit, v)).cast("array<bigint>")
    steps = F.size(F.filter(array(cuts[STEP - 1 :: STEP]), beyond))
    return steps * STEP + F.size(F.filter(F.slice(array(cuts), steps * STEP + 1, STEP), beyond))


def followed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, t (text) and next_t, that of the row that follows by descending doc_id; after the last, the first."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    order = F.struct(F.col("doc_id").isNull().alias("nul"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("neg"), F.xxhash64("t").alias("h"))
    n = min(BUCKETS, 4 * shuffle_partitions(spark))
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 50 * n)).first()[0] or []  # BUCKETS numbers at most
    cuts = sorted(cuts, reverse=True)  # a doc_id with many rows stands here several times
    more, from_ = _before(cuts, lambda c: c > F.col("doc_id")), _before(cuts, lambda c: c >= F.col("doc_id"))
    share = lambda m: F.least(F.floor((F.xxhash64("t") / F.lit(2.0**64) + 0.5) * m), m - 1).cast("int")
    bucket = F.when(F.col("doc_id").isNull(), len(cuts) + 1 + share(F.lit(n))).otherwise(more + F.when(from_ > more + 1, share(from_ - more)).otherwise(0))
    rows = rows.select("doc_id", "t", order.alias("o"), bucket.cast("int").alias("bucket"))
    firsts = sorted((r for r in rows.groupBy("bucket").agg(F.min("o").alias("o")).collect()), key=lambda r: r[0])  # one for each bucket
    if not firsts:
        return docs.select("doc_id", F.col("text").alias("t"), F.col("text").alias("next_t"))
    ahead = [(firsts[(i + 1) % len(firsts)][1], firsts[i][0]) for i in range(len(firsts))]
    ahead = spark.createDataFrame([((o["nul"], o["neg"], o["h"]), b) for o, b in ahead], "o struct<nul:boolean,neg:bigint,h:bigint>, before int")
    rows = rows.join(F.broadcast(ahead), "o", "left")  # a row for each bucket
    rows = rows.withColumn("at", F.explode(F.filter(F.array(F.struct(F.lit(False).alias("tail"), F.col("bucket").alias("bucket")), F.when(F.col("before").isNotNull(), F.struct(F.lit(True).alias("tail"), F.col("before").alias("bucket")))), lambda x: x.isNotNull())))
    rows = rows.select("doc_id", "t", F.col("o"), F.col("at.bucket").alias("bucket"), F.col("at.tail").alias("tail"))
    w = Window.partitionBy("bucket").orderBy("tail", "o", "t")
    return rows.withColumn("next_t", F.lead("t").over(w)).where(~F.col("tail")).select("doc_id", "t", "next_t")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = followed(spark, read_table(spark, sf_dir, "documents"))
    df = df.withColumn("n_chars", F.length("t").cast("long")).withColumn("k", F.floor(F.length("t") / 3).cast("int"))
    df = df.withColumn("edited", F.concat(F.expr("left(t, length(t) - k)"), F.expr("left(next_t, k)")))
    for text, into in (("t", "fingerprint"), ("edited", "edited_fingerprint"), ("next_t", "next_fingerprint")):
        df = with_fingerprint(df, text, into)
    return df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
