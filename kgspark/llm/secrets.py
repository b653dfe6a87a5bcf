"""Secret scans: fixed forms of secrets, and character Markov models for those without a form.

Two models of neighbouring characters, one of random strings and one of ordinary identifiers, are trained from labelled
samples. A token is reported where the sum of its pairs' log-likelihood ratios reaches LIMIT; no pair counts for more than
CLIP, so a token that could reach it has LIMIT / CLIP pairs at least (6 characters), and all of these are scored. Both
models mix what they have seen with an even spread, so a corpus whose labelled secrets all are hexadecimal still finds others.

The samples are bounded and taken over all documents: SAMPLE of the distinct values that a fixed form labels as secrets, and
of SAMPLE documents (smallest hash of doc_id) the words that no form touches and that are numbers or end in their digits (else
unlabelled secrets would count as ordinary). The scan itself covers every token of every text.

DataFrame functions only. Offsets are code points, ends exclusive. A scan is one pass without any shuffle; the ratios, one
for each pair of characters, are a literal of the plan.

Edge cases: null or empty text has no spans; a null doc_id is scanned like others; each of repeated rows is reported;
very long tokens cost their length; extra columns are ignored by the query and kept by redact(); where the samples hold no
labelled secret, nothing but the fixed forms is reported; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, read_table, unpacked
from .native import joined, with_spans

# The forms that the scan must know.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"

KINDS = ["assign", "access", "hex", "markov"]
SAMPLE, LIMIT, CLIP = 4000, 12.0, 2.5
SHORTEST = math.ceil(LIMIT / CLIP) + 1
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % SHORTEST
ORDINARY = "^(?:[A-Za-z+/_=-]*[0-9]*|[0-9+/_=-]*)$"  # letters then digits, or digits alone
#: share of the even spread in the model of random strings and in that of ordinary identifiers
EVEN = {1: 0.5, 0: 0.01}
#: characters of the models: each letter case, each digit, and one class for all else
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
N = len(ALPHABET) + 1


def scanned(docs: DataFrame) -> DataFrame:
    """docs(row..., text) with `base`, structs (start, kind, end) of the fixed forms, and those of each form."""
    df = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    low = F.lower("_t")
    df = with_spans(df, "_assign", "_t", ASSIGN, low.rlike("pass|secret|token|api_?key"))
    df = with_spans(df, "_access", "_t", ACCESS, F.contains(F.col("_t"), F.lit("AKIA")))
    df = with_spans(df, "_hex", "_t", HEX, F.col("_t").rlike("[0-9a-f]{16}"))
    df = df.withColumn("_assign", F.filter("_assign", lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 1)) >= 12))

    def plain(name: str, kind: int) -> Column:
        return F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    return df.withColumn("base", F.array_sort(F.concat(plain("_assign", 0), plain("_access", 1), plain("_hex", 2))))


def _apart(tokens: str) -> Column:
    """Tokens that no fixed form touches."""
    return F.when(F.size("base") == 0, F.col(tokens)).otherwise(F.filter(tokens, lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))))


def _classes(token: Column) -> Column:
    """Numbers of a token's characters; one split, so the cost is its length."""
    table = [N - 1] * 128
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i
    numbers = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(numbers, F.ascii(c) + 1), F.lit(N - 1)))


def pairs(token: Column) -> Column:
    """Numbers of the neighbouring character pairs of a token."""
    both = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: x * N + y)
    return F.get(F.transform(F.array(_classes(token)), both), F.lit(0))


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float] | None:
    """The log-likelihood ratio of each pair of characters, row by row; None without labelled secrets."""
    found = scanned(docs.select("text"))
    secret = F.concat(F.transform("_assign", lambda x: F.regexp_extract(x["text"], ASSIGN, 1)), F.transform("_access", lambda x: x["text"]), F.transform("_hex", lambda x: x["text"]))
    secrets = found.select(F.explode(secret).alias("w")).distinct().orderBy(F.xxhash64("w"), "w").limit(sample)
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # bounded, repeated ids too
    df = with_spans(scanned(few), "_word", "_t", r"[A-Za-z0-9+/_=-]{4,}+")
    words = df.select(F.explode(F.filter(_apart("_word"), lambda w: w["text"].rlike(ORDINARY))).alias("x")).select("x.text")
    both = secrets.select(F.lit(1).alias("y"), "w").union(words.select(F.lit(0), F.col("text")))
    counts = both.where(F.length("w") >= 4).select("y", F.explode(pairs(F.col("w"))).alias("pair")).groupBy("y", "pair").count().collect()  # 2 N^2 rows at most
    return ratios({(r[0], r[1]): r[2] for r in counts})


def ratios(counts: dict[tuple[int, int], int]) -> list[float] | None:
    """Clipped log-likelihood ratios from the counts of pairs in random (1) and ordinary (0) strings."""
    if not any(y for y, _ in counts):
        return None

    def model(y: int) -> list[float]:
        rows = [[counts.get((y, i * N + j), 0) for j in range(N)] for i in range(N)]
        single = [sum(row[j] for row in rows) for j in range(N)]  # what follows a character that wasn't seen
        out = []
        for row in rows:
            of = row if sum(row) else single
            out += [(1 - EVEN[y]) * (x / sum(of) if any(of) else 1 / N) + EVEN[y] / N for x in of]
        return out

    return [round(max(-CLIP, min(CLIP, math.log(a / b))), 6) for a, b in zip(model(1), model(0), strict=True)]


def evidence(token: Column, table: list[float]) -> Column:
    """The sum of the log-likelihood ratios of a token's pairs."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")  # folded once
    step = lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.when(s["last"] < 0, 0.0).otherwise(F.get(values, s["last"] * N + x))).alias("sum"))
    return F.aggregate(_classes(token), F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), step)["sum"]


def with_secrets(docs: DataFrame, table: list[float] | None) -> DataFrame:
    """docs with `base` and `spans`, arrays of (start, kind, end); base ones are among spans."""
    df = scanned(docs)
    if table is None:
        return df.withColumn("spans", F.col("base"))
    # most texts hold no such token: places are looked for only where one does
    df = df.withColumn("_some", F.exists(F.regexp_extract_all("_t", F.lit(TOKEN), F.lit(0)), lambda w: evidence(w, table) >= LIMIT))
    df = with_spans(df, "_token", "_t", TOKEN, F.col("_some"))
    df = df.withColumn("_markov", F.filter(_apart("_token"), lambda w: evidence(w["text"], table) >= LIMIT))
    more = F.transform("_markov", lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))
    return df.withColumn("spans", F.array_sort(F.concat("base", more)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    df = with_secrets(docs, train(docs))
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return df.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"))


def redact(docs: DataFrame, table: list[float] | None, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in `text` replaced by mark and n_chars brought up to date; other columns as they are.

    Overlapping spans are replaced as one. Null text stays null.
    """
    df = with_secrets(packed(docs, "text"), table)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda s, x: F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(F.concat(F.substring(F.col("_t"), s["at"] + 1, x["start"] - s["at"]), F.lit(mark))))).otherwise(s["out"]).alias("out"))
    df = df.withColumn("_cut", F.when(F.size("spans") > 0, F.aggregate("spans", start, step)))
    text = F.when(F.col("text").isNull() | F.col("_cut").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.col("_cut")["out"], ""), F.expr("substring(_t, _cut.at + 1)")))
    df = df.withColumn("_new", text)
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_new").cast(docs.schema["n_chars"].dataType)
    return unpacked(df, docs.columns, **new)
