"""Column expressions for regular-expression spans with code-point offsets, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
SPAN = "array<struct<start:int,end:int,text:string,left:string,right:string>>"


def last_words(text: Column) -> Column:
    """The last two words of a text (or the one it has), with what stands between and after them."""
    return F.reverse(F.regexp_extract(F.reverse(text), r"^\s*\S+(?:\s+\S+)?", 0))


def with_spans(df: DataFrame, into: str, text: str, regex: str, guard: Column | None = None, sides: bool = False) -> DataFrame:
    """df with `into`: (start, end, text, left, right) of the leftmost non-overlapping matches of regex.

    split() gives what lies between the matches, so offsets are running sums of lengths; they are summed in blocks of
    64, which keeps a text with very many matches from costing their square. With sides, left and right hold the last two
    words before the match and what follows it up to the end of the next word, as far as the neighbouring match; else they are empty. regex must not
    match the empty string.
    """
    m, g, a, b = f"_{into}_m", f"_{into}_g", f"_{into}_a", f"_{into}_b"
    found = F.regexp_extract_all(F.col(text), F.lit(regex), F.lit(0))
    df = df.withColumn(m, F.when(F.coalesce(guard, F.lit(False)), found) if guard is not None else found)
    some = F.size(m) > 0
    gap = F.transform(F.split(F.col(text), regex, -1), lambda x: F.struct(F.length(x).alias("n"), (last_words(x) if sides else F.lit("")).alias("tail"), (F.regexp_extract(x, r"^\S*\s+\S+|^\S+", 0) if sides else F.lit("")).alias("head")))
    df = df.withColumn(g, F.when(some, gap))
    df = df.withColumn(a, F.when(some, F.zip_with(F.transform(F.col(g), lambda x: x["n"]), F.transform(F.col(m), F.length), lambda x, y: x + F.coalesce(y, F.lit(0)))))

    def total(array: Column) -> Column:
        return F.aggregate(array, F.lit(0), lambda x, y: x + y)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda c: total(F.slice(F.col(a), c * BLOCK + 1, BLOCK)))
    df = df.withColumn(b, F.when(some, blocks))

    def span(i: Column) -> Column:
        c = F.floor(i / BLOCK).cast("int")
        start = total(F.slice(F.col(b), 1, c)) + total(F.slice(F.col(a), c * BLOCK + 1, i - c * BLOCK)) + F.get(F.col(g), i)["n"]
        word = F.get(F.col(m), i)
        return F.struct(start.alias("start"), (start + F.length(word)).alias("end"), word.alias("text"), F.get(F.col(g), i)["tail"].alias("left"), F.get(F.col(g), i + 1)["head"].alias("right"))

    spans = F.when(some, F.transform(F.sequence(F.lit(0), F.size(m) - 1), span)).otherwise(F.array().cast(SPAN))
    return df.withColumn(into, spans).drop(m, g, a, b)


def joined(spans: Column, kinds: list[str]) -> Column:
    """'kind:start:end' of (start, kind number, end) structs in their order, joined with commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
