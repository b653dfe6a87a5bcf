"""Sinks: Parquet, sparse JSON lines in a fixed order, nested JSON reports, Markdown tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def sparse_json(df: DataFrame) -> Column:
    """A row as JSON with sorted keys, nulls left out, whole doubles as integers."""
    whole = []
    for name, kind in sorted(df.dtypes):
        c = F.col(name)
        if kind in ("double", "float"):
            text = F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("string"))
        elif kind == "string":
            text = F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', "$1")
        elif kind in ("boolean", "int", "bigint", "smallint", "tinyint"):
            text = c.cast("string")
        else:
            text = F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")
        whole.append(F.when(c.isNotNull(), F.concat(F.lit(f'"{name}":'), text)))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*whole)), ","), F.lit("}"))


def ordered_json(df: DataFrame, order: list[str], path: str) -> None:
    """One sorted file of sparse JSON lines; the order is the whole table's, so it is meant for published results."""
    df.select(*order, sparse_json(df).alias("value")).orderBy(*order).select("value").write.mode("overwrite").text(path)


def report(df: DataFrame, keys: list[str], into: str) -> DataFrame:
    """keys and `into`: each group's rows as one sorted nested array."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(into))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each row as a line of a Markdown table."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", "\\\\|"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def nested_report(df: DataFrame, levels: list[str], into: str = "rows") -> DataFrame:
    """One row of nested JSON a value of the first level: each level's values hold the next, the last the rows, all sorted."""
    out, name = report(df, levels, into), into
    for k in range(len(levels) - 1, 0, -1):
        out = out.groupBy(*levels[:k]).agg(F.array_sort(F.collect_list(F.struct(levels[k], name))).alias(f"by_{levels[k]}"))
        name = f"by_{levels[k]}"
    return out.select(levels[0], F.to_json(F.struct(levels[0], name)).alias("value"))


def pages(df: DataFrame, keys: list[str], columns: list[str], title: Column, order: list[str]) -> DataFrame:
    """keys and `page`: a Markdown page for each group, its title over a table of its rows."""
    lines = df.withColumn("_title", title).withColumn("_line", F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\|", "\\\\|"), F.lit("")) for c in columns]), F.lit(" |")))
    head = "| " + " | ".join(columns) + " |\n|" + "-|" * len(columns) + "\n"
    g = lines.groupBy(*keys).agg(F.min("_title").alias("_title"), F.array_sort(F.collect_list(F.struct(*order, "_line"))).alias("_rows"))
    return g.select(*keys, F.concat(F.lit("# "), F.col("_title"), F.lit("\n\n" + head), F.array_join(F.transform("_rows", lambda r: r["_line"]), "\n"), F.lit("\n")).alias("page"))


def index(pages_: DataFrame, link: Column, title: Column) -> DataFrame:
    """One row `value`: the list of all pages as Markdown links; it is a list of pages, not of rows."""
    return pages_.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(title.alias("t"), link.alias("l")))), lambda x: F.concat(F.lit("- ["), x["t"], F.lit("]("), x["l"], F.lit(")"))), "\n").alias("value"))


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file so that readers see the old or the new one, never half: to a name beside it, then renamed over it."""
    import uuid

    jvm = spark._jvm
    p, staged = (jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.{uuid.uuid4().hex[:8]}.part"))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration())
    out = staged.getFileSystem(spark._jsc.hadoopConfiguration()).create(staged)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(staged, p, options)
