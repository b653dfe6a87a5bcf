"""Sources: Parquet tables, YAML and JSON documents, JSON Lines, Markdown with a header, source code, optional inputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import relational

SECTIONS = "doc_id string, file string, header string, meta map<string,string>, body string"


class Tables:
    """The Parquet tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def optional(spark: SparkSession, path: str, schema: StructType | str, read) -> DataFrame:
    """read(path), or no rows of the schema where the path isn't there."""
    return read(path) if exists(spark, path) else spark.createDataFrame([], schema)


def json_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON document a file, with `item`, the file's stem."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("item", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def yaml_documents(spark: SparkSession, path: str, schema: StructType | str, at: str | None = None) -> DataFrame:
    """Rows of YAML files: the list in each document, or under its key `at`; a mapping counts as a list of its values
    with their keys as `key`. Files are parsed where they are read."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = schema.fieldNames()

    def go(batches):
        import json

        import pyarrow as pa
        import yaml

        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                data = yaml.safe_load(text)
                data = (data or {}).get(at) if at and isinstance(data, dict) else data
                if isinstance(data, dict):
                    data = [({"key": k} | v if isinstance(v, dict) else {"key": k, "value": v}) for k, v in data.items()]
                rows += [json.dumps(r, default=str, ensure_ascii=False) for r in data or []]
            yield pa.record_batch([pa.array(rows, pa.string())], names=["row"])

    texts = spark.read.text(path, wholetext=True)
    parsed = texts.mapInArrow(go, "row string").select(F.from_json("row", schema).alias("r"))
    return parsed.select(*[F.col(f"r.{n}").alias(n) for n in names])


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (folder), file, header, meta (flat keys of the header), body of Markdown files with an optional header."""
    df = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    header = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---(?:\n|\z)", "")
    pairs = F.transform(F.regexp_extract_all(header, F.lit(r"(?m)^([A-Za-z_][\w-]*:[ \t]*\S.*)$"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"^([^:]+):", 1).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]+:\s*", ""), F.lit("\"' ")).alias("v")))
    return df.select(F.regexp_extract("p", r"([^/]+)/[^/]+$", 1).alias("doc_id"), F.regexp_extract("p", r"([^/]+)$", 1).alias("file"), header.alias("header"), F.map_from_entries(pairs).alias("meta"), body.alias("body"))


def section_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ord, file, header, meta, body) of the numbered Markdown files `[0-9]*.md` of each document folder, in the order of
    their names; the header is no part of the body."""
    df = markdown(spark, path).where(F.col("file").rlike(r"^[0-9].*\.md$"))
    return df.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("file")).alias("ord"), "file", "header", "meta", "body")


def rows(spark: SparkSession, records: list[dict], schema: StructType) -> DataFrame:
    """Local records (of a configuration, say) with exactly the schema's columns: each value cast to its type as text is, null
    where that fails or where it is missing. Lists and maps keep their structure."""
    from pyspark.sql.types import ArrayType, MapType, StringType, StructField

    plain = lambda f: not isinstance(f.dataType, ArrayType | MapType | StructType)
    read = StructType([StructField(f.name, StringType() if plain(f) else f.dataType) for f in schema.fields])
    told = lambda v: v if v is None or isinstance(v, str) else ("true" if v else "false") if isinstance(v, bool) else str(v)
    data = [tuple(told(r.get(f.name)) if plain(f) else r.get(f.name) for f in schema.fields) for r in records]
    df = spark.createDataFrame(data, read)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if plain(f) else F.col(f.name)).alias(f.name) for f in schema.fields])


def overlaid(seed: DataFrame, path: str, schema: StructType | str, keys: list[str], name: str, columns: list[str], at: str | None = None) -> DataFrame:
    """seed rows with the edits of an overlay file on top; without the file the seed alone, in the same columns."""
    spark = seed.sparkSession
    return relational.overlay(seed, optional(spark, path, schema, lambda p: yaml_documents(spark, p, schema, at)), keys, name, columns)


def functions(spark: SparkSession, path: str, language: str) -> DataFrame:
    """(file, name, line, calls, doc) of the functions defined in Python or JavaScript files; a file that isn't valid Python gives none."""

    def go(batches):
        import ast

        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, file in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist(), strict=True):
                if language == "python":
                    try:
                        tree = ast.parse(text or "")
                    except (SyntaxError, ValueError, RecursionError):
                        continue
                    for node in ast.walk(tree):
                        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                            calls = sorted({f.id if isinstance(f, ast.Name) else f.attr for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(f := c.func, ast.Name | ast.Attribute)})
                            rows.append((file, node.name, node.lineno, calls, ast.get_docstring(node)))
                else:
                    starts = [(m.start(), m.group(1) or m.group(2)) for m in re.finditer(r"(?m)^(?:async\s+)?function\s+(\w+)|^const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", text)]
                    for (at, name), end in zip(starts, [s for s, _ in starts[1:]] + [len(text)], strict=True):
                        calls = sorted(set(re.findall(r"\b(\w+)\(", text[at:end])) - {name, "if", "for", "while", "switch", "function", "return", "catch"})
                        rows.append((file, name, text.count("\n", 0, at) + 1, calls, None))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.string())), pa.array(cols[4], pa.string())], names=["file", "name", "line", "calls", "doc"])

    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    return texts.mapInArrow(go, "file string, name string, line int, calls array<string>, doc string")


def evidence_rows(documents: DataFrame) -> DataFrame:
    """Nested evidence documents as rows: a source and field each."""
    s = documents.select("item", F.posexplode("sources").alias("source_ix", "s"))
    return s.select("item", "source_ix", "s.tier", "s.url", "s.http", F.explode("s.values").alias("field", "value")).where(~F.col("field").endswith("_line"))
