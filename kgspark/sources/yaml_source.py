"""YAML records as a Spark data source: spark.read.format("yaml_records").

One partition a file, so a folder is parsed where it is read. Records are the items of a list, or the values of a mapping (their keys
as `key`), in the whole document or under option `at`; several documents in one file follow each other. Values are read by the
schema that the reader is given; without one a record is its JSON text in `value`, and `file` names where it stands.

What can't be read goes by option `mode`, as in Spark's own readers: PERMISSIVE (the default) gives a row of nulls with the text in
the column `_corrupt_record` (option columnNameOfCorruptRecord) where the schema has it, a broken file one such row, a record with
a value of another type its other columns as well; DROPMALFORMED leaves such rows out; FAILFAST fails. No other file is affected.
A filter `file = ...` or `file in (...)` on the schema's `file` column is pushed down to the list of files; Spark asks for
spark.sql.python.filterPushdown.enabled for that, which `register` sets.

Paths are read with Arrow's file systems (local, HDFS, S3 and others by their scheme); a glob stands for names in one folder.
"""

from __future__ import annotations

import datetime
import fnmatch
import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType, TimestampType

DEFAULT = "value string, file string, _corrupt_record string"


class YamlFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def typed(value, kind: DataType):
    """value as Spark holds a value of that type; ValueError where it is no such value."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        if isinstance(value, bool):
            return "true" if value else "false"
        return value if isinstance(value, str) else json.dumps(value, default=str, ensure_ascii=False) if isinstance(value, dict | list) else str(value)
    if isinstance(kind, ArrayType):
        if not isinstance(value, list):
            raise ValueError(f"no list: {value!r}")
        return [typed(v, kind.elementType) for v in value]
    if isinstance(kind, MapType | StructType):
        if not isinstance(value, dict):
            raise ValueError(f"no mapping: {value!r}")
        if isinstance(kind, MapType):
            return {typed(k, kind.keyType): typed(v, kind.valueType) for k, v in value.items()}
        return tuple(typed(value.get(f.name), f.dataType) for f in kind.fields)
    if isinstance(value, dict | list):
        raise ValueError(f"no single value: {value!r}")
    if isinstance(kind, BooleanType):
        if isinstance(value, bool):
            return value
        raise ValueError(f"no boolean: {value!r}")
    if isinstance(value, bool):
        raise ValueError(f"a boolean: {value!r}")
    if isinstance(kind, ByteType | ShortType | IntegerType | LongType):
        if isinstance(value, float) and not value.is_integer():
            raise ValueError(f"no whole number: {value!r}")
        n, bits = int(value), {ByteType: 7, ShortType: 15, IntegerType: 31, LongType: 63}[type(kind)]
        if not -(1 << bits) <= n < 1 << bits:
            raise ValueError(f"out of range: {value!r}")
        return n
    if isinstance(kind, FloatType | DoubleType):
        return float(value)
    if isinstance(kind, DecimalType):
        import decimal

        return decimal.Decimal(str(value))
    if isinstance(kind, DateType):
        return value.date() if isinstance(value, datetime.datetime) else value if isinstance(value, datetime.date) else datetime.date.fromisoformat(str(value))
    if isinstance(kind, TimestampType):
        if isinstance(value, datetime.datetime):
            return value
        return datetime.datetime.fromisoformat(str(value))
    raise ValueError(f"unsupported type {kind.simpleString()}")


def records(data, at: str | None) -> list:
    data = data.get(at) if at and isinstance(data, dict) else data
    if isinstance(data, dict):
        return [{"key": k} | (v if isinstance(v, dict) else {"value": v}) for k, v in data.items()]
    if data is None:
        return []
    return data if isinstance(data, list) else [data]


class YamlReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema = schema
        self.path, self.at = options.get("path"), options.get("at")
        self.corrupt = options.get("columnNameOfCorruptRecord", options.get("columnnameofcorruptrecord", "_corrupt_record"))
        self.mode = options.get("mode", "PERMISSIVE").upper()
        self.names: set[str] | None = None
        if not self.path:
            raise ValueError("yaml_records needs a path")
        if self.mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
            raise ValueError(f"unknown mode {self.mode}")

    def _fs(self):
        import pyarrow.fs as fs

        if "://" in self.path or self.path.startswith("file:"):
            scheme, _, rest = self.path.partition(":")
            return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("file",) else set(f.value) if isinstance(f, In) and f.attribute == ("file",) else None
            if wanted is None:
                yield f
            else:
                self.names = wanted if self.names is None else self.names & wanted

    def partitions(self) -> list[YamlFile]:
        import pyarrow.fs as fs

        store, root = self._fs()
        folder, _, name = root.rstrip("/").rpartition("/")
        if any(c in name for c in "*?["):
            found = [i for i in store.get_file_info(fs.FileSelector(folder or "/")) if fnmatch.fnmatchcase(i.base_name, name)]
        else:
            info = store.get_file_info(root)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            found = [info] if info.type == fs.FileType.File else [i for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.endswith((".yaml", ".yml"))]
        paths = sorted(i.path for i in found if i.type == fs.FileType.File)
        return [YamlFile(p) for p in paths if self.names is None or p.rpartition("/")[2] in self.names]

    def read(self, partition: YamlFile) -> Iterator[tuple]:
        import yaml

        file = partition.path.rpartition("/")[2]
        with self._fs()[0].open_input_stream(partition.path) as f:
            raw = f.read()
        try:
            whole = [r for d in yaml.load_all(raw.decode(), getattr(yaml, "CSafeLoader", yaml.SafeLoader)) for r in records(d, self.at)]
        except (yaml.YAMLError, UnicodeDecodeError) as e:
            yield from self._bad(raw.decode(errors="replace"), file, {}, e)
            return
        told = [f for f in self.schema.fields if f.name != self.corrupt]
        plain = {f.name for f in told} <= {"value", "file"}
        for r in whole:
            if plain and not (isinstance(r, dict) and set(r) <= {"value", "key"}):
                r = {"value": r if isinstance(r, str) else json.dumps(r, default=str, ensure_ascii=False)}
            good, wrong = {}, None
            if not isinstance(r, dict):
                r, wrong = {}, ValueError(f"no record: {r!r}")
            for f in told:
                try:
                    good[f.name] = file if f.name == "file" and "file" not in r else typed(r.get(f.name), f.dataType)
                except (ValueError, TypeError, ArithmeticError) as e:
                    wrong = e
            if wrong is None:
                yield tuple(good.get(f.name) for f in self.schema.fields)
            else:
                yield from self._bad(json.dumps(r, default=str, ensure_ascii=False), file, good, wrong)

    def _bad(self, text: str, file: str, good: dict, why: Exception) -> Iterator[tuple]:
        if self.mode == "FAILFAST":
            raise ValueError(f"{file}: {why}") from why
        if self.mode == "PERMISSIVE":
            row = {"file": file} | good | {self.corrupt: text}
            yield tuple(row.get(f.name) for f in self.schema.fields)


class YamlRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "yaml_records"

    def schema(self) -> str:
        return DEFAULT

    def reader(self, schema: StructType) -> YamlReader:
        return YamlReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session; its code goes to executors with the query, they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(YamlRecords)
