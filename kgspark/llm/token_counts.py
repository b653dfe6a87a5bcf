"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A batch of changes adds to the totals and never recounts: an insert counts +1, a delete -1, a revision -1 with the old
figures and +1 with the new. Totals are sums of signed deltas, so batches may come in any order and partial sums
combine before the shuffle, whatever share of the rows one source has. A batch's deltas are one folder `batch=<id>`, which
counts from the moment Spark has put its _SUCCESS file there, after all tasks ended; nothing is renamed. A half-written folder
counts for nothing and is written over by the next try; a batch that counts is not applied again, so a retried commit
changes nothing. One batch id is committed by one writer at a time. compact() keeps the ids of the batches it adds up.

Edge cases: null or empty text counts as a document of 0 tokens; null source or lang is a group of its own; doc_id is
not read, so null or repeated ones count row by row, as do repeated rows; a null op counts as an insert; extra columns
are ignored; an empty batch commits without rows; groups whose documents are all deleted again stay with zeros.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .bytebpe import _pattern, coder
from .common import Scratch, prepare, read_table

DELTAS = "source string, lang string, tokenizer string, n_documents bigint, n_tokens bigint"
VERSION = "byte_bpe_50k@1"
KEYS = ["source", "lang", "tokenizer"]
BASE = "compacted"


def count_tokens(rows: DataFrame, column: str, into: str, path: str) -> DataFrame:
    """rows with a bigint column `into`: the number of tokens of `column`'s whole text."""
    from pyspark.sql.types import LongType, StructField, StructType

    prepare(rows.sparkSession)
    pattern = _pattern()

    def go(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kernels.enter("bytebpe", coder.cache_clear)
        bpe = coder(path, pattern)
        sizes: dict[str, int] = {}
        for batch in batches:
            out = []
            for t in batch.column(column):
                found, total = bpe.pattern.findall(t.as_py() or ""), 0
                if len(sizes) > 1_000_000:
                    sizes.clear()
                new = [w for w in dict.fromkeys(found) if w not in sizes]
                if new:
                    sizes.update(zip(new, (len(e.ids) for e in bpe.tok.encode_batch_fast(new, add_special_tokens=False)), strict=True))
                total = sum(map(sizes.__getitem__, found))
                out.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, into])

    return rows.mapInArrow(go, StructType([*rows.schema.fields, StructField(into, LongType())]))


def deltas(changes: DataFrame, path: str, version: str) -> DataFrame:
    """Signed totals of changes(op, source, lang, text[, old_source, old_lang, old_text]).

    op is 'insert', 'delete' or 'revise'; a revision without old columns is taken as text of the same group.
    """
    have = set(changes.columns)
    op = F.coalesce("op", F.lit("insert"))
    now = changes.select(F.when(op == "delete", -1).otherwise(1).alias("sign"), "source", "lang", "text")
    if "old_text" in have:
        old = changes.where(op == "revise").select(F.lit(-1).alias("sign"), F.col("old_source" if "old_source" in have else "source").alias("source"), F.col("old_lang" if "old_lang" in have else "lang").alias("lang"), F.col("old_text").alias("text"))
        now = now.union(old)
    counted = count_tokens(now, "text", "_tokens", path)
    return counted.groupBy("source", "lang").agg(F.sum("sign").cast("long").alias("n_documents"), F.sum(F.col("sign") * F.col("_tokens")).alias("n_tokens")).select("source", "lang", F.lit(version).alias("tokenizer"), "n_documents", "n_tokens")


class Rollup:
    """Totals kept as a folder of committed batches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _is(self, path: str) -> bool:
        return self._fs.exists(self._path(f"{path}/_SUCCESS"))

    def _folders(self) -> list[str]:
        """Batches with a folder of their own."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and self._is(f"{self.root}/{n}"))

    def committed(self) -> list[str]:
        """Ids of all batches that count, those that were added up among them."""
        held = f"{self.root}/held"
        older = [r[0] for r in self.spark.read.schema("batch string").parquet(held).collect()] if self._is(held) else []  # names of batches
        return sorted({*older, *(b for b in self._folders() if b != BASE)})

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch's deltas; False if that batch was committed before."""
        if batch == BASE or not batch:
            raise ValueError(f"a batch can't be called {batch!r}")
        if batch in self.committed():
            return False
        self._write(rows, f"batch={batch}")
        return True

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.root}/{name}")
        if not self._is(f"{self.root}/{name}"):
            raise RuntimeError(f"{self.root}/{name} has no _SUCCESS file: the batch doesn't count")

    def totals(self) -> DataFrame:
        paths = [f"{self.root}/batch={b}" for b in self._folders()]
        rows = self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS)
        return rows.groupBy(*KEYS).agg(F.sum("n_documents").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self, into: str) -> Rollup:
        """A new rollup elsewhere that starts with these totals and knows these batches; use it once this returns."""
        new = Rollup(self.spark, into)
        new._write(self.spark.createDataFrame([(b,) for b in self.committed()], "batch string"), "held")
        new._write(self.totals(), f"batch={BASE}")
        return new


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version of all documents, kept by batches of every kind.

    All documents are inserted; then those with doc_id divisible by 100 are revised, deleted as revised, and inserted as
    they are. Each batch is committed twice, as after a lost reply. The totals are those of the table.
    """
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    roll = Rollup(spark, Scratch(spark, "tokens").root)
    some, revised = docs.where("doc_id % 100 = 0"), F.concat(F.coalesce("text", F.lit("")), F.lit(" revised"))
    batches = {
        "0001-load": docs.withColumn("op", F.lit("insert")),
        "0002-revise": some.select(F.lit("revise").alias("op"), "source", "lang", revised.alias("text"), F.col("text").alias("old_text")),
        "0003-delete": some.select(F.lit("delete").alias("op"), "source", "lang", revised.alias("text")),
        "0004-insert": some.withColumn("op", F.lit("insert")),
    }
    for _ in range(2):
        for name, changes in batches.items():
            roll.commit(name, deltas(changes, path, VERSION))
    return roll.totals()
