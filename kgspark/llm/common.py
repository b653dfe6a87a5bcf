"""What the operators of this subpackage share: table access, the shared scratch folder, and connected components."""

from __future__ import annotations

import contextlib
import gc
import io
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of documents hold at most BATCH_ROWS rows: the default of 10,000 is meant for narrow rows and holds
    tens of megabytes of text several times over, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application: their Python workers import it."""
    sc = spark.sparkContext
    if getattr(sc, "_kgspark_shipped", False):
        return
    top, held = pathlib.Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(top.rglob("*.py")):
            z.write(file, str(file.relative_to(top.parent)))
    path = f"{shared_dir(spark)}/kgspark-code-{uuid.uuid4().hex[:12]}/kgspark_code.zip"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(held.getvalue()))
    out.close()
    sc.addPyFile(path)
    sc._kgspark_shipped = True


def prepare(spark: SparkSession) -> None:
    modest_batches(spark)
    ship(spark)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kgspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns that an operator reads, and all of a row's own in one struct `_row`: names of these can't clash with
    those an operator adds."""
    return docs.select(*keep, F.struct(*[docs[c] for c in docs.columns]).alias("_row"))


def unpacked(df: DataFrame, columns: list[str], **new) -> DataFrame:
    """The rows' own columns again, those in new replaced."""
    return df.select(*[new[c].alias(c) if c in new else F.col("_row").getField(c).alias(c) for c in columns])


class Scratch:
    """Tables written to the shared folder. They cut lineage, survive lost executors, and can be dropped early."""

    def __init__(self, spark: SparkSession, tag: str):
        prepare(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/kgspark-{tag}-{uuid.uuid4().hex[:12]}"
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        with contextlib.suppress(Exception):  # not every file system supports it; then the folder's owner cleans up
            p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        del df
        self.release()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, f"{self.root}/{name}")

    def drop_others(self, *keep: str) -> None:
        """Drop all tables but these."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(p):
            if status.getPath().getName() not in keep:
                fs.delete(status.getPath(), True)

    def release(self) -> None:
        """Let Spark delete shuffle files of finished steps: it does so once the driver has collected their handles."""
        gc.collect()
        self.spark._jvm.System.gc()


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b), component being the smallest node reachable.

    Min-label rounds with pointer jumping on tables in the shared folder: labels fall along edges (a join and a
    partially aggregated min, no collected neighbour lists), then each label is replaced by its own label. Only the
    number of changed labels reaches the driver. Nulls in a or b are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = scratch.write(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{tag}-0")
    for i in range(1, max_rounds + 1):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(seen, "node", "left").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        nxt = low.join(up, "low", "left").select("node", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("moved"))
        nxt = scratch.write(nxt, f"{tag}-{i}")
        moved = nxt.where("moved").limit(1).count()
        labels = nxt.select("node", "label")
        if i > 1:
            scratch.drop(f"{tag}-{i - 1}")
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.withColumnRenamed("label", "component")
