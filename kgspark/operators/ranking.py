"""Numbers along an order, worked out over all tasks: a range shuffle, numbers within its parts, and sums of the parts before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def _parted(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    return cut(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))


def _ahead(rows: DataFrame, keys: list[str], amount: Column) -> DataFrame:
    """(keys, _part, _first, _ahead): a part's first row of each key, and the key's amount in the parts before."""
    parts = rows.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), amount.alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.select(*keys, "_part", "_first", F.coalesce(before, F.lit(0)).alias("_ahead"))


def numbered(df: DataFrame, order: list, into: str, keys: list[str] | None = None) -> DataFrame:
    """df with the number (from 0) of each row within its keys (not null) by order; no group has to fit a task."""
    keys = keys or []
    rows = _parted(df, keys, order)
    return rows.join(_ahead(rows, keys, F.count("*")), [*keys, "_part"]).withColumn(into, F.col("_row") - F.col("_first") + F.col("_ahead")).drop("_part", "_row", "_first", "_ahead")


def running_total(df: DataFrame, order: list, amount: str, into: str, keys: list[str] | None = None) -> DataFrame:
    """df with the sum of amount over the rows before each within its keys (not null)."""
    keys = keys or []
    rows = _parted(df, keys, order)
    within = F.coalesce(F.sum(amount).over(Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_within", within).join(_ahead(rows, keys, F.sum(amount)), [*keys, "_part"])
    return rows.withColumn(into, F.col("_within") + F.col("_ahead")).drop("_part", "_row", "_first", "_ahead", "_within")
