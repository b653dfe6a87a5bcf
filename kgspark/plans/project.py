"""The test tables seen as the graph's domain: orders as wiring, parts as items, suppliers as supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A line's successor in its order; (l_orderkey, l_linenumber) isn't unique, so all columns break ties.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]

CONNECTS_SQL = """
nx AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst,
       l_returnflag AS medium, l_linestatus AS setup FROM lineitem),
wires AS (SELECT DISTINCT src, dst, medium, setup FROM nx WHERE dst IS NOT NULL AND src <> dst)
"""


def wires(t) -> DataFrame:
    """CONNECTS edges(src, dst, medium, setup): each line's part to the next line's part of the order."""
    nx = t.lineitem.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).alias("dst"), F.col("l_returnflag").alias("medium"), F.col("l_linestatus").alias("setup"))
    return nx.where("dst is not null and src <> dst").distinct()


def places(t) -> DataFrame:
    """child -> parent edges of customers and suppliers, nations, regions; ids are typed."""
    c = t.customer.select(F.concat(F.lit("customer:"), "c_custkey").alias("src"), F.concat(F.lit("nation:"), "c_nationkey").alias("dst"))
    s = t.supplier.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("src"), F.concat(F.lit("nation:"), "s_nationkey").alias("dst"))
    n = t.nation.select(F.concat(F.lit("nation:"), "n_nationkey").alias("src"), F.concat(F.lit("region:"), "n_regionkey").alias("dst"))
    return c.union(s).union(n)


PLACES_SQL = """
places AS (
  SELECT 'customer:' || c_custkey AS src, 'nation:' || c_nationkey AS dst FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)
"""
