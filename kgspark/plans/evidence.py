"""Queries over evidence, support and load."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..operators import rules
from .base import query

EVIDENCE_SQL = """
ev AS (SELECT l_partkey AS part, l_suppkey AS supplier, CAST(round(l_tax * 100) AS INTEGER) AS value FROM lineitem),
per AS (SELECT part, supplier, value, count(*) AS n FROM ev GROUP BY ALL),
whole AS (SELECT part, supplier, sum(n) AS n, count(*) AS kinds, max(value) AS most, max(CASE WHEN n * 2 > total THEN value END) AS major
  FROM (SELECT *, sum(n) OVER (PARTITION BY part, supplier) AS total FROM per) GROUP BY ALL),
resolved AS (SELECT part, supplier, CASE WHEN kinds > 1 THEN coalesce(major, most) ELSE most END AS value,
  CASE WHEN kinds > 1 THEN 'conflict' WHEN n > 1 THEN 'confirmed' ELSE 'single' END AS status FROM whole)
"""


def sources(t):
    """One line is one source for the value of (part, supplier)."""
    return t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.round(F.col("l_tax") * 100).cast("int").alias("value"))


@query("""
WITH keys AS (SELECT s_suppkey AS supplier, setup, rail, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS capacity
  FROM supplier, (VALUES ('F'), ('O')) a(setup), (VALUES ('A'), ('N'), ('R')) b(rail)),
d AS (SELECT l_suppkey AS supplier, l_linestatus AS setup, l_returnflag AS rail, count(*) AS modules,
  sum(CASE WHEN l_discount <> 0 THEN l_quantity END) AS draw, count(*) FILTER (l_discount = 0) AS n_missing, count(*) FILTER (l_tax = 0) AS n_attested
  FROM lineitem GROUP BY ALL)
SELECT supplier, setup, rail, coalesce(modules, 0) AS modules, coalesce(draw, 0)::DOUBLE AS draw, coalesce(n_missing, 0) AS n_missing,
  coalesce(n_attested, 0) AS n_attested, capacity, round_even(100 * coalesce(draw, 0) / capacity, 0) AS pct
FROM keys LEFT JOIN d USING (supplier, setup, rail)""")
def power_budget(t):
    """Load of every supplier, setup and rail: known draw, modules without figure, attested ones, share of capacity."""
    spark = t.supplier.sparkSession
    grid = spark.createDataFrame([(s, r) for s in "FO" for r in "ANR"], "setup string, rail string")
    keys = t.supplier.select(F.col("s_suppkey").alias("supplier"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("capacity")).crossJoin(F.broadcast(grid))  # six rows
    draws = t.lineitem.select(F.col("l_suppkey").alias("supplier"), F.col("l_linestatus").alias("setup"), F.col("l_returnflag").alias("rail"), F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("draw"), (F.col("l_tax") == 0).alias("attested"))
    return ev.load(draws, keys, ["supplier", "setup", "rail"])


@query("""
SELECT l_suppkey AS supplier, count(DISTINCT l_partkey) AS n, min(p_name) AS first_name, max(p_name) AS last_name,
  array_to_string(list_sort(list(DISTINCT p_brand) FILTER (l_discount = 0)), ', ') AS brands_missing
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def power_budget_modules(t):
    """Parts each supplier feeds, and the brands without a figure."""
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("supplier"))
    missing = F.array_join(F.array_sort(F.collect_set(F.when(F.col("l_discount") == 0, F.col("p_brand")))), ", ")
    return x.agg(F.count_distinct("l_partkey").alias("n"), F.min("p_name").alias("first_name"), F.max("p_name").alias("last_name"), missing.alias("brands_missing"))


@query("""
WITH per AS (SELECT l_partkey AS part, count(*) AS n, min('tier' || (s_nationkey % 3)) AS tier FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' GROUP BY 1)
SELECT CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one ' || tier ELSE 'two or more' END AS support, count(*) AS specs
FROM part LEFT JOIN per ON part = p_partkey GROUP BY 1""")
def source_support(t):
    """Specs by how many sources support them; parts without any line stay."""
    src = t.lineitem.where("l_returnflag = 'R'").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("l_partkey").alias("part"), F.concat(F.lit("tier"), F.col("s_nationkey") % 3).alias("tier"))
    return ev.support(t.part.select(F.col("p_partkey").alias("part")), src, ["part"]).groupBy("support").agg(F.count("*").alias("specs"))


@query(f"WITH {EVIDENCE_SQL} SELECT status, count(*) AS n, sum(value)::BIGINT AS total FROM resolved GROUP BY 1")
def evidence_resolve(t):
    return ev.resolve(sources(t), ["part", "supplier"]).groupBy("status").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"WITH {EVIDENCE_SQL} SELECT part, supplier, value, status FROM resolved")
def evidence_resolve_rows(t):
    return ev.resolve(sources(t), ["part", "supplier"]).select("part", "supplier", "value", "status")


@query(f"""WITH {EVIDENCE_SQL}
SELECT CASE WHEN p_size <= 2 THEN 'override' ELSE status END AS status, count(*) AS n, sum(CASE WHEN p_size <= 2 THEN 0 ELSE value END)::BIGINT AS total
FROM resolved JOIN part ON p_partkey = part GROUP BY 1""")
def evidence_override(t):
    """Overrides win: parts of size 2 or less are 0."""
    keys = sources(t).select("part", "supplier").distinct()
    over = keys.join(t.part.where("p_size <= 2"), F.col("part") == F.col("p_partkey")).select("part", "supplier", F.lit(0).alias("value"))
    return ev.resolve(sources(t), ["part", "supplier"], overrides=over).groupBy("status").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""
WITH g AS (SELECT p_partkey, count(l_tax) AS n, count(DISTINCT round(l_tax * 100)) AS kinds FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_partkey = p_partkey GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'single' WHEN kinds = 1 THEN 'agree' ELSE 'DISAGREE' END AS status, count(*) AS n FROM g GROUP BY 1""")
def agreement_class(t):
    """How far raw values of a part agree."""
    raw = t.part.join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_partkey") == F.col("p_partkey"), "left").select("p_partkey", F.round(F.col("l_tax") * 100).alias("value"))
    return ev.agreement(raw, ["p_partkey"]).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {EVIDENCE_SQL}, r AS (SELECT part, max(CASE status WHEN 'confirmed' THEN 0 WHEN 'single' THEN 2 ELSE 5 END) AS k, count(*) FILTER (status = 'confirmed') AS n_confirmed FROM resolved GROUP BY 1)
SELECT part, CASE k WHEN 0 THEN 'confirmed' WHEN 2 THEN 'single' ELSE 'conflict' END AS worst, n_confirmed FROM r""")
def worst_status(t):
    return ev.worst_status(ev.resolve(sources(t), ["part", "supplier"]), ["part"])


@query("""
WITH ev AS (SELECT l_partkey AS part, 'f' || (l_suppkey % 4) AS field, round(l_tax * 100)::INT AS value FROM lineitem WHERE l_returnflag = 'R'),
want AS (SELECT p_partkey AS part, 'f' || k AS field FROM part, range(4) r(k)),
seen AS (SELECT part, field, count(*) AS n, count(DISTINCT value) AS kinds FROM ev GROUP BY ALL),
st AS (SELECT part, field, CASE WHEN field = 'f0' AND part % 5 = 0 THEN CASE WHEN part % 2 = 0 THEN 'inferred' ELSE 'override' END
  WHEN n IS NULL THEN 'missing' WHEN kinds > 1 THEN 'conflict' WHEN n > 1 THEN 'confirmed' ELSE 'single' END AS status FROM want LEFT JOIN seen USING (part, field)),
r AS (SELECT part, max(CASE status WHEN 'confirmed' THEN 0 WHEN 'single' THEN 1 WHEN 'override' THEN 2 WHEN 'inferred' THEN 3 WHEN 'missing' THEN 4 ELSE 5 END) FILTER (NOT (status = 'missing' AND field IN ('f1', 'f2', 'f3'))) AS k,
  count(*) FILTER (status = 'confirmed') AS n_confirmed FROM st GROUP BY 1)
SELECT coalesce(['confirmed', 'single', 'override', 'inferred', 'missing', 'conflict'][k + 1], 'none') AS worst, count(*) AS parts, sum(n_confirmed)::BIGINT AS n_confirmed FROM r GROUP BY 1""")
def worst_status_override(t):
    """Weakest statuses of parts with four wanted fields: some overridden with null values, half of these with a status of their own;
    three fields whose absence doesn't count."""
    ev_ = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("part"), F.concat(F.lit("f"), F.col("l_suppkey") % 4).alias("field"), F.round(F.col("l_tax") * 100).cast("int").alias("value"))
    want = t.part.select(F.col("p_partkey").alias("part"), F.explode(F.array(*[F.lit(f"f{k}") for k in range(4)])).alias("field"))
    over = t.part.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("part"), F.lit("f0").alias("field"), F.lit(None).cast("int").alias("value"), F.when(F.col("p_partkey") % 2 == 0, "inferred").alias("status"))
    worst = ev.worst_status(ev.resolve(ev_, ["part", "field"], want, over), ["part"], F.col("field").isin("f1", "f2", "f3"))
    return worst.groupBy(F.coalesce("worst", F.lit("none")).alias("worst")).agg(F.count("*").alias("parts"), F.sum("n_confirmed").alias("n_confirmed"))


RULES = [(1, "owner", ["tax"], ["single"], ["BUILDING", "AUTOMOBILE"]), (2, "shop", ["tax", "size"], ["single", "conflict"], ["BUILDING", "MACHINERY"]), (3, "paper", ["size"], ["confirmed"], ["FURNITURE"])]


@query("""
WITH specs AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'tax' ELSE 'size' END AS field,
  CASE c_custkey % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'conflict' ELSE 'confirmed' END AS status, c_mktsegment AS role FROM customer)
SELECT coalesce(CASE WHEN field = 'tax' AND status = 'single' AND role IN ('BUILDING', 'AUTOMOBILE') THEN 'owner'
  WHEN status IN ('single', 'conflict') AND role IN ('BUILDING', 'MACHINERY') THEN 'shop'
  WHEN field = 'size' AND status = 'confirmed' AND role = 'FURNITURE' THEN 'paper' END, 'none') AS attested, count(*) AS n
FROM specs GROUP BY 1""")
def attestation(t):
    """The first rule whose fields, statuses and roles fit."""
    c = F.col("c_custkey")
    specs = t.customer.select(c.alias("id"), F.when(c % 2 == 0, "tax").otherwise("size").alias("field"), F.when(c % 3 == 0, "single").when(c % 3 == 1, "conflict").otherwise("confirmed").alias("status"), F.col("c_mktsegment").alias("role"))
    table = t.customer.sparkSession.createDataFrame(RULES, "rule_ord int, id string, fields array<string>, statuses array<string>, roles array<string>")
    rules_ = table.withColumnRenamed("id", "rid")
    hit = ev.attest(specs.withColumnRenamed("id", "spec"), rules_.withColumnRenamed("rid", "id"), ["spec"])
    return hit.groupBy(F.coalesce("attested", F.lit("none")).alias("attested")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus, o_orderpriority) AS place FROM orders GROUP BY 1, 2")
def status_tally(t):
    """A histogram in descending order, equal counts by name."""
    from pyspark.sql import Window

    g = t.orders.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "status", "priority")).cast("long"))  # fifteen rows


@query("""
SELECT 'reference' AS rule, 'ERROR' AS severity, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
UNION ALL SELECT 'priority', 'ERROR', count(*) FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')
UNION ALL SELECT 'balance', 'WARN', count(*) FROM supplier WHERE s_acctbal NOT BETWEEN 0 AND 9000
UNION ALL SELECT 'line key', 'ERROR', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'date', 'WARN', count(*) FROM orders WHERE o_orderstatus = 'F' AND CASE WHEN o_totalprice > 200000 THEN o_orderdate END IS NULL""")
def violations(t):
    """Rules over references, domains, ranges, keys and required values, one table of counts."""
    parts = [
        rules.references(t.lineitem, "l_orderkey", t.orders.where("o_orderstatus <> 'P'"), "o_orderkey", "reference", F.col("l_orderkey")),
        rules.domain(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], "priority", F.col("o_orderkey")),
        rules.within(t.supplier, "s_acctbal", 0, 9000, "balance", F.col("s_suppkey"), "WARN"),
        rules.unique(t.lineitem, ["l_orderkey", "l_linenumber"], "line key"),
        rules.required(t.orders.withColumn("dated", F.when(F.col("o_totalprice") > 200000, F.col("o_orderdate"))), "dated", F.col("o_orderstatus") == "F", "date", F.col("o_orderkey"), "WARN"),
    ]
    return rules.together(parts).groupBy("rule", "severity").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(t):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("""
WITH g AS (SELECT l_suppkey AS supplier, l_linestatus AS setup, sum(CAST(l_quantity AS DECIMAL(18, 2))) AS used FROM lineitem GROUP BY 1, 2)
SELECT supplier, setup, used::DOUBLE AS used, (s_acctbal * 10)::DOUBLE AS capacity, used > s_acctbal * 10 AS over FROM g JOIN supplier ON s_suppkey = supplier""")
def capacity_rows(t):
    """Used against capacity for each supplier and setup."""
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_linestatus").alias("setup")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("used"))
    j = g.join(t.supplier.select(F.col("s_suppkey").alias("supplier"), (F.col("s_acctbal") * 10).alias("capacity")), "supplier")
    return j.withColumn("over", F.col("used") > F.col("capacity"))
