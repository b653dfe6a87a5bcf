"""Queries for merges, allocation, windows and order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import relational as rel
from ..operators import text as tx
from .base import query


@query("""
WITH s AS (SELECT DISTINCT p_brand, p_name FROM part), g AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY regexp_replace(p_name, '[0-9]+', '') , p_name) AS r FROM s)
SELECT p_brand AS brand, p_name AS name, row_number() OVER (PARTITION BY b ORDER BY k, p_name) AS place FROM (
  SELECT p_brand, p_name, lpad(regexp_extract(lower(p_brand), '([0-9]+)', 1), 12, '0') AS k, regexp_extract(p_brand, '^[^0-9]*') AS b FROM g)""")
def natural_sort(t):
    """Brands in natural order: numbers by value."""
    s = t.part.select("p_brand", "p_name").distinct().withColumn("b", F.regexp_extract("p_brand", "^[^0-9]*", 0))
    w = Window.partitionBy("b").orderBy(rel.natural_key(F.col("p_brand")), "p_name")
    return s.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH x AS (SELECT p_brand AS brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS c FROM part)
SELECT brand, rank, p_partkey, greatest(c - 12, 0) AS more FROM x WHERE rank <= 12""")
def topn_more(t):
    """Twelve parts of each brand, and how many more there are."""
    x = rel.top_and_more(t.part.withColumnRenamed("p_brand", "brand"), ["brand"], [F.desc("p_retailprice"), "p_partkey"], "p_partkey", 12)
    return x.select("brand", F.col("rank").cast("long").alias("rank"), "p_partkey", "more")


@query("""
SELECT s::INTEGER AS slot, coalesce(n, 0) AS n, coalesce(brands, 'spare') AS brands FROM range(0, 61) r(s)
LEFT JOIN (SELECT p_size, count(*) AS n, array_to_string(list_sort(list(DISTINCT p_brand)), ', ') AS brands FROM part WHERE p_type = 'ECONOMY' GROUP BY 1) ON p_size = s""")
def densify_slots(t):
    """Every size with the brands of economy parts, spare ones listed."""
    g = t.part.where("p_type = 'ECONOMY'").groupBy(F.col("p_size").alias("slot")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("p_brand")), ", ").alias("brands"))
    return rel.densify(g, "slot", 0, 60).select("slot", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("brands", F.lit("spare")).alias("brands"))


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), 1000) AS until FROM conversations")
def next_section(t):
    """Where each turn ends: at the next one, or at the end."""
    return tx.next_boundary(t.conversations, ["conv_id"], "turn", F.lit(1000).cast("long")).select("conv_id", "turn", "until")


@query("""
SELECT p_partkey, (SELECT name FROM (VALUES (1, 'red wid'), (2, 'small'), (3, 'blue bolt x'), (4, 'red')) v(ord, name) WHERE name = p_name OR starts_with(p_name, name) OR starts_with(name, p_name) ORDER BY ord LIMIT 1) AS name FROM part""")
def prefix_match(t):
    """The first listed name that is a prefix of the part's, or the other way round."""
    names = t.part.sparkSession.createDataFrame([(1, "red wid"), (2, "small"), (3, "blue bolt x"), (4, "red")], "ord int, name string")
    return rel.first_prefix(t.part.select("p_partkey", "p_name"), "p_name", names, "name", ["p_partkey"], "ord").select("p_partkey", "name")


@query("""
WITH a AS (SELECT p_partkey, left(p_name, 3 + p_partkey % 9) AS a FROM part), b AS (SELECT DISTINCT left(p_name, 2 + p_partkey % 7) AS b FROM part)
SELECT p_partkey, count(*) AS n, min(b) AS first FROM a JOIN b ON starts_with(a, b) OR starts_with(b, a) GROUP BY 1""")
def prefix_pairs(t):
    """How many names, cut at various lengths, are a prefix of a part's cut name or begin with it."""
    cut = lambda least, period: F.left("p_name", (F.lit(least) + F.col("p_partkey") % period).cast("int"))
    x = rel.prefix_pairs(t.part.select("p_partkey", cut(3, 9).alias("a")), "a", t.part.select(cut(2, 7).alias("b")).distinct(), "b")
    return x.groupBy("p_partkey").agg(F.count("*").alias("n"), F.min("b").alias("first"))


@query("""
WITH s AS (SELECT n_regionkey AS k, n_name AS name, n_nationkey AS v, 'seed' AS note FROM nation WHERE n_nationkey < 20),
e AS (SELECT n_regionkey AS k, lower(n_name) AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 100 END AS v, 'edit' AS note FROM nation WHERE n_nationkey > 9)
SELECT coalesce(e.k, s.k) AS k, coalesce(e.name, s.name) AS name, coalesce(e.v, s.v) AS v, coalesce(e.note, s.note) AS note, CASE WHEN s.name IS NULL THEN 'edit' WHEN e.name IS NULL THEN 'seed' ELSE 'both' END AS origin
FROM s FULL JOIN e ON s.k = e.k AND upper(s.name) = upper(e.name)""")
def overlay_merge(t):
    """Seed rows with edits on top, names compared in any case."""
    n = t.nation
    seed = n.where("n_nationkey < 20").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("v"), F.lit("seed").alias("note"))
    edit = n.where("n_nationkey > 9").select(F.col("n_regionkey").alias("k"), F.lower("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") + 100).alias("v"), F.lit("edit").alias("note"))
    return rel.overlay(seed, edit, ["k"], "name", ["v", "note"])


@query("""
WITH u AS (SELECT o_custkey AS device, o_orderpriority AS name, 0 AS precedence FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey, lower(o_orderpriority), 1 FROM orders WHERE o_orderstatus = 'O' UNION SELECT o_custkey, o_orderpriority, 2 FROM orders WHERE o_orderstatus = 'P')
SELECT precedence, count(*) AS n, count(DISTINCT device) AS devices FROM (SELECT *, row_number() OVER (PARTITION BY device, upper(name) ORDER BY precedence, name) AS r FROM u) WHERE r = 1 GROUP BY 1""")
def source_precedence(t):
    """Three sources of names; the first that has a name wins."""
    part = lambda s: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("device"), (F.lower("o_orderpriority") if s == "O" else F.col("o_orderpriority")).alias("name")).distinct()
    return rel.first_of([part("F"), part("O"), part("P")], ["device"], "name").groupBy("precedence").agg(F.count("*").alias("n"), F.count_distinct("device").alias("devices"))


@query("""
WITH p AS (SELECT DISTINCT c_nationkey AS nation, o_orderpriority AS priority, c_mktsegment AS segment FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 450000),
d AS (SELECT n_nationkey AS nation, priority, segment FROM nation, (SELECT DISTINCT o_orderpriority AS priority FROM orders), (SELECT DISTINCT c_mktsegment AS segment FROM customer))
SELECT nation, priority, segment FROM d WHERE (nation, priority, segment) NOT IN (SELECT (nation, priority, segment) FROM p)""")
def default_fill(t):
    """Default rows for combinations that no large order covers."""
    x = t.orders.where("o_totalprice > 450000").join(t.customer, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"))
    d = t.nation.select(F.col("n_nationkey").alias("nation")).crossJoin(t.orders.select(F.col("o_orderpriority").alias("priority")).distinct()).crossJoin(t.customer.select(F.col("c_mktsegment").alias("segment")).distinct())  # three short lists
    return rel.default_fill(x, d, ["nation", "priority", "segment"])


@query("""
WITH p AS (SELECT l_suppkey AS device, 'PORT ' || l_linenumber AS name, CASE l_linenumber % 3 WHEN 0 THEN 'in' WHEN 1 THEN 'out' ELSE 'bidir' END AS dir, l_returnflag AS medium FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07),
c AS (SELECT device, unnest(CASE dir WHEN 'bidir' THEN ['bidir', 'in', 'out'] ELSE [dir] END) AS dir, medium FROM p),
d AS (SELECT s_suppkey AS device, name, dir, medium FROM supplier, (VALUES ('Port 1', 'in', 'A'), ('Port 2', 'out', 'A'), ('Out', 'out', 'N'), ('In', 'in', 'R'), ('Thru', 'bidir', 'N')) v(name, dir, medium))
SELECT * FROM d WHERE (device, dir, medium) NOT IN (SELECT (device, dir, medium) FROM c) AND (device, upper(name)) NOT IN (SELECT (device, name) FROM p)""")
def default_ports(t):
    """Default ports of suppliers: those of a direction and medium that no line covers (one both ways covers in and out) and whose
    name none has."""
    way = F.when(F.col("l_linenumber") % 3 == 0, "in").when(F.col("l_linenumber") % 3 == 1, "out").otherwise("bidir")
    p = t.lineitem.where("l_discount > 0.09 and l_tax > 0.07").select(F.col("l_suppkey").alias("device"), F.concat(F.lit("PORT "), F.col("l_linenumber").cast("string")).alias("name"), way.alias("dir"), F.col("l_returnflag").alias("medium"))
    port = lambda n, d, m: F.struct(F.lit(n).alias("name"), F.lit(d).alias("dir"), F.lit(m).alias("medium"))
    five = F.array(port("Port 1", "in", "A"), port("Port 2", "out", "A"), port("Out", "out", "N"), port("In", "in", "R"), port("Thru", "bidir", "N"))
    d = t.supplier.select(F.col("s_suppkey").alias("device"), F.explode(five).alias("p")).select("device", "p.*")
    return rel.default_fill(p, d, ["device", "dir", "medium"], {"dir": {"bidir": ["in", "out"]}}, ["device", "name"])


@query("""
WITH r AS (SELECT o_orderkey, o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P'),
s AS (SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS p, c_acctbal FROM customer),
f AS (SELECT c_custkey, p, row_number() OVER (PARTITION BY p ORDER BY c_acctbal DESC, c_custkey) AS k FROM s)
SELECT o_orderkey, r.p, c_custkey FROM r LEFT JOIN f ON r.p = f.p AND r.k = f.k""")
def free_slot_allocation(t):
    """The k-th pending order of a priority gets the k-th free customer."""
    r = t.orders.where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_orderpriority").alias("p"), "o_orderdate")
    m = F.col("c_nationkey") % 5
    p = F.when(m == 0, "1-URGENT").when(m == 1, "2-HIGH").when(m == 2, "3-MEDIUM").when(m == 3, "4-NOT SPECIFIED").otherwise("5-LOW")
    s = t.customer.select("c_custkey", p.alias("p"), (-F.col("c_acctbal")).alias("poor"))
    return rel.allocate(r, s, ["p"], ["o_orderdate", "o_orderkey"], ["poor", "c_custkey"]).select("o_orderkey", "p", "c_custkey")


@query("""
SELECT l_suppkey AS supplier, l_linestatus AS row, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity,
  coalesce(sum(l_quantity) OVER (PARTITION BY l_suppkey, l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem""")
def placement(t):
    """How far along its row each item starts."""
    x = t.lineitem.select(F.col("l_suppkey").alias("supplier"), F.col("l_linestatus").alias("row"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    return rel.running(x, ["supplier", "row"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"], "l_quantity").withColumn("before", F.col("before").cast("double"))


@query("""
WITH x AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)
SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || ' ' || n END AS name FROM x""")
def unique_names(t):
    """Names made unique: base, base 2, base 3."""
    return rel.unique_names(t.part, "p_name", ["p_partkey"]).select("p_partkey", "name")


@query()
def first_fit_rows(t):
    """Items put into the rows of their supplier one after the other: exact row, first with room, last."""
    items = t.lineitem.where("l_returnflag = 'R'").select(F.concat(F.lit("s"), "l_suppkey").alias("box"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("item"), F.concat(F.lit("f"), F.col("l_partkey") % 2).alias("format"), F.col("l_quantity").alias("size"), F.when(F.col("l_linenumber") == 1, F.lit(2)).cast("int").alias("row_index"))
    items = items.groupBy("box", "item").agg(F.min("format").alias("format"), F.sum("size").alias("size"), F.min("row_index").alias("row_index"))
    items = items.withColumn("ord", F.col("item"))
    rows = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("box"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("row_index")).select("box", "row_index", F.concat(F.lit("f"), F.col("row_index") % 2).alias("format"), F.lit(1500.0).alias("size"))
    return rel.first_fit(items, rows)


@query("""SELECT s_suppkey, round_even(100.0 * s_acctbal / nullif(s_nationkey * 100, 0), 0) AS pct, greatest(3, least(12, s_nationkey)) AS clamped, ('0x' || left(md5(s_name), 8))::BIGINT % 16 AS bucket,
CASE WHEN s_suppkey % 3 = 0 THEN 'none' ELSE s_name END AS name FROM supplier""")
def scalar_shapes(t):
    """Percentages rounded half to even, clamped numbers, stable buckets, the first value that isn't blank."""
    blank = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.col("s_name"))
    return t.supplier.select("s_suppkey", scalar.percent(F.col("s_acctbal"), F.col("s_nationkey") * 100).alias("pct"), scalar.clamp(F.col("s_nationkey"), 3, 12).alias("clamped"), scalar.bucket(F.col("s_name"), 16).alias("bucket"), scalar.either(blank, F.lit("none")).alias("name"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parts(t):
    """Host and path of each page."""
    return t.pages.select("page_id", scalar.host(F.col("url")).alias("host"), scalar.path(F.col("url")).alias("path"))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM orders WHERE o_orderkey % 5 = 0")
def days(t):
    """Orders by the day that their text starts with; some texts start with none."""
    text = F.when(F.col("o_orderkey") % 5 == 0, "no date 2025-01-02").otherwise(F.concat(F.lit(" "), F.col("o_orderdate").cast("string")))
    return t.orders.groupBy(scalar.day(text).alias("day")).agg(F.count("*").alias("n"))
