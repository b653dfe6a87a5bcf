"""Queries over the property graph: motifs, paths, closure, components, impact."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import hierarchy, layout
from .base import query
from .project import CONNECTS_SQL, PLACES_SQL, places, wires


_KINDS = ["region", "nation", "supplier", "part"]


def _number(kind: str, key: str) -> Column:
    """A vertex as one number: its key and, in the last two bits, its kind. Shuffles of many links are smaller by that."""
    return F.shiftleft(F.col(key).cast("bigint"), 2) + F.lit(_KINDS.index(kind)).cast("bigint")


def _kind(number: Column) -> Column:
    return number.bitwiseAND(F.lit(3).cast("bigint"))


def _name(number: Column) -> Column:
    prefix = F.element_at(F.array(*[F.lit(f"{k}:") for k in _KINDS]), (_kind(number) + 1).cast("int"))
    return F.concat(prefix, F.shiftright(number, 2).cast("string"))


@query(f"""WITH {CONNECTS_SQL}
SELECT src, medium, count(*) AS n, array_to_string(list_sort(list(dst)), ', ') AS feeds FROM wires WHERE setup = 'F' GROUP BY 1, 2""")
def motif_feeds(t):
    """What each part feeds in setup F, by medium."""
    graph = g.PropertyGraph(t.part.select(F.col("p_partkey").alias("id")), wires(t))
    x = graph.find("(a)-[e]->(b)", where={"e": "setup = 'F'"})
    return x.groupBy(F.col("e_src").alias("src"), F.col("e_medium").alias("medium")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("e_dst")).cast("array<string>"), ", ").alias("feeds"))


@query("""
SELECT a.o_custkey AS customer, count(*) AS pairs FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority
WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O' GROUP BY 1""")
def motif_fork(t):
    """Customers with a finished and an open order of one priority."""
    graph = g.PropertyGraph(t.customer.select(F.col("c_custkey").alias("id")), t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")))
    x = graph.find("(c)-[p]->(); (c)-[q]->()", where={"p": "status = 'F'", "q": "status = 'O'"}, having="p_priority = q_priority")
    return x.groupBy(F.col("c_id").alias("customer")).agg(F.count("*").alias("pairs"))


@query("""
SELECT r_name AS region, c_mktsegment AS segment, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18, 2)))::DOUBLE AS total
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def motif_chain(t):
    """Order value along region, nation, customer, order."""
    x = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey")).join(t.customer, F.col("c_nationkey") == F.col("n_nationkey")).join(t.orders, F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy(F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("""
WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)
SELECT a.s AS first, b.s AS second, count(*) AS parts FROM s a JOIN s b ON a.p = b.p AND a.s < b.s GROUP BY 1, 2 HAVING count(*) >= 2""")
def motif_converge(t):
    """Pairs of suppliers that sell the same parts."""
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    x = g.PropertyGraph(t.part.select(F.col("p_partkey").alias("id")), e).find("()-[a]->(c); ()-[b]->(c)", having="a_src < b_src")
    return x.groupBy(F.col("a_src").alias("first"), F.col("b_src").alias("second")).agg(F.count("*").alias("parts")).where("parts >= 2")


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R'),
c AS (SELECT src, dst, CASE WHEN p_size > 45 THEN NULL ELSE p_size END AS ch FROM e JOIN part ON p_partkey = dst),
f AS (SELECT *, count(*) OVER (PARTITION BY src) AS fan FROM c)
SELECT src, ch, count(*) AS n, CASE WHEN ch IS NULL THEN 'no channel' ELSE 'conflict' END AS kind FROM f WHERE fan >= 2 GROUP BY src, ch HAVING count(*) > 1 OR ch IS NULL""")
def fanout_conflicts(t):
    """Sources with two children or more on one channel; children without a channel are reported apart."""
    e = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    c = e.join(t.part, F.col("dst") == F.col("p_partkey")).select("src", F.when(F.col("p_size") <= 45, F.col("p_size")).alias("ch"))
    fan = c.groupBy("src").agg(F.count("*").alias("fan")).where("fan >= 2")
    x = c.join(fan.select("src"), "src").groupBy("src", "ch").agg(F.count("*").alias("n")).where("n > 1 or ch is null")
    return x.withColumn("kind", F.when(F.col("ch").isNull(), "no channel").otherwise("conflict"))


@query("""
SELECT c_mktsegment AS segment, count(*) AS n, min(c_custkey) AS first FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') GROUP BY 1""")
def unrecorded_items(t):
    """Customers that no urgent finished order touches."""
    seen = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(seen, "c_custkey", "left_anti").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@query("""
WITH v AS (SELECT p_partkey AS id FROM part WHERE p_size <= 40), e AS (SELECT 'R' || l_returnflag AS rel, l_partkey AS src, l_suppkey * 3 AS dst FROM lineitem)
SELECT rel, side, count(*) AS n FROM (SELECT rel, 'src' AS side FROM e WHERE src NOT IN (SELECT id FROM v) UNION ALL SELECT rel, 'dst' FROM e WHERE dst NOT IN (SELECT id FROM v)) GROUP BY 1, 2""")
def dangling_edges(t):
    """Edge ends that are no vertex."""
    e = t.lineitem.select(F.concat(F.lit("R"), "l_returnflag").alias("rel"), F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 3).alias("dst"))
    return g.dangling(e, t.part.where("p_size <= 40").select(F.col("p_partkey").alias("id"))).groupBy("rel", "side").agg(F.count("*").alias("n"))


VISIBLE_SQL = f"""WITH {PLACES_SQL}, v AS (SELECT src AS id FROM places UNION SELECT dst FROM places),
vis AS (SELECT id, CASE WHEN id IN ('nation:3', 'nation:7', 'nation:12') OR id LIKE 'customer:%7' THEN 'private' ELSE 'public' END AS visibility FROM v),
ed AS (SELECT src, dst, CASE WHEN a.visibility = 'private' OR b.visibility = 'private' THEN 'private' ELSE 'public' END AS visibility FROM places JOIN vis a ON a.id = src JOIN vis b ON b.id = dst)"""


def _places_graph(t) -> g.PropertyGraph:
    e = places(t)
    ids = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    private = F.col("id").isin("nation:3", "nation:7", "nation:12") | (F.col("id").startswith("customer:") & F.col("id").endswith("7"))
    return g.PropertyGraph(ids.withColumn("visibility", F.when(private, "private").otherwise("public")), e)


@query(VISIBLE_SQL + " SELECT visibility, split_part(src, ':', 1) AS kind, count(*) AS n FROM ed GROUP BY 1, 2")
def visibility(t):
    """An edge is private where either end is."""
    x = _places_graph(t)
    return g.derive_visibility(x.edges, x.vertices).groupBy("visibility", F.split("src", ":")[0].alias("kind")).agg(F.count("*").alias("n"))


@query(VISIBLE_SQL + """ SELECT 'vertex' AS part, split_part(id, ':', 1) AS kind, count(*) AS n FROM vis WHERE visibility = 'public' GROUP BY 2
UNION ALL SELECT 'edge', split_part(src, ':', 1), count(*) FROM ed WHERE visibility = 'public' GROUP BY 2""")
def public_subgraph(t):
    p = _places_graph(t).public()
    kind = lambda c: F.split(c, ":")[0].alias("kind")
    v = p.vertices.groupBy(kind("id")).agg(F.count("*").alias("n")).select(F.lit("vertex").alias("part"), "kind", "n")
    return v.union(p.edges.groupBy(kind("src")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "kind", "n"))


def _reach_sql(where: str, roots: str) -> str:
    return f"""WITH RECURSIVE {CONNECTS_SQL}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM wires WHERE {where}),
r(id, d) USING KEY (id) AS (SELECT id, 0 FROM ({roots}) UNION
  SELECT e.dst, min(d) + 1 FROM r JOIN e ON e.src = r.id WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS seen WHERE seen.id = e.dst) GROUP BY e.dst)
SELECT d AS hops, count(*) AS n FROM r GROUP BY 1"""


def _hops(edges, roots):
    return g.reach(edges, roots).groupBy("hops").agg(F.count("*").alias("n"))


@query(_reach_sql("true", "SELECT min(src) AS id FROM e"))
def reach_hops(t):
    """How many parts are how many hops away from the lowest one."""
    e = wires(t)
    return _hops(e, e.agg(F.min("src").alias("id")))


@query(_reach_sql("setup = 'O' AND medium = 'N'", "SELECT min(src) AS id FROM e"))
def reach_scoped(t):
    """The same within setup O along one medium: a walk must not leak to another setup."""
    e = g.scoped(wires(t), "O").where("medium = 'N'")
    return _hops(e, e.agg(F.min("src").alias("id")))


@query(_reach_sql("true", "SELECT DISTINCT src AS id FROM e ORDER BY 1 LIMIT 5"))
def reach_multi_root(t):
    """Least hops from any of five roots."""
    e = wires(t)
    return _hops(e, e.select(F.col("src").alias("id")).distinct().orderBy("id").limit(5))


@query(f"""WITH RECURSIVE {PLACES_SQL}, r(id, depth) AS (SELECT 'region:1', 0 UNION SELECT src, depth + 1 FROM places JOIN r ON dst = r.id)
SELECT depth, split_part(id, ':', 1) AS kind, count(*) AS n FROM r GROUP BY 1, 2""")
def closure_descendants(t):
    """Everything under a region, with its depth."""
    roots = t.region.where("r_regionkey = 1").select(F.concat(F.lit("region:"), "r_regionkey").alias("id"))
    x = g.reach(places(t).select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)
    return x.groupBy(F.col("hops").alias("depth"), F.split("id", ":")[0].alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT 'u' || user_id AS a, 'k' || json_extract_string(props, '$.k') AS b FROM events WHERE event_type = 'purchase'),
b AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(id, seen) AS (SELECT DISTINCT a, a FROM b UNION SELECT r.id, b.b FROM r JOIN b ON b.a = r.seen)
SELECT component, count(*) AS size FROM (SELECT id, min(seen) AS component FROM r GROUP BY 1) GROUP BY 1""")
def components(t):
    """Users and the keys of their purchases: sizes of the connected groups."""
    e = t.events.where("event_type = 'purchase'").select(F.concat(F.lit("u"), "user_id").alias("src"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("dst")).distinct()
    return g.components(e).groupBy("component").agg(F.count("*").alias("size"))


@query(f"""WITH {CONNECTS_SQL}
SELECT 'in' AS side, degree, count(*) AS n FROM (SELECT dst, count(*) AS degree FROM wires GROUP BY 1) GROUP BY 2
UNION ALL SELECT 'out', degree, count(*) FROM (SELECT src, count(*) AS degree FROM wires GROUP BY 1) GROUP BY 2""")
def degrees(t):
    e = wires(t)
    side = lambda c, name: g.degrees(e, c).groupBy("degree").agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "degree", "n")
    return side("dst", "in").union(side("src", "out"))


@query()
def cycle_check(t):
    """Parts on cycles of wires or between cycles, whatever their length; no SQL peels a graph."""
    core = g.cyclic_core(wires(t))
    return core.select(F.col("src").alias("id")).union(core.select("dst")).distinct()


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS src, o_orderkey AS dst FROM orders WHERE o_orderkey < o_custkey)
SELECT count(*) FILTER (src = dst) AS loops, count(*) AS edges FROM e""")
def acyclic_gate(t):
    """Edges from higher to lower numbers: their count, and how many are on a cycle."""
    e = t.orders.where("o_orderkey < o_custkey").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")).distinct()
    return e.agg(F.count("*").alias("edges")).crossJoin(g.cyclic_core(e).agg(F.count("*").alias("loops")))  # one row each


@query("""
SELECT r_name AS region, count(*) AS customers, count(*) FILTER (regions <> 1) AS violations FROM (
  SELECT c_custkey, min(r_name) AS r_name, count(DISTINCT r_regionkey) AS regions FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1) GROUP BY 1""")
def ancestors_one_facet(t):
    """Each customer stands below exactly one region, by interval labels."""
    broader = places(t).select(F.col("src").alias("id"), F.lit(0).alias("ord"), F.col("dst").alias("parent"))
    ids = broader.select("id").union(broader.select("parent")).distinct()
    labels, extra = hierarchy.intervals(ids, broader)
    c = hierarchy.below(labels, extra, ids.where("id like 'region:%'"), ids.where("id like 'customer:%'"))
    per = c.groupBy("id").agg(F.min("top").alias("a"), F.count_distinct("top").alias("regions"))
    named = per.join(t.region.select(F.concat(F.lit("region:"), "r_regionkey").alias("a"), F.col("r_name").alias("region")), "a")
    return named.groupBy("region").agg(F.count("*").alias("customers"), F.count_if(F.col("regions") != 1).alias("violations"))


@query(f"""WITH {PLACES_SQL}, d AS (SELECT dst AS id, 0 AS d FROM places WHERE dst LIKE 'region:%' UNION SELECT src, 1 FROM places WHERE src LIKE 'nation:%'
UNION SELECT src, 2 FROM places WHERE src LIKE 'customer:%' OR src LIKE 'supplier:%' UNION SELECT 'order:' || o_orderkey, 3 FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT split_part(id, ':', 1) AS kind, d AS depth, count(*) AS n FROM d GROUP BY 1, 2""")
def layering(t):
    """Longest-path depth from regions down to urgent orders."""
    down = places(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    o = t.orders.where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("customer:"), "o_custkey").alias("src"), F.concat(F.lit("order:"), "o_orderkey").alias("dst"))
    return g.layers(down.union(o)).groupBy(F.split("id", ":")[0].alias("kind"), "depth").agg(F.count("*").alias("n"))


@query("""
WITH f AS (SELECT o_custkey AS customer, p_type FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)
SELECT customer, count(*) FILTER (p_type IN ('SMALL', 'MEDIUM')) AS kinds FROM f GROUP BY 1 HAVING count(*) FILTER (p_type = 'ECONOMY') > 0 AND count(*) FILTER (p_type IN ('SMALL', 'MEDIUM')) > 0""")
def inherits(t):
    """Customers whose orders hold the parameter type and any kind of the subject's family."""
    spark = t.part.sparkSession
    family = g.reach(spark.createDataFrame([("SIZED", "SMALL"), ("SIZED", "MEDIUM"), ("ANY", "SIZED"), ("ANY", "ECONOMY")], "src string, dst string"), spark.createDataFrame([("SIZED",)], "id string")).select(F.col("id").alias("p_type"))
    f = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_custkey").alias("customer"), "p_type")
    kinds = f.join(family, "p_type").groupBy("customer").agg(F.count("*").alias("kinds"))
    return kinds.join(f.where("p_type = 'ECONOMY'").select("customer").distinct(), "customer", "left_semi")


@query("""
WITH n AS (SELECT n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name LIKE 'A%'), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT * FROM n)),
l AS (SELECT l_partkey, l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT * FROM s))
SELECT (SELECT count(*) FROM n) AS nations, (SELECT count(*) FROM s) AS suppliers, (SELECT count(DISTINCT l_partkey) FROM l) AS parts, (SELECT count(DISTINCT l_orderkey) FROM l) AS orders""")
def impact(t):
    """What regions with a prefix touch, link by link."""
    n = t.nation.join(t.region.where(F.col("r_name").startswith("A")), F.col("r_regionkey") == F.col("n_regionkey"), "left_semi")
    s = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    x = t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    counts = [n.agg(F.count("*").alias("nations")), s.agg(F.count("*").alias("suppliers")), x.agg(F.count_distinct("l_partkey").alias("parts")), x.agg(F.count_distinct("l_orderkey").alias("orders"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # one row each
    return out


@query("""
SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'AFRICA') GROUP BY 1""")
def undocumented(t):
    """Parts that no supplier of a region ever sold, by brand."""
    africa = t.nation.join(t.region.where("r_name = 'AFRICA'"), F.col("r_regionkey") == F.col("n_regionkey"), "left_semi")
    s = t.supplier.join(africa, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    sold = t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    return t.part.join(sold, "p_partkey", "left_anti").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))


@query("""
SELECT n_name AS nation, kind, count(*) AS n FROM (SELECT s_nationkey AS k, 'supplier' AS kind FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer)
JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE' GROUP BY 1, 2""")
def lineage_counts(t):
    """Suppliers and customers that each nation of a region defines."""
    both = t.supplier.select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("kind")).union(t.customer.select("c_nationkey", F.lit("customer")))
    n = t.nation.join(t.region.where("r_name = 'EUROPE'"), F.col("r_regionkey") == F.col("n_regionkey"), "left_semi")
    return both.join(n, F.col("k") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation"), "kind").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {PLACES_SQL}, seeds AS (SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_acctbal < 0), up AS (SELECT id FROM seeds UNION SELECT dst FROM places JOIN up ON src = up.id)
SELECT 'vertex' AS part, split_part(id, ':', 1) AS kind, count(*) AS n FROM up GROUP BY 2
UNION ALL SELECT 'edge', split_part(src, ':', 1), count(*) FROM places WHERE src IN (SELECT id FROM up) AND dst IN (SELECT id FROM up) GROUP BY 2""")
def subgraph_extract(t):
    """Customers in debt and all above them, with the edges among these."""
    e = places(t)
    ids = g.reach(e, t.customer.where("c_acctbal < 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("id"))).select("id")
    kind = lambda c: F.split(c, ":")[0].alias("kind")
    v = ids.groupBy(kind("id")).agg(F.count("*").alias("n")).select(F.lit("vertex").alias("part"), "kind", "n")
    return v.union(g.induced(e, ids).groupBy(kind("src")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "kind", "n"))


@query(f"""WITH {CONNECTS_SQL}, e AS (SELECT DISTINCT src, dst FROM wires), m AS (SELECT p_partkey AS id FROM part WHERE p_size <= 25),
f AS (SELECT src, dst, src IN (SELECT id FROM m) AS si, dst IN (SELECT id FROM m) AS di FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN si THEN src ELSE dst END ORDER BY src, dst) AS n FROM f WHERE si <> di)
SELECT 'outer' AS side, 'whole' AS kind, count(*) AS n FROM f WHERE NOT si AND NOT di UNION ALL SELECT 'inner', 'whole', count(*) FROM f WHERE si AND di
UNION ALL SELECT s.side, CASE WHEN n = 1 THEN 'first port' ELSE 'numbered port' END, count(*) FROM c, (VALUES ('outer'), ('inner')) s(side) GROUP BY 1, 2""")
def boundary_rewrite(t):
    """Wires after the small parts became one node: whole ones, and those cut at a proxy port."""
    outer, inner = g.rewrite_boundary(wires(t).select("src", "dst").distinct(), t.part.where("p_size <= 25").select(F.col("p_partkey").alias("id")), "box")
    both = outer.select(F.lit("outer").alias("side"), "port").union(inner.select(F.lit("inner"), "port"))
    kind = F.when(F.col("port").isNull(), "whole").when(F.col("port").contains(" "), "numbered port").otherwise("first port")
    return both.groupBy("side", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""
SELECT a.r_name AS customer_region, b.r_name AS supplier_region, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON n1.n_nationkey = c_nationkey JOIN region a ON a.r_regionkey = n1.n_regionkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation n2 ON n2.n_nationkey = s_nationkey JOIN region b ON b.r_regionkey = n2.n_regionkey GROUP BY 1, 2""")
def relation_rollup(t):
    """Relations rolled up to the classes of both ends."""
    where = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "r_name")
    c = t.customer.join(where, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("customer_region"))
    s = t.supplier.join(where, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("r_name").alias("supplier_region"))
    x = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return x.groupBy("customer_region", "supplier_region").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT DISTINCT 'supplier:' || l_suppkey AS s, 'part:' || l_partkey AS p FROM lineitem), own AS (SELECT p FROM s WHERE s = 'supplier:1'),
m AS (SELECT DISTINCT s, p FROM s WHERE p IN (SELECT p FROM own) AND s <> 'supplier:1'), k AS (SELECT 'nation:' || s_nationkey AS k, 'supplier:' || s_suppkey AS s FROM supplier)
SELECT 'kind' AS ring, k AS id, s AS via FROM k WHERE s = 'supplier:1' UNION ALL SELECT 'parameter', p, 'supplier:1' FROM own
UNION ALL SELECT 'mover', s, p FROM m UNION ALL SELECT 'kind of mover', k, s FROM k WHERE s IN (SELECT s FROM m)""")
def neighbourhood(t):
    """Two steps around supplier 1: its nation, its parts, the other suppliers of these, and their nations."""
    sells = t.lineitem.select(F.concat(F.lit("supplier:"), "l_suppkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst")).distinct()
    lives = t.supplier.select(F.concat(F.lit("nation:"), "s_nationkey").alias("src"), F.concat(F.lit("supplier:"), "s_suppkey").alias("dst"), F.lit("kind").alias("rel"))
    edges = lives.unionByName(sells.withColumn("rel", F.lit("sells")))
    return g.neighbourhood(g.PropertyGraph(edges.select(F.col("src").alias("id")), edges), "supplier:1", "kind", "sells", "sells")


@query("""
WITH n AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY 1, 2""")
def follow_ups(t):
    """Which action follows which."""
    x = t.events.select(F.col("event_type").alias("a"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("b"))
    return x.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"""WITH {PLACES_SQL}, v AS (SELECT src AS id FROM places UNION SELECT dst FROM places)
SELECT 'vertex' AS part, split_part(id, ':', 1) AS a, '' AS b, count(*) AS n FROM v GROUP BY 2
UNION ALL SELECT 'edge', split_part(src, ':', 1), split_part(dst, ':', 1), count(*) FROM places GROUP BY 2, 3""")
def schema_counts(t):
    """Vertices by type, edges by the types of both ends."""
    e = places(t)
    kind = lambda c: F.split(c, ":")[0]
    v = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    vs = v.groupBy(kind("id").alias("a")).agg(F.count("*").alias("n")).select(F.lit("vertex").alias("part"), "a", F.lit("").alias("b"), "n")
    return vs.union(e.groupBy(kind("src").alias("a"), kind("dst").alias("b")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "a", "b", "n"))


@query("""
WITH sells AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), first AS (SELECT p, min(s) AS s FROM sells GROUP BY 1),
up AS (SELECT s_suppkey AS s, 'region:' || n_regionkey || '/nation:' || n_nationkey || '/supplier:' || s_suppkey AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT 'region:' || r_regionkey AS id, 0 AS depth, 'region:' || r_regionkey AS path, false AS also FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 1, 'region:' || n_regionkey || '/nation:' || n_nationkey, false FROM nation
UNION ALL SELECT 'supplier:' || s, 2, path, false FROM up
UNION ALL SELECT 'part:' || p, 3, path || '/part:' || p, s <> (SELECT f.s FROM first f WHERE f.p = sells.p) FROM sells JOIN up USING (s)""")
def tree_walk(t):
    """Regions, nations, suppliers and parts in pre-order; a part stands under its first supplier, and as a leaf under others."""
    sells = t.lineitem.select(_number("part", "l_partkey").alias("id"), F.col("l_suppkey").alias("ord"), _number("supplier", "l_suppkey").alias("parent"))
    zero = F.lit(0).cast("bigint").alias("ord")
    broader = t.supplier.select(_number("supplier", "s_suppkey").alias("id"), zero, _number("nation", "s_nationkey").alias("parent")).union(t.nation.select(_number("nation", "n_nationkey"), zero, _number("region", "n_regionkey")))
    walk = g.taxonomy_walk(t.region.select(_number("region", "r_regionkey").alias("id")), broader, sells, _name)
    return walk.select("id", "depth", F.array_join("path", "/").alias("path"), "also")


@query("""
WITH e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)
SELECT id, d AS depth, h AS height, 2 - h AS alap FROM (
  SELECT 'r' || r_regionkey AS id, 0 AS d, CASE WHEN EXISTS (SELECT 1 FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey) THEN 2 ELSE 1 END AS h FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
  UNION ALL SELECT 'n' || n_nationkey, 1, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 1 ELSE 0 END FROM nation
  UNION ALL SELECT 's' || s_suppkey, 2, 0 FROM supplier)""")
def layer_ranks(t):
    """Depth, height and latest layer of regions, nations and suppliers."""
    e = t.nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    return g.ranks(e.union(t.supplier.select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey"))))


@query("""
SELECT l_suppkey AS supplier, bool_and(p_size > 3) AS all_swappable, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def routing_swappable(t):
    """Nodes all of whose feeds may be swapped."""
    x = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return x.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.bool_and(F.col("p_size") > 3).alias("all_swappable"), F.count_distinct("l_partkey").alias("parts"))


@query("""
WITH sells AS (SELECT DISTINCT 'part:' || l_partkey AS p, 'nation:' || s_nationkey AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey), up AS (SELECT 'nation:' || n_nationkey AS n, 'region:' || n_regionkey AS r FROM nation)
SELECT r AS region, count(DISTINCT p) AS parts FROM sells JOIN up USING (n) GROUP BY 1""")
def below_regions(t):
    """Parts below each region: a part hangs under the nation of its first supplier, and has other nations as second parents."""
    sells = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select(_number("part", "l_partkey").alias("id"), F.col("s_nationkey").alias("ord"), _number("nation", "s_nationkey").alias("parent"))
    broader = sells.union(t.nation.select(_number("nation", "n_nationkey"), F.lit(0), _number("region", "n_regionkey")))
    regions = t.region.select(_number("region", "r_regionkey").alias("id"))
    labels, extra = hierarchy.intervals(regions, broader)
    pairs = hierarchy.below(labels, extra, regions, labels.where(_kind(F.col("id")) == _KINDS.index("part")).select("id"))
    return pairs.groupBy(_name(F.col("top")).alias("region")).agg(F.count("*").alias("parts"))


_LAYOUT_SQL = """
e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
d0 AS (SELECT id, CASE left(id, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS d FROM v),
a AS (SELECT s_suppkey AS ord, 's' || s_suppkey AS src, 'r' || n_regionkey AS dst FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 2 = 1),
d1 AS (SELECT id, greatest(d, coalesce(CASE WHEN id IN (SELECT dst FROM a) THEN 3 END, 0)) AS d FROM d0),
b AS (SELECT 1000000 + n_nationkey AS ord, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation WHERE n_nationkey % 2 = 0),
d2 AS (SELECT d1.id, greatest(d1.d, coalesce(max(s.d) + 1, 0)) AS d FROM d1 LEFT JOIN b ON b.dst = d1.id LEFT JOIN d1 s ON s.id = b.src GROUP BY d1.id, d1.d)"""


@query(f"WITH {_LAYOUT_SQL} SELECT id, d::INT AS col, row_number() OVER (PARTITION BY d ORDER BY id) - 1 AS row FROM d2")
def layout_columns(t):
    """Columns of regions, nations and suppliers by their links, and then by links both ways: odd suppliers to their region, then
    regions to their even nations, which see the regions where the suppliers pushed them."""
    cat = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    home = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey"))
    links = t.nation.select(F.lit(0).cast("bigint").alias("ord"), cat("r", "n_regionkey").alias("src"), cat("n", "n_nationkey").alias("dst"), F.lit(False).alias("bidirectional"))
    links = links.union(t.supplier.select(F.lit(0).cast("bigint"), cat("n", "s_nationkey"), cat("s", "s_suppkey"), F.lit(False)))
    links = links.union(home.where("s_suppkey % 2 = 1").select(F.col("s_suppkey").cast("bigint"), cat("s", "s_suppkey"), cat("r", "n_regionkey"), F.lit(True)))
    links = links.union(t.nation.where("n_nationkey % 2 = 0").select((F.lit(1000000) + F.col("n_nationkey")).cast("bigint"), cat("r", "n_regionkey"), cat("n", "n_nationkey"), F.lit(True)))
    ids = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    return layout.columns(ids, links)


@query("""
WITH e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'In ' || (n_nationkey * 7 % 23) AS port FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, CASE WHEN s_suppkey % 4 > 0 THEN 'Jack ' || s_suppkey % 11 END FROM supplier),
p AS (SELECT src AS id, min(coalesce(port, '~')) AS port FROM e GROUP BY 1),
v AS (SELECT id, CASE left(id, 1) WHEN 'r' THEN 0 WHEN 'n' THEN 1 ELSE 2 END AS depth, coalesce(p.port, '~') AS port FROM (SELECT src AS id FROM e UNION SELECT dst FROM e) LEFT JOIN p USING (id)),
k AS (SELECT id, depth, CASE WHEN port = '~' THEN port ELSE lower(split_part(port, ' ', 1)) || ' ' || lpad(split_part(port, ' ', 2), 12, '0') END AS port FROM v),
l0 AS (SELECT id, depth, row_number() OVER (ORDER BY port, id) - 1 AS place FROM k WHERE depth = 0),
m1 AS (SELECT dst AS id, sum(coalesce(place, 0)) / count(*) AS mean FROM e LEFT JOIN l0 ON l0.id = src GROUP BY 1),
l1 AS (SELECT k.id, depth, row_number() OVER (ORDER BY port, mean, k.id) - 1 AS place FROM k JOIN m1 USING (id) WHERE depth = 1),
m2 AS (SELECT dst AS id, sum(coalesce(place, 0)) / count(*) AS mean FROM e LEFT JOIN l1 ON l1.id = src GROUP BY 1),
l2 AS (SELECT k.id, depth, row_number() OVER (ORDER BY port, mean, k.id) - 1 AS place FROM k JOIN m2 USING (id) WHERE depth = 2)
SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2""")
def layer_places(t):
    """The order of regions, of nations and of suppliers: by numbered ports, then by where what comes before them stands."""
    cat = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    e = t.nation.select(cat("r", "n_regionkey").alias("src"), cat("n", "n_nationkey").alias("dst"), F.concat(F.lit("In "), (F.col("n_nationkey") * 7 % 23).cast("string")).alias("to_port"))
    jack = F.when(F.col("s_suppkey") % 4 > 0, F.concat(F.lit("Jack "), (F.col("s_suppkey") % 11).cast("string")))
    e = e.union(t.supplier.select(cat("n", "s_nationkey"), cat("s", "s_suppkey"), jack))
    return layout.layer_order(g.layers(e), e)
