"""The graph built from the test tables, and records and views of a consumer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import build, consumer, golden
from ..operators import text as tx
from .base import query
from .project import CONNECTS_SQL, wires

_WORLD_SQL = f"""{CONNECTS_SQL}, i AS (SELECT p_partkey AS id, p_type, p_brand, CASE WHEN p_size > 48 THEN 'private' ELSE 'public' END AS vis FROM part WHERE p_size <> 7),
ev AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS s FROM lineitem WHERE l_partkey IN (SELECT id FROM i))"""


def world(t) -> build.World:
    """Parts as items (those of size 7 are missing), wires as links, suppliers as sources that tell a part's size."""
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    items = t.part.where("p_size <> 7").select(text("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("manufacturer"), none.alias("status"), (F.col("p_size") > 5).alias("in_use"), none.alias("format"), none.alias("role"), F.when(F.col("p_size") > 48, "private").otherwise("public").alias("visibility"), "p_size")
    told = t.lineitem.select(text("l_partkey").alias("item"), text("l_suppkey").alias("url")).distinct().join(items.select(F.col("id").alias("item"), F.col("p_size").alias("value")), "item")
    evidence = told.select("item", F.lit("size").alias("field"), F.lit("maker").alias("tier"), "url", F.lit("200").alias("http"), "value", none.alias("line"))
    links = wires(t).select("setup", text("src").alias("src"), text("dst").alias("dst"), none.alias("src_port"), none.alias("dst_port"), "medium", F.when((F.col("src") + F.col("dst")) % 13 == 0, "confirmed").otherwise("unconfirmed").alias("status"), none.alias("confirmed"), F.lit(None).cast("boolean").alias("swappable"), F.lit(None).cast("boolean").alias("bidirectional"), none.alias("note"))
    return build.World(items=items.drop("p_size"), evidence=evidence, links=links)


@query(f"""WITH {_WORLD_SQL}, e AS (
  SELECT 'IN_CATEGORY' AS name, vis FROM i UNION ALL SELECT 'MADE_BY', vis FROM i UNION ALL SELECT 'HAS_SPEC', vis FROM i WHERE id IN (SELECT id FROM ev)
  UNION ALL SELECT 'SOURCED_FROM', 'public' FROM ev UNION ALL SELECT 'CONSULTED', vis FROM ev JOIN i USING (id)
  UNION ALL SELECT 'CONNECTS', CASE WHEN src IN (SELECT id FROM i WHERE vis = 'private') OR dst IN (SELECT id FROM i WHERE vis = 'private') THEN 'private' ELSE 'public' END FROM wires)
SELECT 'edge' AS part, name, vis AS visibility, count(*) AS n FROM e GROUP BY ALL
UNION ALL SELECT 'vertex', 'item', vis, count(*) FROM i GROUP BY 3 UNION ALL SELECT 'vertex', 'category', 'public', count(DISTINCT p_type) FROM i UNION ALL SELECT 'vertex', 'manufacturer', 'public', count(DISTINCT p_brand) FROM i
UNION ALL SELECT 'vertex', 'spec', 'public', count(DISTINCT id) FROM ev UNION ALL SELECT 'vertex', 'source', 'public', count(DISTINCT s) FROM ev""")
def graph_build(t):
    """Vertices and edges of the built graph by type and visibility."""
    g = build.build(world(t))
    v = g.vertices.groupBy(F.lit("vertex").alias("part"), F.col("type").alias("name"), "visibility").agg(F.count("*").alias("n"))
    return v.union(g.edges.groupBy(F.lit("edge"), F.col("rel"), "visibility").agg(F.count("*").alias("n")))


@query(f"""WITH {_WORLD_SQL}, bad AS (SELECT 'CONNECTS src' AS detail FROM wires WHERE src NOT IN (SELECT id FROM i) UNION ALL SELECT 'CONNECTS dst' FROM wires WHERE dst NOT IN (SELECT id FROM i))
SELECT 'edge end is no vertex' AS rule, detail, count(*) AS n FROM bad GROUP BY ALL""")
def graph_gates(t):
    """What keeps the built graph from being published: wires of the missing parts."""
    return build.gates(build.build(world(t))).groupBy("rule", "detail").agg(F.count("*").alias("n"))


@query("""SELECT n_nationkey AS id, n_name AS short FROM nation WHERE contains(lower('Acme ' || n_name || ' 1U'), 'on')""")
def short_names(t):
    """Nations found by a part of their name, without the maker in front and the size behind."""
    d = t.nation.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Acme "), "n_name", F.lit(" 1U")).alias("name"), F.lit("Acme").alias("manufacturer"))
    return consumer.search(d.drop("manufacturer"), "ON").select("id", consumer.short_name(F.col("name"), F.lit("Acme")).alias("short"))


@query("""SELECT s_suppkey, s_nationkey, ((n - 1) // 7)::INT AS "row", ((n - 1) % 7)::INT AS "column" FROM (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)""")
def grid_places(t):
    """Suppliers of a nation in rows of seven."""
    return consumer.wrapped(t.supplier.select("s_suppkey", "s_nationkey"), ["s_nationkey"], ["s_suppkey"])


@query("""SELECT s_nationkey, min(s_suppkey % 50)::DOUBLE - 2 AS x, min(s_acctbal) - 2 AS y, max(s_suppkey % 50) - min(s_suppkey % 50)::DOUBLE + 14 AS w, max(s_acctbal) - min(s_acctbal) + 9 AS h FROM supplier WHERE s_acctbal > 0 GROUP BY 1""")
def bounding_boxes(t):
    """The box around each nation's suppliers that have a place."""
    nodes = t.supplier.select("s_nationkey", (F.col("s_suppkey") % 50).cast("double").alias("x"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("y"))
    return consumer.bounding_box(nodes, ["s_nationkey"], 10, 5, 2)


@query("""WITH p AS (SELECT DISTINCT l_partkey AS id, l_suppkey AS s, l_suppkey % 2 = 0 AS inward FROM lineitem WHERE l_returnflag = 'R')
SELECT p_partkey AS id, CASE WHEN p_size > 5 THEN 1 ELSE 0 END + 1 AS n_specs, coalesce(n, 0)::INT AS n_ports, first FROM part
LEFT JOIN (SELECT id, count(*) AS n, 'port ' || coalesce(min(s) FILTER (inward), min(s)) AS first FROM p GROUP BY 1) USING (id) WHERE true""".replace("USING (id)", "ON id = p_partkey").replace("SELECT p_partkey AS id,", "SELECT p_partkey AS part,"))
def device_records(t):
    """Parts as devices with their figures and jacks, inputs first."""
    devices = t.part.select(F.col("p_partkey").alias("id"))
    specs = t.part.select(F.col("p_partkey").alias("device"), F.explode(F.array(F.struct(F.lit("size").alias("field"), F.when(F.col("p_size") > 5, F.col("p_size")).cast("double").alias("value")), F.struct(F.lit("price").alias("field"), F.col("p_retailprice").alias("value")))).alias("x")).select("device", "x.field", "x.value")
    sold = t.lineitem.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    ports = sold.select(F.col("l_partkey").alias("device"), F.concat(F.lit("port "), "l_suppkey").alias("name"), F.when(F.col("l_suppkey") % 2 == 0, "in").otherwise("out").alias("dir"), F.lit("cv").alias("medium"), F.col("l_suppkey").alias("ord"), F.lit(False).alias("hidden"))
    r = consumer.records(devices, specs, ports)
    return r.select(F.col("id").alias("part"), F.size("specs").alias("n_specs"), F.size("ports").alias("n_ports"), F.get("ports", F.lit(0))["name"].alias("first"))


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS m, l_suppkey % 3 AS ix FROM lineitem WHERE l_linenumber = 1),
u AS (SELECT s, ix, sum(CASE WHEN p_size % 7 = 0 THEN 4 ELSE p_size END) AS used FROM p JOIN part ON p_partkey = m GROUP BY 1, 2)
SELECT s_suppkey AS s, r.ix::INT AS row_index, r.wide, coalesce(used, 0)::BIGINT AS used, (r.wide - coalesce(used, 0))::BIGINT AS free FROM supplier, (VALUES (0, 84), (1, 900)) r(ix, wide) LEFT JOIN u ON u.s = s_suppkey AND u.ix = r.ix""")
def free_widths(t):
    """What is left of each row of each supplier's case."""
    cases = t.supplier.select(F.lit("w").alias("setup"), F.col("s_suppkey").alias("id"), F.array(F.struct(F.lit(84).alias("hp")), F.struct(F.lit(900).alias("hp"))).alias("rows"))
    placed = t.lineitem.where("l_linenumber = 1").select(F.lit("w").alias("setup"), F.col("l_suppkey").alias("case"), F.col("l_partkey").alias("module"), (F.col("l_suppkey") % 3).cast("int").alias("row_index")).distinct()
    items = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("hp"))
    return consumer.free_width(cases, placed, items).select(F.col("case").alias("s"), "row_index", "wide", "used", "free")


@query("""WITH e AS (SELECT user_id AS id, event_id AS pos, CASE WHEN event_type = 'view' THEN (event_id % 90)::INT END AS page, CASE WHEN event_type = 'signup' THEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) END AS ord
  FROM events WHERE event_type IN ('view', 'signup')),
w AS (SELECT id, last_value(page IGNORE NULLS) OVER o AS page, last_value(ord IGNORE NULLS) OVER o AS ord FROM e WINDOW o AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT id, ord::INT AS ord, min(page) AS first_page, max(page) AS last_page FROM w WHERE ord IS NOT NULL GROUP BY ALL""")
def pages_covered(t):
    """Users' signups as sections and their views as page marks: the pages of each section."""
    marks = t.events.where("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), (F.col("event_id") % 90).cast("int").alias("page"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    starts = t.events.where("event_type = 'signup'").select(F.col("user_id").alias("id"), n.alias("ord"), F.col("event_id").alias("at"), F.lit(None).cast("bigint").alias("until"))
    return tx.pages_covered(marks, starts)


_WIRED = "SELECT src AS id FROM wires WHERE (src + dst) % 13 = 0 UNION SELECT dst FROM wires WHERE (src + dst) % 13 = 0"


@query(f"""WITH {_WORLD_SQL} SELECT DISTINCT medium AS key, dst::VARCHAR AS value FROM wires WHERE src = 0 AND setup = 'F' AND (src + dst) % 13 = 0""")
def asked_feeds(t):
    """What part 0 feeds in setup F, by confirmed links."""
    return golden.feeds(build.build(world(t)), "0", "F")


@query(f"""WITH RECURSIVE {_WORLD_SQL}, e AS MATERIALIZED (SELECT DISTINCT src, dst FROM wires WHERE medium IN ('N', 'R') AND (src + dst) % 13 = 0),
r(id, d) USING KEY (id) AS (SELECT 27, 0 UNION SELECT e.dst, min(d) + 1 FROM r JOIN e ON e.src = r.id WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS seen WHERE seen.id = e.dst) GROUP BY e.dst)
SELECT d::VARCHAR AS key, id::VARCHAR AS value FROM r WHERE d > 0""")
def asked_reach(t):
    """What part 27 reaches by confirmed links of two media, with hops."""
    return golden.reach(build.build(world(t)), "27", ["N", "R"])


@query(f"""WITH {_WORLD_SQL} SELECT p_type AS key, id::VARCHAR AS value FROM i WHERE id NOT IN ({_WIRED})""")
def asked_unrecorded(t):
    """Items that no confirmed link names, by category; some have unconfirmed ones."""
    return golden.unrecorded(build.build(world(t)))


@query(f"""WITH {_WORLD_SQL}, n AS (SELECT id, count(*) AS n FROM ev GROUP BY 1)
SELECT CASE WHEN n = 1 THEN 'one maker' ELSE 'two or more' END AS key, count(*)::VARCHAR AS value FROM n GROUP BY 1""")
def asked_support(t):
    """Figures by how many sources stand behind them."""
    return golden.support(build.build(world(t)))
