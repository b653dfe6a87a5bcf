"""Rule sets over the test tables seen as records: how often each rule is broken."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import validators as v
from .base import query


def _tally(violations):
    return violations.groupBy("rule", "severity").agg(F.count("*").alias("n"))


def _sql(records: str, parts: dict[str, str], warns: tuple[str, ...] = ()) -> str:
    """records as CTEs, then a count for each rule from its FROM clause; rules that nothing breaks have no row."""
    each = " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{'WARN' if rule in warns else 'ERROR'}' AS severity, count(*) AS n FROM {part}" for rule, part in parts.items())
    return f"WITH {records} SELECT * FROM ({each}) WHERE n > 0"


_LINKS = """i AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size <= 48 UNION ALL SELECT 's' || s_suppkey FROM supplier),
l AS (SELECT l_linestatus AS setup, 'p' || l_partkey AS src, 's' || (l_suppkey * 2) AS dst, l_returnflag AS medium,
  CASE WHEN l_discount > 0.05 THEN 'confirmed' WHEN l_discount > 0.01 THEN 'unconfirmed' ELSE 'odd' END AS status, CASE WHEN l_tax > 0.02 THEN 'd' END AS confirmed FROM lineitem)"""


@query(_sql(_LINKS, {
    "link src is no item": "l WHERE src NOT IN (SELECT id FROM i)", "link dst is no item": "l WHERE dst NOT IN (SELECT id FROM i)", "link setup unknown": "l WHERE setup <> 'O'",
    "link medium": "l WHERE medium NOT IN ('A', 'N')", "link status": "l WHERE status = 'odd'", "confirmed link without date": "l WHERE status = 'confirmed' AND confirmed IS NULL",
    "link unconfirmed": "l WHERE status = 'unconfirmed'"}, ("link unconfirmed",)))
def link_rules(t):
    """Lines as links from parts to suppliers."""
    items = t.part.where("p_size <= 48").select(F.concat(F.lit("p"), "p_partkey").alias("id")).union(t.supplier.select(F.concat(F.lit("s"), "s_suppkey")))
    status = F.when(F.col("l_discount") > 0.05, "confirmed").when(F.col("l_discount") > 0.01, "unconfirmed").otherwise("odd")
    rows = t.lineitem.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_linestatus").alias("setup"), F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), F.col("l_suppkey") * 2).alias("dst"), F.col("l_returnflag").alias("medium"), status.alias("status"), F.when(F.col("l_tax") > 0.02, "d").alias("confirmed"))
    return _tally(v.links(rows, items, t.lineitem.sparkSession.createDataFrame([("O",)], "id string"), ["A", "N"]))


_PLACED = """i AS (SELECT 'p' || p_partkey AS id, p_size > 5 AS in_use, CASE WHEN p_size % 7 <> 0 THEN p_size END AS hp, CASE WHEN p_size % 11 = 0 THEN '2U' WHEN p_size % 2 = 0 THEN '1U' ELSE '3U' END AS format, p_retailprice > 1000 AS has_specs FROM part),
c AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS supply FROM supplier WHERE s_suppkey % 10 <> 3),
p AS (SELECT 'p' || l_partkey AS module, 's' || l_suppkey AS box, 'n' || (l_suppkey % 25) AS power, (l_suppkey % 4)::INT AS ix, (min(l_orderkey) % 50)::INT AS position FROM lineitem WHERE l_linenumber = 1 GROUP BY l_partkey, l_suppkey),
j AS (SELECT p.*, i.hp, i.format, CASE ix WHEN 1 THEN '1U' WHEN 2 THEN '3U' END AS row_format FROM p JOIN c ON c.id = p.box JOIN i ON i.id = p.module WHERE hp IS NOT NULL),
f AS (SELECT box, format, sum(hp) AS used FROM j GROUP BY 1, 2)"""


@query(_sql(_PLACED, {
    "placement case unknown": "p WHERE box NOT IN (SELECT id FROM c)", "powered by another supply": "p JOIN c ON c.id = box WHERE power <> supply",
    "placed but not in use": "p JOIN i ON i.id = module WHERE NOT in_use", "placed without width": "p JOIN i ON i.id = module WHERE hp IS NULL",
    "row out of bounds": "j WHERE ix = 3", "row of another format": "j WHERE row_format <> format", "position taken twice": "(SELECT box FROM j WHERE ix IN (1, 2) GROUP BY box, ix, position HAVING count(*) > 1)",
    "module placed more than once": "(SELECT module FROM p GROUP BY 1 HAVING count(*) > 1)", "row too full": "(SELECT box FROM j WHERE ix IN (1, 2) GROUP BY box, ix HAVING sum(hp) > 400)", "format too full": "f WHERE used > CASE format WHEN '2U' THEN 0 ELSE 400 END",
    "module in use is nowhere placed": "i WHERE in_use AND has_specs AND id NOT IN (SELECT module FROM p WHERE box IN (SELECT id FROM c))"}, ("placed but not in use", "placed without width")))
def placement_rules(t):
    """First lines as parts placed in their supplier's case of two rows."""
    size = F.col("p_size")
    items = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), (size > 5).alias("in_use"), F.when(size % 7 != 0, size).alias("hp"), F.when(size % 11 == 0, "2U").when(size % 2 == 0, "1U").otherwise("3U").alias("format"), (F.col("p_retailprice") > 1000).alias("has_specs"), F.lit("module").alias("kind"))
    row = lambda f: F.struct(F.lit(f).alias("format"), F.lit(400).alias("hp"))
    cases = t.supplier.where("s_suppkey % 10 <> 3").select(F.lit("w").alias("setup"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("supply"), F.array().cast("array<string>").alias("mounted"), F.array(row("1U"), row("3U")).alias("rows"))
    first = t.lineitem.where("l_linenumber = 1").groupBy("l_partkey", "l_suppkey").agg((F.min("l_orderkey") % 50).cast("int").alias("position"))
    placed = first.select(F.lit("w").alias("setup"), F.concat(F.lit("p"), "l_partkey").alias("module"), F.concat(F.lit("s"), "l_suppkey").alias("case"), F.concat(F.lit("n"), F.col("l_suppkey") % 25).alias("powered_by"), (F.col("l_suppkey") % 4).cast("int").alias("row_index"), "position", F.lit("confirmed").alias("status"), F.lit("d").alias("confirmed"))
    return _tally(v.placements(placed, cases, items).union(v.rows(placed, cases, items)).union(v.capacity(placed, cases, items)))


_CHANNELS = """ch AS (SELECT c_mktsegment AS setup, 'n' || c_nationkey AS device, (c_custkey % 20)::VARCHAR AS i, CASE WHEN c_custkey % 21 = 0 THEN 'omni' ELSE (c_custkey % 17)::VARCHAR END AS o,
  CASE WHEN c_custkey % 3 = 0 THEN 'confirmed' WHEN c_custkey % 3 = 1 THEN 'unconfirmed' ELSE 'odd' END AS status, CASE WHEN c_acctbal > 0 THEN 'd' END AS confirmed FROM customer),
w AS (SELECT DISTINCT c_mktsegment AS setup, 'n' || c_nationkey AS device FROM customer WHERE c_acctbal > 9900)"""


@query(_sql(_CHANNELS, {
    "channel device unknown": "ch WHERE device NOT IN (SELECT 'n' || n_nationkey FROM nation WHERE n_regionkey < 4)", "in channel": "ch WHERE i::INT NOT BETWEEN 1 AND 16", "out channel": "ch WHERE o = 'omni' OR o = '0'",
    "channel status": "ch WHERE status = 'odd'", "confirmed channel without date": "ch WHERE status = 'confirmed' AND confirmed IS NULL", "channel recorded twice": "(SELECT setup FROM ch GROUP BY setup, device HAVING count(*) > 1)",
    "channel but no midi link": "ch WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.setup = ch.setup AND w.device = ch.device)"}, ("channel but no midi link",)))
def channel_rules(t):
    """Customers as channel records of their nation."""
    k = F.col("c_custkey")
    status = F.when(k % 3 == 0, "confirmed").when(k % 3 == 1, "unconfirmed").otherwise("odd")
    rows = t.customer.select(F.col("c_mktsegment").alias("setup"), F.concat(F.lit("n"), "c_nationkey").alias("device"), (k % 20).cast("string").alias("in"), F.when(k % 21 == 0, "omni").otherwise((k % 17).cast("string")).alias("out"), status.alias("status"), F.when(F.col("c_acctbal") > 0, "d").alias("confirmed"))
    wired = t.customer.where("c_acctbal > 9900").select(F.col("c_mktsegment").alias("setup"), F.concat(F.lit("n"), "c_nationkey").alias("device")).distinct()
    return _tally(v.channels(rows, t.nation.where("n_regionkey < 4").select(F.concat(F.lit("n"), "n_nationkey").alias("id")), wired))


_SECTIONS = """s AS (SELECT doc_id, source AS doc, split_part(text, chr(10), 1) AS title, text AS body, lang AS tag FROM documents)"""


@query(_sql(_SECTIONS, {
    "section without title": "s WHERE trim(title) = ''", "section without body": "s WHERE trim(body) = ''", "section tag not in the vocabulary": "s WHERE tag NOT IN ('en', 'de')", "section document unknown": "s WHERE doc NOT IN (SELECT min(source) FROM documents)",
    "section length": "s WHERE length(body) NOT BETWEEN 600 AND 3000", "title twice in a document": "(SELECT doc FROM s GROUP BY doc, lower(title) HAVING count(*) > 1)"}, ("section length", "title twice in a document")))
def section_rules(t):
    """Documents as sections of their source, titled by their first line."""
    none = F.lit(None).cast("string")
    rows = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("doc"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("body"), F.array("lang").alias("tags"), none.alias("sha256"), none.alias("path"))
    files = t.documents.sparkSession.createDataFrame([], "path string")
    tags = t.documents.sparkSession.createDataFrame([("en",), ("de",)], "id string")
    return _tally(v.sections(rows, t.documents.agg(F.min("source").alias("id")), tags, files, 600, 3000))



@query("""WITH RECURSIVE c AS (SELECT DISTINCT 'u' || user_id AS a, 'k' || json_extract_string(props, '$.k') AS b FROM events WHERE event_type = 'signup'),
e AS MATERIALIZED (SELECT a, b FROM c UNION SELECT b, a FROM c),
r(id, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
p AS (SELECT id, min(seen) AS component FROM r GROUP BY 1),
h AS (SELECT DISTINCT component, id AS device, (substr(id, 2)::BIGINT % 40)::VARCHAR AS ch FROM p WHERE id LIKE 'u%' AND substr(id, 2)::BIGINT % 40 < 16)
SELECT component || '/' || ch AS subject, array_to_string(list_sort(list(device)), ', ') AS detail FROM h GROUP BY component, ch HAVING count(*) > 1""")
def channel_clashes(t):
    """Users joined by the keys of their signups: who shares a channel within one group."""
    c = t.events.where("event_type = 'signup'").select(F.concat(F.lit("u"), "user_id").alias("from_node"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("to_node"), F.lit("midi").alias("medium")).distinct()
    nodes = c.select(F.col("from_node").alias("uid"), F.col("from_node").alias("device")).distinct()
    ch = F.expr("cast(substr(device, 2) as bigint) % 40")
    heard = nodes.select("device", F.when(ch < 16, ch.cast("string")).otherwise("omni").alias("in"))
    return v.receive_clashes(nodes, c, heard).select("subject", "detail")


_TERMS = """n AS (SELECT count(*) AS n FROM supplier), b AS (SELECT s_suppkey AS s, s_nationkey AS k FROM supplier UNION SELECT s_suppkey, (s_nationkey + 1) % 25 FROM supplier WHERE s_suppkey % 10 = 0),
f AS (SELECT DISTINCT s, n_regionkey AS r FROM b JOIN nation ON n_nationkey = k), f1 AS (SELECT s, min(r) AS r FROM f GROUP BY s HAVING count(*) = 1), rel AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 13 = 0 THEN 'hums' ELSE 'sells' END AS p, (s_suppkey * 3) % n + 1 AS o FROM supplier, n)"""


@query(_sql(_TERMS, {
    "more than one facet": "(SELECT s FROM f GROUP BY s HAVING count(*) > 1)", "label of several concepts": "(SELECT s_suppkey % 60 AS k FROM supplier GROUP BY 1 HAVING count(*) > 1)",
    "close match within the hierarchy": "supplier WHERE s_suppkey % 7 = 0", "predicate not declared": "rel WHERE p = 'hums'", "tag not in the vocabulary": "nation WHERE n_regionkey > 2",
    "subject outside the domain": "rel WHERE p = 'sells' AND s NOT IN (SELECT s FROM f1 WHERE r < 2)", "object outside the range": "rel WHERE p = 'sells' AND o IN (SELECT s FROM b) AND o NOT IN (SELECT s FROM f1 WHERE r > 1)", "relation end unknown": "rel WHERE p = 'sells' AND o NOT IN (SELECT s FROM b)"}))
def term_rules(t):
    """Nations and suppliers as concepts under regions as facets; a tenth of the suppliers are in two nations."""
    spark, key = t.nation.sparkSession, lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    none, blank = F.array().cast("array<string>"), F.lit(None).cast("string")
    row = lambda id_, pref, broader, close, tag: [id_.alias("id"), pref.alias("pref"), none.alias("alt"), broader.alias("broader"), close.alias("close"), tag.alias("tag")]
    k, s = F.col("s_nationkey"), F.col("s_suppkey")
    nations = t.nation.select(*row(key("n", F.col("n_nationkey")), key("nation ", F.col("n_nationkey")), F.array(key("r", F.col("n_regionkey"))), none, key("t", F.col("n_regionkey"))))
    up = F.when(s % 10 == 0, F.array(key("n", k), key("n", (k + 1) % 25))).otherwise(F.array(key("n", k)))
    suppliers = t.supplier.select(*row(key("s", s), key("sup ", s % 60), up, F.when(s % 7 == 0, F.array(key("n", k))).otherwise(none), blank))
    predicates = spark.createDataFrame([("sells", ["r0", "r1"], ["r2", "r3", "r4"])], "id string, domain array<string>, range array<string>")
    relations = t.supplier.crossJoin(t.supplier.agg(F.count("*").alias("n"))).select(key("s", s).alias("s"), F.when(s % 13 == 0, "hums").otherwise("sells").alias("p"), key("s", (s * 3) % F.col("n") + 1).alias("o"))  # n: one row
    tags = spark.createDataFrame([("t0",), ("t1",), ("t2",)], "id string")
    return _tally(v.terminology(nations.union(suppliers), predicates, relations, spark.createDataFrame([], "label string, senses array<string>"), tags, t.region.select(key("r", F.col("r_regionkey")).alias("id"))))


_SESSIONS = """nd AS (SELECT c_mktsegment AS session, 'u' || c_nationkey AS uid, c_acctbal > -900 AS named FROM customer WHERE c_nationkey < 20),
cb AS (SELECT c_mktsegment AS session, 'u' || c_nationkey AS a, 'u' || (c_custkey % 30) AS b, CASE WHEN c_custkey % 9 = 0 THEN 'fog' ELSE 'cv' END AS medium FROM customer)"""


@query(_sql(_SESSIONS, {
    "session name": "(SELECT DISTINCT c_mktsegment AS m FROM customer) WHERE NOT regexp_matches(m, '^[a-z0-9][a-z0-9-]{0,63}$')", "node without uid or device": "nd WHERE NOT named", "node uid twice": "(SELECT session FROM nd GROUP BY session, uid HAVING count(*) > 1)",
    "cable end is no node": "(SELECT session, a AS e FROM cb UNION ALL SELECT session, b FROM cb) x WHERE NOT EXISTS (SELECT 1 FROM nd WHERE nd.session = x.session AND nd.uid = x.e)", "cable to its own node": "cb WHERE a = b", "cable medium": "cb WHERE medium = 'fog'"}))
def session_rules(t):
    """Market segments as sessions, nations as nodes, customers as cables."""
    uid = lambda c: F.concat(F.lit("u"), c.cast("string"))
    k, spark = F.col("c_custkey"), t.customer.sparkSession
    nodes = t.customer.where("c_nationkey < 20").select(F.col("c_mktsegment").alias("session"), uid(F.col("c_nationkey")).alias("uid"), F.when(F.col("c_acctbal") > -900, "d").alias("device"))
    cables = t.customer.select(F.col("c_mktsegment").alias("session"), k.cast("string").alias("uid"), uid(F.col("c_nationkey")).alias("from_uid"), uid(k % 30).alias("to_uid"), F.when(k % 9 == 0, "fog").otherwise("cv").alias("medium"))
    ports = spark.createDataFrame([], "device string, name string, dir string, medium string")
    return _tally(v.session(t.customer.select(F.col("c_mktsegment").alias("name")).distinct(), nodes, cables, ports))


def _id(prefix: str, number) -> Column:
    return F.concat(F.lit(prefix), (F.col(number) if isinstance(number, str) else number).cast("string"))


_CASES = """i AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'n' || n_nationkey FROM nation WHERE n_nationkey < 20),
st AS (SELECT 'r' || r_regionkey AS id, 'n' || (r_regionkey * 7) AS interface FROM region WHERE r_regionkey < 4),
s AS (SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_suppkey % 9 = 0),
c AS (SELECT 'r' || (s_nationkey % 5) AS setup, 's' || s_suppkey AS id, 'n' || s_nationkey AS supply, s_suppkey AS k FROM s)"""


@query(_sql(_CASES, {
    "setup interface is no item": "st WHERE interface NOT IN (SELECT id FROM i)", "case setup unknown": "c WHERE setup NOT IN (SELECT id FROM st)", "case is no item": "c WHERE id NOT IN (SELECT id FROM i)",
    "case supply is no item": "c WHERE supply NOT IN (SELECT id FROM i)", "mounted item unknown": "c, (VALUES (1), (7)) v(d) WHERE 's' || (k + d) NOT IN (SELECT id FROM i)", "case recorded twice": "(SELECT id FROM c GROUP BY setup, id HAVING count(*) > 1)"}))
def case_rules(t):
    """Suppliers as cases of their region's setup, every ninth recorded twice."""
    items = t.supplier.where("s_acctbal > 0").select(_id("s", "s_suppkey").alias("id")).union(t.nation.where("n_nationkey < 20").select(_id("n", "n_nationkey")))
    setups = t.region.where("r_regionkey < 4").select(_id("r", "r_regionkey").alias("id"), _id("n", F.col("r_regionkey") * 7).alias("interface"))
    s = t.supplier.union(t.supplier.where("s_suppkey % 9 = 0"))
    k = F.col("s_suppkey")
    return _tally(v.cases(s.select(_id("r", F.col("s_nationkey") % 5).alias("setup"), _id("s", k).alias("id"), _id("n", "s_nationkey").alias("supply"), F.array(_id("s", k + 1), _id("s", k + 7)).alias("mounted")), setups, items))


_CONTROLLERS = """m AS (SELECT c_mktsegment AS setup, 'n' || c_nationkey AS a, 'n' || ((c_nationkey + 1) % 26) AS b, (c_custkey % 16 + 1)::VARCHAR AS ch, c_custkey % 140 AS cc, ['red', 'Small', 'BLUE bolt (x)'][(c_custkey % 3)::INT + 1] AS par, 'b' || (c_custkey % 60) AS cited FROM customer),
h AS (SELECT c_mktsegment AS setup, 'n' || c_nationkey AS d, (min(c_custkey) % 17)::VARCHAR AS o, (max(c_custkey) % 17)::VARCHAR AS i FROM customer GROUP BY 1, 2),
l AS (SELECT 'b' || p_size AS doc, p_name || ' CC ' || (p_partkey % 128) AS text FROM part),
told AS (SELECT DISTINCT doc, par, cc FROM m JOIN l ON doc = cited WHERE contains(lower(text), lower(split_part(par, ' (', 1))) AND regexp_matches(text, '(^|[^0-9])' || cc || '([^0-9]|$)'))"""


@query(_sql(_CONTROLLERS, {
    "controller sends on another channel": "m LEFT JOIN h ON h.setup = m.setup AND d = a WHERE o IS DISTINCT FROM ch", "controller target unknown": "m WHERE b NOT IN (SELECT 'n' || n_nationkey FROM nation)", "controller number": "m WHERE cc > 127",
    "target does not listen": "m LEFT JOIN h ON h.setup = m.setup AND d = b WHERE i IS DISTINCT FROM ch", "cited section unknown": "m WHERE cited NOT IN (SELECT doc FROM l)",
    "no line names parameter and number": "m WHERE cited IN (SELECT doc FROM l) AND NOT EXISTS (SELECT 1 FROM told WHERE doc = cited AND told.par = m.par AND told.cc = m.cc)"}))
def controller_rules(t):
    """Customers as controls of their nation that cite the parts of a size as lines."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment").alias("setup")
    par = F.element_at(F.array(F.lit("red"), F.lit("Small"), F.lit("BLUE bolt (x)")), (k % 3 + 1).cast("int"))
    maps = t.customer.select(seg, _id("n", "c_nationkey").alias("controller"), _id("n", (F.col("c_nationkey") + 1) % 26).alias("target"), (k % 16 + 1).alias("channel"), (k % 140).cast("int").alias("cc"), par.alias("parameter"), _id("b", k % 60).alias("doc"))
    heard = t.customer.groupBy(seg, _id("n", "c_nationkey").alias("device")).agg((F.min("c_custkey") % 17).cast("string").alias("out"), (F.max("c_custkey") % 17).cast("string").alias("in"))
    lines = t.part.select(_id("b", "p_size").alias("doc"), F.col("p_partkey").alias("line"), F.concat("p_name", F.lit(" CC "), (F.col("p_partkey") % 128).cast("string")).alias("text"))
    return _tally(v.controllers(maps, heard, t.nation.select(_id("n", "n_nationkey").alias("id")), lines))


_RECORDS = """c AS (SELECT c_mktsegment AS setup, 'n' || c_nationkey AS device, c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'unconfirmed' ELSE 'odd' END AS status, CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'False' WHEN 2 THEN 'yes' END AS thru FROM customer),
n AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey < 4), st AS (SELECT min(c_mktsegment) AS id FROM customer UNION ALL SELECT max(c_mktsegment) FROM customer),
x AS (SELECT 'n' || s_nationkey AS device, bool_or(contains(s_name, '7')) AS found FROM supplier GROUP BY 1),
h AS (SELECT setup, device, (min(k) % 17)::VARCHAR AS o FROM c GROUP BY 1, 2)"""


@query(_sql(_RECORDS, {
    "channel device unknown": "c WHERE device NOT IN (SELECT id FROM n)", "in channel": "c WHERE k % 20 NOT BETWEEN 1 AND 16", "channel status": "c WHERE status = 'odd'", "channel recorded twice": "(SELECT setup FROM c GROUP BY setup, device HAVING count(*) > 1)",
    "channel setup unknown": "c WHERE setup NOT IN (SELECT id FROM st)", "thru is not true or false": "c WHERE thru = 'yes'", "channel unconfirmed": "c WHERE status = 'unconfirmed'",
    "texts never mention it": "x WHERE NOT found AND device IN (SELECT id FROM n) AND device IN (SELECT device FROM c)",
    "controller unknown": "c WHERE device NOT IN (SELECT id FROM n)", "controller setup unknown": "c WHERE setup NOT IN (SELECT id FROM st)", "controller status": "c WHERE status = 'odd'", "controller unconfirmed": "c WHERE status = 'unconfirmed'",
    "program changes on another channel": "c JOIN h USING (setup, device) WHERE k % 5 <> 0 AND o <> (k % 16 + 1)::VARCHAR",
    "controller''s target unknown": "c WHERE 'n' || (k % 27) NOT IN (SELECT id FROM n)"}, ("channel unconfirmed", "texts never mention it", "controller unconfirmed")))
def channel_record_rules(t):
    """Customers as channel and controller records of their nation; its suppliers' names are its texts."""
    k = F.col("c_custkey")
    status = F.when(k % 3 == 0, "confirmed").when(k % 3 == 1, "unconfirmed").otherwise("odd")
    thru = F.when(k % 4 == 0, "true").when(k % 4 == 1, "False").when(k % 4 == 2, "yes")
    base = t.customer.select(F.col("c_mktsegment").alias("setup"), _id("n", "c_nationkey").alias("device"), (k % 20).cast("string").alias("in"), F.lit("off").alias("out"), status.alias("status"), F.lit("d").alias("confirmed"), thru.alias("thru"), k.alias("k"))
    items = t.nation.where("n_regionkey < 4").select(_id("n", "n_nationkey").alias("id"))
    setups = t.customer.agg(F.min("c_mktsegment").alias("id")).union(t.customer.agg(F.max("c_mktsegment")))
    heard = base.groupBy("setup", "device").agg((F.min("k") % 17).cast("string").alias("out"))
    texts = t.supplier.select(_id("n", "s_nationkey").alias("device"), F.col("s_name").alias("text"))
    maps = base.select(_id("c", "k").alias("id"), "setup", "device", "status", F.when(F.col("k") % 5 != 0, F.col("k") % 16 + 1).alias("program"))
    own = v.channel_records(base, items, base.select("setup", "device").distinct(), setups, texts, "7")
    return _tally(own.union(v.controller_records(maps, base.select(_id("c", "k").alias("id"), _id("n", F.col("k") % 27).alias("device")), heard, items, setups)))


_PICTURES = """p AS (SELECT 's' || (p_partkey % 120) AS device, p_name || '-' || p_size AS file, ['photo', 'drawing', 'panel', 'film'][(p_size % 4)::INT + 1] AS type, CASE WHEN p_partkey % 6 <> 0 THEN 'own' END AS source FROM part),
i AS (SELECT 's' || s_suppkey AS id, s_acctbal > 0 AS in_use FROM supplier), f AS (SELECT DISTINCT p_name || '-' || (p_size + 1) AS path FROM part)"""


@query(_sql(_PICTURES, {
    "picture device unknown": "p WHERE device NOT IN (SELECT id FROM i)", "picture file missing": "p WHERE file NOT IN (SELECT path FROM f)", "picture type": "p WHERE type = 'film'", "picture without source": "p WHERE source IS NULL",
    "file of no picture": "f WHERE path NOT IN (SELECT file FROM p)", "item without picture": "i WHERE in_use AND id NOT IN (SELECT device FROM p)"}, ("item without picture",)))
def picture_rules(t):
    """Parts as pictures of suppliers."""
    named = lambda size: F.concat_ws("-", "p_name", size.cast("string"))
    kinds = F.array(*map(F.lit, ["photo", "drawing", "panel", "film"]))
    rows = t.part.select(_id("p", "p_partkey").alias("id"), _id("s", F.col("p_partkey") % 120).alias("device"), named(F.col("p_size")).alias("file"), F.element_at(kinds, (F.col("p_size") % 4 + 1).cast("int")).alias("type"), F.when(F.col("p_partkey") % 6 != 0, "own").alias("source"))
    return _tally(v.pictures(rows, t.supplier.select(_id("s", "s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("in_use")), t.part.select(named(F.col("p_size") + 1).alias("path")).distinct()))


_CODE = """a AS (SELECT 'a' || c_custkey AS action, ['1-URGENT', 'high', '(LOW)'][(c_custkey % 3)::INT + 1] AS label, ['1 urgent', 'high', 'low'][(c_custkey % 3)::INT + 1] AS plain FROM customer),
c AS (SELECT 'a' || (o_custkey + 30) AS action, regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g') AS body FROM orders),
w AS (SELECT 'f' || s_nationkey AS file, 'd' || (s_suppkey % 40) AS dataset, 'd' || (s_suppkey % 41) AS said, s_nationkey FROM supplier)"""


@query(_sql(_CODE, {
    "route that nothing serves": "(SELECT DISTINCT o_orderkey % 500 AS r FROM orders) WHERE r NOT IN (SELECT s_suppkey FROM supplier)", "action without documentation": "a WHERE action NOT IN (SELECT action FROM c)",
    "documented action does not exist": "c WHERE action NOT IN (SELECT action FROM a)", "label not in the section": "c JOIN a USING (action) WHERE NOT contains(body, plain)",
    "path that is no file": "(SELECT DISTINCT s_nationkey + 3 AS n FROM supplier) WHERE n NOT IN (SELECT n_nationkey FROM nation)",
    "declared write not performed": "w WHERE (file, said) NOT IN (SELECT (file, dataset) FROM w)"}, ("action without documentation",)))
def code_rules(t):
    """Customers as actions that orders document, order numbers as routes that suppliers serve, nations as files."""
    k = F.col("c_custkey")
    actions = t.customer.select(_id("a", k).alias("action"), F.element_at(F.array(F.lit("1-URGENT"), F.lit("high"), F.lit("(LOW)")), (k % 3 + 1).cast("int")).alias("label"))
    vertices = actions.select(F.col("action").alias("id"), F.lit("ui_action").alias("type")).union(t.nation.select(_id("f", "n_nationkey"), F.lit("code_file")))
    edges = t.orders.select(_id("c", "o_custkey").alias("src"), _id("route:", F.col("o_orderkey") % 500).alias("dst"), F.lit("REQUESTS").alias("rel"))
    edges = edges.union(t.supplier.select(_id("route:", "s_suppkey"), _id("f", "s_nationkey"), F.lit("SERVED_BY"))).union(t.supplier.select(_id("f", "s_nationkey"), _id("d", F.col("s_suppkey") % 40), F.lit("WRITES")))
    covers = t.orders.select(_id("o", "o_orderkey").alias("section"), _id("a", F.col("o_custkey") + 30).alias("action"), F.col("o_orderpriority").alias("body"))
    paths = t.supplier.select(_id("f", F.col("s_nationkey") + 3).alias("path")).distinct()
    return _tally(v.code(vertices, edges, covers, actions, paths, t.supplier.select(_id("f", "s_nationkey").alias("file"), _id("d", F.col("s_suppkey") % 41).alias("dataset"))))
