"""Places of a drawn graph as data: columns by longest path, links that go both ways last, and the order within a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .ranking import numbered
from .relational import natural_key


def _chains(edges: DataFrame) -> DataFrame:
    """(id, head, d) of vertices with one way in and one way out: the first vertex up the chain that isn't such a one, and how far.
    Pointers double each round; what still points into a chain once they are longer than all chains is on a cycle."""
    single = lambda side: edges.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n")).where("n = 1").select("id")
    inner = single("dst").join(single("src"), "id", "left_semi")
    links = cut(edges.select(F.col("dst").alias("id"), F.col("src").alias("head")).join(inner, "id", "left_semi").withColumn("d", F.lit(1)))
    most, span = links.count(), 1
    while links.join(links.select(F.col("id").alias("head")), "head", "left_semi").limit(1).count():
        if span > most:
            raise ValueError("the graph has a cycle")
        up = links.select(F.col("id").alias("head"), F.col("head").alias("_head"), F.col("d").alias("_d"))
        links = cut(links.join(up, "head", "left").select("id", F.coalesce("_head", "head").alias("head"), (F.col("d") + F.coalesce("_d", F.lit(0))).alias("d")))
        span *= 2
    return links


def layers(edges: DataFrame) -> DataFrame:
    """(id, depth) of an acyclic graph: the longest path that ends at each vertex, 0 at its sources. A cycle is an error.

    Chains are drawn together to one weighted edge first, in a number of rounds that is the logarithm of their length. The rest is
    peeled: a vertex gets its depth when its last way in has been seen, so each edge gives its value once; the edges that
    are still to come are written again whenever half of the vertices are done.
    """
    e = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    chains = _chains(e)
    head = chains.select(F.col("id").alias("src"), "head", "d")
    heavy = e.join(chains.select(F.col("id").alias("dst")), "dst", "left_anti").join(head, "src", "left")
    heavy = cut(heavy.select(F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("d", F.lit(0)) + 1).alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w")))
    pending = cut(heavy.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("ways")).withColumn("depth", F.lit(0)))
    ids = heavy.select(F.col("src").alias("id")).union(chains.select("head")).distinct()
    frontier = cut(ids.join(pending, "id", "left_anti").withColumn("depth", F.lit(0)))
    done, whole = frontier, pending.count()
    while True:
        hits = heavy.join(frontier.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.max(F.col("depth") + F.col("w")).alias("d"))
        seen = cut(pending.join(hits, "id", "left").select("id", (F.col("ways") - F.coalesce("n", F.lit(0))).alias("ways"), F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth")))
        frontier, pending = seen.where("ways = 0").select("id", "depth"), seen.where("ways > 0")
        left, new = pending.count(), frontier.limit(1).count()
        if not new:
            break
        done = done.union(frontier)
        if left < whole // 2:
            heavy, whole = cut(heavy.join(pending.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "w")), left
    if left:
        raise ValueError("the graph has a cycle")
    within = chains.join(done.withColumnRenamed("id", "head"), "head").select("id", (F.col("depth") + F.col("d")).cast("int").alias("depth"))
    return done.select("id", F.col("depth").cast("int").alias("depth")).union(within)


def relaxed(depth: DataFrame, links: DataFrame) -> DataFrame:
    """depth(id, depth) after links(ord, src, dst) have each pushed their end one column beyond their start, once, in their order: a
    link sees what the links before it did, not what those after it do. Vertices without a depth stand at 0.

    A link's value is one more than the largest of its start's depth and the values of earlier links that end there: a running
    maximum along a vertex's links, again until nothing changes. The rounds are the longest chain of links in order.
    """
    ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    start = cut(ends.join(depth, "id", "full").select("id", F.coalesce("depth", F.lit(0)).alias("depth")))
    value = links.join(start.withColumnRenamed("id", "src"), "src").select("ord", "src", "dst", (F.col("depth") + 1).alias("value"))
    value = cut(value)
    while True:
        arrive = value.select(F.col("dst").alias("at"), "ord", F.lit(None).cast(value.schema["dst"].dataType).alias("src"), F.lit(None).cast(value.schema["dst"].dataType).alias("dst"), "value", F.lit(None).cast("int").alias("own"))
        leave = value.select(F.col("src").alias("at"), "ord", "src", "dst", F.lit(None).cast("int").alias("value"), F.col("value").alias("own"))
        before = F.max("value").over(Window.partitionBy("at").orderBy("ord").rangeBetween(Window.unboundedPreceding, -1))
        nxt = arrive.unionByName(leave).withColumn("_b", before).where("own is not null")
        nxt = cut(nxt.select("ord", "src", "dst", F.greatest("own", F.coalesce(F.col("_b") + 1, F.lit(0))).alias("value"), (F.coalesce(F.col("_b") + 1, F.lit(0)) > F.col("own")).alias("moved")))
        value = nxt.select("ord", "src", "dst", "value")
        if not nxt.where("moved").limit(1).count():
            break
    pushed = value.groupBy(F.col("dst").alias("id")).agg(F.max("value").alias("_v"))
    return start.join(pushed, "id", "left").select("id", F.greatest("depth", F.coalesce("_v", F.lit(0))).alias("depth"))


def columns(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, col, row) of ids(id) with links(ord, src, dst, bidirectional): the column is the depth along links that go one way, then
    pushed by those that go both; rows are counted within a column by id."""
    one_way = links.where("not coalesce(bidirectional, false)")
    depth = layers(one_way)
    placed = ids.select("id").distinct().join(relaxed(depth, links.where("bidirectional")), "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("col"))
    return numbered(placed, ["id"], "row", ["col"])


def layer_order(layers_: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, depth, place): the order of each layer, one layer after the other.

    First by the least port that a vertex's cables land on (edges(src, dst, to_port); none comes last), in natural order; then by the mean
    place of what comes before it: predecessors of the layer before count with their place, others with 0. Last by id.
    """
    e = cut(edges.select("src", "dst", F.nullif("to_port", F.lit("")).alias("to_port")))
    port = e.groupBy(F.col("src").alias("id")).agg(F.min(F.coalesce("to_port", F.lit("~"))).alias("port"))
    every = cut(layers_.join(port, "id", "left").select("id", "depth", natural_key(F.coalesce("port", F.lit("~"))).alias("port")))
    ways = cut(e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("ways")))
    most = every.agg(F.max("depth")).first()[0]
    out = prev = None
    for k in range(-1 if most is None else most + 1):
        layer = every.where(F.col("depth") == k)
        if prev is None:
            layer = layer.withColumn("mean", F.lit(0.0))
        else:
            came = e.join(prev.select(F.col("id").alias("src"), "place"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("place").alias("sum"))
            layer = layer.join(came, "id", "left").join(ways, "id", "left").withColumn("mean", F.coalesce(F.col("sum") / F.col("ways"), F.lit(0.0))).drop("sum", "ways")
        prev = cut(numbered(layer, ["port", "mean", "id"], "place").select("id", "depth", "place"))
        out = prev if out is None else out.union(prev)
    return every.select("id", "depth", F.lit(0).cast("bigint").alias("place")).limit(0) if out is None else out
