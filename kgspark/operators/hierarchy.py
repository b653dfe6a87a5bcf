"""Hierarchies by interval labels: what is below a vertex has numbers between its own and its last descendant's, so "is below" needs
no table of all pairs. Second parents are a small table beside the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .ranking import running_total

#: Numbers are below 2^LEVELS
LEVELS = 40
#: Tables of at most so many rows are counted and sent to all tasks, so what they are joined with stays where it is
SMALL = 20_000


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def parents(broader: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, parent, also) of broader(id, ord, parent), each pair once: also is false for the first parent by ord, and true for others.

    With ids(id), vertices without a parent are there too, with a null parent. One shuffle by id; a vertex's parents are sorted in one task.
    """
    rows = broader.select("id", "ord", "parent")
    if ids is not None:
        rows = rows.unionByName(ids.select("id", F.lit(None).cast(broader.schema["ord"].dataType).alias("ord"), F.lit(None).cast(broader.schema["parent"].dataType).alias("parent")))
    once = rows.repartition("id").groupBy("id", "parent").agg(F.min("ord").alias("ord"))
    first = F.min(F.when(F.col("parent").isNotNull(), F.struct("ord", "parent"))).over(Window.partitionBy("id"))
    flagged = once.withColumn("_first", first).where("parent is not null or _first is null")
    return flagged.select("id", "parent", F.coalesce(F.col("parent") != F.col("_first.parent"), F.lit(False)).alias("also"))


def intervals(ids: DataFrame, broader: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, extra) of ids(id) and broader(id, ord, parent); vertices with a parent need not be among ids.

    labels(id, parent, depth, pre, last): a vertex hangs under its first parent by ord; pre counts a walk in pre-order, siblings by
    id, and last is the number of its last descendant. extra(id, parent) are the other parents. Three rounds a level (down,
    sizes up, numbers down), each over one level; siblings are summed over all tasks. What hangs on a cycle isn't reached.
    """
    links = cut(parents(broader, ids))
    tree = cut(links.where("not also").select("id", "parent"))
    extra = links.where("also").select("id", "parent")
    level = tree.where("parent is null")
    levels = []
    while level.limit(1).count():
        levels.append(level)
        level = cut(tree.join(level.select(F.col("id").alias("parent")), "parent").select("id", "parent"))
    sized: list[DataFrame] = []
    for level in reversed(levels):
        rows = level.withColumn("size", F.lit(1).cast("bigint"))
        if sized:
            below = sized[-1].groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("_s"))
            rows = level.join(below, "id", "left").withColumn("size", 1 + F.coalesce("_s", F.lit(0))).drop("_s")
        sized.append(cut(rows))
    labels = before = None
    for d, level in enumerate(reversed(sized)):
        rows = running_total(level, ["id"], "size", "_before") if before is None else running_total(level, ["id"], "size", "_before", ["parent"])
        pre = F.col("_before") if before is None else F.col("_pre") + 1 + F.col("_before")
        if before is not None:
            rows = rows.join(before.select(F.col("id").alias("parent"), F.col("pre").alias("_pre")), "parent")
        before = cut(rows.select("id", "parent", F.lit(d).alias("depth"), pre.cast("bigint").alias("pre"), (pre + F.col("size") - 1).cast("bigint").alias("last")))
        labels = before if labels is None else labels.union(before)
    if labels is None:
        labels = tree.select("id", "parent", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("pre"), F.lit(0).cast("bigint").alias("last")).limit(0)
    return labels, extra


def _blocks(lo: Column, hi: Column) -> Column:
    """The aligned blocks (k, j), [j * 2^k, (j + 1) * 2^k), that make up lo..hi: two a level at most."""
    block = lambda k, j: F.struct(k.cast("int").alias("k"), j.cast("bigint").alias("j"))
    none = F.array().cast("array<struct<k:int,j:bigint>>")

    def step(s: Column, k: Column) -> Column:
        a, b = s["a"], s["b"]
        odd, even = (a <= b) & (a % 2 == 1), (a <= b) & (b % 2 == 0)
        both = F.concat(s["out"], F.when(odd, F.array(block(k, a))).otherwise(none), F.when(even & ~(odd & (a == b)), F.array(block(k, b))).otherwise(none))
        up, down = F.floor((a + F.when(odd, 1).otherwise(0)) / 2), F.floor((b - F.when(even, 1).otherwise(0)) / 2)
        return F.struct(F.when(a <= b, up).otherwise(1).cast("bigint").alias("a"), F.when(a <= b, down).otherwise(0).cast("bigint").alias("b"), both.alias("out"))

    first = F.struct(lo.cast("bigint").alias("a"), hi.cast("bigint").alias("b"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), first, step, lambda s: s["out"])


def covered(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points(id, pre) joined with the ranges(top, lo, hi) that hold their number: (id, top).

    A range join by keys: ranges are cut to aligned blocks, and a point is looked up in its block of each size that occurs. No nested
    loop, and only pairs that hold are made.
    """
    blocks = cut(ranges.select("top", F.explode(_blocks(F.col("lo"), F.col("hi"))).alias("x")).select("top", "x.k", "x.j"))
    sizes = blocks.agg(F.collect_set("k").alias("ks"))  # one row of at most LEVELS numbers
    places = points.crossJoin(F.broadcast(sizes)).select("id", "pre", F.explode("ks").alias("k"))
    places = places.select("id", "k", F.expr("shiftright(pre, k)").alias("j"))
    return places.join(_sent(blocks), ["k", "j"]).select("id", "top")


def below(labels: DataFrame, extra: DataFrame, tops: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(id, top): which of tops(id) each vertex (or each of among(id)) stands below, itself included, each pair once.

    By the tree, and through second parents: what is below the child of an extra link is below all that its other parent is
    below, links in turn included. That is settled once for each of these parents, however many links lead to it.
    """
    ranges = tops.select("id").distinct().join(labels, "id").select(F.col("id").alias("top"), F.col("pre").alias("lo"), F.col("last").alias("hi"))
    points = labels.select("id", "pre") if among is None else labels.join(among.select("id").distinct(), "id", "left_semi").select("id", "pre")
    by_tree = covered(points, ranges)
    if not extra.limit(1).count():
        return by_tree
    children = cut(extra.select("id").distinct())
    under = children.join(labels, "id").where("last > pre").select(F.col("id").alias("top"), F.col("pre").alias("lo"), F.col("last").alias("hi"))
    others = cut(extra.select(F.col("parent").alias("id")).distinct().join(labels.select("id", "pre"), "id"))
    known = cut(covered(others, ranges).distinct())
    # an other parent at or below a child with other parents in turn is below all that these are below
    inside = covered(others, under).union(others.join(children, "id", "left_semi").select("id", F.col("id").alias("top")))
    onward = cut(extra.withColumnRenamed("id", "top").join(_sent(cut(inside)), "top").select("id", F.col("parent").alias("next")).where("id <> next").distinct())
    fresh = known
    while True:
        new = onward.join(fresh.withColumnRenamed("id", "next"), "next").select("id", "top").distinct()
        fresh = cut(new.join(known, ["id", "top"], "left_anti"))
        if not fresh.limit(1).count():
            break
        known = known.union(fresh)
    own = cut(extra.join(_sent(known.withColumnRenamed("id", "parent")), "parent").select("id", "top").distinct())
    through = covered(points, under).withColumnRenamed("top", "_child").join(own.withColumnRenamed("id", "_child"), "_child").select("id", "top")
    return by_tree.union(through).union(own.join(points.select("id"), "id", "left_semi")).distinct()
