"""Property graphs as two DataFrames: motifs compiled to joins, reach, closure, components, layers, integrity."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import parents
from .layout import layers
from .lineage import cut

EDGE_PATTERN = re.compile(r"\(\s*(\w*)\s*\)\s*-\[\s*(\w*)\s*\]->\s*\(\s*(\w*)\s*\)")


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame

    def find(self, motif: str, where: dict[str, Column | str] | None = None, having: Column | str | None = None) -> DataFrame:
        """Rows matching '(a)-[e]->(b); (b)-[f]->(c)'; columns are e_src, e_<property>, a_<property> and so on.

        where holds conditions on single elements, over their bare column names; they apply before any join.
        """
        where = where or {}
        steps = [EDGE_PATTERN.fullmatch(x.strip()) for x in motif.split(";") if x.strip()]
        if not steps or None in steps:
            raise ValueError(f"no motif: {motif!r}")

        def element(df: DataFrame, name: str) -> DataFrame:
            df = df.filter(where[name]) if name in where else df
            return df.select([F.col(c).alias(f"{name}_{c}") for c in df.columns])

        out, bound, used = None, {}, set()
        for k, m in enumerate(steps):
            a, e, b = m.group(1), m.group(2) or f"_e{k}", m.group(3)
            if e in used:
                raise ValueError(f"edge {e!r} stands twice in {motif!r}")
            used.add(e)
            edge = element(self.edges, e)
            if a and a == b:  # a loop: both ends are one vertex
                edge = edge.where(F.col(f"{e}_src") == F.col(f"{e}_dst"))
            on = [F.col(bound[v]) == F.col(f"{e}_{side}") for v, side in ((a, "src"), (b, "dst")) if v in bound]
            if out is None:
                out = edge
            elif on:
                cond = on[0] if len(on) == 1 else on[0] & on[1]
                out = out.join(edge, cond)
            else:
                raise ValueError("each step must share a vertex with one before it")
            for v, side in ((a, "src"), (b, "dst")):
                if v and v not in bound:
                    bound[v] = f"{e}_{side}"
        for v, key in bound.items():
            if v:
                vertex = element(self.vertices, v)
                out = out.join(vertex, F.col(key) == F.col(f"{v}_id"))
        return out.filter(having) if having is not None else out

    def public(self) -> "PropertyGraph":
        """The public part: private vertices, private edges and edges with a private end are left out."""
        e = derive_visibility(self.edges, self.vertices)
        return PropertyGraph(self.vertices.filter("visibility = 'public'"), e.filter("visibility = 'public'"))


def confirmed(edges: DataFrame) -> DataFrame:
    """Conclusions rest on confirmed edges only."""
    return edges.filter("status = 'confirmed'")


def scoped(edges: DataFrame, setup: str | None) -> DataFrame:
    return edges if setup is None else edges.filter(F.col("setup") == setup)


def bare(id_: Column | str) -> Column:
    """An id without its type prefix."""
    c = F.col(id_) if isinstance(id_, str) else id_
    return F.when(F.instr(c, ":") > 0, F.substring(c, F.instr(c, ":") + 1, F.length(c))).otherwise(c)


def derive_visibility(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """An edge is private if it is marked so or either end is; it is never set by hand otherwise."""
    private = vertices.filter("visibility = 'private'").select("id").distinct()
    tagged = edges.join(private.select(F.col("id").alias("src"), F.lit(True).alias("_s")), "src", "left").join(private.select(F.col("id").alias("dst"), F.lit(True).alias("_d")), "dst", "left")
    hidden = F.coalesce("_s", F.lit(False)) | F.coalesce("_d", F.lit(False))
    if "visibility" in edges.columns:
        hidden = hidden | F.coalesce(F.col("visibility") == "private", F.lit(False))
    return tagged.withColumn("visibility", F.when(hidden, "private").otherwise("public")).drop("_s", "_d")


def reach(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(id, hops) of every vertex reached from any of roots(id) along edges(src, dst); roots have 0 hops.

    A frontier loop: each round joins the last frontier with the edges and drops what was reached before. Only the size
    of the frontier comes to the driver.
    """
    steps = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seen = cut(roots.select("id").where("id is not null").distinct().withColumn("hops", F.lit(0)))
    frontier, hop = seen, 0
    while most is None or hop < most:
        hop += 1
        new = frontier.select(F.col("id").alias("src")).join(steps, "src").select(F.col("dst").alias("id")).distinct()
        frontier = cut(new.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)))
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)  # all parts are checkpoints already
    return seen


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): weakly connected components named by their smallest id; an isolated vertex is its own."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null")
    both = cut(e.union(e.select("b", "a")).where("a <> b").distinct())
    ids = both.select(F.col("a").alias("id")).distinct()
    if vertices is not None:
        ids = ids.union(vertices.select("id")).distinct()
    labels = cut(ids.withColumn("component", F.col("id")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id", "left").select("id", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("up"))
        nxt = low.join(jump, "low", "left").select("id", F.least("low", "up").alias("component"), (F.least("low", "up") < F.col("component")).alias("moved"))
        nxt = cut(nxt)
        labels = nxt.select("id", "component")
        if not nxt.where("moved").limit(1).count():
            return labels


def degrees(edges: DataFrame, side: str = "dst") -> DataFrame:
    """(id, degree); vertices of degree zero are absent."""
    return edges.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree"))


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) of child->parent edges(src, dst); shortest depth; each vertex is its own at 0. Runs to
    the fixpoint, cycles included: a pair counts once."""
    ids = edges.select(F.col("src").alias("x")).union(edges.select(F.col("dst").alias("x"))).distinct()
    step = edges.select(F.col("src").alias("child"), F.col("dst").alias("parent")).distinct()
    all_ = ids.select(F.col("x").alias("ancestor"), F.col("x").alias("descendant"), F.lit(0).alias("depth"))
    front, d = all_, 0
    while True:
        d += 1
        front = front.join(step, F.col("ancestor") == F.col("child")).select(F.col("parent").alias("ancestor"), "descendant").distinct()
        front = cut(front.join(all_, ["ancestor", "descendant"], "left_anti").withColumn("depth", F.lit(d)))
        if not front.limit(1).count():
            break
        all_ = cut(all_.unionByName(front))
    return all_


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges left when vertices without a way in or without a way out are peeled off, again and again: those on cycles and
    between them. Empty exactly if the graph has no cycle, whatever a cycle's length."""
    e = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    n = e.count()
    while n:
        inner = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e = cut(inner.select("src", "dst"))
        left = e.count()
        if left == n:
            break
        n = left
    return e


def cycle_paths(edges: DataFrame) -> DataFrame:
    """(root, path): cycles in full, from their smallest vertex back to it; one at least for each part of the cyclic core.

    In the core every vertex has a way on; taking the smallest, and dropping what none comes to, leaves cycles alone.
    """
    step = cut(cyclic_core(edges).groupBy("src").agg(F.min("dst").alias("dst")))
    n = step.count()
    while n:
        step = cut(step.join(step.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        left = step.count()
        if left == n:
            break
        n = left
    roots = components(step).select(F.col("component").alias("root")).distinct()
    walk = cut(roots.select("root", F.array("root").alias("path"), F.col("root").alias("at")))
    done = walk.where("false").select("root", "path")
    while walk.limit(1).count():
        walk = cut(walk.join(step, F.col("at") == F.col("src")).select("root", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))
        done = done.union(walk.where("root = at").select("root", "path"))
        walk = walk.where("root <> at")
    return done


def ranks(edges: DataFrame) -> DataFrame:
    """(id, depth, height, alap): the longest paths to and from each vertex, and the latest layer it can stand in."""
    down = layers(edges)
    up = layers(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("id", F.col("depth").alias("height"))
    top = down.agg(F.max("depth").alias("_top"))
    return down.join(up, "id").crossJoin(F.broadcast(top)).select("id", "depth", "height", (F.col("_top") - F.col("height")).alias("alap"))  # top is one row


def neighbourhood(graph: PropertyGraph, focus: str, kind: str, sets: str, moves: str) -> DataFrame:
    """(ring, id, via): two steps around a vertex. Its kinds, what it sets, what else moves these, and the kinds of those.

    kind, sets and moves are edge relations: narrower -kind-> broader, owner -sets-> parameter, mover -moves-> parameter.
    """
    e = lambda rel: graph.edges.where(F.col("rel") == rel).select("src", "dst").distinct()
    own = e(sets).where(F.col("src") == focus).select(F.col("dst").alias("param"))
    movers = e(moves).where(F.col("src") != focus).join(own, F.col("dst") == F.col("param")).select(F.col("src").alias("mover"), "param").distinct()
    kinds = e(kind).select(F.col("src").alias("k"), F.col("dst").alias("of"))
    rings = [
        kinds.where(F.col("of") == focus).select(F.lit("kind").alias("ring"), F.col("k").alias("id"), F.col("of").alias("via")),
        own.select(F.lit("parameter"), "param", F.lit(focus)),
        movers.select(F.lit("mover"), "mover", "param"),
        movers.select("mover").distinct().join(kinds, F.col("mover") == F.col("of")).select(F.lit("kind of mover"), "k", "of"),
    ]
    return rings[0].union(rings[1]).union(rings[2]).union(rings[3])


def dangling(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(rel, side, id) of each edge end that is no vertex."""
    ids = vertices.select("id").distinct()
    ends = [edges.select("rel", F.lit(s).alias("side"), F.col(s).alias("id")).join(ids, "id", "left_anti") for s in ("src", "dst")]
    return ends[0].select("rel", "side", "id").union(ends[1].select("rel", "side", "id"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids(id)."""
    i = ids.select("id").distinct()
    return edges.join(i.withColumnRenamed("id", "src"), "src", "left_semi").join(i.withColumnRenamed("id", "dst"), "dst", "left_semi")


def rewrite_boundary(edges: DataFrame, members: DataFrame, box: str) -> tuple[DataFrame, DataFrame]:
    """(outer, inner) edges of a graph whose members become one node `box`: an edge that crosses is cut in two at a
    proxy port, named by the member's id and numbered where a name is taken; others stay where they are."""
    m = members.select("id").distinct()
    flagged = edges.join(m.select(F.col("id").alias("src"), F.lit(True).alias("si")), "src", "left").join(m.select(F.col("id").alias("dst"), F.lit(True).alias("di")), "dst", "left").fillna(False, ["si", "di"])
    crossing = flagged.where("si <> di").withColumn("base", F.when(F.col("si"), F.col("src")).otherwise(F.col("dst")).cast("string"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("src", "dst"))
    crossing = crossing.withColumn("port", F.when(n == 1, F.col("base")).otherwise(F.concat_ws(" ", "base", n.cast("string"))))
    outer = flagged.where("not si and not di").select(F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(None).cast("string").alias("port"))
    outer = outer.union(crossing.select(F.when(F.col("si"), F.lit(box)).otherwise(F.col("src").cast("string")), F.when(F.col("di"), F.lit(box)).otherwise(F.col("dst").cast("string")), "port"))
    inner = flagged.where("si and di").select(F.col("src").cast("string"), F.col("dst").cast("string"), F.lit(None).cast("string").alias("port"))
    inner = inner.union(crossing.select(F.when(F.col("si"), F.col("src").cast("string")).otherwise(F.lit(box)), F.when(F.col("di"), F.col("dst").cast("string")).otherwise(F.lit(box)), "port"))
    return outer, inner


def preorder(tree: DataFrame, name: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(id, depth, path) of a tree given as (id, parent), roots having a null parent; sorted by path it is a pre-order walk. Paths
    hold what name makes of ids. What hangs on a cycle has no root and isn't reached."""
    level = tree.where("parent is null").select("id", F.lit(0).alias("depth"), F.array(name(F.col("id"))).alias("path"))
    out, d = level, 0
    while True:
        d += 1
        level = cut(level.select(F.col("id").alias("parent"), "path").join(tree, "parent").select("id", F.lit(d).alias("depth"), F.concat("path", F.array(name(F.col("id")))).alias("path")))
        if not level.limit(1).count():
            return out
        out = out.union(level)


def taxonomy_walk(ids: DataFrame, broader: DataFrame, leaves: DataFrame | None = None, name: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(id, depth, path, also) of a hierarchy in which vertices may have several parents, broader(id, ord, parent): under its
    first parent a vertex is walked on from, under the others it stands as a leaf with also = true. ids(id) are those without parents;
    others need not be among them.

    leaves(id, ord, parent) are links of vertices that are nobody's parent. They take no part in the levels and are put under their
    parents at the end: one shuffle by vertex, one by parent. Vertices may be numbers that name makes names of in the result.
    """
    links = cut(parents(broader, ids))
    walk = cut(preorder(links.where("not also").select("id", "parent"), name))
    hung = links.where("also")
    hung = hung if leaves is None else hung.union(parents(leaves))
    above = walk.select(F.col("id").alias("parent"), "depth", "path")
    hung = hung.join(above, "parent").select(name(F.col("id")).alias("id"), F.col("depth") + 1, F.concat("path", F.array(name(F.col("id")))), "also")
    return walk.select(name(F.col("id")).alias("id"), "depth", "path", F.lit(False).alias("also")).union(hung)
