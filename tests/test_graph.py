import pytest
from pyspark.sql import functions as F

from kgspark.operators import graph as g
from kgspark.plans import registry


@pytest.fixture(scope="module")
def five(spark):
    v = spark.createDataFrame([("a", "public"), ("b", "public"), ("c", "private"), ("d", "public"), ("e", "public")], "id string, visibility string")
    rows = [("a", "b", "s1", "confirmed"), ("b", "c", "s1", "confirmed"), ("c", "a", "s1", "confirmed"), ("c", "d", "s2", "confirmed"), ("a", "e", "s1", "unconfirmed")]
    return g.PropertyGraph(v, spark.createDataFrame(rows, "src string, dst string, setup string, status string"))


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_reach_counts_confirmed_edges_only_and_keeps_to_its_scope(spark, five):
    root = spark.createDataFrame([("a",)], "id string")
    e = g.confirmed(five.edges)
    assert ids(g.reach(e, root), "id", "hops") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert ids(g.reach(g.scoped(e, "s1"), root), "id", "hops") == [("a", 0), ("b", 1), ("c", 2)]
    assert ids(g.reach(e, root, 1), "id", "hops") == [("a", 0), ("b", 1)]


def test_motifs(spark, five):
    assert ids(five.find("(x)-[e]->(y); (y)-[f]->(z)", where={"e": "status = 'confirmed'", "f": "status = 'confirmed'"}), "x_id", "y_id", "z_id") == [("a", "b", "c"), ("b", "c", "a"), ("b", "c", "d"), ("c", "a", "b")]
    assert ids(five.find("(p)-[a]->(c); (q)-[b]->(c)", having="p_id < q_id"), "p_id", "q_id", "c_id") == []
    with pytest.raises(ValueError):
        five.find("(a)-[e]->(b); (c)-[f]->(d)")
    with pytest.raises(ValueError):
        five.find("(a)--(b)")
    with pytest.raises(ValueError):
        five.find("(a)-[e]->(b); (b)-[e]->(c)")
    loops = g.PropertyGraph(five.vertices, spark.createDataFrame([("a", "a"), ("a", "b")], "src string, dst string"))
    assert ids(loops.find("(x)-[e]->(x)"), "x_id") == [("a",)] and loops.find("(x)-[e]->(y)").count() == 2


def test_visibility_follows_the_ends(five):
    assert ids(five.public().edges, "src", "dst") == [("a", "b"), ("a", "e")]


def test_components_keep_isolated_vertices(spark):
    v = spark.createDataFrame([(x,) for x in "abcx"], "id string")
    e = spark.createDataFrame([("b", "a"), ("a", "c"), ("b", "c")], "src string, dst string")
    assert ids(g.components(e, v), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")]
    assert ids(g.degrees(e), "id", "degree") == [("a", 1), ("c", 2)]


def test_closure_layers_cycles(spark, five):
    e = spark.createDataFrame([("x", "y"), ("y", "z"), ("x", "z")], "src string, dst string")
    assert ("z", "x", 1) in ids(g.closure(e), "ancestor", "descendant", "depth")
    assert ids(g.layers(e), "id", "depth") == [("x", 0), ("y", 1), ("z", 2)]
    assert ids(g.cycle_paths(five.edges), "root", "path") == [("a", ["a", "b", "c", "a"])]
    assert ids(g.ranks(e), "id", "depth", "height", "alap") == [("x", 0, 2, 0), ("y", 1, 1, 1), ("z", 2, 0, 2)]
    with pytest.raises(ValueError):
        g.layers(five.edges)
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "src int, dst int")
    assert g.layers(chain).agg(F.max("depth")).first()[0] == 40 and g.closure(chain).agg(F.max("depth")).first()[0] == 40


def test_cyclic_core_equals_brute_force(spark):
    """Peeled graphs and cycles of any length against a search from every vertex."""
    import random

    for seed in range(4):
        r = random.Random(seed)
        pairs = {(r.randint(0, 25), r.randint(0, 25)) for _ in range(30)} | ({(100 + k, 100 + (k + 1) % 12) for k in range(12)} if seed else set())
        to = {a: {y for x, y in pairs if x == a} for a, _ in pairs}

        def reached(a, to=to):
            seen, todo = set(), [a]
            while todo:
                for y in to.get(todo.pop(), ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            return seen

        on = {a for a in to if a in reached(a)}
        between = {x for x in {v for p in pairs for v in p} if (x in on or any(x in reached(a) for a in on)) and (x in on or reached(x) & on)}
        df = spark.createDataFrame(sorted(pairs), "src int, dst int")
        core = g.cyclic_core(df)
        got = {v for e in core.collect() for v in e}
        assert got == between
        for row in g.cycle_paths(df).collect():
            p = row["path"]
            assert p[0] == p[-1] == min(p) and all(y in to[x] for x, y in zip(p, p[1:], strict=False))
        assert (g.cycle_paths(df).count() > 0) == bool(on)


def test_the_small_environment_graph(spark):
    v = spark.createDataFrame([(x,) for x in "abcx"], "id string")
    e = spark.createDataFrame([("b", "a"), ("a", "c"), ("b", "c")], "src string, dst string")
    graph = g.PropertyGraph(v, e)
    assert ids(g.degrees(e), "id", "degree") == [("a", 1), ("c", 2)]
    assert ids(graph.find("(p)-[e]->(c); (q)-[f]->(c)", having="p_id < q_id"), "p_id", "q_id", "c_id") == [("a", "b", "c")]
    assert ids(g.components(e, v), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")]


def test_two_steps_around_and_walk_with_several_parents(spark):
    e = spark.createDataFrame([("k1", "f", "kind"), ("f", "p", "sets"), ("m", "p", "moves"), ("k2", "m", "kind"), ("m", "q", "moves")], "src string, dst string, rel string")
    out = g.neighbourhood(g.PropertyGraph(e.select(F.col("src").alias("id")), e), "f", "kind", "sets", "moves")
    assert ids(out, "ring", "id", "via") == [("kind", "k1", "f"), ("kind of mover", "k2", "m"), ("mover", "m", "p"), ("parameter", "p", "f")]
    b = spark.createDataFrame([("b", 0, "a"), ("c", 0, "a"), ("d", 0, "b"), ("d", 1, "c"), ("e", 0, "d")], "id string, ord int, parent string")
    walk = g.taxonomy_walk(spark.createDataFrame([(x,) for x in "abcde"], "id string"), b)
    assert ids(walk, "path", "also") == [(["a"], False), (["a", "b"], False), (["a", "b", "d"], False), (["a", "b", "d", "e"], False), (["a", "c"], False), (["a", "c", "d"], True)]


def test_leaves_of_a_walk_need_no_levels(spark, sf):
    """Links of leaves given apart make the same walk, numbers are named at the end; tree_walk reads its lines once, in one go."""
    b = [(2, 0, 1), (3, 0, 1), (4, 5, 2), (4, 1, 3), (9, 0, 8), (8, 0, 9)]
    hung = [(5, 2, 4), (5, 7, 1), (5, 7, 1), (6, 0, 3), (7, 0, 99), (7, 1, 2), (10, 0, 9)]
    f = lambda x: spark.createDataFrame(x, "id long, ord int, parent long")
    name = lambda c: F.concat(F.lit("v"), c.cast("string"))
    roots = spark.createDataFrame([(1,)], "id long")
    want = [(["v1"], False), (["v1", "v2"], False), (["v1", "v2", "v4"], True), (["v1", "v2", "v7"], True), (["v1", "v3"], False), (["v1", "v3", "v4"], False), (["v1", "v3", "v4", "v5"], False), (["v1", "v3", "v6"], False), (["v1", "v5"], True)]
    assert ids(g.taxonomy_walk(roots, f(b), f(hung), name), "path", "also") == want
    assert ids(g.taxonomy_walk(roots, f(b + hung), None, name), "path", "also") == want
    plan = registry.QUERIES["tree_walk"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_partkey" in line for line in plan.splitlines()) == 1


def test_integrity(spark, five):
    bad = five.edges.union(spark.createDataFrame([("a", "nowhere", "s1", "confirmed")], five.edges.schema)).withColumn("rel", F.lit("CONNECTS"))
    assert ids(g.dangling(bad, five.vertices), "side", "id") == [("dst", "nowhere")]


def test_boundary(spark):
    e = spark.createDataFrame([("a", "m1"), ("b", "m1"), ("m1", "m2"), ("a", "b")], "src string, dst string")
    m = spark.createDataFrame([("m1",), ("m2",)], "id string")
    outer, inner = g.rewrite_boundary(e, m, "box")
    assert ids(outer.fillna(""), "src", "dst", "port") == [("a", "b", ""), ("a", "box", "m1"), ("b", "box", "m1 2")]
    assert ids(inner.fillna(""), "src", "dst", "port") == [("box", "m1", "m1"), ("box", "m1", "m1 2"), ("m1", "m2", "")]


def test_bare_and_preorder(spark):
    df = spark.createDataFrame([("item:x:y",), ("plain",)], "id string")
    assert ids(df.select(g.bare("id").alias("b")), "b") == [("plain",), ("x:y",)]
    tree = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a")], "id string, parent string")
    assert ids(g.preorder(tree), "id", "depth") == [("a", 1), ("b", 2), ("r", 0)]
