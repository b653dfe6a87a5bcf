import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from kgspark.llm import embedding_dedup as ed

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows):
    usable = [(i, np.array(e, np.float32).astype(np.float64), y) for i, e, y in rows if i is not None and y is not None and e and all(v is not None and math.isfinite(v) for v in e) and any(e)]
    links, up = Counter(), {k: k for k in range(len(usable))}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(usable)):
        for b in range(a):
            (i, x, y), (j, z, w) = usable[a], usable[b]
            if y == w and len(x) == len(z) and x @ z / math.sqrt((x @ x) * (z @ z)) >= 0.98:
                links[a] += 1
                links[b] += 1
                up[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for k, (i, _, _) in enumerate(usable):
        least[top(k)] = min(i, least.get(top(k), i))
    out = [(i, links[k], least[top(k)], i == least[top(k)]) for k, (i, _, _) in enumerate(usable)]
    rest = [r for r in rows if not (r[0] is not None and r[2] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1]))]
    return Counter(out + [(i, 0, i, None if i is None else True) for i, _, _ in rest])


def test_against_brute_force(spark):
    r = random.Random(4)
    gauss = lambda: [r.gauss(0, 1) for _ in range(16)]
    rows = [(i, gauss(), i % 2) for i in range(60)]
    for c in range(8):
        base = gauss()
        rows += [(100 + 10 * c + k, [v + r.gauss(0, 0.05) for v in base], c % 2) for k in range(6)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], 1), (303, rows[0][1], None), (304, None, 0), (305, [], 0), (306, [0.0] * 16, 0), (307, [float("nan")] * 16, 0), (308, [None] + [1.0] * 15, 0), (309, [float("inf")] + [1.0] * 15, 0), (None, rows[0][1], 0), (310, [1.0, 2.0], 0), (311, [2.0, 4.0], 0), (312, [1e-30] * 16, 0), (313, [1e30] * 16, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out, recall = ed.near_duplicates(spark, df)
    assert Counter(map(tuple, out.collect())) == brute(rows) and recall >= 0.9


def test_shards_and_chunks(spark, monkeypatch):
    """Small limits, so that shards overlap, are dealt into chunks and are searched as graphs."""
    monkeypatch.setattr(ed, "SHARD", 40)
    monkeypatch.setattr(ed, "CELL", 90)
    monkeypatch.setattr(ed, "CHUNK", 60)
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 24))
    x = np.concatenate([r.normal(size=(300, 24)), np.repeat(base[:20], 4, axis=0) + r.normal(size=(80, 24)) * 0.02, base[59] + r.normal(size=(120, 24)) * 0.02])
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    out, recall = ed.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(4))
    want = {i: (n, c) for (i, n, c, _) in brute(rows)}
    got = {v["vec_id"]: (v["n_links"], v["component_id"]) for v in out.collect()}
    assert recall >= 0.99 and got == want


def test_chains_over_chunks(spark, monkeypatch):
    """Each label is a chain of vectors 8 degrees apart, over many chunks: no split separates a component."""
    monkeypatch.setattr(ed, "CELL", 10)
    monkeypatch.setattr(ed, "SHARD", 5)
    monkeypatch.setattr(ed, "CHUNK", 4)
    rows = [(100 * y + k, [math.cos(math.radians(8 * k)), math.sin(math.radians(8 * k))], y) for y in range(6) for k in range(40)]
    out, recall = ed.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(map(tuple, out.collect())) == brute(rows) and recall == 1.0


def test_a_failed_audit_ends_in_exact_products(spark, monkeypatch):
    monkeypatch.setattr(ed, "search", lambda x, adjacency, queries, beam: np.zeros((len(queries), len(x)), bool))
    monkeypatch.setattr(ed, "CHUNK", 7)
    monkeypatch.setattr(ed, "WIDEST", 2)
    rows = [(100 * k, [math.cos(math.radians(8 * k)), math.sin(math.radians(8 * k))], k // 20) for k in range(40)]
    out, recall = ed.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, out.collect())) == brute(rows) and recall == 1.0


def test_many_vector_lengths_and_long_vectors(spark):
    rows = [(k, [1.0] * (k + 1), 0) for k in range(1005)] + [(2000 + k, [0.5] * (k + 1), 0) for k in range(0, 1005, 50)]
    rows += [(5000, [float(k % 7) for k in range(50_000)], 1), (5001, [2.0 * (k % 7) for k in range(50_000)], 1)]
    out, recall = ed.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, out.collect())) == brute(rows) and recall == 1.0


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ["node", "weight", "shard", "chunk", "chunks", "vec", "asked", "near", "links", "n_links", "component_id", "kept", "to", "i", "j"]
    out, _ = ed.near_duplicates(spark, df.select("*", *[F.lit("own").alias(c) for c in clash]))
    assert Counter(map(tuple, out.collect())) == brute(rows)


def test_empty(spark):
    out, recall = ed.near_duplicates(spark, spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and recall == 1.0


def test_recall_on_the_tables(spark, sf):
    assert ed.near_duplicates(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))[1] >= 0.9


def test_components_do_not_depend_on_the_order_of_edges(spark):
    from kgspark.llm.common import Scratch, connected_components

    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    random.Random(1).shuffle(edges)
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()
    assert {r["node"]: r["component"] for r in got} == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_one_link_across_chunks_joins_two_groups(monkeypatch):
    """Two groups of one shard, each over both chunks, with a single link between members of different chunks."""
    n, chunk = 40, np.arange(40) % 2
    group = np.arange(n) // 2 % 2
    near = group[:, None] == group[None, :]
    near[37, 38] = near[38, 37] = True  # both hit their own group in the other chunk first
    edges, links = [], np.zeros(n, int)
    for i, j in ((0, 0), (0, 1), (1, 1)):
        mine, asks = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        monkeypatch.setattr(ed, "search", lambda x, adjacency, queries, beam: near[np.ix_(asks, mine)].copy())
        held = np.flatnonzero((chunk == i) | (chunk == j))
        m = len(held)
        t = pa.table({"node": held, "weight": np.ones(m, int), "chunk": chunk[held], "i": [i] * m, "j": [j] * m, "shard": ["s"] * m, "shards": [["s"]] * m, "near": pa.array([[]] * m, pa.list_(pa.int64())), "embedding": pa.array([[1.0]] * m, pa.list_(pa.float32()))})
        out = ed.found_in_tile(t, 1)
        edges += list(zip(out["node"].to_pylist(), out["to"].to_pylist(), strict=True))
        np.add.at(links, out["node"].to_numpy(), out["links"].to_numpy())
    up = list(range(n))
    for _ in range(n):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert set(up) == {0} and (links == near.sum(axis=1) - 1).all()


def test_no_more_copies_than_the_overlap(spark, monkeypatch):
    """Whatever the number of levels, a node is in its nearest cells only, and in at least one."""
    from kgspark.llm.common import Scratch

    monkeypatch.setattr(ed, "CELL", 40)
    monkeypatch.setattr(ed, "SHARD", 20)
    monkeypatch.setattr(ed, "FAN", 6)
    r = np.random.default_rng(2)
    rows = [(i, [float(v) for v in x], 0) for i, x in enumerate(r.normal(size=(1500, 8)))]
    nodes = spark.createDataFrame(rows, "node bigint, embedding array<float>, label int").repartition(3)
    for overlap in (1, 2, 4):
        scratch = Scratch(spark, f"copies{overlap}")
        placed = ed.shards(nodes, overlap, scratch).collect()
        copies = Counter(p["node"] for p in placed)
        assert set(copies) == set(range(1500)) and max(copies.values()) <= overlap
        assert len({(p["node"], p["shard"]) for p in placed}) == len(placed)
        assert max(p["shard"].count(".") for p in placed) >= 3


def test_audit_equals_brute_force(spark, monkeypatch):
    """Tiles of few queries and rows; the share of links that are missing is what recall lacks."""
    monkeypatch.setattr(ed, "QUERIES", 3)
    monkeypatch.setattr(ed, "ROWS", 11)
    r = np.random.default_rng(3)
    base = r.normal(size=(9, 12))
    rows = [(20 * i, [float(v) for v in base[i % 9] + r.normal(size=12) * 0.03], i % 2) for i in range(120)]
    nodes = ed.nodes_of(spark.createDataFrame(rows, SCHEMA)).selectExpr("*", "vec as node")
    true = {i: n for (i, n, _, _) in brute(rows)}
    asked = [i for i in true if i % 100 == 0]
    assert sum(true[i] for i in asked) > 100
    whole = spark.createDataFrame(list(true.items()), "node bigint, links bigint")
    assert ed._audit(nodes, whole) == 1.0
    assert ed._audit(nodes, whole.where(F.col("node") != asked[0])) == 1 - true[asked[0]] / sum(true[i] for i in asked)
