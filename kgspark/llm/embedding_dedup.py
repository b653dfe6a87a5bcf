"""Embedding near-dedup: a robust-pruned flat graph over overlapping cluster shards, searched by range expansion.

Vectors link when their labels are equal and their cosine, in double precision, is at least 0.98.

1. Equal vectors of one label become one node with a weight; copies are never compared with each other.
2. Shards: a cell starts as a label and a vector length. A cell of over CELL nodes is split among centroids that are
   fitted on about SAMPLE of its own nodes, again and again, so shards stay small whatever the table's size. A node goes
   to its nearest centroid and to further ones that are not beyond twice the range's angle from it: no link leads farther.
   The overlap is one for the whole descent: at every level a node keeps the `overlap` cells that it lies deepest in (by the
   sum of its margins to the nearest centroids on the way), its nearest one first, so it never has more copies than that. A
   cell that does not shrink, a crowd within the range, is dealt into chunks of CHUNK.
3. Each chunk's graph: every node's nearest LIST nodes, robustly pruned to DEGREE, with reverse edges. A node's
   adjacency lists of all its shards are united.
4. Every node is a query: greedy search from the chunk's medoids with a beam, which goes on expanding any node in range.
   The chunks of a crowd meet in tiles, each pair of chunks once: the later one's nodes are queries to the earlier one's
   graph. Found pairs are verified in double precision; a pair that meets in several shards is counted in the first one.
   Only counts and spanning edges leave a tile, never its pairs.
5. Recall is audited in one job: every row with vec_id divisible by 100 against all rows of its label by brute force, in
   tiles of QUERIES by ROWS. Below AUDIT, the search is repeated with a wider overlap and beam, at last by exact products of
   all tiles of each label.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without label, link
with nothing; vectors of different length don't link; a null vec_id links with nothing and has neither component nor kept;
rows are judged each for itself, so repeated rows link with each other; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, read_table

RANGE = 0.98
SAMPLE, FAN, SHARD, CELL, CHUNK = 4096, 64, 250, 1000, 2000
LIST, SPREAD, LONG, ENTRIES, DEGREE, ALPHA, BEAM, OVERLAP, WIDEST, AUDIT, QUERIES, ROWS = 48, 16, 8, 24, 24, 1.2, 32, 2, 8, 0.99, 2000, 20_000


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors in double precision, one row for each list."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))
    peak = np.abs(x).max(axis=1, keepdims=True) if x.size else np.ones((len(x), 1))
    x = x / np.where(peak > 0, peak, 1)  # tiny and huge vectors keep their precision
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spread rows of x."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            part = x[near == j]
            if len(part):
                v = part.sum(axis=0)
                n = np.linalg.norm(v)
                c[j] = v / n if n > 0 else c[j]
    return c


def robust_prune(sims: np.ndarray, order: np.ndarray, between: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Of candidates in order of similarity, those no kept one is alpha times closer to than the node is."""
    kept: list[int] = []
    alive = np.ones(len(order), bool)
    for i in range(len(order)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= alpha * (1 - between[i]) > (1 - sims)
    return kept


def medoids(x: np.ndarray, most: int = ENTRIES) -> np.ndarray:
    """The node nearest to the mean, then farthest-first ones: entry points that reach separate groups."""
    if not len(x):
        return np.zeros(0, np.int64)
    out = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[out[0]]
    while len(out) < min(most, len(x)):
        far = int(np.argmin(near))
        if near[far] > 0.9:
            break
        out.append(far)
        near = np.maximum(near, x @ x[far])
    return np.array(out)


def build(x: np.ndarray, degree: int = DEGREE, wide: int = LIST) -> list[np.ndarray]:
    """Adjacency (row numbers) of a flat graph over unit vectors x.

    A node's candidates are its nearest nodes and, for LONG edges that connect tight groups with the rest, some spread
    over the chunk; pruning picks among either.
    """
    n = len(x)
    wide = min(wide, n - 1)
    if wide < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    out: list[list[int]] = []
    far = np.arange(SPREAD) * max(1, n // SPREAD)
    for lo in range(0, n, 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        near = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
        for i in range(len(s)):
            links: list[int] = []
            for at, most in ((near[i], degree - LONG), ((far + 7919 * (lo + i)) % n, LONG)):
                at = np.setdiff1d(at, [lo + i, *links])
                at = at[np.argsort(-s[i, at], kind="stable")]
                links += at[robust_prune(s[i, at], at, x[at] @ x[at].T, most, ALPHA)].tolist()
            out.append(links)
    both: list[list[int]] = [list(o) for o in out]
    for i, o in enumerate(out):
        for j in o:
            if len(both[j]) < 2 * degree:
                both[j].append(i)
    return [np.unique(np.array(b, np.int64)) for b in both]


def search(x: np.ndarray, adjacency: list[np.ndarray], queries: np.ndarray, beam: int, reach: float = RANGE) -> np.ndarray:
    """Boolean (query, node): what greedy search from the medoids finds in range, expanding every node in range."""
    n = len(x)
    found = np.zeros((len(queries), n), bool)
    if not n:
        return found
    width = max(1, max(len(a) for a in adjacency))
    table = np.full((n, width), -1, np.int64)
    for i, a in enumerate(adjacency):
        table[i, : len(a)] = a
    entries, near = medoids(x), reach - 0.02
    for lo in range(0, len(queries), 512):
        q = queries[lo : lo + 512]
        score = np.full((len(q), n), -2.0)
        todo = np.zeros((len(q), n), bool)
        score[:, entries], todo[:, entries] = q @ x[entries].T, True
        active = np.arange(len(q))

        def visit(rr, cc, q=q, score=score, todo=todo):
            score[rr, cc] = np.einsum("ij,ij->i", q[rr], x[cc])
            todo[rr, cc] = True

        while len(active):
            open_ = np.where(todo[active], score[active], -3.0)
            best = np.argmax(open_, axis=1)
            top = open_[np.arange(len(active)), best]
            k = min(beam, n)
            bar = np.partition(score[active], n - k, axis=1)[:, n - k]
            go = (top > -2.5) & ((top >= bar) | (top >= near))
            active, best = active[go], best[go]
            if not len(active):
                break
            todo[active, best] = False
            nb = table[best]
            r = np.repeat(active, width).reshape(nb.shape)
            new = (nb >= 0) & (score[r, np.maximum(nb, 0)] <= -2.0)
            visit(r[new], nb[new])
            while True:  # the range: all its open nodes at a time
                wide = active[(todo[active] & (score[active] >= near)).any(axis=1)]
                if not len(wide):
                    break
                front = todo[wide] & (score[wide] >= near)
                todo[wide] &= ~front
                cols = np.flatnonzero(front.any(axis=0))
                edges = np.zeros((len(cols), n), np.float32)
                nbs = table[cols]
                rows_ = np.repeat(np.arange(len(cols)), width).reshape(nbs.shape)
                edges[rows_[nbs >= 0], nbs[nbs >= 0]] = 1
                meets = (front[:, cols].astype(np.float32) @ edges > 0) & (score[wide] <= -2.0)
                i, j = np.nonzero(meets)
                visit(wide[i], j)
        found[lo : lo + 512] = score >= reach
    return found


def _least(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of each of n rows' components; the pairs i, j hold both directions."""
    label = np.arange(n)
    if not len(i):
        return label
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    while True:
        low = label.copy()
        low[i[first]] = np.minimum(label[i[first]], np.minimum.reduceat(label[j], first))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def nodes_of(rows: DataFrame) -> DataFrame:
    """(label, embedding, vec, weight, asked): distinct usable vectors of each label; asked: the audit's queries."""
    good = "label is not null and vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) <= 3.4028235e38) and exists(embedding, x -> x <> 0)"
    return rows.where(good).groupBy("label", "embedding").agg(F.min("vec_id").alias("vec"), F.count("*").alias("weight"), F.max(F.col("vec_id") % 100 == 0).alias("asked"))


PLACED = "shard string, node bigint, embedding array<float>"
ROUTED = PLACED + ", margin double, depth int"


def _centroids(t: pa.Table) -> pa.Table:
    """(shard, c, embedding): centroids of one cell, fitted on its sampled rows (shard, n, embedding)."""
    x, n = _matrix(t.column("embedding")), t.column("n")[0].as_py()
    c = kmeans(x, min(FAN, -(-n // SHARD), len(x)))
    return pa.table({"shard": pa.array([t.column("shard")[0].as_py()] * len(c)), "c": pa.array(np.arange(len(c), dtype=np.int32)), "embedding": pa.array(list(c), pa.list_(pa.float32()))})


def _assign(t: pa.Table, overlap: int, depth: int) -> pa.Table:
    """ROUTED rows of one block of a cell: its nodes, each once for every centroid that it may go to."""
    nodes, cents = t.filter(pc.is_null(t.column("c"))), t.filter(pc.is_valid(t.column("c")))
    if not nodes.num_rows:
        return pa.table({"shard": pa.array([], pa.string()), "node": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())), "margin": pa.array([], pa.float64()), "depth": pa.array([], pa.int32())})
    sims = _matrix(nodes.column("embedding")) @ _matrix(cents.column("embedding")).T
    near = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
    angle = np.arccos(np.clip(np.take_along_axis(sims, near, axis=1), -1, 1))
    more = angle - angle[:, :1]
    i, j = np.nonzero(more <= 2 * np.arccos(RANGE) + 1e-6)
    number, name = cents.column("c").to_numpy(), t.column("shard")[0].as_py()
    return pa.table(
        {
            "shard": pa.array([f"{name}.{number[near[a, b]]}" for a, b in zip(i, j, strict=True)], pa.string()),
            "node": nodes.column("node").take(pa.array(i)),
            "embedding": nodes.column("embedding").take(pa.array(i)).cast(pa.list_(pa.float32())),
            "margin": pa.array(nodes.column("margin").to_numpy()[i] + more[i, j]),
            "depth": pa.array(np.full(len(i), depth, np.int32)),
        }
    )


def _assigned(overlap: int, depth: int) -> Callable[[pa.Table], pa.Table]:
    return lambda t: _assign(t, overlap, depth)


def shards(nodes: DataFrame, overlap: int, scratch: Scratch) -> DataFrame:
    """PLACED rows: every node in at most `overlap` shards, split until a cell has CELL nodes or no longer shrinks."""
    cells = nodes.select(F.concat_ws("/", "label", F.size("embedding")).alias("shard"), "node", "embedding", F.lit(0.0).alias("margin"), F.lit(0).alias("depth"))
    level, parents = 0, None
    while True:
        sizes = cells.where(F.col("depth") == level).groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > CELL)  # shallower cells are final
        if parents is not None:
            sizes = sizes.join(parents, F.regexp_replace("shard", r"\.[0-9]+$", "") == F.col("parent")).where(F.col("n") <= 0.8 * F.col("was")).select("shard", "n")
        big = scratch.write(sizes, f"big{overlap}-{level}")
        if not big.limit(1).count():
            return cells.select("shard", "node", "embedding")
        going = cells.join(big, "shard")
        cents = going.where(F.pmod(F.xxhash64("node", F.lit(level)), "n") < SAMPLE).groupBy("shard").applyInArrow(_centroids, "shard string, c int, embedding array<float>")
        cents = scratch.write(cents, f"centroids{overlap}-{level}")
        blocks = F.ceil(F.col("n") / CHUNK).cast("int")  # a cell's nodes are dealt into blocks; each gets the cell's few centroids
        left = going.select("shard", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), "node", F.lit(None).cast("int").alias("c"), "embedding", "margin")
        right = cents.join(big, "shard").select("shard", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(None).cast("bigint").alias("node"), "c", "embedding", F.lit(None).cast("double").alias("margin"))
        parents = big.select(F.col("shard").alias("parent"), F.col("n").alias("was"))
        level += 1
        moved = left.unionByName(right).groupBy("shard", "block").applyInArrow(_assigned(overlap, level), ROUTED)
        rank = F.row_number().over(Window.partitionBy("node").orderBy("margin", "shard"))  # of at most overlap^2 rows
        cells = cells.join(big, "shard", "left_anti").unionByName(moved).withColumn("rank", rank).where(F.col("rank") <= overlap).drop("rank")
        cells = scratch.write(cells, f"cells{overlap}-{level}")


def _chunked(placed: DataFrame) -> DataFrame:
    """placed with its chunk and the number of chunks of its shard."""
    many = placed.groupBy("shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    return placed.join(many, "shard").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit("chunk")), "chunks").cast("int"))


def _graph(placed: DataFrame) -> DataFrame:
    """(node, near): the united adjacency lists."""

    def go(t: pa.Table) -> pa.Table:
        x, ids = _matrix(t.column("embedding")), t.column("node").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        return pa.table({"node": pa.array(ids), "near": pa.array([ids[a] for a in build(x)], pa.list_(pa.int64()))})

    lists = placed.groupBy("shard", "chunk").applyInArrow(go, "node bigint, near array<bigint>")
    return lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a list for each of its shards


def found_in_tile(t: pa.Table, beam: int | None) -> pa.Table:
    """(node, links, to) of one tile: the nodes of chunk i (searched) and of chunk j (queries); all pairs if beam is None.

    links is the weight of the nodes in range that this shard counts, `to` a spanning edge of the tile's links.
    """
    x, ids = _matrix(t.column("embedding")), t.column("node").to_numpy()
    order = np.argsort(ids, kind="stable")
    x, ids, chunk = x[order], ids[order], t.column("chunk").to_numpy()[order]
    weight, shard, i = t.column("weight").to_numpy()[order], t.column("shard")[0].as_py(), t.column("i")[0].as_py()
    names = t.column("shards").take(pa.array(order)).to_pylist()
    mine = np.flatnonzero(chunk == i)
    asks = np.flatnonzero(chunk == t.column("j")[0].as_py())
    if beam is None:
        hits = x[asks] @ x[mine].T >= RANGE
    else:
        near = t.column("near").take(pa.array(order)).to_pylist()
        at = {int(v): k for k, v in enumerate(ids[mine])}
        adjacency = [np.array(sorted({at[v] for v in near[k] or () if v in at}), np.int64) for k in mine]
        hits = search(x[mine], adjacency, x[asks], beam)
    one = i == t.column("j")[0].as_py()
    if one:
        np.fill_diagonal(hits, False)
        hits |= hits.T
    q, v = np.nonzero(hits)
    q, v = asks[q], mine[v]
    # the shard that counts a pair is the first that both are in
    numbers = {s: k for k, s in enumerate(sorted({s for some in names for s in some}))}
    member = np.zeros((len(ids), len(numbers)), bool)
    for k, some in enumerate(names):
        member[k, [numbers[s] for s in some]] = True
    counted = np.argmax(member[q] & member[v], axis=1) == numbers[shard] if len(q) else np.zeros(0, bool)
    links = np.bincount(q[counted], weights=weight[v[counted]].astype(np.float64), minlength=len(ids))
    if not one:
        links += np.bincount(v[counted], weights=weight[q[counted]].astype(np.float64), minlength=len(ids))
    to = ids[_least(len(ids), np.concatenate([q, v]), np.concatenate([v, q]))]
    return pa.table({"node": pa.array(ids), "links": pa.array(links.astype(np.int64)), "to": pa.array(to)})


def _found(placed: DataFrame, nodes: DataFrame, graph: DataFrame | None, beam: int | None) -> DataFrame:
    """(node, links, to) of all tiles of placed(shard, node, embedding, chunk, chunks)."""
    lists = placed.groupBy("node").agg(F.sort_array(F.collect_list("shard")).alias("shards"))  # a node's few shards
    rows = placed.join(nodes.select("node", "weight"), "node").join(lists, "node")
    rows = rows.join(graph, "node") if graph is not None else rows.withColumn("near", F.lit(None).cast("array<bigint>"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    return rows.drop("other", "chunks").groupBy("shard", "i", "j").applyInArrow(lambda t: found_in_tile(t, beam), "node bigint, links bigint, to bigint")


def _true_links(t: pa.Table) -> pa.Table:
    """(node, true): the weight of one tile's rows in range of each of its queries."""
    query = t.column("query").to_numpy()
    ids, weight, x = t.column("node").to_numpy(), t.column("weight").to_numpy(), _matrix(t.column("embedding"))
    asks, rows = np.flatnonzero(query), np.flatnonzero(~query)
    total = np.zeros(len(asks), np.int64)
    for lo in range(0, len(rows), QUERIES):
        some = rows[lo : lo + QUERIES]
        total += ((x[asks] @ x[some].T >= RANGE) & (ids[asks][:, None] != ids[some][None, :])) @ weight[some]
    return pa.table({"node": pa.array(ids[asks]), "true": pa.array(total)})


def _audit(nodes: DataFrame, links: DataFrame) -> float:
    """Share of the brute-force links of the nodes of rows with vec_id divisible by 100 that were counted."""
    rows = nodes.select(F.concat_ws("/", "label", F.size("embedding")).alias("shard"), "node", "weight", "embedding", "asked")
    sizes = rows.groupBy("shard").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("m"), F.ceil(F.count_if("asked") / QUERIES).cast("int").alias("k")).where("k > 0")
    rows = rows.join(sizes, "shard")
    row_block, query_block = F.pmod(F.xxhash64("node"), "m").cast("int"), F.pmod(F.xxhash64("node"), "k").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tiles = rows.select("shard", "node", "weight", "embedding", F.lit(False).alias("query"), row_block.alias("i"), every("k").alias("j"))
    tiles = tiles.unionByName(rows.where("asked").select("shard", "node", "weight", "embedding", F.lit(True).alias("query"), every("m").alias("i"), query_block.alias("j")))
    exact = tiles.groupBy("shard", "i", "j").applyInArrow(_true_links, "node bigint, true bigint").groupBy("node").agg(F.sum("true").alias("true"))
    truth, got = exact.join(links, "node", "left").agg(F.sum("true"), F.sum(F.least("true", F.coalesce("links", F.lit(0))))).first()
    return got / truth if truth else 1.0


def near_duplicates(spark: SparkSession, rows: DataFrame, overlap: int = OVERLAP, beam: int = BEAM) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) of every row of rows(vec_id, embedding, label), and the audited recall."""
    scratch = Scratch(spark, "vectors")
    rows = rows.select("vec_id", "embedding", "label")
    nodes = scratch.write(nodes_of(rows).withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbered as written
    search_beam: int | None = beam
    while True:
        exact = search_beam is None
        placed = nodes.select(F.concat_ws("/", "label", F.size("embedding")).alias("shard"), "node", "embedding") if exact else shards(nodes, overlap, scratch)
        placed = scratch.write(_chunked(placed), f"placed{overlap}-{exact}")
        graph = None if exact else scratch.write(_graph(placed), f"graph{overlap}")
        found = scratch.write(_found(placed, nodes, graph, search_beam), f"found{overlap}-{exact}")
        links = scratch.write(found.groupBy("node").agg(F.sum("links").alias("links")), f"links{overlap}-{exact}")
        recall = 1.0 if exact else _audit(nodes, links)
        if recall >= AUDIT:
            break
        if overlap < WIDEST:
            overlap, search_beam = 2 * overlap, 2 * search_beam
        else:
            search_beam = None  # the exact way for the rest: every tile of a label, whole
    parts = connected_components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")), scratch)
    named = nodes.select("node", "vec", "weight").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("vec").alias("component_id"))
    told = scratch.write(named.join(least, "component").join(links, "node", "left").select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "told")
    scratch.drop_others("nodes", "told")
    by_vector = nodes.select("label", "embedding", "node").join(told, "node").drop("node")
    out = rows.join(by_vector, ["label", "embedding"], "left").select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")), recall


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, read_table(spark, sf_dir, "embeddings"))[0]
