"""N-gram Jaccard join: a blocked sparse product of document-by-shingle incidence with size-derived bounds.

Documents link when 100 |A n B| >= 80 |A u B| over their distinct 5-word shingles. The product A x A' is never formed
whole. What keeps it small, all of it exact:

* documents with equal shingle sets (128 bits of signature) are one row of the incidence (a class); copies are never
  compared with each other. Columns name a class by 64 of these bits; classes that share them are told apart by their sets;
* only prefix columns enter: in one global order of shingles, common ones last, two linked sets must share one of each
  set's first n - ceil(0.8 n) + 1 shingles. Which shingles count as common is found by lossy counting over all rows; it
  only orders, so an incomplete list changes the work, not the result;
* the order deals the columns to buckets as packed blocks; columns with one class drop out there;
* column groups are first connected through a few leaders, the pairs counted as long as the group; overlap counts over
  the prefix drop pairs below  ceil(4(m+n)/9) - ceil(0.8 max(m, n)) + 1  common columns before whole sets are compared;
* after components are formed, the product runs again over only those pairs of a column that lie in different
  components: pairs inside one can't change it. So no link between different components is lost.

Edge cases: null or empty text, or text without words, has an empty set and links with nothing; rows with a null
doc_id get n_shingles but neither link nor component (null); repeated rows and rows sharing a doc_id count as one node
of the component graph; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blockshuffle, kernels
from .common import Scratch, connected_components, read_table, shuffle_partitions

K, COMMON, MOST_COMMON = 5, 64, 1 << 17
BUCKET = 32 << 20  # bytes of text whose prefix records a bucket is meant to hold: about two thirds of that in records
RECORD = np.dtype([("key", "<u8"), ("sig", "<i8"), ("n", "<i4")])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(table: pa.Table):
    b, offs = kernels.texts(table.column("text"))
    h, at = kernels.shingles(b, offs, K)
    lo, hi = kernels.set_signatures(h, at)
    return h, at, _signed(lo), _signed(hi)


def _census(docs: DataFrame) -> DataFrame:
    """Rows of kind 'doc' with a set's size and signature, and of kind 'key' with shingles frequent in one block."""
    schema = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("n", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64())])

    def go(batches):
        kernels.enter("ngram")
        for t in kernels.blocks(batches, "text"):
            h, at, lo, hi = _sets(t)
            n = np.diff(at).astype(np.int32)
            yield pa.record_batch([pa.array(np.zeros(len(n), np.int8)), t.column("doc_id").combine_chunks() if t.num_rows else pa.array([], pa.int64()), pa.array(n), pa.array(lo), pa.array(hi)], schema=schema)
            _, first = np.unique(lo, return_index=True)
            mine = np.zeros(len(n), bool)
            mine[first] = True
            v = np.sort(h[np.repeat(mine, n)])
            if len(v):
                cut = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
                c = np.diff(cut)
                often = c >= max(2, len(first) // 1000)
                keys, c = _signed(v[cut[:-1]][often].copy()), c[often].astype(np.int32)
                yield pa.record_batch([pa.array(np.ones(len(c), np.int8)), pa.nulls(len(c), pa.int64()), pa.array(c), pa.array(keys), pa.array(keys)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(go, "kind tinyint, doc_id bigint, n int, lo bigint, hi bigint")


def _prefix_blocks(docs: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """Packed (key, class, size) records of each distinct set's prefix."""
    common = np.sort(common.view(np.uint64))
    where = np.zeros(1 << 20, bool)
    where[(common >> np.uint64(44)).astype(np.int64)] = True

    def go(batches):
        kernels.enter("ngram")
        for t in kernels.blocks(batches, "text"):
            h, at, lo, hi = _sets(t)
            n = np.diff(at)
            _, first = np.unique(np.stack([lo, hi], axis=1), axis=0, return_index=True)
            mine = np.zeros(len(n), bool)
            mine[first] = True
            mine &= n > 0
            late = where[(h >> np.uint64(44)).astype(np.int64)] if len(common) else np.zeros(len(h), bool)
            if late.any():
                maybe = np.flatnonzero(late)
                at_ = np.minimum(np.searchsorted(common, h[maybe]), len(common) - 1)
                late[maybe] = common[at_] == h[maybe]
            owner = np.repeat(np.arange(len(n)), n)
            so_far = np.concatenate([[0], np.cumsum(late)])
            before = so_far[:-1] - so_far[at[:-1]][owner]
            inside = np.arange(len(h)) - at[:-1][owner]
            lates = np.diff(so_far[at])
            rank = np.where(late, (n - lates)[owner] + before, inside - before)
            prefix = n - (4 * n + 4) // 5 + 1
            take = (rank < prefix[owner]) & mine[owner]
            out = np.zeros(int(take.sum()), RECORD)
            out["key"], out["sig"], out["n"] = h[take], lo[owner[take]], n[owner[take]]
            often = late[take]
            yield from blockshuffle.pack(out["key"][~often], out[~often], buckets)
            # a common column may hold a third of all rows: its records are dealt by block, not by column
            yield from blockshuffle.spread(out[often], buckets)
            del h, late, owner, so_far, before, inside, rank, take, out
            kernels.trim()

    return docs.select("doc_id", "text").mapInArrow(go, blockshuffle.SCHEMA)


def _columns(blocks: DataFrame, buckets: int) -> DataFrame:
    """(key, sig, n) of the columns that two classes or more share, and of all common ones."""
    schema = pa.schema([("key", pa.int64()), ("sig", pa.int64()), ("n", pa.int32())])

    def go(table: pa.Table) -> pa.Table:
        often = table.num_rows and table.column("bucket")[0].as_py() < 0
        r = blockshuffle.unpack(table, RECORD)
        r = r[np.lexsort((r["sig"], r["key"]))]
        if len(r) and not often:
            new = np.concatenate([[True], (r["key"][1:] != r["key"][:-1]) | (r["sig"][1:] != r["sig"][:-1])])
            r = r[new]
            cut = np.flatnonzero(np.concatenate([[True], r["key"][1:] != r["key"][:-1], [True]]))
            r = r[np.repeat(np.diff(cut) > 1, np.diff(cut))]
        return pa.table([pa.array(_signed(r["key"].copy())), pa.array(r["sig"].copy()), pa.array(r["n"].copy())], schema=schema)

    if buckets > 2 * shuffle_partitions(blocks.sparkSession):
        blocks = blocks.repartition(buckets, "bucket")
    return blocks.groupBy("bucket").applyInArrow(go, "key bigint, sig bigint, n int").distinct()


def _size_fits(a: str, b: str):
    return (F.lit(5) * F.least(a, b) >= F.lit(4) * F.greatest(a, b))


def _least_common(a: str, b: str):
    """Common prefix columns that two linked sets of these sizes have at least."""
    total, most = F.col(a) + F.col(b), F.greatest(a, b)
    return F.floor((4 * total + 8) / 9) - F.floor((4 * most + 4) / 5) + 1


def _leader_pairs(columns: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, na, nb): each class of a column with a few leaders of it; as many pairs as the columns have rows."""
    # each step is written, so that the shuffles behind it can go before the next one's
    dense = columns.groupBy("key").agg(F.count("*").alias("df"))
    central = scratch.write(columns.join(dense, "key").groupBy("sig").agg((F.sum(F.log2("df")) / F.max("n")).alias("weight")), "central")
    orders = [F.struct((-F.col("weight")).alias("o"), "sig", "n")] + [F.struct(F.xxhash64("sig", F.lit(i)).cast("double").alias("o"), "sig", "n") for i in (1, 2)]
    leaders = columns.join(central, "sig").groupBy("key").agg(F.array_distinct(F.array(*(F.min(o) for o in orders))).alias("leaders"))
    leaders = scratch.write(leaders, "leaders")
    pairs = columns.join(leaders, "key").select("sig", "n", F.explode("leaders").alias("l")).where("sig <> l.sig")
    first = F.col("sig") < F.col("l.sig")
    pairs = pairs.select(F.least("sig", "l.sig").alias("a"), F.greatest("sig", "l.sig").alias("b"), F.when(first, F.col("n")).otherwise(F.col("l.n")).alias("na"), F.when(first, F.col("l.n")).otherwise(F.col("n")).alias("nb"))
    pairs = scratch.write(pairs.where(_size_fits("na", "nb")).distinct(), "met")
    lists = scratch.write(columns.groupBy("sig").agg(F.collect_list("key").alias("keys")), "lists")  # a document's prefix at most
    some = scratch.write(pairs.join(lists.select(F.col("sig").alias("a"), F.col("keys").alias("ka")), "a").where(F.size("ka") >= _least_common("na", "nb")), "some")
    counted = some.join(lists.select(F.col("sig").alias("b"), F.col("keys").alias("kb")), "b")
    out = scratch.write(counted.where(F.size(F.array_intersect("ka", "kb")) >= _least_common("na", "nb")).select("a", "b", "na", "nb"), "pairs")
    scratch.drop("central", "leaders", "met", "lists", "some")
    return out


def _cross_pairs(columns: DataFrame, component: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, na, nb) of all pairs that share enough columns and lie in different components.

    In each column all but its largest component's classes meet the whole column, so a settled group costs its length.
    """
    c = scratch.write(columns.join(component, "sig", "left").withColumn("comp", F.coalesce("comp", "sig")), "placed")
    parts = c.groupBy("key", "comp").agg(F.count("*").alias("m"))
    main = parts.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("x"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("x.comp").alias("main"))
    c = scratch.write(c.join(main, "key"), "mixed")
    # two sets share at most as many columns as each has here, so a pair beyond its bound isn't made at all
    c = scratch.write(c.join(c.groupBy("sig").agg(F.count("*").alias("m")), "sig"), "counted")
    left = c.where("comp <> main").select("key", F.col("sig").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("m").alias("ma"))
    right = c.select("key", F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), "main", F.col("m").alias("mb"))
    met = left.join(right, "key").where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & _size_fits("na", "nb") & (F.least("ma", "mb") >= _least_common("na", "nb")))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
    return met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("common")).where(F.col("common") >= _least_common("na", "nb")).select("a", "b", "na", "nb")


def _linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Of pairs (of class signatures) those whose whole sets link, as (x, y) of the classes' smallest doc_id."""
    wanted = pairs.select(F.col("a").alias("lo")).union(pairs.select(F.col("b").alias("lo"))).distinct()
    ids = classes.join(wanted, "lo").select(F.col("rep").alias("doc_id"), "lo", "hi")
    schema = pa.schema([("lo", pa.int64()), ("hi", pa.int64()), ("rep", pa.int64()), ("h", pa.list_(pa.int64()))])

    def go(batches):
        kernels.enter("ngram")
        for t in kernels.blocks(batches, "text", 8 << 20):
            h, at, lo, hi = _sets(t)
            good = (lo == t.column("lo").to_numpy()) & (hi == t.column("hi").to_numpy())  # not another row of this doc_id
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(_signed(h)))
            whole = pa.record_batch([pa.array(lo), pa.array(hi), t.column("doc_id").combine_chunks(), lists], schema=schema)
            yield whole.filter(pa.array(good))

    sets = docs.select("doc_id", "text").join(ids, "doc_id").mapInArrow(go, "lo bigint, hi bigint, rep bigint, h array<bigint>")
    sets = scratch.write(sets.dropDuplicates(["lo", "hi"]), f"{tag}-sets")
    left = sets.select(F.col("lo").alias("a"), F.col("rep").alias("x"), F.col("h").alias("ha"))
    right = sets.select(F.col("lo").alias("b"), F.col("rep").alias("y"), F.col("h").alias("hb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("ha", "hb")))
    ok = both.where(F.col("common") * 100 >= (F.size("ha") + F.size("hb") - F.col("common")) * 80)
    out = scratch.write(ok.select("x", "y", "a", "b"), f"{tag}-links")
    scratch.drop(f"{tag}-sets")
    return out


def jaccard_components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text)."""
    scratch = Scratch(spark, "ngram")
    docs = docs.select("doc_id", "text")
    census = scratch.write(_census(docs), "census")
    rows = census.where("kind = 0").select("doc_id", "n", "lo", "hi")
    often = census.where("kind = 1").groupBy("lo").agg(F.sum("n").alias("c")).where(F.col("c") >= COMMON).orderBy(F.desc("c"), "lo").limit(MOST_COMMON)
    common = np.array([r[0] for r in often.select("lo").collect()], dtype=np.int64)  # 1 MB at most: MOST_COMMON
    classes = scratch.write(rows.where("n > 0 and doc_id is not null").groupBy("lo", "hi").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    known = docs.where("doc_id is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * shuffle_partitions(spark), -(-size // BUCKET))  # as many as the bytes need: a task's share doesn't grow
    columns = scratch.write(_columns(_prefix_blocks(known, common, buckets), buckets), "columns")
    pairs = _leader_pairs(columns, scratch)
    links = _linked(known, classes, pairs, scratch, "first")
    found = scratch.write(connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch, "cc1"), "components1")
    named = links.select(F.col("x").alias("node"), F.col("a").alias("sig")).union(links.select(F.col("y").alias("node"), F.col("b").alias("sig"))).distinct()
    component = named.join(found, "node").groupBy("sig").agg(F.min("component").alias("comp"))
    # a class goes by 64 bits of its 128; where two classes share them, no pair of theirs is left out
    twice = classes.groupBy(F.col("lo").alias("sig")).agg(F.count("*").alias("c")).where("c > 1").select("sig")
    component = component.join(twice, "sig", "left_anti")
    rest = _cross_pairs(columns, component, scratch).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    rest = scratch.write(rest, "rest")
    if rest.limit(1).count():
        more = _linked(known, classes, rest, scratch, "rest")
        if more.limit(1).count():
            edges = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("x", "y"))
            found = connected_components(edges, scratch, "cc2")
    members = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("lo", "hi", F.coalesce("component", "rep").alias("component"))
    out = rows.join(members, ["lo", "hi"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    # rows that share a doc_id are one node: all take the smallest component of theirs
    out = out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))
    return _joined_ids(out, scratch)


def _joined_ids(out: DataFrame, scratch: Scratch) -> DataFrame:
    """Where several rows share a doc_id, their components are one."""
    out = scratch.write(out, "out")
    scratch.drop_others("out")
    several = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a <> b")
    if not several.limit(1).count():
        return out
    pairs = out.join(several.select("doc_id"), "doc_id").groupBy("doc_id", "component_id").agg(F.lit(1)).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    merged = connected_components(pairs.union(out.where("component_id is not null").select(F.col("component_id").alias("a"), F.col("component_id").alias("b"))).union(several.select("a", "b")), scratch, "cc3")
    merged = merged.select(F.col("node").alias("component_id"), F.col("component").alias("low"))
    return out.join(merged, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("low", "component_id").alias("component_id"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, read_table(spark, sf_dir, "documents"))
