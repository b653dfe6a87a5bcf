"""A Merkle manifest of a table: every row a leaf, a tree for each source, a tree over the sources, and a proof for each row.

Leaves are digests of the rows' fields (DataFrame functions). They are ranked within their source by a range shuffle, so a source of
any size is dealt over all tasks, and cut to aligned blocks of SPAN = ARITY ** LEVELS leaves. Two passes over blocks:

* the blocks' own roots; these are nodes of the next height and are treated the same way again, until a source is one
  node; then the sources' roots likewise, to one root. Each height has 1/SPAN of the nodes below it.
* the traversal: within a block, treehash stacks advance the authentication path leaf by leaf. For each level the current
  run of siblings is held while the next one grows by one leaf a step, so a level holds two runs and a stack. The block's
  upper path, which all its leaves share, is appended.

A proof of a row is the siblings of each level from leaf to root; folding them with the row's leaf gives the root.

Edge cases: a null field is marked `-`, so null and empty text differ; a null source is a source of its own, before all others; null
doc_ids come before others; rows that share source and doc_id are ordered by their leaf, and repeated rows are leaves of their own (which of
them has which proof is then arbitrary, the set of proofs is not); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table, shuffle_partitions

ARITY, LEVELS = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int, arity: int) -> int:
    """Levels of a tree of n leaves: none for one."""
    k = 0
    while arity**k < n:
        k += 1
    return k


class TreeHash:
    """Nodes of `level` from leaves pushed one by one: a stack of at most `arity` digests a level."""

    def __init__(self, level: int, arity: int):
        self.arity, self.stack = arity, [[] for _ in range(level + 1)]

    def push(self, leaf: str) -> None:
        self.stack[0].append(leaf)
        for lower, upper in zip(self.stack, self.stack[1:], strict=False):
            if len(lower) < self.arity:
                return
            upper.append(H(lower))
            lower.clear()

    def run(self) -> list[str]:
        """The nodes so far, those that no more leaves follow included."""
        for lower, upper in zip(self.stack, self.stack[1:], strict=False):
            if lower:
                upper.append(H(lower))
                lower.clear()
        return self.stack[-1]


def block_root(leaves: list[str], levels: int, arity: int) -> str:
    tree = TreeHash(levels, arity)
    for leaf in leaves:
        tree.push(leaf)
    return tree.run()[0]


#: What stands left and right of a node, for each level from its own up
Path = list[tuple[list[str], list[str]]]


def traverse(leaves: list[str], levels: int, arity: int) -> Iterator[Path]:
    """The authentication path of each leaf within its block, in order."""
    now, ahead = [], []
    for level in range(levels):
        tree = TreeHash(level, arity)
        for leaf in leaves[: arity ** (level + 1)]:
            tree.push(leaf)
        now.append(tree.run())
        ahead.append(TreeHash(level, arity))
    for i in range(len(leaves)):
        path = []
        for level in range(levels):
            span = arity ** (level + 1)
            if i and i % span == 0:
                now[level], ahead[level] = ahead[level].run(), TreeHash(level, arity)
            if i + span < len(leaves):
                ahead[level].push(leaves[i + span])
            at = i // arity**level % arity
            path.append((now[level][:at], now[level][at + 1 :]))
        yield path


def fold(leaf: str, path: Path) -> str:
    for left, right in path:
        leaf = H([*left, leaf, *right])
    return leaf


def spelled(path: Path) -> str:
    """left|right of each level, levels parted by `/`."""
    return "".join("".join(left) + "|" + "".join(right) + "/" for left, right in path)


def read(text: str) -> Path:
    return [tuple([side] if side else [] for side in level.split("|")) for level in text.split("/")[:-1]]


def ranked(df: DataFrame, scratch: Scratch, tag: str, group: str, *order: str) -> DataFrame:
    """df with `rank` (from 0) and `n` within group, by order; a range shuffle and a sum over parts, no group in one task."""
    salted = df.withColumn("_salt", F.monotonically_increasing_id())  # equal rows go to several parts
    sort = [group, *order, "_salt"]
    rows = salted.repartitionByRange(shuffle_partitions(df.sparkSession), *sort).sortWithinPartitions(*sort).drop("_salt")
    rows = scratch.write(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), tag)
    parts = rows.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_count"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("_count").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "_part", (F.col("_first") - before).alias("_base"), F.sum("_count").over(w).alias("n"))
    return rows.join(parts, [group, "_part"]).withColumn("rank", F.col("_row") - F.col("_base")).drop("_part", "_row", "_base")


class Manifest:
    """The trees over blocks of leaves; every step is a written table."""

    def __init__(self, scratch: Scratch, arity: int = ARITY, levels: int = LEVELS):
        self.scratch, self.arity, self.levels, self.span = scratch, arity, levels, arity**levels

    def blocks(self, nodes: DataFrame, tag: str, *payload: str) -> DataFrame:
        """(grp, block, n, digests, ...) of nodes(grp, rank, n, digest, ...): at most `span` nodes a row."""
        dealt = nodes.withColumn("block", F.floor(F.col("rank") / self.span)).groupBy("grp", "block")
        rows = dealt.agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "digest", *payload))).alias("_rows"))
        return self.scratch.write(rows.select("grp", "block", "n", F.col("_rows.digest").alias("digests"), *[F.col(f"_rows.{c}").alias(c) for c in payload]), tag)

    def _levels(self):
        """Levels within a block, by the number of nodes of its group."""
        arity, levels = self.arity, self.levels
        return lambda n: min(levels, height(n, arity))

    def roots(self, blocks: DataFrame) -> DataFrame:
        """(grp, rank, n, digest): each block's root as a node of the next height."""
        arity, span, levels = self.arity, self.span, self._levels()

        def go(batches):
            for b in batches:
                ns = b.column("n").to_pylist()
                digests = [block_root(d.as_py(), levels(n), arity) for d, n in zip(b.column("digests"), ns, strict=True)]
                yield pa.record_batch([b.column("grp"), b.column("block"), pa.array([-(-n // span) for n in ns], pa.int64()), pa.array(digests, pa.string())], names=["grp", "rank", "n", "digest"])

        return blocks.select("grp", "block", "n", "digests").mapInArrow(go, "grp string, rank bigint, n bigint, digest string")

    def upper(self, blocks: DataFrame, tag: str) -> DataFrame:
        """(grp, block, path, root): the path from each block's root to its group's root."""
        nodes = self.scratch.write(self.roots(blocks), f"{tag}-roots")
        alone = nodes.where("n = 1").select("grp", F.col("rank").alias("block"), F.lit("").alias("path"), F.col("digest").alias("root"))
        if not nodes.where("n > 1").limit(1).count():
            return alone
        above = self.blocks(nodes.where("n > 1"), f"{tag}-up")
        arity, span, levels = self.arity, self.span, self._levels()

        def go(batches):
            for b in batches:
                for grp, block, n, digests, path, root in zip(*(b.column(c).to_pylist() for c in ("grp", "block", "n", "digests", "path", "root")), strict=True):
                    paths = [spelled(p) + path for p in traverse(digests, levels(n), arity)]
                    m = len(paths)
                    yield pa.record_batch([pa.array([grp] * m, pa.string()), pa.array([block * span + k for k in range(m)], pa.int64()), pa.array(paths, pa.string()), pa.array([root] * m, pa.string())], names=["grp", "block", "path", "root"])

        joined = above.join(self.upper(above, f"{tag}-up"), ["grp", "block"])
        return self.scratch.write(alone.union(joined.mapInArrow(go, "grp string, block bigint, path string, root string")), f"{tag}-paths")

    def proofs(self, leaves: DataFrame, *payload: str) -> DataFrame:
        """leaves(grp, digest, ...) with each leaf's path to the root: (grp, digest, ..., subroot, root, proof), proof holding what
        stands left and right of it for each level; see `read`. A block's rows are one batch of at most `span`."""
        return self._finished(leaves, payload, None)

    def checked(self, leaves: DataFrame, changed: str, *payload: str) -> DataFrame:
        """leaves with the digest of their proof and the root that their proof gives with `changed` (a leaf, or null for the same)
        in their place; the proofs themselves are not kept."""
        return self._finished(leaves, payload, changed)

    def _finished(self, leaves: DataFrame, payload: tuple[str, ...], changed: str | None) -> DataFrame:
        carried = [*payload, *([changed] if changed and changed not in payload else [])]
        blocks = self.blocks(leaves, "blocks", *carried)
        up = self.scratch.write(self.upper(blocks, "leaves").withColumnRenamed("root", "subroot"), "up")
        tops = ranked(up.where("block = 0").select(F.lit("").alias("top"), F.col("grp").alias("name"), F.col("subroot").alias("digest")), self.scratch, "tops", "top", "name")
        tops = self.blocks(tops.withColumnRenamed("top", "grp"), "top-blocks", "name")
        top = tops.join(self.upper(tops, "top"), ["grp", "block"])
        arity, levels = self.arity, self._levels()

        def sources(batches):
            for b in batches:
                for n, digests, names, path, root in zip(*(b.column(c).to_pylist() for c in ("n", "digests", "name", "path", "root")), strict=True):
                    paths = [spelled(p) + path for p in traverse(digests, levels(n), arity)]
                    yield pa.record_batch([pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array([root] * len(paths), pa.string())], names=["grp", "top_path", "root"])

        above = self.scratch.write(top.mapInArrow(sources, "grp string, top_path string, root string"), "sources")
        joined = blocks.join(up, ["grp", "block"]).join(above, "grp").withColumn("upper", F.concat("path", "top_path")).drop("path", "top_path", "block")
        names = ["proof"] if changed is None else ["proof_sha256", "folded_root"]
        kinds = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
        schema = ", ".join(["grp string", "digest string", *[f"`{c}` {kinds[c]}" for c in payload], "subroot string", "root string", *[f"{c} string" for c in names]])

        def go(batches):
            for b in batches:
                for k in range(b.num_rows):
                    row = b.slice(k, 1)
                    one = {c: row.column(c)[0].as_py() for c in ("grp", "n", "digests", "subroot", "root", "upper")}
                    digests, upper = one["digests"], read(one["upper"])
                    others = row.column(changed)[0].as_py() if changed else None
                    out = ([], []) if changed else ([],)
                    for i, path in enumerate(traverse(digests, levels(one["n"]), arity)):
                        path = path + upper
                        if changed is None:
                            out[0].append(spelled(path))
                        else:
                            out[0].append(H([d for left, right in path for d in (*left, *right)]))
                            out[1].append(fold(others[i] or digests[i], path))
                    m = len(digests)
                    cols = [pa.array([one["grp"]] * m, pa.string()), pa.array(digests, pa.string()), *[row.column(c)[0].values for c in payload], pa.array([one["subroot"]] * m, pa.string()), pa.array([one["root"]] * m, pa.string())]
                    yield pa.RecordBatch.from_arrays([*cols, *[pa.array(o, pa.string()) for o in out]], names=["grp", "digest", *payload, "subroot", "root", *names])

        return joined.mapInArrow(go, schema)


def field(c: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def source_key(c: str) -> Column:
    """Sources in the order of their UTF-8 bytes, null before all."""
    return F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(c)))


def leaves(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(grp, rank, n, digest, doc_id, tampered) of documents; tampered is the leaf with A-Z of text in lower case, null where the
    row is left alone (all but those whose crc32 of the decimal doc_id is divisible by 5)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cols = [F.col(c) for c in FIELDS]
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select(source_key("source").alias("grp"), "doc_id", leaf(*cols).alias("digest"), F.when(picked, leaf(*cols[:-1], lower)).alias("tampered"))
    return ranked(scratch.write(rows, "leaves"), scratch, "ranked", "grp", "doc_id", "digest")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "manifest")
    found = Manifest(scratch).checked(leaves(read_table(spark, sf_dir, "documents"), scratch), "tampered", "doc_id")
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
