"""Merges, precedence, allocation, densified slots, natural order: shapes that are more than one join or window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay(seed: DataFrame, edits: DataFrame, keys: list[str], name: str, columns: list[str]) -> DataFrame:
    """seed rows with edits on top, matched by name in any case; an edit's non-null columns win, unmatched edits are added."""
    def one(df: DataFrame, side: str) -> DataFrame:
        r = F.row_number().over(Window.partitionBy(*keys, F.upper(name)).orderBy(name))
        return df.withColumn("_r", r).where("_r = 1").select(*keys, F.upper(name).alias("_k"), *[F.col(c).alias(f"{side}{c}") for c in [name, *columns]])

    j = one(seed, "_s_").join(one(edits, "_e_"), [*keys, "_k"], "full")
    origin = F.when(F.col(f"_s_{name}").isNull(), "edit").when(F.col(f"_e_{name}").isNull(), "seed").otherwise("both")
    return j.select(*keys, *[F.coalesce(f"_e_{c}", f"_s_{c}").alias(c) for c in [name, *columns]], origin.alias("origin"))


def first_of(sources: list[DataFrame], keys: list[str], name: str) -> DataFrame:
    """The union of sources; of rows with equal keys and name (any case) the one of the earliest source stays."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("precedence", F.lit(i))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    r = F.row_number().over(Window.partitionBy(*keys, F.upper(name)).orderBy("precedence", name))
    return every.withColumn("_r", r).where("_r = 1").drop("_r")


def first_match(left: DataFrame, right: DataFrame, on: Column, id_cols: list[str], order: str, value: str) -> DataFrame:
    """left with `value` of the first matching row of right, in order."""
    hit = left.join(right, on).groupBy(*id_cols).agg(F.min(F.struct(order, value)).alias("_m")).select(*id_cols, F.col(f"_m.{value}").alias(value))
    return left.join(hit, id_cols, "left")


def default_fill(present: DataFrame, defaults: DataFrame, on: list[str], covers: dict[str, dict[str, list[str]]] | None = None, unless: list[str] | None = None) -> DataFrame:
    """Defaults for what is not there.

    covers: for a column of `on`, values that stand for others as well ({"dir": {"bidir": ["in", "out"]}}). unless: a default
    is also left out where what is present has the same values in these columns, in any case; nulls match nothing.
    """
    have = present
    for column, wider in (covers or {}).items():
        also = F.array(F.col(column))
        for value, others in wider.items():
            also = F.when(F.col(column) == value, F.array(F.col(column), *map(F.lit, others))).otherwise(also)
        have = have.withColumn(column, F.explode(also))
    out = defaults.join(have.select(*on).distinct(), on, "left_anti")
    if not unless:
        return out
    keys = [f"_unless{i}" for i in range(len(unless))]
    plain = [F.lower(F.col(c).cast("string")).alias(k) for c, k in zip(unless, keys, strict=True)]
    return out.select("*", *plain).join(present.select(*plain).distinct(), keys, "left_anti").select(*out.columns)


def allocate(requests: DataFrame, slots: DataFrame, keys: list[str], request_order: list[str], slot_order: list[str]) -> DataFrame:
    """The k-th request of a group gets its k-th free slot; a request beyond the slots gets none."""
    k = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return requests.withColumn("_k", k(request_order)).join(slots.withColumn("_k", k(slot_order)), [*keys, "_k"], "left").drop("_k")


def unique_names(df: DataFrame, base: str, order: list[str], into: str = "name") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn(into, F.when(n == 1, F.col(base)).otherwise(F.concat_ws(" ", base, n.cast("string"))))


def densify(df: DataFrame, slot: str, lo: int, hi: int) -> DataFrame:
    """Every slot from lo to hi, those without rows included."""
    every = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias(slot))
    return every.join(df, slot, "left")


def natural_key(text: Column, width: int = 12) -> Column:
    """Sorts numbers in text by value: each run of digits is padded."""
    parts = F.split(F.regexp_replace(F.lower(text), r"(\d+)", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, width, "0")).otherwise(p)), "")


def top_and_more(df: DataFrame, keys: list[str], order: list, value: str, top: int) -> DataFrame:
    """keys, rank, value, more: each group's first rows, and how many there are beyond."""
    w = Window.partitionBy(*keys)
    x = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - top, F.lit(0)))
    return x.where(F.col("rank") <= top).select(*keys, "rank", value, "more")


def running(df: DataFrame, keys: list[str], order: list, amount: str) -> DataFrame:
    """df with `before`, the sum of amount over the rows ahead of it in its group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(amount).over(w), F.lit(0)))


def first_fit(items: DataFrame, rows: DataFrame) -> DataFrame:
    """(box, item, row): items(box, ord, item, format, size, row_index) into rows(box, row_index, format, size).

    An item goes to the row it names, else to the first row of its format with room, else to the last row of its format;
    without any it stays unplaced (null). One after the other within a box: sorted parts hold a box's rows and then its items, and are
    read in one pass that keeps no more than a batch and the room of one box.
    """
    slot = rows.select("box", F.lit(0).alias("_item"), F.lit(None).cast(items.schema["ord"].dataType).alias("ord"), F.lit(None).cast("string").alias("item"), "format", F.col("size").cast("double").alias("size"), F.col("row_index").cast("int").alias("row_index"))
    both = slot.unionByName(items.select("box", F.lit(1).alias("_item"), "ord", "item", "format", F.col("size").cast("double").alias("size"), F.col("row_index").cast("int").alias("row_index")))
    both = both.repartition("box").sortWithinPartitions("box", "_item", "ord", "row_index").drop("ord")

    def fit(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        at, room, of = None, {}, {}
        for batch in batches:
            out = []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("box", "_item", "format", "size", "row_index")]
            for box, item, format_, size, named in zip(*columns, strict=True):
                if box != at:
                    at, room, of = box, {}, {}
                size = float("nan") if size is None else size
                if not item:
                    room[named] = size
                    of.setdefault(format_, []).append(named)
                    continue
                row = named
                if named is None or named not in room:
                    mine = of.get(format_) if format_ is not None else None
                    row = next((r for r in mine if room[r] >= size), mine[-1]) if mine else None
                if row is not None:
                    room[row] -= size
                out.append(row)
            placed = batch.filter(pc.equal(batch.column(batch.schema.get_field_index("_item")), 1)).select(["box", "item"])
            yield pa.record_batch([*placed.columns, pa.array(out, pa.int32())], names=["box", "item", "row"])

    return both.mapInArrow(fit, "box string, item string, row int")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, repeats counted; empty where both agree."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, digest: a SHA-256 that equal content shares, in any order, repeats counted.

    Each row's SHA-256 as JSON is cut into five numbers; their sums and the number of rows are hashed. Sums are partial before
    the shuffle, so no task holds a group's rows.
    """
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    cut = [F.conv(F.substring(h, 13 * k + 1, 13), 16, 10).cast("decimal(38,0)").alias(f"_h{k}") for k in range(5)]
    sums = df.select(*keys, *cut).groupBy(*keys).agg(F.count("*").alias("_n"), *[F.sum(f"_h{k}").alias(f"_h{k}") for k in range(5)])
    return sums.select(*keys, F.sha2(F.concat_ws(",", F.col("_n").cast("string"), *[F.col(f"_h{k}").cast("string") for k in range(5)]), 256).alias("digest"))


def prefix_pairs(left: DataFrame, text: str, right: DataFrame, name: str) -> DataFrame:
    """left and right rows where one's string is a prefix of the other's, or both are equal; by equal keys, not by comparing all.

    Each string is cut to the lengths that occur on the other side, which are few; the cut is the key.
    """
    lengths = lambda df, c, into: df.agg(F.collect_set(F.length(c)).alias(into))  # noqa: E731  # one row, as many numbers as lengths
    cut = lambda df, c, other, oc, strict: df.crossJoin(F.broadcast(lengths(other, oc, "_ns"))).withColumn("_n", F.explode(F.filter("_ns", lambda n: (n < F.length(c)) if strict else (n <= F.length(c))))).withColumn("_key", F.left(F.col(c), F.col("_n"))).drop("_ns", "_n")
    columns = [*left.columns, *right.columns]
    longer = cut(left, text, right, name, False).join(right.withColumn("_key", F.col(name)), "_key").select(*columns)
    shorter = left.withColumn("_key", F.col(text)).join(cut(right, name, left, text, True), "_key").select(*columns)
    return longer.unionByName(shorter)


def first_prefix(left: DataFrame, text: str, right: DataFrame, name: str, id_cols: list[str], order: str) -> DataFrame:
    """left with the first name of right, in order, that is a prefix of its text or the other way round; null without one."""
    hit = prefix_pairs(left, text, right, name).groupBy(*id_cols).agg(F.min(F.struct(order, name)).alias("_m")).select(*id_cols, F.col(f"_m.{name}").alias(name))
    return left.join(hit, id_cols, "left")
