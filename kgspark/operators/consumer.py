"""What a consumer of the graph is given: device records with everything about them, and the views over these.

devices(id, name, manufacturer, category, in_use, ...); ports(device, name, dir, medium, ord, hidden); links(id, src, src_port,
dst, dst_port, medium); specs(device, field, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relational


def group_of(category: Column, groups: dict[str, list[str]], default: str = "other") -> Column:
    """The group that names the category, in any case; the default for one that no group names, null included."""
    out = None
    for name, members in groups.items():
        hit = F.lower(category).isin([m.lower() for m in members])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def short_name(name: Column, maker: Column) -> Column:
    """A name without its maker's in front and without a size of '1U' behind."""
    starts = F.startswith(F.lower(name), F.concat(F.lower(maker), F.lit(" ")))
    bare = F.when(maker.isNotNull() & starts, F.substring(name, F.length(maker) + 2, F.length(name))).otherwise(name)
    return F.trim(F.regexp_replace(bare, r"\s+1U$", ""))


def search(devices: DataFrame, words: str, group: str | None = None, in_use: bool | None = None) -> DataFrame:
    """Devices whose name, maker, category or model holds the words, in any case; of one group, and in use or not, if asked."""
    have = [F.col(c) for c in ("name", "manufacturer", "category", "model") if c in devices.columns]
    out = devices.where(F.contains(F.lower(F.concat_ws(" ", *have)), F.lit(words.lower())))
    out = out.where(F.col("group") == group) if group is not None else out
    return out.where(F.coalesce("in_use", F.lit(False)) == in_use) if in_use is not None else out


def resolved_ends(links: DataFrame, ports: DataFrame) -> DataFrame:
    """links with every end named where a jack is left: named jacks are taken first, then the k-th unnamed end of a device,
    direction and medium gets its k-th visible jack that no link names. An end beyond the jacks stays null."""
    seen = ports.where(~F.coalesce("hidden", F.lit(False)))
    out = links
    for end, column, direction in (("src", "src_port", "out"), ("dst", "dst_port", "in")):
        named = links.where(F.col(column).isNotNull()).select(F.col(end).alias("device"), F.col(column).alias("name")).distinct()
        free = seen.where(F.col("dir").isin(direction, "bidir")).join(named, ["device", "name"], "left_anti").select("device", "medium", "ord", F.col("name").alias("_jack"))
        asks = links.where(F.col(column).isNull()).select("id", F.col(end).alias("device"), "medium")
        got = relational.allocate(asks, free, ["device", "medium"], ["id"], ["ord", "_jack"]).select("id", "_jack")
        out = out.join(got, "id", "left").withColumn(column, F.coalesce(column, "_jack")).drop("_jack")
    return out.select(links.columns)


def records(devices: DataFrame, specs: DataFrame, ports: DataFrame, placements: DataFrame | None = None, channels: DataFrame | None = None, loads: DataFrame | None = None) -> DataFrame:
    """One row a device: its own columns, `specs` (map), `ports` (visible, inputs first), `placed`, `midi` and `load`. Each list is
    of one device; what isn't recorded is null or empty."""
    s = specs.where("value is not null").groupBy(F.col("device").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("field", F.col("value").cast("double").alias("value"))))).alias("specs"))
    p = ports.where(~F.coalesce("hidden", F.lit(False))).groupBy(F.col("device").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct((F.col("dir") != "in").alias("after"), "ord", "name", "dir", "medium"))), lambda x: F.struct(x["name"].alias("name"), x["dir"].alias("dir"), x["medium"].alias("medium"))).alias("ports"))
    out = devices.join(s, "id", "left").join(p, "id", "left")
    out = out.withColumn("specs", F.coalesce("specs", F.create_map().cast("map<string,double>"))).withColumn("ports", F.coalesce("ports", F.array().cast(p.schema["ports"].dataType)))
    for table, key, name in ((placements, "module", "placed"), (channels, "device", "midi"), (loads, "supply", "load")):
        if table is None:
            continue
        rest = [c for c in table.columns if c != key]
        out = out.join(table.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), "id", "left")
    return out


def dataset(devices: DataFrame, links: DataFrame, templates: DataFrame) -> DataFrame:
    """(section, key, value) of the whole consumer dataset: a JSON row for each device record, link and template."""
    row = lambda df, section, key: df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(df.columns))).alias("value"))
    return row(devices, "devices", "id").union(row(links, "links", "id")).union(row(templates, "templates", "name"))


def summary(values: Column, form: str) -> Column:
    """`form` with each {key} filled from a map of strings; null unless all keys are there."""
    import re

    keys = re.findall(r"\{(\w+)\}", form)
    out = F.lit(form)
    for k in keys:
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(F.try_element_at(values, F.lit(k)), F.lit("")))
    there = F.forall(F.array(*map(F.lit, keys)), lambda k: F.coalesce(F.try_element_at(values, k), F.lit("")) != "") if keys else F.lit(True)
    return F.when(there, out)


def bounding_box(nodes: DataFrame, keys: list[str], width: float, height: float, margin: float = 0.0) -> DataFrame:
    """keys, x, y, w, h around nodes(keys..., x, y) of one size; groups without a placed node are absent."""
    g = nodes.where("x is not null and y is not null").groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return g.select(*keys, (F.col("x0") - margin).alias("x"), (F.col("y0") - margin).alias("y"), (F.col("x1") - F.col("x0") + width + 2 * margin).alias("w"), (F.col("y1") - F.col("y0") + height + 2 * margin).alias("h"))


def wrapped(df: DataFrame, keys: list[str], order: list, width: int = 7) -> DataFrame:
    """df with `row` and `column` of a grid that many wide, within each group."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_n", n).withColumn("row", F.floor(F.col("_n") / width).cast("int")).withColumn("column", (F.col("_n") % width).cast("int")).drop("_n")


def inputs_first(ports: DataFrame) -> DataFrame:
    """ports with `place`: inputs, then the rest, each in the order they have."""
    return ports.withColumn("place", F.row_number().over(Window.partitionBy("device").orderBy(F.col("dir") != "in", "ord", "name")))


def free_width(cases: DataFrame, placements: DataFrame, items: DataFrame, default: int = 4) -> DataFrame:
    """(setup, case, row_index, wide, used, free): every row of cases(setup, id, rows); a module without a width counts as 4 HP."""
    every = cases.select("setup", F.col("id").alias("case"), F.posexplode("rows").alias("row_index", "r")).select("setup", "case", "row_index", F.col("r.hp").alias("wide"))
    hp = placements.join(items.select(F.col("id").alias("module"), "hp"), "module", "left").groupBy("setup", "case", "row_index").agg(F.sum(F.coalesce("hp", F.lit(default))).alias("used"))
    return every.join(hp, ["setup", "case", "row_index"], "left").select("setup", "case", "row_index", "wide", F.coalesce("used", F.lit(0)).alias("used"), (F.col("wide") - F.coalesce("used", F.lit(0))).alias("free"))


def controller_section(maps: DataFrame, channels: DataFrame) -> DataFrame:
    """(controller, channel, target, entries): what each controller sends to whom, its numbers in order with their names."""
    g = maps.groupBy("controller", "channel", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cc", "name"))), lambda x: F.concat_ws(" ", x["cc"].cast("string"), x["name"])), ", ").alias("entries"))
    return g.join(channels.select(F.col("device").alias("target"), F.col("in").alias("listens")).distinct(), "target", "left").select("controller", "channel", "target", "listens", "entries")
