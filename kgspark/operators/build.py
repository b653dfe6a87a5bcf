"""Building the property graph: records of a world become wide vertex and edge tables, are gated, and are published.

Each record table becomes labelled selects; `wide` gives them every column of schema.VERTEX or schema.EDGE, cast or null. A
vertex of its own (an item, a manual) must be there once; what only stands for a value (a category, a source) is ensured: it is
there once however often it is named.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import EDGE, VERTEX
from ..sources import sinks
from . import evidence, graph, relational, rules, text


@dataclass(frozen=True)
class World:
    """Record tables; any may be None, that is: not recorded.

    items(id, name, category, manufacturer, status, in_use, format, role, visibility), evidence(item, field, tier, url, http,
    value, line), overrides(item, field, value), manuals(id, item, doc_type, version), sections(manual, file, title, tags[]),
    concepts(id, pref, alt[], broader[], close[], tag, facet), relations(s, p, o), uses(src, concept, label, n),
    links(setup, src, dst, src_port, dst_port, medium, status, confirmed, swappable, bidirectional, note),
    placements(setup, module, case, powered_by, row, row_index, position, status, confirmed), channels(device, in, out, thru,
    status, confirmed), questions(id, question, expected[]), datasets(id, rel, entities[]).
    """

    items: DataFrame
    evidence: DataFrame | None = None
    overrides: DataFrame | None = None
    manuals: DataFrame | None = None
    sections: DataFrame | None = None
    concepts: DataFrame | None = None
    relations: DataFrame | None = None
    uses: DataFrame | None = None
    links: DataFrame | None = None
    placements: DataFrame | None = None
    channels: DataFrame | None = None
    questions: DataFrame | None = None
    datasets: DataFrame | None = None


def wide(df: DataFrame, schema: StructType) -> DataFrame:
    """df with exactly the schema's columns: cast where the type differs (null where that fails), null where missing."""
    have = dict(df.dtypes)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def key(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.concat_ws(".", *[F.col(p) if isinstance(p, str) else p for p in parts]))


def ensured(vertices: DataFrame) -> DataFrame:
    """One row an id: the fullest by name, then the first in order; used for vertices that stand for values."""
    rest = [c for c in vertices.columns if c not in ("id", "name", "type")]
    best = F.min(F.struct(F.col("name").isNull().alias("_none"), "name", "type", F.struct(*rest).alias("_rest"))).alias("_x")  # partial minima: an id of any size
    return vertices.groupBy("id").agg(best).select("id", "_x.name", "_x.type", "_x._rest.*").select(vertices.columns)


def _union(parts: list[DataFrame], schema: StructType) -> DataFrame:
    return reduce(DataFrame.unionByName, [wide(p, schema) for p in parts])


def _specs(w: World) -> tuple[DataFrame, DataFrame]:
    """Resolved figures (item, field, value, status) and their sources."""
    keys = ["item", "field"]
    over = w.overrides
    wanted = w.evidence.select(*keys).union(over.select(*keys)) if over is not None else w.evidence
    return evidence.resolve(w.evidence, keys, wanted, over), w.evidence.where("value is not null")


def build(w: World) -> graph.PropertyGraph:
    """Vertices and edges of a world; visibility of edges follows their ends."""
    own, values, edges = [], [], []
    i = w.items.withColumn("visibility", F.coalesce("visibility", F.lit("public")))
    v = i.select(key("item", "id").alias("id"), F.lit("item").alias("type"), "name", "visibility", "category", "manufacturer", "status", "in_use", "format", "role")
    if w.channels is not None:
        told = [F.col("ord")] if "ord" in w.channels.columns else []
        first = w.channels.withColumn("id", key("item", "device")).groupBy("id").agg(F.min(F.struct(*told, F.struct(F.col("in").alias("midi_in_ch"), F.col("out").alias("midi_out_ch"), F.col("thru").alias("midi_thru_pass"), F.col("status").alias("midi_status"), F.col("confirmed").alias("midi_confirmed")).alias("c"))).alias("x"))
        v = v.join(first.select("id", "x.c.*"), "id", "left")  # the first record of a device by ord; without an order the least one
    own.append(v)
    for column, kind, rel in (("category", "cat", "IN_CATEGORY"), ("manufacturer", "mfr", "MADE_BY")):
        named = i.where(F.col(column).isNotNull())
        values.append(named.select(key(kind, text.slug(F.col(column))).alias("id"), F.lit({"cat": "category", "mfr": "manufacturer"}[kind]).alias("type"), F.col(column).alias("name")))
        edges.append(named.select(key("item", "id").alias("src"), key(kind, text.slug(F.col(column))).alias("dst"), F.lit(rel).alias("rel")))
    if w.evidence is not None:
        resolved, told = _specs(w)
        own.append(resolved.select(key("spec", "item", "field").alias("id"), F.lit("spec").alias("type"), F.concat_ws(" ", "item", "field").alias("name"), "field", "value", "status"))
        values.append(w.evidence.where("url is not null").select(key("src", "url").alias("id"), F.lit("source").alias("type"), F.col("url").alias("name"), "tier", "url", "http"))
        edges.append(resolved.select(key("item", "item").alias("src"), key("spec", "item", "field").alias("dst"), F.lit("HAS_SPEC").alias("rel"), "status"))
        edges.append(told.where("url is not null").select(key("spec", "item", "field").alias("src"), key("src", "url").alias("dst"), F.lit("SOURCED_FROM").alias("rel"), "value", "line"))
        edges.append(w.evidence.where("url is not null").select(key("item", "item").alias("src"), key("src", "url").alias("dst"), F.lit("CONSULTED").alias("rel"), "http").distinct())
    if w.manuals is not None:
        own.append(w.manuals.select(key("manual", "id").alias("id"), F.lit("manual").alias("type"), F.col("id").alias("name"), "doc_type", "version"))
        edges.append(w.manuals.where("item is not null").select(key("item", "item").alias("src"), key("manual", "id").alias("dst"), F.lit("HAS_MANUAL").alias("rel")))
    if w.sections is not None:
        at = F.concat(F.lit("section:"), F.concat_ws("/", "manual", "file"))
        own.append(w.sections.select(at.alias("id"), F.lit("section").alias("type"), F.col("title").alias("name"), F.lit("private").alias("visibility")))
        edges.append(w.sections.select(key("manual", "manual").alias("src"), at.alias("dst"), F.lit("HAS_SECTION").alias("rel")))
        tagged = w.sections.select(at.alias("at"), F.explode("tags").alias("tag"))
        values.append(tagged.select(key("tag", "tag").alias("id"), F.lit("tag").alias("type"), F.col("tag").alias("name")))
        edges.append(tagged.select(F.col("at").alias("src"), key("tag", "tag").alias("dst"), F.lit("TAGGED").alias("rel")))
    if w.concepts is not None:
        own.append(w.concepts.select(key("term", "id").alias("id"), F.lit("term").alias("type"), F.col("pref").alias("name"), "facet", F.array_join("alt", "; ").alias("alt"), F.when(F.col("grouping") if "grouping" in w.concepts.columns else F.lit(False), "grouping").otherwise("concept").alias("role")))
        for column, rel in (("broader", "BROADER"), ("close", "CLOSE_MATCH")):
            edges.append(w.concepts.select("id", F.explode(column).alias("x")).select(key("term", "id").alias("src"), key("term", "x").alias("dst"), F.lit(rel).alias("rel")))
        values.append(w.concepts.where("tag is not null").select(key("tag", "tag").alias("id"), F.lit("tag").alias("type"), F.col("tag").alias("name")))
        edges.append(w.concepts.where("tag is not null").select(key("term", "id").alias("src"), key("tag", "tag").alias("dst"), F.lit("UNDER_TAG").alias("rel")))
    if w.relations is not None:
        edges.append(w.relations.select(key("term", "s").alias("src"), key("term", "o").alias("dst"), F.upper(F.regexp_replace("p", "[^A-Za-z0-9]+", "_")).alias("rel")))
    if w.uses is not None:
        edges.append(w.uses.select("src", key("term", "concept").alias("dst"), F.lit("USES_TERM").alias("rel"), "label", F.col("n").alias("value")))
    if w.links is not None:
        edges.append(w.links.select(key("item", "src").alias("src"), key("item", "dst").alias("dst"), F.lit("CONNECTS").alias("rel"), "setup", "medium", F.col("src_port").alias("from_port"), F.col("dst_port").alias("to_port"), "status", "confirmed", "swappable", "bidirectional", "note"))
    if w.placements is not None:
        p = w.placements
        edges.append(p.select(key("item", "module").alias("src"), key("item", "case").alias("dst"), F.lit("INSTALLED_IN").alias("rel"), "setup", "row", "row_index", "position", "status", "confirmed"))
        edges.append(p.where("powered_by is not null and powered_by <> module").select(key("item", "module").alias("src"), key("item", "powered_by").alias("dst"), F.lit("POWERED_BY").alias("rel"), "setup", "status", "confirmed"))
    if w.questions is not None:
        own.append(w.questions.select(key("q", "id").alias("id"), F.lit("question").alias("type"), F.col("question").alias("name")))
        edges.append(w.questions.select("id", F.explode("expected").alias("x")).select(key("q", "id").alias("src"), F.concat(F.lit("section:"), "x").alias("dst"), F.lit("EXPECTS").alias("rel")))
    if w.datasets is not None:
        named = w.datasets.select("id", "rel", F.explode("entities").alias("x")).join(w.items.select(F.col("id").alias("x")), "x", "left_semi")
        values.append(w.datasets.select(key("data", "id").alias("id"), F.lit("dataset").alias("type"), F.col("id").alias("name")))
        edges.append(named.select(key("data", "id").alias("src"), key("item", "x").alias("dst"), F.upper("rel").alias("rel")))
    vertices = _union(own, VERTEX).unionByName(ensured(_union(values, VERTEX)))
    vertices = vertices.withColumn("visibility", F.coalesce("visibility", F.lit("public")))
    e = graph.derive_visibility(_union(edges, EDGE), vertices)
    return graph.PropertyGraph(vertices.select(VERTEX.fieldNames()), e.select(EDGE.fieldNames()))


def joined(*graphs: graph.PropertyGraph) -> graph.PropertyGraph:
    """Several graphs as one: tables united by column name, values that several name ensured, visibility derived anew."""
    vertices = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [g.vertices for g in graphs])
    edges = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [g.edges for g in graphs])
    vertices = ensured(wide(vertices, VERTEX))
    return graph.PropertyGraph(vertices, graph.derive_visibility(wide(edges, EDGE), vertices).select(EDGE.fieldNames()))


def gates(g: graph.PropertyGraph, forbidden: list[str] | None = None) -> DataFrame:
    """Violations that keep a graph from being published: an id twice, an edge end that is no vertex, a private vertex that a
    public edge names, and public rows that hold a forbidden pattern."""
    parts = [rules.unique(g.vertices, ["id"], "vertex id twice")]
    bad = graph.dangling(g.edges, g.vertices)
    parts.append(rules.violation(bad, "edge end is no vertex", F.col("id"), F.concat_ws(" ", "rel", "side")))
    private = g.vertices.where("visibility = 'private'").select("id")
    for side in ("src", "dst"):
        parts.append(rules.violation(g.edges.where("visibility = 'public'").join(private.withColumnRenamed("id", side), side, "left_semi"), "public edge at a private vertex", F.concat_ws(" ", "src", "rel", "dst")))
    if forbidden:
        public = g.public()
        lines = public.vertices.select(F.col("id"), sinks.sparse_json(public.vertices).alias("text")).union(public.edges.select(F.concat_ws(" ", "src", "rel", "dst"), sinks.sparse_json(public.edges)))
        found = text.leaks(lines, "id", forbidden)
        parts.append(rules.violation(found, "forbidden text is public", F.col("id"), F.array_join("found", ", ")))
    return rules.together(parts)


def sample(violations: DataFrame, each: int = 3) -> DataFrame:
    """The first violations of each rule, and how many there are: what a failed gate reports."""
    n = violations.groupBy("rule").agg(F.count("*").alias("n"))
    first = violations.withColumn("_r", F.row_number().over(Window.partitionBy("rule").orderBy("subject", "detail"))).where(F.col("_r") <= each)
    return first.drop("_r").join(n, "rule")


def publish(g: graph.PropertyGraph, path: str, forbidden: list[str] | None = None, inputs: str | None = None) -> str:
    """Write the full graph as Parquet and its public part as sorted sparse JSON, as one new version; a graph with gate errors isn't
    written. Returns the version's name.

    All tables go to a folder of their own under `versions`; only when they are there, the small file CURRENT, which names the
    version and the digest of the inputs that it was made from, is replaced in one step. Until then readers see the version
    before, and never tables of two versions; earlier versions stay as they are.
    """
    spark = g.vertices.sparkSession
    wrong = sample(gates(g, forbidden)).collect()  # three rows a rule
    if wrong:
        raise ValueError("; ".join(f"{r['rule']}: {r['subject']} {r['detail']} ({r['n']} in all)" for r in wrong))
    version = f"{datetime.datetime.now(datetime.UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    at = f"{path}/versions/{version}"
    sinks.parquet(g.vertices, f"{at}/vertices.parquet")
    sinks.parquet(g.edges, f"{at}/edges.parquet")
    public = g.public()
    sinks.ordered_json(public.vertices, ["id"], f"{at}/public/vertices.json")
    sinks.ordered_json(public.edges, ["src", "rel", "dst", "setup", "medium"], f"{at}/public/edges.json")
    sinks.replace_file(spark, f"{path}/CURRENT", json.dumps({"version": version, "inputs": inputs}))
    return version


def current(spark: SparkSession, path: str, inputs: str | None = None) -> str:
    """The folder of the published version. With a digest of the inputs as they are now, a version made from others is an error."""
    found = [r[0] for r in spark.read.text(f"{path}/CURRENT").collect()]  # one line
    told = json.loads(found[0])
    if inputs is not None and told["inputs"] != inputs:
        raise ValueError(f"version {told['version']} is stale: its inputs have changed since")
    return f"{path}/versions/{told['version']}"


def published(spark: SparkSession, path: str, inputs: str | None = None) -> graph.PropertyGraph:
    """The graph as last published, both tables of one version; see `current`."""
    at = current(spark, path, inputs)
    return graph.PropertyGraph(spark.read.parquet(f"{at}/vertices.parquet"), spark.read.parquet(f"{at}/edges.parquet"))


def inputs_digest(w: World) -> str:
    """One digest of all records, in any order of rows: what `publish` keeps and `published` compares."""
    parts = {name: relational.digest(getattr(w, name), []).collect() for name in sorted(tables(w))}  # a row a table
    return hashlib.sha256(json.dumps({k: v[0]["digest"] if v else None for k, v in parts.items()}).encode()).hexdigest()


def tables(w: World) -> list[str]:
    """Names of the tables that are recorded."""
    return [f.name for f in fields(w) if getattr(w, f.name) is not None]
