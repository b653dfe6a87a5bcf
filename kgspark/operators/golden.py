"""Questions asked of a built graph: each kind is a plan that answers in rows (key, value), and answers are held against
what is expected.

Ids in answers are bare. Conclusions about wiring rest on confirmed links where a kind says so; an empty answer means "not
recorded".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evidence, graph, terms
from .graph import PropertyGraph, bare

KINDS: dict[str, Callable[..., DataFrame]] = {}


def kind(f):
    KINDS[f.__name__] = f
    return f


def _edges(g: PropertyGraph, *rels: str) -> DataFrame:
    return g.edges.where(F.col("rel").isin(*rels))


def _typed(g: PropertyGraph, *types: str) -> DataFrame:
    return g.vertices.where(F.col("type").isin(*types))


def _pairs(df: DataFrame, key: Column, value: Column) -> DataFrame:
    return df.select(key.cast("string").alias("key"), value.cast("string").alias("value")).distinct()


@kind
def feeds(g: PropertyGraph, item: str, setup: str | None = None) -> DataFrame:
    """medium -> what the item feeds by confirmed links."""
    e = graph.confirmed(graph.scoped(_edges(g, "CONNECTS"), setup)).where(F.col("src") == f"item:{item}")
    return _pairs(e, F.col("medium"), bare("dst"))


@kind
def reach(g: PropertyGraph, item: str, media: list[str] | None = None, setup: str | None = None) -> DataFrame:
    """hops -> every item that confirmed links of these media lead to, in the direction they are recorded in."""
    e = graph.confirmed(graph.scoped(_edges(g, "CONNECTS"), setup))
    e = e.where(F.col("medium").isin(media)) if media else e
    root = g.vertices.sparkSession.createDataFrame([(f"item:{item}",)], "id string")
    return _pairs(graph.reach(e.select("src", "dst"), root).where("hops > 0"), F.col("hops"), bare("id"))


@kind
def support(g: PropertyGraph) -> DataFrame:
    """how well figures are supported -> how many."""
    told = _edges(g, "SOURCED_FROM").join(_typed(g, "source").select(F.col("id").alias("dst"), "tier"), "dst").select(F.col("src").alias("id"), "tier")
    s = evidence.support(_typed(g, "spec").select("id"), told, ["id"])
    return s.groupBy(F.col("support").alias("key")).agg(F.count("*").cast("string").alias("value"))


@kind
def midi_conflicts(g: PropertyGraph) -> DataFrame:
    """source/channel -> devices that share a receive channel, of a source with two confirmed midi links or more; those without a
    channel under `not recorded`, however many."""
    e = graph.confirmed(_edges(g, "CONNECTS").where("medium = 'midi'")).select("src", "dst")
    fans = e.groupBy("src").agg(F.count("*").alias("fan")).where("fan >= 2").select("src")
    j = e.join(fans, "src", "left_semi").join(_typed(g, "item").select(F.col("id").alias("dst"), F.col("midi_in_ch").alias("ch")), "dst")
    n = j.groupBy("src", F.col("ch").alias("_ch")).agg(F.count("*").alias("n")).where("n > 1 or _ch is null")
    hit = j.join(n, "src").where("ch <=> _ch")
    return _pairs(hit, F.concat_ws("/", bare("src"), F.coalesce("ch", F.lit("not recorded"))), bare("dst"))


@kind
def unrecorded(g: PropertyGraph) -> DataFrame:
    """category -> items that no confirmed link, place or supply names."""
    e = graph.confirmed(_edges(g, "CONNECTS", "INSTALLED_IN", "POWERED_BY"))
    ends = e.select(F.col("src").alias("id")).union(e.select("dst"))
    return _pairs(_typed(g, "item").join(ends, "id", "left_anti"), F.coalesce("category", F.lit("none")), bare("id"))


def _labels(g: PropertyGraph) -> DataFrame:
    """(src, type, name, concept, label, n) of every use of a term."""
    who = g.vertices.select(F.col("id").alias("src"), "type", "name", "manufacturer")
    return _edges(g, "USES_TERM").select("src", F.col("dst").alias("concept"), "label", F.col("value").alias("n")).join(who, "src")


def _manual_uses(g: PropertyGraph) -> DataFrame:
    """(item, maker, concept, label, n): terms that the manuals of items use."""
    own = _edges(g, "HAS_MANUAL").select(F.col("dst").alias("src"), F.col("src").alias("item"))
    item = _typed(g, "item").select(F.col("id").alias("item"), F.col("manufacturer").alias("maker"))
    return _labels(g).drop("manufacturer").join(own, "src").join(item, "item")


@kind
def naming(g: PropertyGraph, show: list[str] | None = None) -> DataFrame:
    """concept -> `who: word` where makers of manuals clearly differ in the word they use most; concepts that only group others don't
    count, items without a maker stand together as `maker not recorded`."""
    used = _manual_uses(g).join(_typed(g, "term").where("role = 'concept'").select(F.col("id").alias("concept")), "concept", "left_semi")
    used = used.withColumn("maker", F.coalesce("maker", F.lit("maker not recorded")))
    used = used.where(F.col("concept").isin([f"term:{c}" for c in show])) if show else used
    win = terms.differing(terms.dominant(used, ["concept", "maker"], "label", "n"), "concept")
    return _pairs(win, bare("concept"), F.concat_ws(": ", "maker", "winner"))


def _family(g: PropertyGraph, concept: str) -> DataFrame:
    """(concept) a concept and all that are narrower."""
    down = _edges(g, "BROADER").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(down, g.vertices.sparkSession.createDataFrame([(f"term:{concept}",)], "id string")).select(F.col("id").alias("concept"))


@kind
def inherits(g: PropertyGraph, param: str, predicate: str = "MODULATES") -> DataFrame:
    """item -> what its manual names of the things that stand in the relation to the parameter, narrower ones included, where the
    manual names the parameter as well."""
    subjects = _edges(g, predicate).where(F.col("dst") == f"term:{param}").select(F.col("src").alias("id")).distinct()
    down = _edges(g, "BROADER").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    kinds = graph.reach(down, subjects).select(F.col("id").alias("concept"))
    used = _manual_uses(g).select("item", "concept").distinct()
    with_param = used.where(F.col("concept") == f"term:{param}").select("item")
    return _pairs(used.join(kinds, "concept", "left_semi").join(with_param, "item", "left_semi"), bare("item"), bare("concept"))


def _guide(g: PropertyGraph) -> DataFrame:
    """(section, about): what the sections written for users document."""
    told = _edges(g, "DOCUMENTS").select(F.col("src").alias("section"), F.col("dst").alias("about"))
    return told.join(_typed(g, "doc_section").where("role = 'user'").select(F.col("id").alias("section")), "section", "left_semi")


@kind
def undocumented(g: PropertyGraph) -> DataFrame:
    """app -> actions that no section for users documents."""
    gone = _typed(g, "ui_action").join(_guide(g).select(F.col("about").alias("id")), "id", "left_anti")
    app = _edges(g, "PART_OF", "CONTAINS").select(F.col("src").alias("app"), F.col("dst").alias("id"))
    return _pairs(gone.join(app, "id", "left"), F.coalesce(bare("app"), F.lit("none")), bare("id"))


@kind
def doc_impact(g: PropertyGraph, route_prefix: str) -> DataFrame:
    """function, action, section -> what a change of the routes with this prefix touches: functions that request one, actions that
    such a function handles, sections for users about either. One link each: a function that calls everything flags nothing."""
    path = F.regexp_replace(bare("dst"), "^[A-Z]+ ", "")
    functions = _edges(g, "REQUESTS").where(path.startswith(route_prefix)).select(F.col("src").alias("id")).distinct()
    actions = _edges(g, "HANDLED_BY").select(F.col("src").alias("id"), "dst").join(functions.withColumnRenamed("id", "dst"), "dst", "left_semi").select("id").distinct()
    sections = _guide(g).join(functions.union(actions).withColumnRenamed("id", "about"), "about", "left_semi").select(F.col("section").alias("id"))
    rows = functions.select(F.lit("function").alias("what"), "id").union(actions.select(F.lit("action"), "id")).union(sections.select(F.lit("section"), "id"))
    return _pairs(rows, F.col("what"), bare("id"))


@kind
def kb_reach(g: PropertyGraph, system: str, reader: str = "") -> DataFrame:
    """dataset -> how many entities it defines or describes, of the system's datasets that a file below `reader` reads."""
    part = _edges(g, "PART_OF").where(F.col("dst") == f"system:{system}").select("src")
    read = _edges(g, "READS").where(F.col("src").startswith(f"file:{reader}")).select(F.col("dst").alias("src"))
    e = _edges(g, "DEFINES", "DESCRIBES").join(part, "src", "left_semi").join(read, "src", "left_semi")
    return e.groupBy("src").agg(F.count("*").cast("string").alias("value")).select(bare("src").alias("key"), "value")


def _apps(g: PropertyGraph) -> DataFrame:
    """(src, app): what each app contains."""
    return _edges(g, "CONTAINS").join(_typed(g, "app").select(F.col("id").alias("_a")), F.col("src") == F.col("_a")).select(F.col("dst").alias("src"), bare("_a").alias("app")).distinct()


@kind
def concept_where(g: PropertyGraph, concept: str) -> DataFrame:
    """Where the concept or a narrower one is used: manuals -> how many; sections of an app's documents and code files -> which."""
    used = _labels(g).join(_family(g, concept), "concept").select("src", "type", "name").distinct()
    manuals = used.where("type = 'manual'").agg(F.count_distinct("src").alias("n")).where("n > 0").select(F.lit("manuals").alias("key"), F.col("n").cast("string").alias("value"))
    sections = used.where("type = 'doc_section'").join(_apps(g), "src", "left").select(F.concat(F.lit("sections of "), F.coalesce("app", F.lit("?"))).alias("key"), F.coalesce("name", bare("src")).alias("value"))
    files = used.where("type = 'code_file'").select(F.lit("code files").alias("key"), F.coalesce("name", bare("src")).alias("value"))
    return manuals.union(sections.union(files).distinct())


@kind
def vocabulary(g: PropertyGraph, concept: str) -> DataFrame:
    """word, in lower case -> makers whose manuals, and apps whose documents or code, use it for the concept or a narrower one."""
    used = _labels(g).join(_family(g, concept), "concept").where("label is not null").select("src", F.explode(F.split(F.lower("label"), "; ")).alias("word"))
    item = _edges(g, "HAS_MANUAL").select(F.col("dst").alias("src"), F.col("src").alias("item"))
    maker = _edges(g, "MADE_BY").select(F.col("src").alias("item"), F.col("dst").alias("_m")).join(_typed(g, "manufacturer").select(F.col("id").alias("_m"), F.col("name").alias("who")), "_m").select("item", "who")
    by_maker = used.join(item, "src").join(maker, "item").select("word", "who")
    return _pairs(by_maker.union(used.join(_apps(g), "src").select("word", "app")), F.col("word"), F.col("who"))


@kind
def term_gaps(g: PropertyGraph) -> DataFrame:
    """left_only, right_only, shared -> concepts that manuals use, that apps' documents and code use, and that both do."""
    used = _labels(g)
    sides = terms.gaps(used.where("type = 'manual'"), used.join(_apps(g), "src", "left_semi"), "concept")
    return _pairs(sides, F.col("side"), bare("concept"))


def answers(g: PropertyGraph, questions: list[dict]) -> DataFrame:
    """(id, kind, key, value) of all questions, each {id, query, params}."""
    out = None
    for q in questions:
        if q["query"] not in KINDS:
            raise ValueError(f"question {q['id']}: no kind {q['query']!r}")
        x = KINDS[q["query"]](g, **q.get("params", {})).select(F.lit(q["id"]).alias("id"), F.lit(q["query"]).alias("kind"), "key", "value")
        out = x if out is None else out.union(x)
    return out


def verdicts(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, missing, extra, passed): answers(id, key, value) against expected(id, key, value); questions without either are absent."""
    a, b = found.select("id", "key", "value").distinct(), expected.select("id", "key", "value").distinct()
    j = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), ["id", "key", "value"], "full")
    out = j.groupBy("id").agg(F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(F.col("_b").isNull()).alias("extra"))
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("extra") == 0))


def lines(found: DataFrame) -> DataFrame:
    """(id, kind, answer): each question's answer as sorted lines `key: value, value`."""
    g = found.groupBy("id", "kind", "key").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("v"))
    return g.groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "key", "v"))).alias("answer"))
