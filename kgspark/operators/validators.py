"""Rule sets: what must hold of links, cases, placements, channels, controllers, terms, sections, pictures, code and sessions.

Each function returns the violations (rule, severity, subject, detail) of its tables. A rule that only warns says WARN.
Nulls are "not recorded": a rule speaks of them only where it asks for a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, rules, terms
from .rules import violation

# The domains that records may use.
MEDIA = ["audio", "cv", "gate", "clock", "midi", "usb", "power"]
STATUSES = ["confirmed", "unconfirmed"]
DIRECTIONS = ["in", "out", "bidir"]
PICTURES = ["photo", "drawing", "panel"]
NO_CHANNEL = ["omni", "off", "all"]


def _date_when_confirmed(rows: DataFrame, rule: str, subject: Column) -> DataFrame:
    return rules.required(rows, "confirmed", F.col("status") == "confirmed", rule, subject)


def links(rows: DataFrame, items: DataFrame, setups: DataFrame, media: list[str] = MEDIA, statuses: list[str] = STATUSES) -> DataFrame:
    """links(id, setup, src, dst, medium, status, confirmed)."""
    at = F.col("id")
    ends = [rules.references(rows, c, items, "id", f"link {c} is no item", at) for c in ("src", "dst")]
    return rules.together([
        *ends,
        rules.references(rows, "setup", setups, "id", "link setup unknown", at),
        rules.domain(rows, "medium", media, "link medium", at),
        rules.domain(rows, "status", statuses, "link status", at),
        _date_when_confirmed(rows, "confirmed link without date", at),
        violation(rows.where("status = 'unconfirmed'"), "link unconfirmed", at, "", "WARN"),
    ])


def cases(rows: DataFrame, setups: DataFrame, items: DataFrame) -> DataFrame:
    """cases(setup, id, supply, mounted array) and setups(id, interface)."""
    at = F.concat_ws("/", "setup", "id")
    mounted = rows.select("setup", "id", F.explode("mounted").alias("item"))
    return rules.together([
        rules.references(setups, "interface", items, "id", "setup interface is no item", F.col("id")),
        rules.references(rows, "setup", setups, "id", "case setup unknown", at),
        rules.references(rows, "id", items, "id", "case is no item", at),
        rules.references(rows, "supply", items, "id", "case supply is no item", at),
        rules.references(mounted, "item", items, "id", "mounted item unknown", at),
        rules.unique(rows, ["setup", "id"], "case recorded twice"),
    ])


def placements(rows: DataFrame, cases: DataFrame, items: DataFrame) -> DataFrame:
    """placements(setup, module, case, powered_by, status, confirmed) and items(id, in_use, hp)."""
    at = F.concat_ws("/", "setup", "module")
    of = rows.join(cases.select("setup", F.col("id").alias("case"), F.col("supply").alias("_supply"), F.lit(True).alias("_case")), ["setup", "case"], "left")
    known = rows.join(items.select(F.col("id").alias("module"), "in_use", "hp"), "module")
    return rules.together([
        rules.references(rows, "module", items, "id", "placed module unknown", at),
        violation(of.where("_case is null"), "placement case unknown", at, F.col("case")),
        violation(of.where("_case and powered_by is not null and powered_by is distinct from _supply"), "powered by another supply", at, F.col("powered_by")),
        rules.domain(rows, "status", STATUSES, "placement status", at),
        _date_when_confirmed(rows, "confirmed placement without date", at),
        violation(known.where("not in_use"), "placed but not in use", at, "", "WARN"),
        violation(known.where("hp is null"), "placed without width", at, "", "WARN"),
    ])


def rows_of(placements: DataFrame, cases: DataFrame, items: DataFrame) -> DataFrame:
    """placements in known cases of items with a width, with `_row`, the case's row that they name (struct format, hp; counted from 1, 0 and
    null name none), and the item's `_hp` and `_format`: the placement's own `row` if there is one, else the item's, else 3U."""
    c = cases.select("setup", F.col("id").alias("case"), F.col("rows").alias("_list"))
    own = F.col("row") if "row" in placements.columns else F.lit(None).cast("string")
    j = placements.withColumn("_own", own).join(c, ["setup", "case"]).join(items.select(F.col("id").alias("module"), F.col("format").alias("_item"), F.col("hp").alias("_hp")), "module")
    j = j.where("_hp is not null").withColumn("_format", F.coalesce("_own", "_item", F.lit("3U")))
    return j.withColumn("_row", F.when(F.col("row_index") >= 1, F.get("_list", F.col("row_index") - 1))).drop("_list", "_own", "_item")


def rows(placements: DataFrame, cases: DataFrame, items: DataFrame) -> DataFrame:
    """Row numbers within bounds, formats that match, one module a position."""
    j, at = rows_of(placements, cases, items), F.concat_ws("/", "setup", "module")
    return rules.together([
        violation(j.where("row_index <> 0 and _row is null"), "row out of bounds", at, F.col("row_index")),
        violation(j.where("_row is not null and _format <> _row.format"), "row of another format", at, F.col("_format")),
        rules.unique(j.where("position is not null and _row is not null"), ["setup", "case", "row_index", "position"], "position taken twice"),
    ])


def capacity(placements: DataFrame, cases: DataFrame, items: DataFrame) -> DataFrame:
    """One placement a setup, placements for mounted items, rows and formats no fuller than they are wide (a format without a row holds
    nothing), and no module in use left out of a setup that has cases."""
    j = rows_of(placements, cases, items)
    used = j.where("_row is not null").groupBy("setup", "case", "row_index").agg(F.sum("_hp").alias("used"), F.first("_row.hp").alias("wide"))
    shelf = cases.select("setup", F.col("id").alias("case"), F.explode("rows").alias("r")).groupBy("setup", "case", F.col("r.format").alias("_format")).agg(F.sum("r.hp").alias("wide"))
    formats = j.groupBy("setup", "case", "_format").agg(F.sum("_hp").alias("used")).join(shelf, ["setup", "case", "_format"], "left").fillna(0, ["wide"])
    mounted = cases.select("setup", F.col("id").alias("case"), F.explode("mounted").alias("module"))
    placed = placements.join(cases.select("setup", F.col("id").alias("case")), ["setup", "case"], "left_semi").select("setup", "module").distinct()
    wanted = items.where("in_use and has_specs and kind = 'module'").select(F.col("id").alias("module")).crossJoin(cases.select("setup").distinct())  # a row a setup: the answer asks for each
    over = lambda df, rule, *key: violation(df.where("used > wide"), rule, F.concat_ws("/", *[F.col(k).cast("string") for k in key]), F.concat_ws(" of ", F.col("used").cast("string"), F.col("wide").cast("string")))
    return rules.together([
        rules.unique(placements, ["setup", "module"], "module placed more than once"),
        violation(mounted.join(placed, ["setup", "module"], "left_anti"), "mounted without placement", F.concat_ws("/", "setup", "module")),
        over(used, "row too full", "setup", "case", "row_index"),
        over(formats, "format too full", "setup", "case", "_format"),
        violation(wanted.join(placed, ["setup", "module"], "left_anti"), "module in use is nowhere placed", F.concat_ws("/", "setup", "module")),
    ])


def ports_in_text(ports: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(warnings, totals): ports(device, name) that the device's texts(device, text) don't name; found, missing, unchecked."""
    per = texts.select("device", F.lower("text").alias("_t"))
    key = F.regexp_replace(F.lower("name"), r"\s+", " ")
    hits = ports.join(per, "device").groupBy("device", "name").agg(F.bool_or(F.contains(F.regexp_replace("_t", r"\s+", " "), key)).alias("found"))
    told = ports.select("device", "name").distinct().join(hits, ["device", "name"], "left")
    totals = told.agg(F.count_if(F.col("found")).alias("found"), F.count_if(~F.col("found")).alias("missing"), F.count_if(F.col("found").isNull()).alias("unchecked"))
    return violation(told.where("not found"), "port not in the text", F.concat_ws("/", "device", "name"), "", "WARN"), totals


def channel(text: Column) -> Column:
    """Whether a channel is 1 to 16, omni or off."""
    return text.isin("omni", "off") | F.coalesce(text.try_cast("int").between(1, 16), F.lit(False))


def channels(rows: DataFrame, items: DataFrame, wired: DataFrame) -> DataFrame:
    """channels(setup, device, in, out, status, confirmed); wired(setup, device) are ends of midi links."""
    at = F.concat_ws("/", "setup", "device")
    return rules.together([
        rules.references(rows, "device", items, "id", "channel device unknown", at),
        *[violation(rows.where(F.col(c).isNotNull() & ~channel(F.col(c))), f"{c} channel", at, F.col(c)) for c in ("in", "out")],
        violation(rows.where(F.col("out") == "omni"), "out channel", at, F.col("out")),
        rules.domain(rows, "status", STATUSES, "channel status", at),
        _date_when_confirmed(rows, "confirmed channel without date", at),
        rules.unique(rows, ["setup", "device"], "channel recorded twice"),
        violation(rows.join(wired, ["setup", "device"], "left_anti"), "channel but no midi link", at, "", "WARN"),
    ])


def mentions(rows: DataFrame, texts: DataFrame, word: str = "midi") -> DataFrame:
    """(device, found): whether any of a device's texts(device, text) holds the word, in any case; null for a device without texts."""
    told = texts.where("text is not null").groupBy("device").agg(F.bool_or(F.contains(F.lower("text"), F.lit(word.lower()))).alias("found"))
    return rows.select("device").where("device is not null").distinct().join(told, "device", "left")


def channel_records(rows: DataFrame, items: DataFrame, wired: DataFrame, setups: DataFrame, texts: DataFrame, word: str = "midi") -> DataFrame:
    """The rules of `channels` and those of its records: setups(id) that are there, `thru` (as text) true or false, unconfirmed ones,
    and devices whose texts(device, text) never mention the word; a device without texts is not judged."""
    at = F.concat_ws("/", "setup", "device")
    known = rows.join(items.select(F.col("id").alias("device")).distinct(), "device", "left_semi")
    return rules.together([
        channels(rows, items, wired),
        rules.references(rows, "setup", setups, "id", "channel setup unknown", at),
        violation(rows.where("thru is not null and lower(thru) not in ('true', 'false')"), "thru is not true or false", at, F.col("thru")),
        violation(rows.where("status = 'unconfirmed'"), "channel unconfirmed", at, "", "WARN"),
        violation(mentions(known, texts, word).where("not found"), "texts never mention it", F.col("device"), word, "WARN"),
    ])


def controller_records(rows: DataFrame, targets: DataFrame, channels: DataFrame, items: DataFrame, setups: DataFrame) -> DataFrame:
    """controllers(id, setup, device, status, program): what a controller's record says of itself; program is the channel of its program
    changes, null if it sends none. targets(id, device) are those it is meant for and those it is said not to be."""
    at = F.col("id")
    own = channels.select("setup", "device", F.col("out").alias("_out"))
    return rules.together([
        rules.references(rows, "device", items, "id", "controller unknown", at),
        rules.references(rows, "setup", setups, "id", "controller setup unknown", at),
        rules.domain(rows, "status", STATUSES, "controller status", at),
        violation(rows.where("status = 'unconfirmed'"), "controller unconfirmed", at, "", "WARN"),
        violation(rows.where("program is not null").join(own, ["setup", "device"], "left").where("_out is distinct from cast(program as string)"), "program changes on another channel", at, F.col("_out")),
        rules.references(targets, "device", items, "id", "controller's target unknown", at),
    ])


def controllers(maps: DataFrame, channels: DataFrame, items: DataFrame, lines: DataFrame) -> DataFrame:
    """maps(setup, controller, target, channel, cc, parameter, doc), and lines(doc, line, text) of the sections that they cite. A line of the
    section must name the parameter (what stands before a parenthesis, in any case) and the number: each triple of section, name and number
    is looked up once, among the lines of its section that hold the number."""
    at = F.concat_ws("/", "controller", "target", F.col("cc").cast("string"))
    own = channels.select("setup", F.col("device").alias("controller"), F.col("out").alias("_out"))
    heard = channels.select("setup", F.col("device").alias("target"), F.col("in").alias("_in"))
    cited = maps.where("doc is not null").withColumn("_name", F.lower(F.substring_index(F.coalesce("parameter", F.lit("")), " (", 1)))
    there = cited.join(lines.select("doc").distinct(), "doc", "left_semi")
    numbers = F.regexp_extract_all("text", F.lit(r"(?<!\d)(-?\d+)"), F.lit(1))  # whole ones; -5 names 5 as well
    said = lines.select("doc", F.lower("text").alias("_text"), F.explode(F.array_distinct(F.concat(numbers, F.transform(numbers, lambda n: F.ltrim(n, F.lit("-")))))).alias("_cc"))
    asked = there.select("doc", "_name", "cc", F.col("cc").cast("string").alias("_cc")).distinct()
    told = asked.join(said.distinct(), ["doc", "_cc"]).where(F.contains("_text", "_name")).select("doc", "_name", "cc").distinct()
    return rules.together([
        violation(maps.join(own, ["setup", "controller"], "left").where("_out is distinct from cast(channel as string)"), "controller sends on another channel", at, F.col("_out")),
        rules.references(maps, "target", items, "id", "controller target unknown", at),
        violation(maps.where("cc is null or cc not between 0 and 127"), "controller number", at, F.col("cc")),
        violation(maps.join(heard, ["setup", "target"], "left").where("_in is distinct from cast(channel as string)"), "target does not listen", at, F.col("_in")),
        violation(cited.join(lines.select("doc").distinct(), "doc", "left_anti"), "cited section unknown", at, F.col("doc")),
        violation(there.join(told, ["doc", "_name", "cc"], "left_anti"), "no line names parameter and number", at, F.col("doc")),
    ])


def terminology(concepts: DataFrame, predicates: DataFrame, relations: DataFrame, homographs: DataFrame, tags: DataFrame, facets: DataFrame) -> DataFrame:
    """concepts(id, pref, alt[], broader[], close[], tag), predicates(id, domain[], range[]), relations(s, p, o),
    homographs(label, senses[]), tags(id), facets(id): the tops, one of which every concept must reach, and only one."""
    at = F.col("id")
    tops = facets.select("id").distinct()
    up = concepts.select("id", F.explode("broader").alias("parent"))
    near = concepts.select("id", F.explode("close").alias("other"))
    known = concepts.select("id").distinct()
    nodes = known.union(tops).distinct()
    above = graph.closure(up.join(nodes.withColumnRenamed("id", "parent"), "parent", "left_semi").select(F.col("id").alias("src"), F.col("parent").alias("dst"))).where("depth > 0")
    reached = above.join(tops.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").select(F.col("descendant").alias("id"), F.col("ancestor").alias("facet"))
    per = known.join(reached, "id", "left").groupBy("id").agg(F.array_sort(F.collect_set("facet")).alias("f"))  # a concept's few facets
    one = per.where("size(f) = 1").select("id", F.get("f", F.lit(0)).alias("facet")).union(tops.select("id", "id"))
    labels = concepts.select("id", F.explode(F.concat(F.array("pref"), F.coalesce("alt", F.array().cast("array<string>")))).alias("label")).select("id", terms.fold(F.col("label")).alias("label")).distinct()
    told = homographs.select("label", terms.fold(F.col("label")).alias("_key"))
    twice = labels.groupBy("label").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) > 1")
    declared = relations.join(predicates.select(F.col("id").alias("p"), "domain", "range"), "p")
    name = F.concat_ws(" ", "s", "p", "o")

    def ends(side: str, allowed: str, where: str) -> list[DataFrame]:
        there = declared.join(nodes.withColumnRenamed("id", side), side, "left_semi")
        typed = there.join(one.withColumnRenamed("id", side), side, "left")
        return [
            violation(declared.join(nodes.withColumnRenamed("id", side), side, "left_anti"), "relation end unknown", name, F.col(side)),
            violation(typed.where(~F.coalesce(F.array_contains(allowed, F.col("facet")), F.lit(False))), where, name, F.col(side)),
        ]

    both = above.select(F.col("descendant").alias("id"), F.col("ancestor").alias("other"))
    return rules.together([
        rules.unique(concepts, ["id"], "concept id twice"),
        violation(known.join(tops, "id", "left_semi"), "concept is a facet as well", at),
        violation(concepts.where("size(coalesce(broader, array())) = 0"), "concept without a broader one", at),
        rules.references(up, "parent", nodes, "id", "broader concept unknown", at),
        rules.references(near, "other", known, "id", "close match unknown", at),
        rules.references(concepts, "tag", tags, "id", "tag not in the vocabulary", at),
        violation(graph.cycle_paths(up.select(F.col("id").alias("src"), F.col("parent").alias("dst"))), "hierarchy has a cycle", F.col("root"), F.array_join("path", " > ")),
        violation(per.where("size(f) > 1"), "more than one facet", at, F.array_join("f", ", ")),
        violation(per.where("size(f) = 0"), "no facet", at),
        violation(twice, "label of several concepts", F.col("label"), F.array_join("ids", ", ")),
        violation(told.join(labels.select(F.col("label").alias("_key")).distinct(), "_key", "left_semi"), "homograph is a concept's label", F.col("label")),
        violation(homographs.where("size(coalesce(senses, array())) < 2"), "homograph with fewer than two senses", F.col("label")),
        rules.references(homographs.select("label", F.explode("senses").alias("sense")), "sense", known, "id", "homograph sense unknown", F.col("label")),
        violation(near.join(both.union(both.select("other", "id")), ["id", "other"], "left_semi").union(near.where("id = other")), "close match within the hierarchy", at, F.col("other")),
        violation(relations.join(predicates.select(F.col("id").alias("p")), "p", "left_anti"), "predicate not declared", name, F.col("p")),
        *ends("s", "domain", "subject outside the domain"),
        *ends("o", "range", "object outside the range"),
        rules.unique(relations, ["s", "p", "o"], "relation twice"),
    ])


REQUIRED = ["id", "doc", "title", "body"]


def sections(rows: DataFrame, docs: DataFrame, tags: DataFrame, files: DataFrame, least: int = 60, most: int = 30_000) -> DataFrame:
    """sections(id, doc, title, body, tags[], sha256, path): fields, tags, references, length, titles, digests, links."""
    at = F.col("id")
    size = rows.withColumn("_n", F.length("body"))
    return rules.together([
        *[violation(rows.where(F.coalesce(F.trim(F.col(c)), F.lit("")) == ""), f"section without {c}", at) for c in REQUIRED],
        rules.references(rows.select("id", F.explode("tags").alias("tag")), "tag", tags, "id", "section tag not in the vocabulary", at),
        rules.references(rows, "doc", docs, "id", "section document unknown", at),
        rules.within(size, "_n", least, most, "section length", at, "WARN"),
        rules.unique(rows.withColumn("title", F.lower("title")).where("title is not null"), ["doc", "title"], "title twice in a document", "WARN"),
        violation(rows.where("sha256 is not null and sha256 <> sha2(body, 256)"), "section changed since its digest", at),
        violation(broken_links(rows, files), "broken link", at, F.col("target")),
    ])


def broken_links(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(id, target) of relative Markdown links in `body` whose file isn't among files(path); rows have a `path` of their own.

    `.` and `..` are resolved against the folder of the row's path; anchors, mail and absolute addresses are left alone.
    """
    x = rows.select("id", "path", F.explode(F.regexp_extract_all("body", F.lit(r"\]\(([^)\s]+)[^)]*\)"), F.lit(1))).alias("link"))
    x = x.where(~F.col("link").rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|#|/)")).withColumn("link", F.regexp_replace("link", "[#?].*$", "")).where("link <> ''")
    parts = F.filter(F.split(F.concat(F.regexp_replace(F.coalesce("path", F.lit("")), "[^/]*$", ""), F.col("link")), "/"), lambda p: (p != "") & (p != "."))
    step = lambda s, p: F.when((p == "..") & (F.size(s) > 0), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p)))
    x = x.withColumn("target", F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return x.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_anti").select("id", "target")


def pictures(rows: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """pictures(id, device, file, type, source) and the files(path) that are there."""
    at = F.col("id")
    return rules.together([
        rules.references(rows, "device", items, "id", "picture device unknown", at),
        rules.references(rows, "file", files, "path", "picture file missing", at),
        rules.domain(rows, "type", PICTURES, "picture type", at),
        rules.required(rows, "source", F.lit(True), "picture without source", at),
        violation(files.join(rows.select(F.col("file").alias("path")), "path", "left_anti"), "file of no picture", F.col("path")),
        violation(items.where("in_use").join(rows.select(F.col("device").alias("id")), "id", "left_anti"), "item without picture", at, "", "WARN"),
    ])


def code(vertices: DataFrame, edges: DataFrame, covers: DataFrame, labels: DataFrame, readme_paths: DataFrame, declared: DataFrame) -> DataFrame:
    """Code graph against its documents: covers(section, action, body) says which section documents which action, labels
    (action, label) what it is called on screen, readme_paths(path) what a README names, declared(file, dataset) what a file
    says it writes."""
    e = lambda rel: edges.where(F.col("rel") == rel)
    kind = lambda k: vertices.where(F.col("type") == k).select("id")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")
    drift = covers.join(labels, "action").where(~F.contains(plain(F.col("body")), F.trim(plain(F.col("label")))))
    wrote = e("WRITES").select(F.col("src").alias("file"), F.col("dst").alias("dataset"))
    return rules.together([
        violation(e("REQUESTS").select(F.col("dst").alias("id")).distinct().join(e("SERVED_BY").select(F.col("src").alias("id")), "id", "left_anti"), "route that nothing serves", F.col("id")),
        violation(kind("ui_action").join(covers.select(F.col("action").alias("id")), "id", "left_anti"), "action without documentation", F.col("id"), "", "WARN"),
        violation(covers.join(kind("ui_action").select(F.col("id").alias("action")), "action", "left_anti"), "documented action does not exist", F.col("section"), F.col("action")),
        violation(drift, "label not in the section", F.col("section"), F.col("label")),
        violation(readme_paths.join(kind("code_file").select(F.col("id").alias("path")), "path", "left_anti"), "path that is no file", F.col("path")),
        violation(declared.join(wrote, ["file", "dataset"], "left_anti"), "declared write not performed", F.col("file"), F.col("dataset")),
    ])


SLUG = "^[a-z0-9][a-z0-9-]{0,63}$"


def session(sessions: DataFrame, nodes: DataFrame, cables: DataFrame, ports: DataFrame) -> DataFrame:
    """sessions(name), nodes(session, uid, device), cables(session, uid, from_uid, to_uid, medium), ports(device, name, dir, medium)."""
    node, cable = F.concat_ws("/", "session", F.coalesce("uid", F.lit("?"))), F.concat_ws("/", "session", "uid")
    ends = [violation(cables.join(nodes.select("session", F.col("uid").alias(c)), ["session", c], "left_anti"), "cable end is no node", cable, F.col(c)) for c in ("from_uid", "to_uid")]
    return rules.together([
        violation(sessions.where(~F.col("name").rlike(SLUG)), "session name", F.col("name")),
        violation(nodes.where("uid is null or device is null"), "node without uid or device", node),
        rules.unique(nodes.where("uid is not null"), ["session", "uid"], "node uid twice"),
        *ends,
        violation(cables.where("from_uid = to_uid"), "cable to its own node", cable),
        rules.domain(cables, "medium", MEDIA, "cable medium", cable),
        rules.domain(ports, "dir", DIRECTIONS, "port direction", F.concat_ws("/", "device", "name")),
        rules.domain(ports, "medium", MEDIA, "port medium", F.concat_ws("/", "device", "name")),
    ])


def named_once(ports: DataFrame) -> DataFrame:
    """ports(device, ord, name, ...) without a name met before in its device, in any case, and without blank names."""
    r = F.row_number().over(Window.partitionBy("device", F.upper(F.trim("name"))).orderBy("ord"))
    return ports.where(F.trim("name") != "").withColumn("_r", r).where("_r = 1").drop("_r")


def receive_clashes(nodes: DataFrame, cables: DataFrame, channels: DataFrame) -> DataFrame:
    """Devices that receive on one channel in one component of midi cables: nodes(uid, device), cables(from_node, to_node,
    medium), channels(device, in). omni, off and all don't clash, nor do two nodes of one device."""
    midi = cables.where(F.col("medium").isin("midi", "usb")).select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
    part = graph.components(midi, nodes.select(F.col("uid").alias("id"))).withColumnRenamed("id", "uid")
    heard = nodes.join(part, "uid").join(channels.select("device", F.col("in").alias("ch")), "device").where(F.col("ch").isNotNull() & ~F.col("ch").isin(NO_CHANNEL))
    g = heard.groupBy("component", "ch").agg(F.array_sort(F.collect_set("device")).alias("devices")).where("size(devices) > 1")
    return violation(g, "same receive channel", F.concat_ws("/", F.col("component").cast("string"), "ch"), F.array_join("devices", ", "), "WARN")


def low_coverage(recall: DataFrame, key: str, least: float = 0.95) -> DataFrame:
    """Of text.recall() rows those under the share that a conversion must keep."""
    return violation(recall.where(F.col("occurrence_recall") < least), "conversion lost text", F.col(key), F.round("occurrence_recall", 4), "WARN")
