"""Source code as a graph: files, functions, calls, routes, switch cases, labels on screen, comments.

Patterns over whole files run in the JVM; Python's own syntax is read with `ast` in Arrow batches. A file that isn't valid Python
gives no functions. What a file defines, imports and calls are rows of their own (`symbols`); which function a call means is
settled by joins (`calls`), so no file is read together with another.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import route as normal_route


def files(spark: SparkSession, path: str, tracked: list[str] | None = None) -> DataFrame:
    """(file, text) of whole files; where names of tracked files are given, of those only."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.regexp_replace(F.col("_metadata.file_path"), r"^.*?:/*(?=/)", "").alias("file"), F.col("value").alias("text"))
    if tracked is None:
        return df
    names = spark.createDataFrame([(t,) for t in tracked], "tracked string")
    ends = df.withColumn("_parts", F.split("file", "/")).withColumn("_n", F.explode(F.sequence(F.lit(1), F.size("_parts"))))
    ends = ends.withColumn("tracked", F.array_join(F.slice("_parts", F.size("_parts") - F.col("_n") + 1, F.col("_n")), "/"))
    return ends.join(names, "tracked").select(F.col("tracked").alias("file"), "text")


def _each(df: DataFrame, pattern: str, group: int, name: str) -> DataFrame:
    return df.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("at", name))


def api_calls(df: DataFrame) -> DataFrame:
    """(file, method, route): requests in scripts. Without a method of its own a request is a GET."""
    call = r"""(?s)(?:fetch|api|request)\(\s*[`'"]([^`'"]+)[`'"]([^;]{0,200})"""
    x = df.select("file", F.arrays_zip(F.regexp_extract_all("text", F.lit(call), F.lit(1)).alias("route"), F.regexp_extract_all("text", F.lit(call), F.lit(2)).alias("rest")).alias("c")).select("file", F.explode("c").alias("c"))
    method = F.upper(F.regexp_extract("c.rest", r"""method\s*:\s*['"`](\w+)""", 1))
    return x.select("file", F.when(method == "", "GET").otherwise(method).alias("method"), normal_route(F.col("c.route")).alias("route")).distinct()


def served_routes(df: DataFrame) -> DataFrame:
    """(file, route): paths that handlers compare, match or are registered for."""
    told = r"""(?:path\s*(?:==|\.startswith\()\s*|@\w+\.(?:route|get|post|put|delete)\(\s*|re\.(?:full)?match\(\s*r?)['"](/[^'"]*)['"]"""
    return _each(df, told, 1, "route").select("file", normal_route(F.regexp_replace(F.regexp_replace("route", r"[\^$]", ""), r"\([^)]*\)", ":id")).alias("route")).distinct()


def switch_cases(df: DataFrame) -> DataFrame:
    """(file, case): values that switches tell apart."""
    return _each(df, r"""\bcase\s+['"]([^'"]+)['"]\s*:""", 1, "case").select("file", "case").distinct()


def labels(df: DataFrame) -> DataFrame:
    """(file, action, label): what a button that carries data-action is called on screen."""
    button = r"""(?s)<(?:button|a)\b[^>]*\bdata-action="([^"]+)"[^>]*>(.*?)</(?:button|a)>"""
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(button), F.lit(1)).alias("action"), F.regexp_extract_all("text", F.lit(button), F.lit(2)).alias("label"))
    x = df.select("file", F.explode(pairs).alias("c"))
    return x.select("file", "c.action", F.trim(F.regexp_replace(F.regexp_replace("c.label", "<[^>]*>", " "), r"\s+", " ")).alias("label")).where("label <> ''").distinct()


def comments(text: Column, language: str) -> Column:
    """The comments of a file as lines: # in Python, // and /* */ elsewhere. A mark inside a string counts as one as well."""
    if language == "python":
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)(?:^|\s)#+[ \t]*(.+)$"), F.lit(1)), F.trim), "\n")
    line = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)(?:^|[^:])//+[ \t]*(.+)$"), F.lit(1)), F.trim)
    block = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)/\*(.*?)\*/"), F.lit(1)), lambda b: F.trim(F.regexp_replace(b, r"(?m)^\s*\*+[ \t]?|\s+$", "")))
    return F.array_join(F.concat(line, block), "\n")


def docstrings(df: DataFrame) -> DataFrame:
    """(file, name, text): docstrings of a Python file (name '') and of its classes and functions."""

    def go(batches):
        import ast

        import pyarrow as pa

        for batch in batches:
            rows = []
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.Module | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) and (doc := ast.get_docstring(node)):
                        rows.append((file, getattr(node, "name", ""), doc))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols], names=["file", "name", "text"])

    return df.select("file", "text").mapInArrow(go, "file string, name string, text string")


SYMBOLS = "file string, kind string, scope string, base string, name string, module string, exact boolean, line int"


def _python_symbols(file: str, text: str) -> list[tuple]:
    import ast

    functions_ = (ast.FunctionDef, ast.AsyncFunctionDef)
    tree = ast.parse(text)
    defined = {}  # of equal names the last one holds
    for node in tree.body:
        if isinstance(node, functions_):
            defined[node.name] = node
        elif isinstance(node, ast.ClassDef):
            defined.update({f"{node.name}.{m.name}": m for m in node.body if isinstance(m, functions_)})
    rows = []
    folder = file.strip("/").split("/")[:-1]
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            rows += [("import", None, a.asname or a.name, None, a.name.replace(".", "/"), False, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.level <= len(folder) + 1:
            path = (node.module or "").replace(".", "/")
            if node.level:  # from the file's own folder upwards
                path = "/".join([*folder[: len(folder) - node.level + 1], *([path] if path else [])])
            rows += [("import", None, a.asname or a.name, a.name, path, node.level > 0, node.lineno) for a in node.names]
    for name, node in defined.items():
        rows.append(("def", None, None, name, None, None, node.lineno))
        inside = list(ast.walk(node))
        bound = {n.arg for n in inside if isinstance(n, ast.arg)} | {n.id for n in inside if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        bound |= {n.name for n in inside if isinstance(n, (*functions_, ast.ClassDef)) and n is not node}
        bound -= {g for n in inside if isinstance(n, ast.Global) for g in n.names} | {"self", "cls"}
        for call in (n.func for n in inside if isinstance(n, ast.Call)):
            chain = []
            while isinstance(call, ast.Attribute):
                chain.append(call.attr)
                call = call.value
            if isinstance(call, ast.Name) and call.id not in bound:
                *base, last = [call.id, *reversed(chain)]
                rows.append(("call", name, ".".join(base) or None, last, None, None, None))
    return rows


def _script_symbols(file: str, text: str) -> list[tuple]:
    import posixpath

    starts = [(m.start(), m.end(), m.group(1) or m.group(2)) for m in re.finditer(r"(?m)^(?:export\s+(?:default\s+)?)?(?:(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>)", text)]
    rows = []
    for m in re.finditer(r"(?m)^import\s+(?:\{([^}]*)\}|\*\s*as\s+([\w$]+))\s*from\s*['\"](\.[^'\"]*)['\"]", text):
        path = posixpath.normpath(posixpath.join(posixpath.dirname(file), m.group(3))).strip("/")
        path += "" if path.endswith((".js", ".mjs")) else ".js"
        line = text.count("\n", 0, m.start()) + 1
        named = [p.split(" as ") for p in re.sub(r"\s+", " ", m.group(1) or "").split(",") if p.strip()]
        rows += [("import", None, p[-1].strip(), p[0].strip(), path, True, line) for p in named]
        if m.group(2):
            rows.append(("import", None, m.group(2), None, path, True, line))
    bodies = {name: (at, text[end:until]) for (at, end, name), until in zip(starts, [s for s, _, _ in starts[1:]] + [len(text)], strict=True)}
    for name, (at, body) in bodies.items():
        rows.append(("def", None, None, name, None, None, text.count("\n", 0, at) + 1))
        bound = set(re.findall(r"\b(?:const|let|var|function)\s+([A-Za-z_$][\w$]*)", body))
        for base, last in re.findall(r"(?<![\w$.])(?:([A-Za-z_$][\w$]*)\.)?([A-Za-z_$][\w$]*)\s*\(", body):
            if (base or last) not in bound:
                rows.append(("call", name, base or None, last, None, None, None))
    return rows


def symbols(df: DataFrame) -> DataFrame:
    """What each of the Python and JavaScript files df(file, text) defines, imports and calls; one row each.

    `def`: a top-level function, or a method as Class.method, with its line. `import`: `base` is the name it has here, `name` the
    one there (null: the module itself), `module` a path; exact if it was given from the file's own place. `call`: `scope` is the
    function that calls, `base` what stands before the last dot. Names that the calling function binds itself (parameters,
    assignments, inner functions) are no calls of other functions. Scripts are read by pattern: what looks like a call in a string
    or comment is one. Files of other kinds, null texts and files that aren't valid give no rows.
    """

    def go(batches):
        import pyarrow as pa

        kinds = [pa.string()] * 6 + [pa.bool_(), pa.int32()]
        names = ["file", "kind", "scope", "base", "name", "module", "exact", "line"]
        for batch in batches:
            rows = []
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                read = _python_symbols if file.endswith(".py") else _script_symbols
                try:
                    rows += [(file, *r) for r in read(file, text)]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return df.where("text is not null").select("file", "text").where(F.col("file").rlike(r"\.(?:py|m?js)$")).mapInArrow(go, SYMBOLS)


def modules(imports: DataFrame, files_: DataFrame) -> DataFrame:
    """(file, module, exact, target): the file that each module path of imports(file, module, exact) means.

    An exact path is that file. Any other is looked for in the importing file's folder, then in each one above it, so the
    nearest folder that holds it decides; a path has one file, so no import meets more rows than its folder is deep.
    """
    path = F.regexp_replace(F.regexp_replace("file", "^/+", ""), r"(?:/__init__)?\.py$", "")
    held = files_.select(path.alias("path"), F.col("file").alias("target")).groupBy("path").agg(F.min("target").alias("target"))
    asked = imports.select("file", "module", "exact").distinct()
    folders = F.filter(F.split(F.regexp_replace("file", "/*[^/]*$", ""), "/"), lambda d: d != "")
    depth = F.when(F.col("exact"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("_folders")))
    asked = asked.withColumn("_folders", folders).withColumn("_k", F.explode(depth))
    asked = asked.withColumn("path", F.array_join(F.filter(F.concat(F.slice("_folders", F.lit(1), F.col("_k")), F.array("module")), lambda d: d != ""), "/"))
    return asked.join(held, "path").groupBy("file", "module", "exact").agg(F.max(F.struct("_k", "target")).alias("_m")).select("file", "module", "exact", F.col("_m.target").alias("target"))


def calls(found: DataFrame) -> DataFrame:
    """(file, scope, target, name): which function of which file each call of symbols() means.

    In this order: a function of the same file (self.f and cls.f: of the same class; C.f: of the class C there), an imported
    function or one of an imported module or class, and for scripts, which share one page, the last file's function of that name.
    Calls of itself, of what no file defines, and of methods of other objects are left out.
    """
    defined = found.where("kind = 'def'").select(F.col("file").alias("target"), "name").distinct()
    asked = found.where("kind = 'call'").select("file", "scope", "base", F.col("name").alias("call")).distinct()
    imports = found.where("kind = 'import'").select("file", F.col("base").alias("alias"), F.col("name").alias("there"), "module", "exact").distinct()
    deeper = F.array_join(F.filter(F.array("module", "there"), lambda d: d.isNotNull() & (d != "")), "/")
    wanted = imports.select("file", "module", "exact").union(imports.where("there is not null").select("file", deeper, "exact"))
    where = modules(wanted, found.select("file").distinct())

    def step(rank: int, df: DataFrame, target: Column, name: Column) -> DataFrame:
        return df.select("file", "scope", "base", "call", F.lit(rank).alias("rank"), target.alias("target"), name.alias("name"))

    of_class = F.substring_index("scope", ".", 1)
    own = F.when(F.col("base").isNull(), F.col("call")).when(F.col("base").isin("self", "cls") & F.contains(F.col("scope"), F.lit(".")), F.concat_ws(".", of_class, "call")).otherwise(F.concat_ws(".", "base", "call"))
    named = asked.withColumn("alias", F.coalesce("base", "call")).join(imports, ["file", "alias"])
    at = named.join(where, ["file", "module", "exact"])
    inside = named.where("base is not null and there is not null").withColumn("module", deeper).join(where, ["file", "module", "exact"])
    meant = F.when(F.col("base").isNull(), F.col("there")).when(F.col("there").isNull(), F.col("call")).otherwise(F.concat_ws(".", "there", "call"))
    scripts = defined.where(F.col("target").rlike(r"\.m?js$")).groupBy("name").agg(F.max("target").alias("target"))
    shared = asked.where(F.col("base").isNull() & F.col("file").rlike(r"\.m?js$")).join(scripts, F.col("call") == F.col("name"))
    every = step(1, asked, F.col("file"), own).union(step(2, at, F.col("target"), meant)).union(step(2, inside, F.col("target"), F.col("call"))).union(step(3, shared, F.col("target"), F.col("call")))
    every = every.where((F.col("file") != F.col("target")) | (F.col("scope") != F.col("name"))).join(defined, ["target", "name"])
    best = every.groupBy("file", "scope", "base", "call").agg(F.min(F.struct("rank", "target", "name")).alias("_m"))
    return best.select("file", "scope", F.col("_m.target").alias("target"), F.col("_m.name").alias("name")).distinct()


def graph_edges(requests: DataFrame, served: DataFrame, found: DataFrame) -> DataFrame:
    """(src, dst, rel) of a code graph: files contain functions, functions call functions, files request and serve routes. A
    function is `fn:<file>:<name>`, so equal names of different files stay apart; found: symbols()."""
    fn = lambda at, name: F.concat(F.lit("fn:"), F.col(at), F.lit(":"), F.col(name))
    file, route = (lambda c: F.concat(F.lit("file:"), c)), (lambda c: F.concat(F.lit("route:"), c))
    parts = [
        found.where("kind = 'def'").select(file(F.col("file")).alias("src"), fn("file", "name").alias("dst"), F.lit("CONTAINS").alias("rel")),
        calls(found).select(fn("file", "scope"), fn("target", "name"), F.lit("CALLS")),
        requests.select(file(F.col("file")), route(F.col("route")), F.lit("REQUESTS")),
        served.select(route(F.col("route")), file(F.col("file")), F.lit("SERVED_BY")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()
