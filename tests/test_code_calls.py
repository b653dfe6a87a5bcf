"""Which function a call means: own file, class, imports, scope; files with equal names; files that aren't valid."""

from pyspark.sql import functions as F

from kgspark.sources import code, readers

A = '''
import sys
import lib.store as st
from util import load, save as keep
from .near import close
from lib import store
from lib.store import Box


def load_all(path):
    load(path)
    keep(path)
    st.write(path)
    store.write(path)
    close()
    Box.make()
    run(path)
    sys.exit(0)
    path.write()
    load_all(path)


def run(load):
    load()
    helper = len
    helper()
    print(missing())


def helper():
    pass


class Job:
    def go(self):
        self.stop()
        helper()
        other.stop()

    def stop(self):
        def inner():
            helper()

        inner()
'''
UTIL = "def load(p):\n    run(p)\n\n\ndef run(p):\n    pass\n\n\ndef save(p):\n    load(p)\n"
STORE = "class Box:\n    @classmethod\n    def make(cls):\n        return cls.size() + write(1)\n\n    @classmethod\n    def size(cls):\n        return 1\n\n\ndef write(p):\n    pass\n\n\ndef write(p):\n    load(p)\n"
NEAR = "from .. import top\nfrom ..top import first\n\n\ndef close():\n    top.second()\n    first()\n    load(1)\n"
JS_A = "import { draw as paint } from './b.js';\nimport * as ns from './b';\nfunction start() { paint(1); ns.draw(2); shared(); local(); }\nfunction local() { const draw = 1; draw(2); start(); if (x) { y.start() } }\nfunction draw() {}\n"
JS_B = "export function draw(a) { shared(a) }\nexport const shared = async (a) => local(a)\n"
JS_C = "function shared() {}\n"


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "file string, text string")


def calls_of(spark, files):
    return sorted(f"{r.file}:{r.scope} > {r.target}:{r.name}" for r in code.calls(code.symbols(table(spark, files))).collect())


def test_calls_are_resolved(spark):
    files = {"app/tools/a.py": A, "app/tools/util.py": UTIL, "app/lib/store.py": STORE, "app/tools/near.py": NEAR, "app/top.py": "def first():\n    pass\n\n\ndef second():\n    pass\n", "util.py": "def load():\n    pass\n", "bad.py": "def broken(:", "no.py": None, "x.txt": "def load(): run()"}
    assert calls_of(spark, files) == sorted([
        "app/lib/store.py:Box.make > app/lib/store.py:Box.size", "app/lib/store.py:Box.make > app/lib/store.py:write",
        "app/tools/a.py:Job.go > app/tools/a.py:Job.stop", "app/tools/a.py:Job.go > app/tools/a.py:helper", "app/tools/a.py:Job.stop > app/tools/a.py:helper",
        "app/tools/a.py:load_all > app/lib/store.py:Box.make", "app/tools/a.py:load_all > app/lib/store.py:write", "app/tools/a.py:load_all > app/tools/a.py:run",
        "app/tools/a.py:load_all > app/tools/near.py:close", "app/tools/a.py:load_all > app/tools/util.py:load", "app/tools/a.py:load_all > app/tools/util.py:save",
        "app/tools/near.py:close > app/top.py:first", "app/tools/near.py:close > app/top.py:second",
        "app/tools/util.py:load > app/tools/util.py:run", "app/tools/util.py:save > app/tools/util.py:load",
    ])


def test_calls_of_scripts(spark):
    assert calls_of(spark, {"web/a.js": JS_A, "web/b.js": JS_B, "web/c.js": JS_C}) == sorted([
        "web/a.js:start > web/b.js:draw", "web/a.js:start > web/c.js:shared", "web/a.js:start > web/a.js:local", "web/a.js:local > web/a.js:start",
        "web/b.js:draw > web/b.js:shared", "web/b.js:shared > web/a.js:local",
    ])


def test_equal_names_stay_two_vertices(spark):
    found = code.symbols(table(spark, {"a/x.py": UTIL, "b/x.py": UTIL}))
    none = spark.createDataFrame([], "file string, method string, route string")
    edges = {tuple(r) for r in code.graph_edges(none, none.select("file", "route"), found).collect()}
    assert {(f"file:{d}/x.py", f"fn:{d}/x.py:load", "CONTAINS") for d in "ab"} <= edges
    assert {e for e in edges if e[2] == "CALLS"} == {(f"fn:{d}/x.py:{s}", f"fn:{d}/x.py:{t}", "CALLS") for d in "ab" for s, t in (("load", "run"), ("save", "load"))}
    assert calls_of(spark, {}) == []


def test_modules_are_the_nearest_ones(spark):
    files = spark.createDataFrame([("/r/util.py",), ("/r/a/util.py",), ("/r/a/b/c.py",), ("/r/pkg/__init__.py",)], "file string")
    asked = spark.createDataFrame([("/r/a/b/c.py", "util", False), ("/r/x/y.py", "util", False), ("/r/a/b/c.py", "pkg", False), ("/r/a/b/c.py", "a/util", False), ("/r/a/b/c.py", "r/util", True), ("/r/a/b/c.py", "none", False), ("q.py", "util", False)], "file string, module string, exact boolean")
    got = {(r.file, r.module): r.target for r in code.modules(asked, files).collect()}
    assert got == {("/r/a/b/c.py", "util"): "/r/a/util.py", ("/r/x/y.py", "util"): "/r/util.py", ("/r/a/b/c.py", "pkg"): "/r/pkg/__init__.py", ("/r/a/b/c.py", "a/util"): "/r/a/util.py", ("/r/a/b/c.py", "r/util"): "/r/util.py"}


def test_one_broken_file_does_not_fail_the_others(spark, tmp_path):
    (tmp_path / "ok.py").write_text("def f():\n    g()\n")
    (tmp_path / "bad.py").write_text("def f(:")
    assert [(r.name, r.calls) for r in readers.functions(spark, f"{tmp_path}/*.py", "python").collect()] == [("f", ["g"])]
    assert code.files(spark, str(tmp_path)).where(F.col("text").isNull()).count() == 0
