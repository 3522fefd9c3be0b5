"""The graph kept up to date over deliveries, against a full build."""

import datetime
import random

from risklens.operators.imports import build_edges
from risklens.operators.units import symbols
from risklens.streaming import graph_index

SCHEMA = "project_name string, file_path string, content string, analyzed_at timestamp"


def _day(n):
    return datetime.datetime(2024, 1, n)


def _apply(spark, folder, batch, rows):
    graph_index.apply_delivery(spark, folder, spark.createDataFrame([("p", *r) for r in rows], SCHEMA), batch)


def _edges(df):
    return sorted((r.src, r.stmt_seq, r.pos, r.dst) for r in df.collect())


def test_a_new_file_reaches_statements_that_named_it(spark, tmp_path):
    folder = str(tmp_path)
    _apply(spark, folder, 0, [("a.py", "import lib.db\nfrom lib import tool\n", _day(1)), ("b.py", "import a; import lib.db\n", _day(1))])
    assert _edges(graph_index.read_edges(spark, folder)) == [("b.py", 1, 0, "a.py")]
    # the package form comes first, then the module, which counts more
    _apply(spark, folder, 1, [("lib/db/__init__.py", "", _day(1))])
    assert [e[3] for e in _edges(graph_index.read_edges(spark, folder)) if e[3] != "a.py"] == ["lib/db/__init__.py"] * 2
    _apply(spark, folder, 2, [("lib/db.py", "", _day(1)), ("lib/tool.py", "def t(): pass\n", _day(1))])
    assert _edges(graph_index.read_edges(spark, folder)) == [
        ("a.py", 1, 0, "lib/db.py"), ("a.py", 2, 1, "lib/tool.py"), ("b.py", 1, 0, "a.py"), ("b.py", 1, 65536, "lib/db.py")
    ]
    # a changed file loses its former statements, a late version changes nothing
    _apply(spark, folder, 3, [("a.py", "x = 1\n", _day(2)), ("b.py", "", datetime.datetime(2023, 1, 1))])
    _apply(spark, folder, 3, [("a.py", "x = 1\n", _day(2)), ("b.py", "", datetime.datetime(2023, 1, 1))])
    assert [e[0] for e in _edges(graph_index.read_edges(spark, folder))] == ["b.py", "b.py"]
    rows = {r.file_path: r for r in graph_index.read_indexed(spark, folder).collect()}
    assert rows["b.py"].imports == ["a.py", "lib/db.py"] and rows["a.py"].imports == [] and rows["lib/tool.py"].functions == ["t"]


def test_deliveries_equal_a_full_build(spark, tmp_path):
    rng, folder, now = random.Random(2), str(tmp_path), {}
    paths = [f"{d}{m}.py" for d in ("", "pkg/", "pkg/sub/") for m in ("__init__", "a", "b", "c")]
    lines = ["import pkg.a", "import pkg", "from . import b", "from .. import c", "from .a import x", "from pkg.sub import a, c", "import a; from .b import *", "def f(): import pkg.sub.b"]
    for batch in range(5):
        rows = []
        for path in rng.sample(paths, 4):
            content = "\n".join(rng.sample(lines, rng.randint(0, 5)) + [f"def g{batch}(): pass", ""])
            now[path] = content
            rows.append((path, content, _day(batch + 1)))
        _apply(spark, folder, batch, rows)
    files = spark.createDataFrame([("p", k, v) for k, v in now.items()], "project_name string, file_path string, content string")
    assert _edges(graph_index.read_edges(spark, folder)) == _edges(build_edges(files))
    indexed = {r.file_path: (r.content, r.functions) for r in graph_index.read_indexed(spark, folder).collect()}
    assert indexed == {r.file_path: (now[r.file_path], r.functions) for r in symbols(files).collect()}
