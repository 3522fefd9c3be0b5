import os
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from risklens.operators import graph, imports, tree
from risklens.operators.imports import build_edges, import_candidates
from risklens.operators.units import extract_imports
from risklens.session import TIDY, materialize

REPO = {
    "main.py": "import os\nimport helper\nfrom app.utils.db import connect\n\ndef main():\n    helper.greet()\n",
    "helper.py": "def greet():\n    print('hi')\n",
    "app/__init__.py": "",
    "app/utils/__init__.py": "",
    "app/utils/db.py": "from app.utils import config\n\ndef connect():\n    return config.get_db_url()\n",
    "app/utils/config.py": "def get_db_url():\n    return 'x'\n",
    "app/auth.py": "from .utils.db import connect\nfrom . import views\nfrom ..outside import x\n",
    "app/views.py": "def view():\n    pass\n",
}


def _edges(df, **kw):
    return {(r.src, r.dst) for r in build_edges(df, **kw).collect()}


def test_edges_of_a_small_repo(corpus):
    assert _edges(corpus(REPO)) == {
        ("main.py", "helper.py"), ("main.py", "app/utils/db.py"),
        ("app/utils/db.py", "app/utils/__init__.py"), ("app/utils/db.py", "app/utils/config.py"),
        ("app/auth.py", "app/utils/db.py"), ("app/auth.py", "app/__init__.py"), ("app/auth.py", "app/views.py"),
    }


def test_bare_dot_import_keeps_its_extra_dot_on_request(corpus):
    assert ("app/auth.py", "app/views.py") not in _edges(corpus(REPO), compat=True)


def test_standard_and_unknown_modules_give_no_edge(corpus):
    df = corpus({"a.py": "import os, sys\nimport json\nfrom pathlib import Path\nimport missing\nfrom fake import m\n",
                 "os.py": "", "json.py": ""})
    assert _edges(df) == set()


def test_candidates(corpus):
    source = (
        "import a, b\nimport c as d\nimport e as f, g\nfrom m import x, y as z\nfrom n import *\nfrom o import (\n  p,  # c\n  q,\n)\n"
        "from .r import s\nfrom . import t\n"
    )
    rows = import_candidates(extract_imports(corpus({"t.py": source}))).orderBy("stmt_seq", "pos").collect()
    assert [(r.stmt_seq, r.module) for r in rows] == [
        (1, "a"), (3, "g"), (4, "m"), (4, "m.x"), (4, "m.y"), (5, "n"), (6, "o"), (6, "o.p"), (6, "o.q"),
        (10, ".r"), (10, ".r.s"), (11, "."), (11, ".t"),
    ]


def test_one_statement_keeps_a_target_once_and_statements_repeat_it(corpus):
    df = corpus({"a.py": "from b import x\nfrom b import y\nimport a\n", "b.py": ""})
    rows = sorted((r.src, r.dst, r.stmt_seq) for r in build_edges(df).collect())
    assert rows == [("a.py", "a.py", 3), ("a.py", "b.py", 1), ("a.py", "b.py", 2)]


def test_levels_go_up_and_leave_the_root_unresolved(corpus):
    df = corpus({"p/q/r.py": "from ...top import x\nfrom ..mid import y\nfrom ....far import z\n",
                 "top.py": "", "p/mid.py": "", "far.py": ""})
    assert _edges(df) == {("p/q/r.py", "top.py"), ("p/q/r.py", "p/mid.py")}


def test_a_module_file_comes_before_a_package(corpus):
    df = corpus({"a.py": "import m\nfrom .n import x\n", "m.py": "", "m/__init__.py": "", "n/__init__.py": "", "n.py": ""})
    assert _edges(df) == {("a.py", "m.py"), ("a.py", "n.py")}


def _bundle(spark, files, target, depth):
    roots = spark.createDataFrame([("p", target)], "project_name string, root string")
    rows = graph.context_bundle(files, build_edges(files), roots, depth).collect()
    return rows[0].bundle if rows else None


def test_context_grows_with_depth(spark, corpus):
    files = corpus(REPO)
    one, two = _bundle(spark, files, "main.py", 1), _bundle(spark, files, "main.py", 2)
    assert "def main():" in one and "def greet():" in one and "def get_db_url" not in one
    assert one.index("Context: helper.py") < one.index("Context: app/utils/db.py") < one.index("Target: main.py")
    assert "def get_db_url" in two
    # an empty file has no section
    assert "__init__" not in two


def test_cycle_and_missing_target(spark, corpus):
    files = corpus({"a.py": "import b\n", "b.py": "import a\n"})
    assert _bundle(spark, files, "a.py", 5) == (
        "=== Context: b.py ===\nimport a\n\n\n=== Target: a.py ===\nimport b\n"
    )
    assert _bundle(spark, files, "nothing.py", 2) is None


def test_bundle_of_many_sections_is_one_text(spark, corpus):
    n = 310
    names = [f"d{i}/same.py" if i in (3, 305) else f"m{i}.py" for i in range(n)]
    calls = "".join(f"import {x[:-3].replace('/', '.')}\n" for x in names)
    files = corpus({"a.py": calls, **{x: f"x = {i}\n" for i, x in enumerate(names)}})
    roots = spark.createDataFrame([("p", "a.py")], "project_name string, root string")
    bundles = graph.context_bundle(files, build_edges(files), roots, 1)
    [row] = bundles.collect()
    assert row.bundle.count("=== Context: ") == n and row.bundle.endswith(calls)
    rows = graph.unpack_bundle(bundles, "bundle").collect()
    # of two sections with one file name the last stays, wherever they stand
    assert len(rows) == n and [r.path for r in rows if r.name == "same.py"] == ["d305/same.py"]


def test_unpack_is_the_inverse(spark, corpus):
    files = corpus(REPO)
    roots = spark.createDataFrame([("p", "main.py")], "project_name string, root string")
    bundle = graph.context_bundle(files, build_edges(files), roots, 2)
    rows = {r.path: (r.kind, r.content) for r in graph.unpack_bundle(bundle, "bundle").collect()}
    assert rows["main.py"] == ("Target", REPO["main.py"].strip())
    assert all(content == REPO[path].strip() for path, (_, content) in rows.items()) and len(rows) == 4


def test_unpack_last_name_wins_and_raw_text_stays(spark):
    text = "=== Context: x/a.py ===\nold\n\n=== Target: y/a.py ===\nnew\n"
    df = spark.createDataFrame([(1, text), (2, "no headers"), (3, "=== Target: a ===\n  ")], "id int, t string")
    rows = sorted((r.id, r.name or "", r.kind, r.content) for r in graph.unpack_bundle(df, "t").collect())
    assert rows == [(1, "a.py", "Target", "new"), (2, "", "Raw", "no headers"), (3, "", "Raw", "=== Target: a ===\n  ")]


def _random_graph(spark, n, seed, hub=True):
    rng = random.Random(seed)
    rows = []
    for src in range(n):
        fan = 40 if hub and src == 0 else rng.randint(0, 4)
        for stmt in range(fan):
            rows.append(("p", f"f{src}", f"f{rng.randrange(n)}", stmt, rng.randint(0, 1)))
    rows = list({(r[1], r[3], r[4]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "project_name string, src string, dst string, stmt_seq bigint, pos bigint")
    out: dict[str, list[str]] = {}
    for _, src, dst, *_ in sorted(rows, key=lambda r: (r[1], r[3], r[4])):
        out.setdefault(src, []).append(dst)
    return df, out


def _walk_levels(out, root, depth):
    found, seen, level = [], {root}, [root]
    for _ in range(depth):
        nxt = []
        for node in level:
            for dst in out.get(node, []):
                if dst not in seen:
                    seen.add(dst)
                    found.append(dst)
                    nxt.append(dst)
        level = nxt
    return found


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_dependencies_equal_a_queue_walk(spark, depth):
    edges, out = _random_graph(spark, 40, depth)
    roots = spark.createDataFrame([("p", f"f{i}") for i in range(40)], "project_name string, root string")
    have: dict[str, list] = {}
    for r in graph.dependencies(edges, roots, depth).collect():
        have.setdefault(r.root, []).append((r.level, r.order, r.dst))
    for i in range(40):
        assert [d for *_, d in sorted(have.get(f"f{i}", []))] == _walk_levels(out, f"f{i}", depth)
    plain = graph.dependencies(edges, roots, depth, order=False)
    assert sorted((r.root, r.dst, r.level) for r in plain.collect()) == sorted(
        (root, d, lv) for root, rows in have.items() for lv, _, d in rows
    )


def _per_level(found):
    return found.groupBy("root", "level").agg(F.count(F.lit(1)).alias("files"), F.sum(F.crc32("dst")).alias("sum"))


def _odd_edges(spark):
    """Two projects with the same names, repeated imports, cycles, null sources, targets and projects."""
    edges, _ = _random_graph(spark, 60, 11)
    rows = [tuple(r) for r in edges.collect()]
    rows += [("q", *r[1:]) for r in rows[::3]] + rows[::4] + [("p", "f1", "f1", 9, 0)]
    rows += [("p", src, dst, 9, 1) for src in ("f1", "f2", None) for dst in ("f3", None)]
    rows += [("p", "f4", None, 9, 2), (None, "f1", "f5", 9, 3), ("p", "f5", "f1", 9, 4), ("p", "f1", "f2", 9, 5)]
    return spark.createDataFrame(rows, edges.schema)


@pytest.mark.parametrize("depth, longest", [(0, 1 << 18), (1, 3), (2, 1 << 18), (2, 20), (3, 100)])
def test_lists_of_imports_give_the_rows_of_single_pairs(spark, monkeypatch, depth, longest):
    """Whatever the number of walks from which a root goes row by row, and in batches."""
    edges = _odd_edges(spark)
    roots = edges.select("project_name", F.col("src").alias("root"))
    more = spark.createDataFrame([("p", "gone"), (None, "f1"), ("r", "f1")], roots.schema)
    roots = roots.unionByName(more)
    rows = graph._dependencies_by_rows(edges, roots, depth, False)
    want, folded = Counter(rows.collect()), Counter(_per_level(rows).collect())
    assert depth == 0 or any(r.dst is None for r in want)
    monkeypatch.setattr(graph, "LONG_ROOT", longest)
    monkeypatch.setattr(graph, "BATCH_WALKS", 600)
    found = graph.dependencies(edges, roots, depth, order=False)
    assert found.columns == rows.columns and Counter(found.collect()) == want
    assert Counter(graph.dependencies(edges, roots, depth, order=False, fold=_per_level).collect()) == folded


def test_pairs_on_disk_are_those_of_a_batch(spark, monkeypatch):
    """Walks are taken in batches of about as many as there are edges."""
    n, fan = 200, 5
    rows = [("p", f"f{i}", f"f{(i * 31 + j * j * 7 + j) % n}", j, 0) for i in range(n) for j in range(fan)]
    edges = spark.createDataFrame(rows, "project_name string, src string, dst string, stmt_seq bigint, pos bigint")
    roots = edges.select("project_name", F.col("src").alias("root"))
    monkeypatch.setattr(graph, "BATCH_WALKS", 1)
    seen = []

    def fold(found):
        seen.append(found.select("root").distinct().count())
        return _per_level(found)

    rows = _per_level(graph._dependencies_by_rows(edges, roots, 2, False)).collect()
    assert Counter(graph.dependencies(edges, roots, 2, order=False, fold=fold).collect()) == Counter(rows)
    # walks of one and two steps are fan + fan^2 for a root, so there are fan + 1 batches
    assert len(seen) == fan + 1 and sum(seen) == n and max(seen) < n / 2


def test_a_written_table_leaves_no_shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager()
    folders = [f.getAbsolutePath() for f in blocks.diskBlockManager().localDirs()]
    shuffles = lambda: {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    before = shuffles()
    df = spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    assert sorted(r["count"] for r in materialize(df).collect())[0] == 1428
    for _ in range(100):  # they are removed by another thread
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.conf.get(TIDY, None) in (None, "false")


def _walk_tree(out, root, limit):
    lines, opened = [root], set()

    def visit(node, depth, prefix):
        if depth >= limit or node in opened:
            return
        opened.add(node)
        for i, dst in enumerate(out.get(node, [])):
            last = i == len(out[node]) - 1
            lines.append(f"{prefix}{'└── ' if last else '├── '}{dst}")
            visit(dst, depth + 1, prefix + ("    " if last else "│   "))

    visit(root, 0, "")
    return lines


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 4])
def test_tree_equals_a_walk(spark, limit):
    edges, out = _random_graph(spark, 15, 7 + limit)
    roots = spark.createDataFrame([("p", f"f{i}") for i in range(16)], "project_name string, root string")
    files = spark.createDataFrame([("p", f"f{i}") for i in range(15)], "project_name string, file_path string")
    have: dict[str, list] = {}
    for r in tree.dep_tree(edges, roots, files, limit).collect():
        have.setdefault(r.root, []).append((r.path, r.text))
    for i in range(15):
        assert [t for _, t in sorted(have[f"f{i}"])] == _walk_tree(out, f"f{i}", limit)
    assert have["f15"] == [([], "File not found: f15")]


def test_direct_reverse_stats_isolated(corpus):
    files = corpus({**REPO, "alone.py": "x = 1\n"})
    edges = build_edges(files)
    assert [r.dst for r in graph.direct_deps(edges, "main.py").orderBy("stmt_seq", "pos").collect()] == [
        "helper.py", "app/utils/db.py"
    ]
    assert {r.src for r in graph.dependents(edges, "app/utils/db.py").collect()} == {"main.py", "app/auth.py"}
    assert [r.file_path for r in graph.isolated_files(files, edges).collect()] == ["alone.py"]
    row = graph.graph_stats(files, edges).collect()[0]
    assert (row.total_files, row.total_imports, row.isolated_files, row.avg_imports_per_file) == (9, 7, 1, 0.78)


def test_resolvers_agree_with_the_edges(corpus):
    files = corpus(REPO)
    asked = imports.deny_modules(import_candidates(extract_imports(files)))
    both = imports.resolve_absolute(asked, files).unionByName(imports.resolve_relative(asked, files))
    assert {(r.file_path, r.dst) for r in both.collect()} == _edges(files)


def test_no_side_of_the_resolution_is_broadcast(spark, corpus, tmp_path):
    """Asked paths and known paths both grow with the corpus: neither may pass the driver."""
    files = corpus({"a/x.py": "import b.y\nfrom . import z\nfrom ..b import y\n", "a/z.py": "", "b/y.py": "", "b/__init__.py": ""})
    files.write.parquet(f"{tmp_path}/files")  # a table of known, small size
    edges = imports.build_edges(spark.read.parquet(f"{tmp_path}/files"))
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert {(r.src, r.dst, r.stmt_seq) for r in edges.collect()} == {
        ("a/x.py", "b/y.py", 1), ("a/x.py", "a/z.py", 2), ("a/x.py", "b/__init__.py", 3), ("a/x.py", "b/y.py", 3),
    }
