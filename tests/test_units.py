import ast
import textwrap

from pyspark.sql import functions as F

from risklens.operators import units
from risklens.operators.units import extract_classes, extract_functions, extract_imports, symbols

TRICKY = textwrap.dedent('''\
    """Module text with
    def not_a_function():
    inside."""
    from __future__ import annotations
    import os
    import a.b.c as abc
    from x import (
        one,  # first
        two as zwei,
    )
    from .rel import thing


    @decorated
    def outer(a,
              b=(1, 2),
    ):
        # a comment
        """Docs of outer."""
        async def inner(x):
            return x

    # a comment at the margin
        y = {
            "k": 1,
    }
        return inner


    class Big(Base):
        """Class text
    that goes to the margin
        """
        x = 1

        def first(self): return 1

        @property
        def second(self):
            import json
            text = """
    def fake():
        pass
    """
            return text

        class Nested:
            pass


    def last():
        \'\'\'Only a text
        over lines\'\'\'


    def größe(wert):
        return wert
''')


def _by_ast(source: str):
    found = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            found.append((node.name, kind, node.lineno, node.end_lineno))
    return sorted(found, key=lambda r: r[2])


def test_units_equal_the_syntax_tree(corpus):
    rows = units.extract_units(corpus({"t.py": TRICKY})).orderBy("pos").collect()
    assert [(r.name, r.node_type, r.start_line, r.end_line) for r in rows] == _by_ast(TRICKY)


def test_units_of_real_modules_equal_the_syntax_tree(corpus):
    import argparse
    import dataclasses
    import inspect
    import json.decoder
    import shlex

    sources = {f"{m.__name__}.py": inspect.getsource(m) for m in (json.decoder, dataclasses, argparse, shlex)}
    rows = units.extract_units(corpus(sources)).collect()
    for path, source in sources.items():
        have = sorted(
            [(r.name, r.node_type, r.start_line, r.end_line) for r in rows if r.file_path == path], key=lambda r: r[2]
        )
        assert have == _by_ast(source), path


def test_code_starts_at_the_header(corpus):
    rows = {r.name: r for r in extract_functions(corpus({"t.py": TRICKY})).collect()}
    assert rows["outer"].code.startswith("def outer(a,") and rows["outer"].code.endswith("return inner")
    assert rows["inner"].code == "async def inner(x):\n        return x"
    assert rows["größe"].code == "def größe(wert):\n    return wert"


def test_docstrings(corpus):
    source = (
        "def a():\n    return 1\n\ndef b(x: int):\n    '''  text \n  more '''\n    return 1\n\n"
        "def c():\n    x = 1\n    \"late\"\n    return x\n\ndef d():\n    if 1:\n        'nested'\n    return 2\n"
    )
    rows = {r.name: r.docstring for r in extract_functions(corpus({"t.py": source})).collect()}
    assert rows == {"a": None, "b": "text \n  more", "c": "late", "d": None}


def test_three_functions_in_order(corpus):
    source = "\ndef one():\n    pass\n\ndef two():\n    pass\n\ndef three():\n    pass\n"
    rows = extract_functions(corpus({"t.py": source})).orderBy("pos").collect()
    assert [(r.name, r.start_line) for r in rows] == [("one", 2), ("two", 5), ("three", 8)]


def test_imports(corpus):
    rows = extract_imports(corpus({"t.py": TRICKY})).orderBy("line").collect()
    assert [(r.line, r.type) for r in rows] == [
        (5, "import_statement"), (6, "import_statement"), (7, "import_from_statement"),
        (11, "import_from_statement"), (TRICKY.split("\n").index("        import json") + 1, "import_statement"),
    ]
    assert rows[2].code.startswith("from x import (") and rows[2].code.endswith(")")
    top = extract_imports(corpus({"t.py": TRICKY}), top_level=True).collect()
    assert sorted(r.line for r in top) == [5, 6, 7, 11]


def test_symbols_and_classes(corpus):
    df = corpus({"t.py": TRICKY, "empty.py": ""})
    names = {r.file_path: r.functions for r in symbols(df).collect()}
    assert names["t.py"] == ["outer", "inner", "Big", "first", "second", "Nested", "last", "größe"]
    assert names["empty.py"] == []
    assert {r.name for r in extract_classes(df).collect()} == {"Big", "Nested"}


def test_a_very_long_file(corpus):
    body = "".join(f"    x{i} = {i}\n\n    # note {i}\n" for i in range(40_000))
    source = "def big():\n" + "    # c\n" * 5_000 + body + "\n\ndef after():\n    pass\n"
    rows = extract_functions(corpus({"t.py": source})).orderBy("pos").collect()
    assert [(r.name, r.start_line, r.end_line) for r in rows] == [
        ("big", 1, 5_001 + 3 * 40_000 - 2), ("after", 125_004, 125_005)
    ]


def test_finding_code_falls_back_to_the_file(spark, corpus):
    files = corpus({"a.py": "def f():\n    return 1\n\nclass g:\n    pass\n", "b.py": "x = 1\n"})
    findings = spark.createDataFrame(
        [("p", "a.py", "f"), ("p", "a.py", "g"), ("p", "b.py", "f"), ("p", "c.py", "f")],
        "project_name string, file string, function string",
    )
    rows = {(r.file, r.function): r.code for r in units.finding_code(findings, files).collect()}
    assert rows[("a.py", "f")] == "def f():\n    return 1"
    assert rows[("a.py", "g")].startswith("def f()") and rows[("b.py", "f")] == "x = 1\n"
    assert rows[("c.py", "f")] is None


def test_lines_keep_every_line(corpus):
    rows = units.to_lines(corpus({"t.py": "a\n\n  b\n"})).orderBy("line").collect()
    assert [(r.line, r.text, r.indent, r.blank) for r in rows] == [
        (1, "a", 0, False), (2, "", 0, True), (3, "  b", 2, False), (4, "", 0, True)
    ]


def test_unit_stats(spark, corpus):
    files = corpus({"a.py": "def f():\n    pass\n", "b.py": "x = 1\n"})
    findings = spark.createDataFrame([("p", True), ("p", None)], "project_name string, vulnerable boolean")
    row = units.unit_stats(files, findings).collect()[0]
    assert (row.files, row.functions, row.vulnerable) == (2, 1, 1)
    assert units.unit_stats(files, findings.filter(F.lit(False))).collect()[0].vulnerable == 0
