"""Units and imports against the standard library's parser: quotes, comments, several
statements on a line, brackets and backslashes."""

import ast
import random

from risklens.operators import units
from risklens.operators.units import extract_functions, extract_imports

FUTURE = "    from __future__ import annotations\n"
ODD = [
    '''# it's """ odd
def a():
    t = '"""'
    u = "\'\'\'"  # isn't it
    return t

def b():
    return """x""" 'y' "#" # " '
''',
    "x = 1; import os\nif x: import json\nimport a; import b.c; from d import e\ntry: from . import f\nexcept E: import g; import h\n",
    "from a.b \\\n    import c\nimport d as \\\n  e, f\nx = 1 + \\\n2; import z\ns = 'import no'; import yes  # import neither\n",
    "def f(a, b=':\\n', c=lambda: 0):\n    'doc # text'; x = 1\n    return (1 +\n2 + [3,\n(4)][0])\n\nclass A(B): x = 1\ndef g():\n"
    "    '''a\n\"\"\" b'''\n    async def h(): pass\n",
    'def a():\n    s = "it\\"s # \\\nmore"\n    return s\n\n\ndef b(x="\\\\"):  # "\n    """say "hi\\""""\n    return 1\n\nr = r"\\"" ""\nclass C:\n    """d"""\n    import q\n',
    "from .. import up\nfrom.rel import (x,  # ) import no\n  y)\nfrom m import *\nimport p as q\ndef gen():\n    yield from src\n    raise E from err\n" + FUTURE,
]


def plain(source):
    return ast.walk(ast.parse(source.replace(FUTURE, "    later\n")))


def valid(source):
    try:
        ast.parse(source)
        return True
    except SyntaxError:
        return False


def check(corpus, sources):
    files = corpus({f"{i}.py": s for i, s in enumerate(sources)})
    found, imports = units.extract_units(files).collect(), extract_imports(files).collect()
    top = extract_imports(files, top_level=True).collect()
    texts = {(r.file_path, r.start_line): r.docstring for r in extract_functions(files).collect()}
    for i, source in enumerate(sources):
        path = f"{i}.py"
        want = sorted(
            (n.lineno, n.end_lineno, n.name, "class" if isinstance(n, ast.ClassDef) else "function")
            for n in plain(source) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
        )
        assert sorted((r.start_line, r.end_line, r.name, r.node_type) for r in found if r.file_path == path) == want, source
        mine = sorted((r for r in imports if r.file_path == path), key=lambda r: (r.line, r.nth))
        nodes = sorted((n for n in plain(source) if isinstance(n, (ast.Import, ast.ImportFrom))), key=lambda n: (n.lineno, n.col_offset))
        assert [r.line for r in mine] == [n.lineno for n in nodes], source
        for r, n in zip(mine, nodes):
            assert ast.dump(ast.parse(r.code).body[0]) == ast.dump(n), source
        outer = [n.lineno for n in ast.parse(source.replace(FUTURE, "    later\n")).body if isinstance(n, (ast.Import, ast.ImportFrom))]
        assert sorted(r.line for r in top if r.file_path == path) == outer, source
        for n in plain(source):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(n) and n.body[0].lineno > n.lineno:
                assert texts[path, n.lineno] is not None, source


def test_odd_files(corpus):
    check(corpus, ODD)


def test_generated_files(corpus):
    rng = random.Random(12)
    strings = [
        "'a'", '"b"', "'''c'''", '"""d"""', "'\"'", '"\'"', "'\\''", '"\\""', "'\"\"\"'", '"\'\'\'"', "'#'", '"import no"', "r'\\\\'", "'; import no'", "b''", '""',
        '"""e\n"f" \'\'\' #\ndef no(): pass\nimport no\n"""', "'''g\n\"\"\" h\n'''", "'''i\\'''j'''", "'k\\\nl'", "u'é'", '"(" \'[\'',
    ]
    assert all(valid(f"x = {s}\n") for s in strings)
    comments = ["", "", "  # plain", "  # it's", '  # """', "  # '''", "  # \" and \\' ; import no", "  # import no", "  # def no(): ("]
    simple = lambda: rng.choice([
        f"x = {rng.choice(strings)}", "import m1", "from m2 import n1, n2", f"f({rng.choice(strings)}, [1, {rng.choice(strings)}])",
        "y = (1,\n2)", "from .m3 import (n3,  # )\n n4)", "import m4 as k", "z = 1 + \\\n 2", rng.choice(strings),
    ])
    sources = []
    while len(sources) < 200:
        out, depth = [], 0
        for _ in range(rng.randint(3, 25)):
            pad, kind = "    " * depth, rng.random()
            if kind < 0.2 and depth < 3:
                head = rng.choice([
                    f"def f{len(out)}(a={rng.choice(strings)}):", f"class K{len(out)}:", "if x:", f"async def g{len(out)}(\n  a,\nb=1):", "for i in j:", "@dec\n" + pad + f"def d{len(out)}():",
                ])
                out.append(pad + head + rng.choice(comments))
                depth += 1
                out.append("    " * depth + simple())
            elif kind < 0.3 and depth:
                depth -= rng.randint(1, depth)
            elif kind < 0.4:
                out.append(rng.choice(["", "# note 'tis", pad + '# """ x', "   "]))
            elif kind < 0.5:
                out.append(pad + rng.choice(["if x: ", "try: pass\n" + pad + "except E: ", "class Q: ", "def q(): "]) + simple() + "; " + simple())
            else:
                out.append(pad + "; ".join(simple() for _ in range(rng.choice([1, 1, 1, 2, 3]))) + rng.choice(comments))
        if valid(source := "\n".join(out) + "\n"):
            sources.append(source)
    check(corpus, sources)


def test_very_long_strings_and_brackets(corpus):
    row = "    'it' \"s\" # '\n"
    source = "def a():\n    x = (\n" + row * 30_000 + "    )\n    y = '''" + "b \" ' # \\' \n" * 30_000 + "'''\n    return x\n\nimport z\ndef c(): pass\n"
    files = corpus({"t.py": source})
    have = [(r.name, r.start_line, r.end_line) for r in units.extract_units(files).orderBy("pos").collect()]
    assert have == [("a", 1, 60_005), ("c", 60_008, 60_008)]
    assert [r.line for r in extract_imports(files).collect()] == [60_007]
