"""Functions, classes, imports and symbols of source files.

Everything happens inside the file's row.  One pass cuts a text into comments, strings
and the rest, the leftmost first, and masks the strings; header lines are found, and
one anchored regular expression per file captures each unit's block (header, then
logical lines that are blank or indented deeper).  Nothing is shuffled and only
finished unit rows leave the array.

Known limits: indents that mix tabs and blanks, quotes of a kind nested in an f-string of
the same kind, and brackets more than five deep whose lines return to the margin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens.functions.text import strip

# Stands for any character of a string but its opening quotes, in the masked text.
MASK = "\u0001"
# Stands for the sign that opens a comment; the comment's text stays.
COMMENT = "\u0002"
_ALL = 1 << 30
# A comment, a long string or a short one, whichever begins first.  Possessive, so a
# text of any length is one loop.
_TOKEN = (
    r"(?s)#[^\n]*+"
    r'|"""(?:[^"\\]++|\\.|"(?!""))*+(?:""")?' r"|'''(?:[^'\\]++|\\.|'(?!''))*+(?:''')?"
    r'|"(?:[^"\\\n]++|\\.)*+"?' r"|'(?:[^'\\\n]++|\\.)*+'?"
)
_LONG_QUOTES = r"""^(?:\"\"\"|''')"""
_NAME = r"[\p{L}\p{N}_]+"
_HEADER = r"(?:(?:async[ \t]+)?def|class)[ \t]+" + _NAME + r"[ \t]*(?=[(:\[])"


def _brackets(depth: int) -> str:
    inner = "|" + _brackets(depth - 1) if depth > 1 else ""
    return rf"[(\[{{](?:[^()\[\]{{}}{COMMENT}]++|{COMMENT}[^\n]*+{inner})*+[)\]}}]"


# A logical line's rest: brackets, strings and backslashes carry it over line ends.
_LINE = rf"(?:[^\n\\(\[{{{COMMENT}]++|{COMMENT}[^\n]*+|\\\r?\n?|{_brackets(5)}|[(\[{{]|\n(?=\n*{MASK}))*+"
# A header at any indent, and the block it opens: following logical lines that are
# blank, deeper than the header, comments, or continue a bracket or a string.
_BLOCK = (
    r"(?md)^(?=([ \t]*)(" + _HEADER + _LINE
    + r"(?:\n(?:[ \t\r]*(?=\n|\z)|\1[ \t]+(?=[^ \t\n])" + _LINE + r"|[ \t]*(?=[" + MASK + COMMENT + r")\]}])" + _LINE + r"))*+))"
)
_TRAILING = r"(?:\n[ \t\r]*(?:" + COMMENT + r"[^\n]*)?)++\z"
_REST = r"[ \t]*(?:" + COMMENT + r"[^\n]*)?\n"
# Body's first statement, or a later one at the body's indent, that is a string; the
# text before it is the first group.
_DOCSTRING = (
    r"(?s)\A((?:async[ \t]+)?def\b(?>.*?:" + _REST + r")(?:" + _REST + r")*+([ \t]+)(?=\S)(?:.*?\n\2)??[rRbBuUfF]{0,2})"
    r"((?:\"\"\"|'''|\"|')" + MASK + r"*+(?:\n++" + MASK + r"++)*+)[ \t\r]*(?:;|" + COMMENT + r"|\n|\z)"
)
_GAP = r"(?:[ \t]|\\\r?\n)"
_IMPORT = (
    r"(?<![\p{L}\p{N}_.])(?:import" + _GAP + r"+[\p{L}\p{N}_]"
    r"|from(?:" + _GAP + r"+(?!__future__\b)|(?=\.))[.\p{L}\p{N}_]+" + _GAP + r"+import\b)"
)
# Comments first, so that a word in one opens no statement.
_STATEMENT = (
    COMMENT + r"[^\n]*+|\bfrom[ \t]+__future__\b[^\n;]*+|(" + _IMPORT + "(?:" + _GAP + r"*\((?:[^)" + COMMENT + r"]++|" + COMMENT + r"[^\n]*+)*+\)|(?:[^\n\\;" + COMMENT + r"]++|\\\r?\n?)*+))"
)
# A logical line's statements stand in a block: indented, or after a compound statement's colon.
_NESTED = r"^[ \t]|^(?:if|elif|else|try|except|finally|for|while|with|def|class|async)\b"


def mask_strings(content: Column) -> Column:
    """Mark comments, and replace the inside and the closing quotes of strings by
    mask characters; length and line numbers stay."""

    def masked(token: Column) -> Column:
        quotes = F.when(F.rlike(token, F.lit(_LONG_QUOTES)), 3).otherwise(1)
        return F.when(F.startswith(token, F.lit("#")), F.concat(F.lit(COMMENT), F.substring(token, 2, _ALL))).otherwise(
            F.concat(F.substring(token, F.lit(1), quotes), F.regexp_replace(F.substring(token, quotes + 1, F.lit(_ALL)), r"[^\n]", MASK))
        )

    between, tokens = F.split(content, _TOKEN, -1), F.regexp_extract_all(content, F.lit(_TOKEN), 0)
    return F.array_join(F.zip_with(between, tokens, lambda a, t: F.concat(a, F.coalesce(masked(t), F.lit("")))), "")


def to_lines(files: DataFrame) -> DataFrame:
    """One row per line: 1-based number, text, indent width, blank flag."""
    lines = files.select("project_name", "file_path", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    indent = F.length(F.regexp_extract("text", r"^([ \t]*)", 1))
    return lines.select(
        "project_name", "file_path", (F.col("pos") + 1).alias("line"), "text",
        indent.alias("indent"), (strip(F.col("text")) == "").alias("blank"),
    )


def _numbered(lines: Column, header: str) -> Column:
    """Lines that match a header, each as (number, text)."""
    pairs = F.transform(lines, lambda s, i: F.struct((i + 1).alias("line"), s.alias("text")))
    return F.filter(pairs, lambda p: F.rlike(p["text"], F.lit(r"(?d)^[ \t]*" + header)))


def _unit_arrays(files: DataFrame) -> tuple[DataFrame, Column]:
    """Files cut to lines and blocks, and the array of their units in pre-order.

    The array is handed out as an expression: exploding a column would make the
    optimizer test its size first, and so build every array twice."""
    masked = files.select("*", mask_strings(F.col("content")).alias("_masked"))
    parts = masked.select(
        "project_name", "file_path", "content",
        _numbered(F.split("_masked", "\n"), _HEADER).alias("_heads"),
        F.regexp_extract_all("_masked", F.lit(_BLOCK), 2).alias("_blocks"),
        F.split("content", "\n").alias("_lines"),
    )

    def unit(head: Column, block: Column) -> Column:
        body = F.regexp_replace(block, _TRAILING, "")
        n_lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
        end = F.least(head["line"] + n_lines - 1, F.size("_lines"))
        code = F.array_join(F.slice("_lines", head["line"], n_lines), "\n")
        return F.struct(
            F.regexp_extract(block, r"(?:def|class)[ \t]+(" + _NAME + ")", 1).alias("name"),
            F.when(F.startswith(block, F.lit("class")), "class").otherwise("function").alias("node_type"),
            head["line"].cast("int").alias("start_line"),
            end.cast("int").alias("end_line"),
            F.rtrim(F.regexp_replace(code, r"^[ \t]+", "")).alias("code"),
        )

    return parts, F.zip_with("_heads", "_blocks", unit)


def extract_units(files: DataFrame) -> DataFrame:
    """All functions and classes, nested ones included, in pre-order ``pos``.

    ``code`` starts at ``def``/``async``/``class`` (decorators are outside) and
    ends with the last statement of the body.
    """
    parts, array = _unit_arrays(files)
    rows = parts.select("project_name", "file_path", F.posexplode(array).alias("pos", "u"))
    return rows.select("project_name", "file_path", "pos", "u.*")


def extract_functions(files: DataFrame) -> DataFrame:
    """Functions and methods with their docstring."""
    functions = extract_units(files).filter(F.col("node_type") == "function")
    return functions.withColumn("docstring", docstring(F.col("code")))


def extract_classes(files: DataFrame) -> DataFrame:
    return extract_units(files).filter(F.col("node_type") == "class")


def docstring(code: Column) -> Column:
    """First string statement of the body, quotes and blanks removed; null if none."""
    masked = mask_strings(code)
    before, length = (F.length(F.regexp_extract(masked, _DOCSTRING, g)) for g in (1, 3))
    raw = F.when(length > 0, F.substring(code, before + 1, length))
    return strip(F.btrim(F.btrim(raw, F.lit('"')), F.lit("'")))


def extract_imports(files: DataFrame, top_level: bool = False) -> DataFrame:
    """Import statements: code, line, nth of the line (from 0), type; on request only those
    outside of blocks.  Statements may follow a semicolon or a block's colon.
    ``from __future__`` is no import of a module and is left out."""
    masked = files.select("project_name", "file_path", mask_strings(F.col("content")).alias("_masked"))
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    # one entry for each line, so that an entry's place is its number; those that
    # begin a logical line hold it
    whole = F.regexp_extract_all("_masked", F.lit(_LINE + r"(?:\n|\z)"), 0)
    entries = F.flatten(F.transform(whole, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(breaks(x), F.lit(1))), lambda o: F.when(o == 1, x))))
    first = F.transform(entries, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    open_lines = F.filter(first, lambda e: F.contains(e["text"], F.lit("import")))

    def statements(e: Column) -> Column:
        codes = F.regexp_extract_all(e["text"], F.lit(_STATEMENT), 1)
        tokens, between = F.regexp_extract_all(e["text"], F.lit(_STATEMENT), 0), F.split(e["text"], _STATEMENT, -1)
        placed = F.filter(F.transform(codes, lambda c, j: F.struct(c.alias("code"), j.alias("j"))), lambda p: p["code"] != "")
        ahead = lambda j: breaks(F.concat(F.array_join(F.slice(tokens, F.lit(1), j), ""), F.array_join(F.slice(between, F.lit(1), j + 1), "")))
        # line ends before a statement: none in a logical line of one line
        one_line = (F.locate("\n", e["text"]) == 0) | (F.locate("\n", e["text"]) == F.length(e["text"]))
        return F.transform(placed, lambda p: F.struct(
            (e["line"] + F.when(one_line, 0).otherwise(ahead(p["j"]))).cast("int").alias("line"), F.rlike(e["text"], F.lit(_NESTED)).alias("nested"),
            strip(F.replace(p["code"], F.lit(COMMENT), F.lit("#"))).alias("code"),
        ))

    found = masked.select("project_name", "file_path", F.flatten(F.transform(open_lines, statements)).alias("_found"))
    # place of a statement among those that begin on its line
    numbered = F.transform("_found", lambda s, i: F.struct(s["line"], s["code"], s["nested"], F.when(
        (i > 0) & (F.get("_found", i - 1)["line"] == s["line"]),
        F.size(F.filter(F.slice("_found", F.lit(1), i), lambda o: o["line"] == s["line"])),
    ).otherwise(0).alias("nth")))
    rows = found.select("project_name", "file_path", F.explode(numbered).alias("s"))
    out = rows.select(
        "project_name", "file_path", "s.line", "s.nth", "s.code",
        F.when(F.startswith("s.code", F.lit("import")), "import_statement")
        .otherwise("import_from_statement").alias("type"),
        "s.nested",
    )
    return out.filter(~F.col("nested")).drop("nested") if top_level else out.drop("nested")


def symbols(files: DataFrame) -> DataFrame:
    """Names of all functions and classes of a file in pre-order, one array per file."""
    masked = files.select("project_name", "file_path", mask_strings(F.col("content")).alias("_masked"))
    heads = F.regexp_extract_all("_masked", F.lit(r"(?md)^[ \t]*(" + _HEADER + ")"), 1)
    names = F.transform(heads, lambda h: F.regexp_extract(h, r"(?:def|class)[ \t]+(" + _NAME + ")", 1))
    return masked.select("project_name", "file_path", names.alias("functions"))


def finding_code(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Code of the first function with the finding's name, the whole file when
    there is none.  Files with findings are cut to their functions where they lie;
    a finding meets one function's code, and contents only when it has none."""
    wanted = findings.select("project_name", F.col("file").alias("file_path")).distinct()
    mine = files.join(wanted, ["project_name", "file_path"], "left_semi")
    named = extract_units(mine).filter(F.col("node_type") == "function").groupBy(
        "project_name", F.col("file_path").alias("file"), F.col("name").alias("function")
    ).agg(F.min_by("code", "pos").alias("_code"))
    found = findings.join(named, ["project_name", "file", "function"], "left")
    whole = mine.select(F.col("project_name").alias("_project"), F.col("file_path").alias("_path"), F.col("content").alias("_whole"))
    bare = F.when(F.col("_code").isNull(), F.col("file"))
    joined = found.join(whole, (F.col("project_name") == F.col("_project")) & (bare == F.col("_path")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in findings.columns], F.coalesce("_code", "_whole").alias("code"))


def unit_stats(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Per project: files scanned, functions analysed, vulnerable findings."""
    units = extract_units(files).filter(F.col("node_type") == "function")
    scanned = files.groupBy("project_name").agg(F.count(F.lit(1)).alias("files"))
    counted = units.groupBy("project_name").agg(F.count(F.lit(1)).alias("functions"))
    bad = findings.groupBy("project_name").agg(F.count_if(F.coalesce("vulnerable", F.lit(False))).alias("vulnerable"))
    out = scanned.join(counted, "project_name", "left").join(bad, "project_name", "left")
    return out.na.fill(0, ["functions", "vulnerable"])
