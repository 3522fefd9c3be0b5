"""From import statements to file-to-file edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens.functions.text import parent_dir, strip
from risklens.operators.units import extract_imports

# First segments never looked up in the corpus.
DENIED = [
    "os", "sys", "json", "time", "datetime", "re", "math", "random",
    "collections", "itertools", "functools", "typing", "pathlib",
    "logging", "unittest", "pytest", "sqlite3", "requests", "flask",
    "django", "numpy", "pandas", "docker", "networkx", "elasticsearch",
]


def import_candidates(imports: DataFrame, compat: bool = False) -> DataFrame:
    """Modules a statement may load, in order ``pos``.

    ``import a, b`` gives its first name without an alias; ``from m import x``
    gives ``m``, then ``m.x``.  With ``compat`` a bare-dot module keeps the extra
    dot (``from . import x`` gives ``..x``).
    """
    # step by step: a column read several times is worked out once
    plain_import = F.col("type") == "import_statement"
    cut = imports.select(
        "project_name", "file_path", F.col("line").cast("bigint").alias("stmt_seq"), "nth", plain_import.alias("_plain"),
        F.regexp_replace(F.regexp_replace("code", r"#[^\n]*", ""), r"\\\r?\n", " ").alias("_code"),
    )
    listed = F.split(F.regexp_replace("_code", r"^import[ \t]+", ""), ",")
    plain = F.filter(F.transform(listed, strip), lambda s: ~F.rlike(s, F.lit(r"\sas\s")) & (s != ""))
    module = F.regexp_extract("_code", r"^from[ \t]*([.\p{L}\p{N}_]+)[ \t]+import\b", 1)
    tail = F.regexp_replace(F.regexp_extract("_code", r"(?s)\bimport\b(.*)$", 1), r"[()]", "")
    names = F.transform(F.split(tail, ","), lambda s: F.regexp_extract(s, r"([.\p{L}\p{N}_]+)", 1))
    first = F.when(F.col("_plain"), F.slice(plain, 1, 1))
    read = cut.select(
        "project_name", "file_path", "stmt_seq", "nth", "_plain", first.alias("_first"),
        F.when(~F.coalesce("_plain", F.lit(False)), module).alias("_module"),
        F.when(~F.coalesce("_plain", F.lit(False)), F.filter(names, lambda s: s != "")).alias("_names"),
    )
    glue = F.lit(".") if compat else F.when(F.endswith("_module", F.lit(".")), "").otherwise(".")
    loaded = F.concat(F.array("_module"), F.transform("_names", lambda s: F.concat("_module", glue, s)))
    modules = F.when(F.col("_plain"), F.col("_first")).otherwise(loaded)
    rows = read.select("project_name", "file_path", "stmt_seq", "nth", F.posexplode(modules).alias("pos", "module"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def deny_modules(candidates: DataFrame, names: Sequence[str] = DENIED) -> DataFrame:
    """Drop modules whose first segment is in the deny list."""
    return candidates.filter(~F.substring_index("module", ".", 1).isin(*names))


def _absolute_paths() -> Column:
    base = F.replace("module", F.lit("."), F.lit("/"))
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))


def _placed(candidates: DataFrame) -> DataFrame:
    """Candidates with the folder ``_prefix`` that a dotted-prefix module is looked up in and
    the ``_name`` below it, each worked out once; both null for other modules, and the
    prefix when it leaves the root."""
    relative = F.startswith("module", F.lit("."))
    folder = F.when(relative, parent_dir(F.col("file_path")))
    cut = candidates.select("*", folder.alias("_folder"), F.when(relative, F.ltrim("module", F.lit("."))).alias("_name"))
    segments = F.when(F.col("_folder") == "", F.array().cast("array<string>")).otherwise(F.split("_folder", "/"))
    up = F.length("module") - F.length("_name") - 1
    based = cut.select("*", segments.alias("_segments"), up.alias("_up"))
    kept = F.size("_segments") - F.col("_up")
    base = F.array_join(F.slice("_segments", F.lit(1), F.greatest(kept, F.lit(0))), "/")
    ended = based.select("*", F.when(F.col("_name").isNotNull() & (kept >= 0), base).alias("_base"))
    prefix = F.when(F.col("_base") == "", "").otherwise(F.concat("_base", F.lit("/")))
    return ended.select(*candidates.columns, "_name", prefix.alias("_prefix"))


def _relative_paths() -> Column:
    """Paths a dotted-prefix module may mean, over columns of :func:`_placed`; empty when
    it leaves the root."""
    nested = F.replace("_name", F.lit("."), F.lit("/"))
    below = lambda *parts: F.concat("_prefix", *parts)
    paths = F.when(F.col("_name") == "", F.array(below(F.lit("__init__.py")))).otherwise(
        F.array(
            below("_name", F.lit(".py")), below("_name", F.lit("/__init__.py")),
            below(nested, F.lit("/__init__.py")), below(nested, F.lit(".py")),
        )
    )
    return F.when(F.col("_prefix").isNotNull(), paths).otherwise(F.array().cast("array<string>"))


def _asked(candidates: DataFrame, paths: Column) -> DataFrame:
    """One row per path a candidate may mean, in order ``_rank``.  The statement is one
    struct column, so that aggregates by statement and place share its shuffle."""
    return _placed(candidates).select(
        F.struct("project_name", "file_path", "stmt_seq", "nth").alias("stmt"), "pos",
        F.posexplode(paths).alias("_rank", "_path"),
    ).withColumn("_project", F.col("stmt.project_name"))


def _existing(asked: DataFrame, files: DataFrame) -> DataFrame:
    """Join candidate paths with the corpus and keep the first that exists:
    (stmt, pos, dst), partitioned by ``stmt``, the importing statement.

    The paths of the corpus are unique, so a popular module is hot on one side
    only, where the adaptive skew join splits it.  Both sides grow with the corpus and
    their sizes are guesses, so neither is ever sent through the driver."""
    known = files.select(F.col("project_name").alias("_project"), F.col("file_path").alias("_path"))
    hits = asked.join(known.hint("merge"), ["_project", "_path"]).select("stmt", "pos", "_rank", "_path").repartition("stmt")
    return hits.groupBy("stmt", "pos").agg(F.min_by("_path", "_rank").alias("dst"))


def asked_paths(files: DataFrame, compat: bool = False) -> DataFrame:
    """Every path that an import statement of the files may mean."""
    asked = deny_modules(import_candidates(extract_imports(files), compat))
    paths = F.when(F.startswith("module", F.lit(".")), _relative_paths()).otherwise(_absolute_paths())
    return _asked(asked, paths)


def resolve_asked(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(stmt, pos, dst): in one statement a target is kept once, at its first place."""
    return _existing(asked, files).groupBy("stmt", "dst").agg(F.min("pos").alias("pos"))


def resolve_absolute(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """``a.b`` to ``a/b.py`` or ``a/b/__init__.py`` from the root."""
    absolute = candidates.filter(~F.startswith("module", F.lit(".")))
    return _existing(_asked(absolute, _absolute_paths()), files).select("stmt.*", "pos", "dst").drop("nth")


def resolve_relative(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Dotted-prefix modules against the folder of the importing file."""
    relative = candidates.filter(F.startswith("module", F.lit(".")))
    return _existing(_asked(relative, _relative_paths()), files).select("stmt.*", "pos", "dst").drop("nth")


def build_edges(files_all: DataFrame, files_indexed: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Edges (project_name, src, dst, stmt_seq, pos) of the indexed files.

    Targets may be any existing file.  In one statement a target is kept once,
    at its first place; statements repeat targets.  The places of a line's second
    statement follow from 65,536 on, and so on.  Both resolvers share one join with
    the corpus.
    """
    sources = files_all if files_indexed is None else files_indexed
    return resolve_asked(asked_paths(sources, compat), files_all).select(
        "stmt.project_name", F.col("stmt.file_path").alias("src"), "dst", F.col("stmt.stmt_seq").alias("stmt_seq"),
        (F.col("stmt.nth") * 65536 + F.col("pos")).alias("pos"),
    )
