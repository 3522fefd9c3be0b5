"""Row filters over paths and findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens.functions.severity import should_verify

# Directories a code index leaves out.
EXCLUDED_DIRS = [
    "venv", "__pycache__", "node_modules", "dist", "build",
    ".tox", ".eggs", ".mypy_cache", ".pytest_cache", "site-packages",
]
# Default exclude globs and substrings.
EXCLUDED_GLOBS = ["**/__pycache__/**", "**/venv/**", "**/.venv/**"]
EXCLUDED_SUBSTRINGS = [".git", "__pycache__"]


def exclude_segments(df: DataFrame, names: Sequence[str] = EXCLUDED_DIRS, path: str = "file_path") -> DataFrame:
    """Drop paths with a hidden or excluded segment; the file name counts too."""
    bad = F.exists(F.split(path, "/"), lambda s: F.startswith(s, F.lit(".")) | s.isin(*names))
    return df.filter(~bad)


def glob_regex(glob: str, mode: str = "pathlib") -> str:
    """Regex of a path glob.

    ``pathlib`` matches whole segments from the right and reads ``**`` as ``*``;
    ``recursive`` reads ``**`` as any number of segments.
    """

    def segment(text: str) -> str:
        out = ""
        for ch in text:
            out += {"*": "[^/]*", "?": "[^/]"}.get(ch, "\\" + ch if not (ch.isalnum() or ch in "_/") else ch)
        return out

    parts = glob.split("/")
    if mode == "pathlib":
        return "(?:^|/)" + "/".join(segment("*" if p == "**" else p) for p in parts) + "$"
    if mode != "recursive":
        raise ValueError(f"unknown mode: {mode}")
    regex = "^"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            regex += ".*" if last else "(?:.*/)?"
        else:
            regex += segment(part) + ("" if last else "/")
    return regex + "$"


def exclude_globs(
    df: DataFrame, globs: Sequence[str] = EXCLUDED_GLOBS, mode: str = "pathlib", path: str = "file_path",
    root: str = "root",
) -> DataFrame:
    """Drop paths matching any glob.  Paths are taken below ``root``, so that
    ``**/venv/**`` also meets a top-level ``venv``; pass ``root=''`` for bare paths."""
    full = F.concat(F.lit(root + "/" if root else ""), F.col(path))
    keep = F.lit(True)
    for glob in globs:
        keep = keep & ~F.rlike(full, F.lit(glob_regex(glob, mode)))
    return df.filter(keep)


def exclude_substrings(df: DataFrame, subs: Sequence[str] = EXCLUDED_SUBSTRINGS, path: str = "file_path") -> DataFrame:
    """Drop paths holding any of the substrings, wherever they stand."""
    keep = F.lit(True)
    for sub in subs:
        keep = keep & ~F.contains(F.col(path), F.lit(sub))
    return df.filter(keep)


def is_vulnerable() -> Column:
    return F.coalesce(F.col("vulnerable"), F.lit(False))


def vulnerable_only(df: DataFrame) -> DataFrame:
    return df.filter(is_vulnerable())


def min_risk(df: DataFrame, n: int = 5) -> DataFrame:
    """Vulnerable findings from score ``n`` on."""
    return df.filter(is_vulnerable() & (F.col("risk_score") >= n))


def effective_score(df: DataFrame) -> Column:
    """final_score if the table has one, else risk_score, else 0."""
    parts = [F.col(c) for c in ("final_score", "risk_score") if c in df.columns]
    return F.coalesce(*parts, F.lit(0))


def actionable(df: DataFrame, min_score: int = 5, verified_only: bool = False) -> DataFrame:
    """Findings from an effective score on, on request only verified ones."""
    keep = effective_score(df) >= min_score
    if verified_only:
        keep = keep & F.coalesce(F.col("verified"), F.lit(False))
    return df.filter(keep)


def pick_strategy(df: DataFrame, strategy: str = "smart") -> DataFrame:
    return df.filter(should_verify(F.col("risk_score"), strategy))


def alert_level(df: DataFrame) -> DataFrame:
    """Column ``alert``: high for vulnerable findings from 7 on, info for the rest."""
    level = F.when(is_vulnerable() & (F.col("risk_score") >= 7), "high").when(is_vulnerable(), "info")
    return df.withColumn("alert", level)


def release_gate(df: DataFrame, by: str = "project_name", n: int = 8) -> DataFrame:
    """Per project: number of blocking findings and whether the gate passes."""
    blocking = is_vulnerable() & (F.col("risk_score") >= n)
    return df.groupBy(by).agg(
        F.count_if(blocking).alias("blocking"),
        (~F.bool_or(blocking)).alias("passed"),
    )


def require_keys(df: DataFrame, map_col: str, keys: Sequence[str]) -> DataFrame:
    """Column ``error``: names the first key the map lacks, null when complete."""
    wanted = F.array(*[F.lit(k) for k in keys])
    missing = F.filter(wanted, lambda k: ~F.coalesce(F.map_contains_key(F.col(map_col), k), F.lit(False)))
    return df.withColumn(
        "error", F.when(F.size(missing) > 0, F.concat(F.lit("Missing required key: "), F.get(missing, F.lit(0))))
    )
