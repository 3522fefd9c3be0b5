"""Pattern rules over code or text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A finding is raised when every pattern occurs in the text."""

    name: str
    type: str
    risk_score: int
    patterns: tuple[str, ...]


# Patterns per class.  The scores are this package's own choice.
RULES = [
    Rule("hardcoded_credentials", "Hardcoded Credentials", 8,
         (r"""(password|api_key|secret|token)\s*=\s*["'][^"']+["']""",)),
    Rule("insecure_random", "Insecure Randomness", 5, (r"import random", r"random\.")),
    Rule("weak_hash", "Weak Hashing", 6, (r"(?i)(md5|sha1)",)),
    Rule("sql_fstring", "SQL Injection", 9, (r"""(?i)f["'](select|insert|update|delete)\s[^"'\n]*\{""",)),
    Rule("shell_fstring", "Command Injection", 9, (r"os\.system\(f",)),
    Rule("unsafe_pickle", "Insecure Deserialization", 8, (r"pickle\.loads",)),
    Rule("path_concat", "Path Traversal", 7, (r"""open\(\s*["'][^"'\n]*["']\s*\+""",)),
    Rule("debug_print", "Debug Logging", 3, (r"""print\(f["']DEBUG""",)),
]


def _hit(text: Column, rule: Rule) -> Column:
    found = F.rlike(text, F.lit(rule.patterns[0]))
    for pattern in rule.patterns[1:]:
        found = found & F.rlike(text, F.lit(pattern))
    return F.when(found, F.struct(
        F.lit(rule.name).alias("rule"), F.lit(rule.type).alias("type"),
        F.lit(rule.risk_score).alias("risk_score"), F.lit(True).alias("vulnerable"),
        F.lit(f"pattern rule {rule.name}").alias("description"),
    ))


def rule_hits(text: Column, rules: list[Rule] = RULES) -> Column:
    """Array of the rules a text meets, tested in one pass over the row."""
    return F.array_compact(F.array(*[_hit(text, r) for r in rules]))


def scan_rules(df: DataFrame, text_col: str, rules: list[Rule] = RULES, keep_text: bool = False) -> DataFrame:
    """One row per text and rule met; a narrow projection, no join, no shuffle."""
    kept = [c for c in df.columns if keep_text or c != text_col]
    hits = df.select(*kept, F.explode(rule_hits(F.col(text_col), rules)).alias("_h"))
    return hits.select(*kept, "_h.*")


def _places(text: Column, pattern: str) -> Column:
    """Every occurrence of a pattern: line and column (from 1), and the text that matched.

    The text is cut at the matches; one pass over the cuts carries line and column on,
    so each character is looked at once."""
    end = F.lit("\n")
    breaks = lambda s: F.length(s) - F.length(F.replace(s, end, F.lit("")))
    after = lambda s, column: F.when(F.contains(s, end), F.length(F.substring_index(s, "\n", -1)) + 1).otherwise(column + F.length(s))
    cuts = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), lambda a, m: F.struct(a.alias("ahead"), m.alias("match"))
    )
    none = F.array().cast("array<struct<line:int,column:int,match:string>>")
    start = F.struct(F.lit(1).alias("line"), F.lit(1).alias("column"), none.alias("found"))

    def step(acc: Column, cut: Column) -> Column:
        line, column = acc["line"] + breaks(cut["ahead"]), after(cut["ahead"], acc["column"])
        here = F.struct(line.alias("line"), column.alias("column"), cut["match"].alias("match"))
        return F.struct(
            (line + breaks(cut["match"])).alias("line"), after(cut["match"], column).alias("column"),
            F.array_append(acc["found"], here).alias("found"),
        )

    # what follows the last match has no match beside it
    return F.aggregate(F.filter(cuts, lambda c: c["match"].isNotNull()), start, step, lambda acc: acc["found"])


def rule_places(df: DataFrame, text_col: str, rules: list[Rule] = RULES) -> DataFrame:
    """One row per place where a rule's first pattern occurs, for the rules a text meets:
    the input's other columns, rule, type, risk_score, nth (from 1), line, column, match.

    One combined pattern tells the texts that no rule can meet; only the others
    are searched rule by rule, and only those that a rule meets are cut."""
    kept, text = [c for c in df.columns if c != text_col], F.col(text_col)
    some = df.filter(F.rlike(text, F.lit("|".join(f"(?:{r.patterns[0]})" for r in rules))))
    met = lambda r: F.reduce(F.array(*[F.rlike(text, F.lit(p)) for p in r.patterns]), F.lit(True), lambda a, b: a & b)
    each = F.array(*[
        F.when(met(r), F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.type).alias("type"), F.lit(r.risk_score).alias("risk_score"), _places(text, r.patterns[0]).alias("places")
        )) for r in rules
    ])
    found = some.select(*kept, F.explode(F.array_compact(each)).alias("_r")).select(*kept, "_r.rule", "_r.type", "_r.risk_score", F.posexplode("_r.places").alias("_n", "_p"))
    return found.select(*kept, "rule", "type", "risk_score", (F.col("_n") + 1).alias("nth"), "_p.*")


def rule_summary(hits: DataFrame) -> DataFrame:
    """Hits and distinct projects per rule and type."""
    return hits.groupBy("rule", "type").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("project_name").alias("projects")
    )
