"""Tables ready to publish: issue titles, bodies, labels and change records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens.functions.severity import severity
from risklens.operators.filters import effective_score
from risklens.operators.ordering import latest_by

BASE_LABELS = ("security",)
FOOTER = "*This issue was created automatically.*"


def issue_title(form: str = "function") -> Column:
    """Title of a finding's issue; form ``file`` names the file instead."""
    if form == "file":
        return F.concat(F.lit("Security: "), "type", F.lit(" in "), "file")
    return F.concat(F.lit("[Security] "), "type", F.lit(" in "), "function", F.lit("()"))


def existing_issues(df: DataFrame, state: str = "open", labels: Sequence[str] = ()) -> DataFrame:
    """Issues by state that carry all labels; change requests are left out."""
    keep = ~F.coalesce("is_pr", F.lit(False))
    if state != "all":
        keep = keep & (F.col("state") == state)
    for label in labels:
        keep = keep & F.array_contains("labels", F.lit(label))
    return df.filter(keep)


def new_issues(findings: DataFrame, existing: DataFrame, within_batch: bool = False) -> DataFrame:
    """Findings whose title no existing issue has.

    Findings of one batch may share a title; with ``within_batch`` only the one
    with the highest score is kept."""
    titled = findings.withColumn("title", issue_title())
    fresh = titled.join(existing.select("title").distinct(), "title", "left_anti")
    if not within_batch:
        return fresh
    return latest_by(fresh, ["title"], [F.col("risk_score").desc(), F.col("file"), F.col("function")])


def issue_labels(mode: str = "audit", base: Sequence[str] = BASE_LABELS) -> Column:
    """Labels by score (``audit``) or by priority and verification (``verified``)."""
    fixed = [F.lit(b) for b in base]
    if mode == "audit":
        extra = [severity(F.col("risk_score"), "label")]
    else:
        extra = [
            F.when(F.col("priority") == "CRITICAL", "critical").when(F.col("priority") == "HIGH", "high-priority"),
            F.when(F.coalesce("verified", F.lit(False)), "verified"),
        ]
    return F.array_compact(F.array(*fixed, *extra))


def _or(df: DataFrame, name: str, default: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)


def issue_body(df: DataFrame, template: str = "audit", footer: str = FOOTER) -> DataFrame:
    """Column ``body``: markdown from the row's fields.

    The ``verified`` template adds the evidence block only for verified findings
    with evidence and cuts the output at 500 characters."""
    # Section texts of the two templates.
    place = F.concat(
        F.lit("\n**Type:** "), _or(df, "type", "Unknown"), F.lit("\n**File:** `"), _or(df, "file", "Unknown"),
        F.lit("`\n**Function:** `"), _or(df, "function", "Unknown"), F.lit("()`\n**Lines:** "),
        _or(df, "start_line", "?"), F.lit("-"), _or(df, "end_line", "?"), F.lit("\n\n### Description\n\n"),
    )
    end = F.lit(f"\n\n---\n\n{footer}\n")
    if template == "audit":
        mark = severity(F.col("risk_score"), "badge")
        emoji = F.when(mark == "red", "🔴").when(mark == "orange", "🟠").when(mark == "yellow", "🟡").otherwise("🟢")
        body = F.concat(
            F.lit("## "), emoji, F.lit(" Security Vulnerability Detected\n\n**Risk Score:** "),
            F.col("risk_score").cast("string"), F.lit("/10"), place, _or(df, "description", ""),
            F.lit("\n\n### Recommendation\n\nPlease review the affected code and apply appropriate security fixes."), end,
        )
        return df.withColumn("body", body)
    verified = F.coalesce("verified", F.lit(False))
    proof = F.when(
        verified & (F.coalesce("evidence", F.lit("")) != ""),
        F.concat(
            F.lit("\n\n### Verification\n\nThis vulnerability has been verified.\n\n**Output:**\n```\n"),
            F.substring(_or(df, "exploit_output", ""), 1, 500), F.lit("\n```\n"),
        ),
    ).otherwise("")
    body = F.concat(
        F.lit("## 🔴 Security Vulnerability Detected\n\n**Status:** "),
        F.when(verified, "✅ VERIFIED").otherwise("❌ Unverified"), F.lit("\n**Risk Score:** "),
        effective_score(df).cast("string"), F.lit("/10\n**Priority:** "), _or(df, "priority", "Unknown"), place,
        _or(df, "description", "No description available"), F.lit("\n\n### Recommendation\n\n"),
        _or(df, "action_recommended", "Review and fix this vulnerability"), F.lit("\n"), proof, end,
    )
    return df.withColumn("body", body)


def change_records(fixes: DataFrame, existing: DataFrame, prefix: str = "security") -> DataFrame:
    """Branch, commit, title and body of verified fixes, one per (repo, branch).

    ``fixes`` has repo, number, type, file and content; empty contents are
    rejected.  ``existing`` has repo, branch, state and url; an open record is
    reused before a closed one."""
    number = F.col("number").cast("string")
    branch = F.concat(F.lit(f"{prefix}/fix-"), number)
    records = fixes.filter(F.coalesce("content", F.lit("")) != "").select(
        "repo", branch.alias("branch"), "number", "type", "file",
        F.concat(F.lit("fix: "), "type", F.lit(" security vulnerability\n\nFixes #"), number).alias("commit_message"),
        F.concat(F.lit("🔒 Security Fix: "), "type").alias("title"),
        F.concat(
            F.lit("## Security Patch\n\nThis PR fixes a **"), "type",
            F.lit("** vulnerability identified in issue #"), number,
            F.lit(".\n\n### Changes\n- Fixed: `"), "file", F.lit("`\n\nFixes #"), number, F.lit("\n"),
        ).alias("body"),
    )
    single = records.groupBy("repo", "branch").agg(
        F.min(F.struct("number", "type", "file", "commit_message", "title", "body")).alias("_r")
    ).select("repo", "branch", "_r.*")
    rank = F.when(F.col("state") == "open", 0).otherwise(1)
    known = existing.groupBy("repo", "branch").agg(
        F.min(F.struct(rank.alias("rank"), F.col("url"))).getField("url").alias("existing_url")
    )
    return single.join(known, ["repo", "branch"], "left")
