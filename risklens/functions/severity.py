"""Score bands and the risk decision table as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Score bands, each as (lowest score, name) plus the rest.
LADDERS: dict[str, tuple[list[tuple[float, str]], str | None]] = {
    "priority": ([(8, "CRITICAL"), (7, "HIGH"), (5, "MEDIUM")], "LOW"),
    "api": ([(8, "critical"), (6, "high"), (4, "medium")], "low"),
    "ui": ([(8, "CRITICAL"), (7, "HIGH"), (4, "MEDIUM")], "LOW"),
    "report": ([(8, "critical"), (7, "high"), (5, "medium")], "low"),
    "label": ([(8, "critical"), (7, "high-priority")], None),
}

# Closed score ranges of the badge ladder.
BADGES = [(9, 10, "red"), (7, 8, "orange"), (5, 6, "yellow"), (0, 4, "green")]


def severity(score: Column, ladder: str = "api") -> Column:
    """Band of a score; null where the ladder names none."""
    if ladder == "badge":
        low, high, name = BADGES[0]
        band = F.when(score.between(low, high), name)
        for low, high, name in BADGES[1:]:
            band = band.when(score.between(low, high), name)
        return band
    bands, rest = LADDERS[ladder]
    band = F.when(score >= bands[0][0], bands[0][1])
    for low, name in bands[1:]:
        band = band.when(score >= low, name)
    return band.otherwise(F.lit(rest))


def risk_columns(score: Column, verified: Column, evidence: Column) -> dict[str, Column]:
    """final_score, label, action_recommended and priority of one finding.

    A verified finding gains two points (ten with evidence); an unverified one
    keeps a high score, loses one in the middle band and drops to zero below.
    """
    proven = verified & evidence
    final = (
        F.when(proven, F.lit(10))
        .when(verified, F.least(F.lit(10), score + 2))
        .when(score >= 8, score)
        .when(score >= 5, F.greatest(F.lit(1), score - 1))
        .otherwise(F.lit(0))
    )
    # Label and action texts.
    label = (
        F.when(proven, "CRITICAL - VERIFIED WITH EXPLOIT")
        .when(verified, "CRITICAL - VERIFIED")
        .when(score >= 8, "High - Unverified")
        .when(score >= 5, "Medium - Unverified")
        .otherwise("False Positive - Low Risk")
    )
    action = (
        F.when(proven, "Fix immediately - working exploit exists")
        .when(verified, "Fix immediately")
        .when(score >= 8, "Manual review recommended - likely vulnerable")
        .when(score >= 5, "Review when resources available")
        .otherwise("Skip - likely false positive")
    )
    return {
        "final_score": final,
        "label": label,
        "action_recommended": action,
        "priority": severity(final, "priority"),
    }


def should_verify(score: Column, strategy: str = "smart") -> Column:
    """Whether a finding is picked for verification; unknown names act as smart."""
    score = F.coalesce(score, F.lit(0))
    if strategy == "all":
        return F.lit(True)
    if strategy == "none":
        return F.lit(False)
    return score >= {"critical": 8, "demo": 6}.get(strategy, 7)


# What a run prints about its own outcome.
SUCCESS_MARKER = "exploit_success"
FAILURE_MARKER = "exploit_failed"

# Substrings of output that count as proof.
INDICATORS = ["uid=", "root:", "etc/passwd", "<script>", "<!entity"]


def outcome_reason(
    stdout: Column, exit_code: Column, success: str = SUCCESS_MARKER, failure: str = FAILURE_MARKER,
    indicators: list[str] | None = None,
) -> Column:
    """Name of the first rule that decides an execution's outcome."""
    text = F.lower(F.coalesce(stdout, F.lit("")))
    code = F.coalesce(exit_code, F.lit(1))
    hit = F.lit(False)
    for part in INDICATORS if indicators is None else indicators:
        hit = hit | F.contains(text, F.lit(part.lower()))
    blank = F.btrim(text, F.lit(" \t\n\r\x0b\x0c")) == ""
    return (
        F.when(F.contains(text, F.lit(success.lower())), "success_marker")
        .when(F.contains(text, F.lit(failure.lower())), "failure_marker")
        .when(code != 0, "nonzero_exit")
        .when(hit, "indicator")
        .when(~blank, "clean_output")
        .otherwise("no_evidence")
    )


def outcome_ok(reason: Column) -> Column:
    """Whether the deciding rule means success."""
    return reason.isin("success_marker", "indicator", "clean_output")
