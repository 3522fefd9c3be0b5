"""Summaries of findings: map-side combined counts, one row per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens.functions.severity import severity
from risklens.operators.filters import effective_score, is_vulnerable, vulnerable_only


def _bands(score: Column) -> dict[str, Column]:
    return {
        "critical": F.count_if(score >= 8),
        "high": F.count_if((score >= 7) & (score < 8)),
        "medium": F.count_if((score >= 5) & (score < 7)),
    }


def _aliased(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(name) for name, c in columns.items()]


def _verified() -> Column:
    return F.coalesce("verified", F.lit(False))


def summary_by_severity(df: DataFrame, by: str = "project_name", files: DataFrame | None = None) -> DataFrame:
    """Total and the four interface bands; with ``files`` also scanned files."""
    band = severity(F.coalesce("risk_score", F.lit(0)), "api")
    out = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(band == name).alias(name) for name in ("critical", "high", "medium", "low")],
    )
    if files is None:
        return out
    scanned = files.groupBy(by).agg(F.count(F.lit(1)).alias("scanned_files"))
    return out.join(scanned, by, "left").na.fill(0, ["scanned_files"])


def audit_summary(df: DataFrame, by: str = "project_name") -> DataFrame:
    """Counts on final_score, where a missing one counts as zero."""
    final = F.coalesce("final_score", F.lit(0))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_verified()).alias("verified"),
        *_aliased(_bands(final)), F.count_if(final == 0).alias("false_positives"),
    )


def audit_report(df: DataFrame, by: str = "project_name") -> DataFrame:
    """Functions analysed, vulnerable ones, and the bands over those."""
    risk = F.when(is_vulnerable(), F.col("risk_score"))
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("functions"), F.count_if(is_vulnerable()).alias("vulnerable"),
        *_aliased(_bands(risk)), F.count_if(risk < 5).alias("low"),
    )


def audit_report_rows(df: DataFrame) -> DataFrame:
    """The findings the report lists: vulnerable, from 7 on, with their band."""
    band = severity(F.col("risk_score"), "report")
    return vulnerable_only(df).filter(F.col("risk_score") >= 7).withColumn("band", band)


def priority_report(df: DataFrame, by: str = "project_name") -> DataFrame:
    """Bands on the effective score, verified, and scores of exactly zero."""
    score = effective_score(df)
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"), *_aliased(_bands(score)), F.count_if(score < 5).alias("low"),
        F.count_if(_verified()).alias("verified"), F.count_if(score == 0).alias("false_positives"),
    )


def top_per_band(
    df: DataFrame, tops: dict[str, int] | None = None, by: str = "project_name", seq: str = "seq"
) -> DataFrame:
    """First rows of each band in rank order, numbered (by default five critical
    and three high ones).  The bound is applied below the shuffle as well."""
    tops = tops or {"CRITICAL": 5, "HIGH": 3}
    score = effective_score(df)
    banded = df.withColumn("band", severity(score, "priority")).filter(F.col("band").isin(*tops))
    window = Window.partitionBy(by, "band").orderBy(score.desc(), seq)
    numbered = banded.withColumn("idx", F.row_number().over(window)).filter(F.col("idx") <= max(tops.values()))
    keep = F.lit(False)
    for name, n in tops.items():
        keep = keep | ((F.col("band") == name) & (F.col("idx") <= n))
    return numbered.filter(keep)


def verification_summary(df: DataFrame, by: str | None = None) -> DataFrame:
    """Total, verified, unverified and critical findings."""
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_verified()).alias("verified"),
        (F.count(F.lit(1)) - F.count_if(_verified())).alias("unverified"),
        F.count_if(F.coalesce("final_score", F.lit(0)) >= 8).alias("critical"),
    )


def review_reduction(df: DataFrame, by: str = "project_name") -> DataFrame:
    """How many findings still need a person: verified, or high and unverified.

    Percentages of the total, rounded half to even."""
    high = ~_verified() & (F.col("label") == "High - Unverified")
    false_positive = F.coalesce("final_score", F.lit(0)) == 0
    counted = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_verified() | high).alias("to_review"),
        F.count_if(false_positive).alias("false_positives"),
    )
    total = F.nullif("total", F.lit(0))
    return counted.withColumns({
        "reduction_pct": F.bround((F.col("total") - F.col("to_review")) * 100.0 / total, 2),
        "false_positive_pct": F.bround(F.col("false_positives") * 100.0 / total, 2),
    })


def dashboard_metrics(df: DataFrame, files: DataFrame, by: str = "project_name") -> DataFrame:
    """Threats, scanned lines and the highest risk; 8.0 when there is no finding.

    Lines are estimated as a hundred per scanned file, 1000 without a count."""
    found = df.groupBy(by).agg(F.count(F.lit(1)).alias("threats"), F.max("risk_score").alias("_max"))
    scanned = files.groupBy(by).agg(F.count(F.lit(1)).alias("_files"))
    out = scanned.join(found, by, "full_outer")
    return out.select(
        by, F.coalesce("threats", F.lit(0)).alias("threats"),
        F.coalesce(F.nullif(F.col("_files"), F.lit(0)) * 100, F.lit(1000)).alias("scanned"),
        F.coalesce(F.col("_max").cast("double"), F.lit(8.0)).alias("risk_score"),
    )
