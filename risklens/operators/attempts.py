"""Logs of verification and fix attempts.

Rows are (finding_id, attempt, strategy, stdout, stderr, exit_code).  Only the
protocol's first attempts count, so every per-finding group is bounded by that
number; the log itself may hold any number of rows per finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens.functions.severity import FAILURE_MARKER, SUCCESS_MARKER, outcome_ok, outcome_reason
from risklens.functions.text import truncated

MAX_ATTEMPTS = 3


def classify_outcome(attempts: DataFrame, success: str = SUCCESS_MARKER, failure: str = FAILURE_MARKER,
                     indicators: list[str] | None = None) -> DataFrame:
    """Columns ``reason`` (the rule that decided) and ``ok``."""
    reason = outcome_reason(F.col("stdout"), F.col("exit_code"), success, failure, indicators)
    return attempts.withColumn("reason", reason).withColumn("ok", outcome_ok(F.col("reason")))


def _counted(attempts: DataFrame, max_attempts: int) -> DataFrame:
    return classify_outcome(attempts).filter(F.col("attempt").between(1, max_attempts))


def first_success(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per finding: verified, the attempt that succeeded (else the maximum), and
    that attempt's output (else the last one's)."""
    at = F.when(F.col("ok"), F.col("attempt"))
    return _counted(attempts, max_attempts).groupBy("finding_id").agg(
        F.coalesce(F.bool_or("ok"), F.lit(False)).alias("verified"),
        F.coalesce(F.min(at), F.lit(max_attempts)).cast("bigint").alias("attempts"),
        F.coalesce(F.min_by("stdout", at), F.max_by("stdout", "attempt"), F.lit("")).alias("output"),
        F.when(F.bool_or("ok"), F.lit("")).otherwise(F.lit("All attempts failed")).alias("error"),
    )


def _before_success(attempts: DataFrame, max_attempts: int) -> DataFrame:
    """Attempts up to and with the first success, marked with its number."""
    per_finding = Window.partitionBy("finding_id")
    marked = _counted(attempts, max_attempts).withColumn(
        "_first", F.min(F.when(F.col("ok"), F.col("attempt"))).over(per_finding)
    )
    return marked.filter(F.col("_first").isNull() | (F.col("attempt") <= F.col("_first")))


def failure_records(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Failures before the first success, long texts cut.

    A row whose ``generation_error`` is set never ran: it keeps that error and
    has no outputs."""
    failed = _before_success(attempts, max_attempts).filter(~F.col("ok"))
    never_ran = F.col("generation_error").isNotNull() if "generation_error" in attempts.columns else F.lit(False)
    error = F.col("generation_error") if "generation_error" in attempts.columns else F.lit(None).cast("string")

    def ran(c: Column) -> Column:
        return F.when(~never_ran, c)

    return failed.select(
        "finding_id", F.col("attempt").cast("bigint").alias("attempt"),
        F.when(never_ran, "generation failed").otherwise(truncated(F.col("strategy"), 150)).alias("strategy"),
        ran(truncated(F.col("stdout"), 200)).alias("stdout"), ran(truncated(F.col("stderr"), 200)).alias("stderr"),
        ran(F.col("exit_code").cast("bigint")).alias("exit_code"), error.alias("error"),
        F.lit("FAILED").alias("result"),
    )


def history_digest(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """For each attempt made, the text of all earlier failures in order."""
    error = F.when(
        F.coalesce("stderr", F.lit("")) != "",
        F.concat(F.lit("Error: "), truncated(F.col("stderr"), 200), F.lit("\n")),
    ).otherwise("")
    entry = F.concat(
        F.lit("\nAttempt #"), F.col("attempt"), F.lit(":\nStrategy: "), truncated(F.col("strategy"), 150),
        F.lit("\n"), error, F.lit("Result: FAILED\n"),
    )
    earlier = Window.partitionBy("finding_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    return _before_success(attempts, max_attempts).select(
        "finding_id", F.col("attempt").cast("bigint").alias("attempt"),
        F.array_join(F.collect_list(entry).over(earlier), "").alias("digest"),
        F.count(F.lit(1)).over(earlier).alias("earlier_failures"),
    )


def baseline_gate(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per finding: whether the check succeeded on the original (attempt 0).  Attempts
    beyond the protocol's are not looked at."""
    return classify_outcome(attempts.filter(F.col("attempt") <= max_attempts)).groupBy("finding_id").agg(
        F.coalesce(F.bool_or(F.when(F.col("attempt") == 0, F.col("ok"))), F.lit(False)).alias("baseline_ok")
    )


def first_fixed(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Per finding: the first fix after which the check no longer succeeds.

    Without a successful baseline nothing is tried (attempts 0).  ``crashed``
    tells a check that failed to run from one that ran and found nothing."""
    tried = F.col("attempt").between(1, max_attempts)
    at = F.when(tried & ~F.col("ok"), F.col("attempt"))
    per = classify_outcome(attempts.filter(F.col("attempt") <= max_attempts)).groupBy("finding_id").agg(
        F.coalesce(F.bool_or(F.when(F.col("attempt") == 0, F.col("ok"))), F.lit(False)).alias("baseline_ok"),
        F.min(at).alias("_at"), F.min_by("stdout", at).alias("_out"), F.min_by("exit_code", at).alias("_code"),
        F.max(F.when(F.col("attempt") == 0, F.col("stdout"))).alias("_base"),
    )
    fixed = F.col("baseline_ok") & F.col("_at").isNotNull()
    return per.select(
        "finding_id", "baseline_ok", fixed.alias("fixed"),
        F.when(~F.col("baseline_ok"), F.lit(0)).otherwise(F.coalesce("_at", F.lit(max_attempts)))
        .cast("bigint").alias("attempts"),
        F.when(~F.col("baseline_ok"), F.coalesce("_base", F.lit(""))).when(fixed, F.col("_out")).otherwise("")
        .alias("verification_output"),
        (fixed & (F.col("_code") != 0)).alias("crashed"),
        F.when(~F.col("baseline_ok"), "Exploit doesn't work on original code (false positive)")
        .when(fixed, "").otherwise(f"Could not generate valid patch after {max_attempts} attempts").alias("error"),
    )


def attempt_rates(results: DataFrame, by: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Share fixed by attempt 1, 2, ... of the findings that passed the gate, and
    the share that did not pass it."""
    passed = F.count_if("baseline_ok")
    rates = [
        F.bround(F.count_if(F.col("fixed") & (F.col("attempts") <= n)) * 100.0 / F.nullif(passed, F.lit(0)), 2)
        .alias(f"fixed_by_{n}_pct")
        for n in range(1, max_attempts + 1)
    ]
    return results.groupBy(by).agg(
        F.count(F.lit(1)).alias("findings"), passed.alias("baseline_ok"), *rates,
        F.bround(F.count_if(~F.col("baseline_ok")) * 100.0 / F.count(F.lit(1)), 2).alias("false_positive_pct"),
    )


def verification_status(results: DataFrame, kind: str = "check") -> DataFrame:
    """Report row per finding: status, first 500 characters of output, and the
    error only when there is one."""
    if kind == "check":
        status = F.when(F.col("verified"), "VERIFIED").otherwise("NOT VERIFIED")
        output = F.col("output")
    else:
        status = F.when(F.col("fixed"), "PATCH VERIFIED").otherwise("PATCH FAILED")
        output = F.col("verification_output")
    meta = [F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("type", "file", "function") if c in results.columns]
    error = F.when(F.col("error") != "", F.concat(F.lit("Error: "), "error"))
    return results.select(
        "finding_id", status.alias("status"), *meta, "attempts", truncated(output, 500).alias("output"),
        error.alias("error"),
    )
