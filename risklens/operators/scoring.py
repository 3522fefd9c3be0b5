"""Scoring, ranking, verification budget and work queues of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens.functions.severity import risk_columns, severity, should_verify
from risklens.operators.filters import effective_score
from risklens.operators.ordering import CHUNK_ROWS, chunk_rank, group_position
from risklens.session import materialize


def score(df: DataFrame, evidence: Column | None = None) -> DataFrame:
    """Add final_score, label, action_recommended and priority."""
    proof = evidence if evidence is not None else F.col("evidence") != ""
    columns = risk_columns(
        F.coalesce("risk_score", F.lit(0)), F.coalesce("verified", F.lit(False)), F.coalesce(proof, F.lit(False))
    )
    return df.withColumns(columns)


def to_api_finding(df: DataFrame) -> DataFrame:
    """Auditor finding to the interface's shape, with defaults."""
    risk = F.coalesce("risk_score", F.lit(0))
    kind = F.coalesce("type", F.lit("Unknown"))
    description = F.coalesce("description", F.lit("")) if "description" in df.columns else F.lit("")
    return df.select(
        "project_name", "seq", "file", kind.alias("title"), kind.alias("type"), severity(risk, "api").alias("severity"),
        F.coalesce("start_line", F.lit(0)).alias("line"), risk.alias("riskScore"),
        description.alias("description"), F.coalesce("function", F.lit("")).alias("function"),
    )


def number_findings(df: DataFrame, by: str = "project_name", order: str = "seq", chunk: int = CHUNK_ROWS) -> DataFrame:
    """1-based ``id`` in scan order."""
    return chunk_rank(df, [by], order, "id", chunk=chunk)


def ranked(df: DataFrame, by: str = "project_name", seq: str = "seq", chunk: int = CHUNK_ROWS) -> DataFrame:
    """Column ``rank`` per project: effective score descending, ties in input order."""
    return chunk_rank(df, [by], seq, "rank", lead=effective_score(df), chunk=chunk)


def prioritize(df: DataFrame, by: str = "project_name", seq: str = "seq") -> DataFrame:
    """Total order over all findings: effective score descending, then input order.

    A range-partitioned sort; the sequence breaks ties, so equal scores spread
    over many partitions.
    """
    return df.orderBy(effective_score(df).desc(), by, seq)


def ranked_overall(df: DataFrame, by: str = "project_name", seq: str = "seq") -> DataFrame:
    """Column ``rank`` over all findings, in the order of :func:`prioritize`."""
    return group_position(df, [], [effective_score(df).desc(), by, seq], "rank")


def select_for_verification(
    df: DataFrame, strategy: str = "smart", max_n: int | None = None, by: str = "project_name", seq: str = "seq"
) -> DataFrame:
    """Column ``selected``: rows that pass the strategy, per project at most
    ``max_n`` in input order (0 or None is no limit).

    The first passing rows of a project come from a row number with a limit, which
    Spark applies below the shuffle; their keys mark the rows.
    """
    passing = should_verify(F.col("risk_score"), strategy)
    if not max_n:
        return df.withColumn("selected", passing)
    first = Window.partitionBy(by).orderBy(seq)
    picked = df.filter(passing).select(by, seq).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= max_n)
    return df.join(picked, [by, seq], "left").withColumn("selected", F.col("_n").isNotNull()).drop("_n")


def validated(df: DataFrame, strategy: str = "smart", max_n: int | None = None) -> DataFrame:
    """Budgeted verification: selected rows are scored with their verification,
    the others as unverified."""
    picked = select_for_verification(df, strategy, max_n)
    seen = picked.withColumns({
        "verified": F.col("selected") & F.coalesce("verified", F.lit(False)),
        "evidence": F.when(F.col("selected"), F.col("evidence")).otherwise(""),
    })
    return score(seen)


def merge_verification(findings: DataFrame, results: DataFrame, key: str = "finding_id") -> DataFrame:
    """Join verification results (verified, output, evidence, error) and rescore.

    ``priority`` is not taken over and ``severity_rating`` is always 'Unknown'.
    A finding without a result stays unverified.
    """
    r = results.select(
        key, F.col("verified").alias("_v"), F.col("output").alias("_o"), F.col("evidence").alias("_e"),
        F.col("error").alias("_err"),
    )
    joined = findings.drop("verified", "evidence").join(r, key, "left")
    merged = joined.withColumns({
        "verified": F.coalesce("_v", F.lit(False)),
        "exploit_output": F.coalesce("_o", F.lit("")),
        "evidence": F.coalesce("_e", F.lit("")),
        "verification_error": F.nullif("_err", F.lit("")),
    }).drop("_v", "_o", "_e", "_err")
    unscored = F.col("risk_score").isNull()
    out = score(merged).drop("priority")
    return out.withColumns({
        "label": F.when(unscored, "UNKNOWN").otherwise(F.col("label")),
        "action_recommended": F.when(unscored, "Review manually").otherwise(F.col("action_recommended")),
        "severity_rating": F.lit("Unknown"),
    })


def pin_first(df: DataFrame, idx: int, pos: str = "rank") -> DataFrame:
    """Move row ``idx`` to the front: arithmetic on a dense 1-based position."""
    p = F.col(pos)
    return df.withColumn(
        "position", F.when(p == idx, F.lit(1)).when(p < idx, p + 1).otherwise(p).cast("bigint")
    )


def work_queue(
    df: DataFrame, selected: DataFrame | None = None, by: str = "project_name", item: str = "seq",
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """Selected rows in rank order: position, state and the next item.

    The successor is an equi-join on (project, position + 1), both sides unique; the
    ranking is computed once.
    """
    chosen = df if selected is None else df.join(selected, [by, item], "left_semi")
    # both sides of the join read one written ranking
    order = materialize(ranked(chosen, by, item, chunk).withColumnRenamed("rank", "position"), "queue")
    following = order.select(
        F.col(by), (F.col("position") - 1).alias("position"), F.col(item).alias("next_item")
    )
    return order.join(following, [by, "position"], "left").withColumn(
        "state", F.when(F.col("position") == 1, "current").otherwise("queued")
    )


def remaining(df: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Findings not remediated yet."""
    return df.join(done.select(*key), key, "left_anti")


def remediated(findings: DataFrame, done: DataFrame, links: DataFrame, key: list[str], order: str = "number") -> DataFrame:
    """Remediated findings with the last link recorded for each, null if none."""
    last = links.groupBy(*key).agg(F.max_by("url", order).alias("url"))
    fixed = findings.join(done.select(*key).distinct(), key)
    return fixed.join(last, key, "left")


def session_actions(log: DataFrame, by: str = "session", order: str = "seq") -> DataFrame:
    """Per session, over the actions before the first exit: fixed (F with success)
    and skipped (S); total counts all queued rows.

    The first exit is a map-side combined minimum, so no session is walked."""
    exits = log.groupBy(by).agg(F.min(F.when(F.col("action") == "E", F.col(order))).alias("_exit"))
    before = F.col("_exit").isNull() | (F.col(order) < F.col("_exit"))
    done = before & (F.col("action") == "F") & F.coalesce("success", F.lit(False))
    return log.join(exits, by).groupBy(by).agg(
        F.count_if(done).alias("fixed"),
        F.count_if(before & (F.col("action") == "S")).alias("skipped"),
        F.count(F.lit(1)).alias("total"),
    )
