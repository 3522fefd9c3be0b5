"""Hot keys: most rows share one module, one finding or one title.

Broadcasts are off and the skew limits tiny, so the adaptive plan must split the
hot partitions; results must equal those of the ordinary plan."""

import pytest
from pyspark.sql import functions as F

from risklens.operators import graph, imports, publish, scoring

FORCED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
}


@pytest.fixture
def forced(spark):
    before = {k: spark.conf.get(k, None) for k in FORCED}

    def switch(on):
        for k, v in FORCED.items():
            if on:
                spark.conf.set(k, v)
            elif before[k] is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, before[k])

    yield switch
    switch(False)


def _both(df, forced):
    """Rows under ordinary and under forced settings, and the forced final plan."""
    forced(False)
    plain = sorted(map(str, df().collect()))
    forced(True)
    hot = df()
    rows = sorted(map(str, hot.collect()))
    assert rows == plain and rows
    return hot._jdf.queryExecution().executedPlan().toString()


def test_a_popular_module(spark, forced):
    files = spark.range(1500).select(
        F.lit("p").alias("project_name"), F.concat(F.lit("m"), "id", F.lit(".py")).alias("file_path"),
        F.concat(F.lit("import m0\nimport m"), (F.col("id") * 7) % 1500, F.lit("\n")).alias("content"),
    )
    plan = _both(lambda: imports.build_edges(files), forced)
    assert "skew=true" in plan
    assert imports.build_edges(files).filter("dst = 'm0.py'").count() >= 1500


def test_a_hub_in_the_graph(spark, forced):
    edges = spark.range(2000).select(
        F.lit("p").alias("project_name"),
        F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("n"), F.col("id") % 50)).alias("src"),
        F.when(F.col("id") % 5 == 1, "hub").otherwise(F.concat(F.lit("n"), F.col("id") % 400)).alias("dst"),
        F.col("id").alias("stmt_seq"), F.lit(0).cast("bigint").alias("pos"),
    )
    roots = edges.select("project_name", F.col("src").alias("root"))
    _both(lambda: graph.dependencies(edges, roots, 2), forced)


def test_one_finding_with_most_rows(spark, forced):
    findings = spark.range(20_000).select(
        F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id") % 500).cast("int").alias("finding_id"),
        (F.col("id") % 11).cast("int").alias("risk_score"), F.lit(False).alias("verified"), F.lit("").alias("evidence"),
        F.col("id").alias("seq"),
    )
    results = spark.range(500).select(
        F.col("id").cast("int").alias("finding_id"), (F.col("id") % 2 == 1).alias("verified"),
        F.lit("out").alias("output"), F.lit("").alias("evidence"), F.lit("").alias("error"),
    )
    plan = _both(lambda: scoring.merge_verification(findings, results), forced)
    assert "skew=true" in plan


def test_one_title_with_most_rows(spark, forced):
    findings = spark.range(20_000).select(
        F.lit("SQL Injection").alias("type"),
        F.when(F.col("id") % 2 == 0, "login").otherwise(F.concat(F.lit("f"), F.col("id") % 700)).alias("function"),
        F.concat(F.lit("file"), "id").alias("file"), F.lit(9).alias("risk_score"),
    )
    known = findings.filter("function in ('f1', 'f3')").select(publish.issue_title().alias("title"))
    _both(lambda: publish.new_issues(findings, known), forced)
    kept = publish.new_issues(findings, known, within_batch=True)
    assert kept.count() == kept.select("title").distinct().count()
