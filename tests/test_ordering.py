"""Numbering in groups where one holds most rows, against plain windows."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens.operators.ordering import chunk_rank, group_position, latest_by
from risklens.operators.scoring import number_findings, ranked, select_for_verification, work_queue


def _rows(spark, n=3000):
    """Half of all rows in one group; scores with many ties; a null group."""
    i = F.col("id")
    group = F.when(i % 2 == 0, "hot").when(i % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), i % 7))
    return spark.range(n).select(
        group.alias("project_name"), (i * 7919 % 100_003).alias("seq"), (i * 31 % 11).cast("int").alias("risk_score"),
        (i % 3 == 0).alias("verified"), F.lit("").alias("evidence"),
    )


def _same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_chunk_rank_equals_a_window(spark):
    df = _rows(spark)
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("project_name").orderBy("seq")).cast("bigint"))
    for chunk in (1, 97, 5_000, 1 << 20):
        _same(want, chunk_rank(df, ["project_name"], "seq", chunk=chunk))


def test_rank_by_score_equals_a_window(spark):
    df = _rows(spark)
    by_score = Window.partitionBy("project_name").orderBy(F.col("risk_score").desc(), "seq")
    _same(df.withColumn("rank", F.row_number().over(by_score).cast("bigint")), ranked(df, chunk=500))


def test_numbers_follow_the_scan_order(spark):
    df = _rows(spark).filter("verified")
    by_seq = Window.partitionBy("project_name").orderBy("seq")
    _same(df.withColumn("id", F.row_number().over(by_seq).cast("bigint")), number_findings(df, chunk=1000))


def test_group_position_equals_a_window(spark):
    df = _rows(spark).repartition(7)
    order = [F.col("risk_score").desc(), F.col("seq")]
    want = df.withColumn("p", F.row_number().over(Window.partitionBy("project_name").orderBy(*order)).cast("bigint"))
    _same(want, group_position(df, ["project_name"], order, "p"))


def test_a_hot_group_is_numbered_in_several_tasks(spark):
    plan = chunk_rank(_rows(spark), ["project_name"], "seq", chunk=100)
    sizes = plan.groupBy("project_name", F.floor(F.col("seq") / 100)).count()
    assert sizes.agg(F.max("count")).first()[0] <= 100


def test_latest_limits_groups_below_the_shuffle(spark):
    df = _rows(spark)
    latest = latest_by(df, ["project_name"], [F.col("seq").desc()])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("WindowGroupLimit") > plan.index("Exchange")
    want = df.groupBy("project_name").agg(F.max("seq").alias("seq"))
    _same(want, latest.select("project_name", "seq"))


def test_budget_takes_the_first_passing_rows(spark):
    df = _rows(spark).filter("project_name is not null")
    by_seq = Window.partitionBy("project_name").orderBy("seq")
    n = F.count_if(F.col("risk_score") >= 7).over(by_seq)
    want = df.withColumn("selected", (F.col("risk_score") >= 7) & (n <= 12))
    _same(want, select_for_verification(df, "smart", 12))
    for no_limit in (0, None):
        _same(df.withColumn("selected", F.col("risk_score") >= 7), select_for_verification(df, "smart", no_limit))


def test_queue_links_every_row_to_its_successor(spark):
    df = _rows(spark).filter("project_name is not null")
    order = Window.partitionBy("project_name").orderBy(F.col("risk_score").desc(), "seq")
    want = df.select(
        "project_name", "seq", F.row_number().over(order).cast("bigint").alias("position"),
        F.lead("seq").over(order).alias("next_item"),
    )
    _same(want, work_queue(df, chunk=300).select("project_name", "seq", "position", "next_item"))
