"""Session settings and the shared scratch folder.

Operators stay lazy wherever they can.  The few that must cut lineage (graph
rounds, global numbering) write a table below the folder the cluster names in
``spark.checkpoint.dir``, so a lost executor costs a re-read and never a wrong
or missing row.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every plan here is written for.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a repeated key in a reply: the last one wins
    "spark.sql.variant.allowDuplicateKeys": "true",
}


# Shuffle files are removed when the execution that made them has ended.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "risklens") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the given one."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SQL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session somebody else built."""
    for key, value in SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    chosen = spark.sparkContext.getCheckpointDir()
    if chosen:
        return chosen.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="risklens-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """Fresh path in the scratch folder, never used before."""
    return f"{scratch_root(spark)}/risklens/{label}-{uuid.uuid4().hex}"


def write_tidy(df: DataFrame, path: str) -> None:
    """Write ``df``; nothing reads this write's own shuffle files again, so they go
    with its end and not when the driver happens to collect its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(TIDY) if before is None else conf.set(TIDY, before)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: lineage is cut, the
    values are fixed, and readers still get column pruning and pushdown."""
    spark = df.sparkSession
    path = new_path(spark, label)
    write_tidy(df, path)
    return spark.read.schema(df.schema).parquet(path)
