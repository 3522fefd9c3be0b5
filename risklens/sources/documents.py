"""The table of file documents: keys, upsert, deletion, lookup, and a layout for lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.functions.text import doc_id
from risklens.operators.ordering import latest_by


def with_doc_id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", doc_id(F.col("project_name"), F.col("file_path")))


def upsert_documents(
    existing: DataFrame, incoming: DataFrame, key: str = "doc_id", order: str = "analyzed_at"
) -> DataFrame:
    """Latest version of every document; a tie goes to the incoming one.
    Documents that did not come in again stay.

    Two anti joins on (key, order): against a small delivery Spark broadcasts its
    keys, and the stored contents are filtered where they lie.  ``existing`` has
    each key once."""
    fresh = latest_by(incoming, [key], [F.col(order).desc()])
    theirs = fresh.select(F.col(key).alias("_key"), F.col(order).alias("_order"))
    kept = existing.join(theirs, (F.col(key) == F.col("_key")) & (F.col(order) <= F.col("_order")), "left_anti")
    ours = existing.select(F.col(key).alias("_key"), F.col(order).alias("_order"))
    accepted = fresh.join(ours, (F.col(key) == F.col("_key")) & (F.col("_order") > F.col(order)), "left_anti")
    return kept.unionByName(accepted)


def write_documents(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Write documents partitioned by project, replacing only the projects in
    ``df``.  A project's documents spread over ``buckets`` tasks, so one big
    project is no single writer."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    (
        df.repartition("project_name", salt)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("project_name").parquet(path)
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_for_lookup(df: DataFrame, path: str, keys: list[str], group_bytes: int = 16 << 20) -> None:
    """Write ``df`` so that few row groups are read for given ``keys``.

    Files are ranges of the keys and sorted by them, so the bounds of a row group
    exclude all but neighbours of the first key; a Bloom filter of each key decides
    inside them.  A filter takes the size that its row group's values need."""
    blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in keys}
    (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .write.mode("overwrite").options(**blooms)
        .option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.block.size", group_bytes)
        .parquet(path)
    )


def clear_project(df: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Documents of all other projects, and the number deleted as a one-row table."""
    gone = F.col("project_name") == project
    return df.filter(~gone), df.filter(gone).agg(F.count(F.lit(1)).alias("deleted"))


def get_document(files: DataFrame, project: str, path: str) -> DataFrame:
    """The document of a path, at most one row.  Over a table of :func:`write_for_lookup`
    both conditions reach the scan."""
    return files.filter((F.col("project_name") == project) & (F.col("file_path") == path)).limit(1)
