"""Incremental indexing of file versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.operators.ordering import latest_by

SCHEMA = "project_name string, file_path string, content string, analyzed_at timestamp, doc_id string"


def read_index(spark: SparkSession, table_path: str) -> DataFrame:
    """The document table: the latest delivered version of every document."""
    deliveries = spark.read.schema(SCHEMA + ", batch bigint").parquet(table_path)
    newest = [F.col("analyzed_at").desc(), F.col("batch").desc()]
    return latest_by(deliveries, ["doc_id"], newest).drop("batch")


def compact_index(spark: SparkSession, table_path: str, target_path: str) -> None:
    """Write the current documents as one delivery of a new table."""
    read_index(spark, table_path).write.parquet(f"{target_path}/batch=0")


def start_index_stream(source: DataFrame, table_path: str, checkpoint: str, available_now: bool = True):
    """Upsert each micro-batch of file versions in the document table.

    A batch writes only its own documents, each once, in a folder of its own:
    the cost follows the delivery, not the table, and a batch that is repeated
    after a failure replaces itself."""

    def step(batch: DataFrame, batch_id: int) -> None:
        # two versions of one time: the greater content, so a repeated batch agrees
        once = latest_by(batch, ["doc_id"], [F.col("analyzed_at").desc(), F.col("content").desc()])
        once.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
