"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from risklens.llm import ann, chat, compression, hilbert, licences, line_dedup, mixing, ngram_join, packing, periodic, phrases, quality, suffix_dedup
from risklens.session import tune


def _over(table: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # a batch that goes to Python is also bounded when every text is long
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        return build(tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet"))

    return query


def _mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return _over("documents", lambda docs: mixing.mix_query(docs, labels))(spark, sf_dir)


def _compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return _over("documents", lambda docs: compression.score_query(docs, labels))(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": _over("documents", packing.pack_query),
    "op2_quality": _over("documents", quality.quality_query),
    "op3_chat": _over("conversations", chat.chat_query),
    "op4_line_dedup": _over("documents", line_dedup.lines_query),
    "op5_suffix_dedup": _over("documents", suffix_dedup.repeats_query),
    "op6_mixing": _mixing,
    "op7_ngram_join": _over("documents", ngram_join.join_query),
    "op8_ann": _over("embeddings", ann.ann_query),
    "op9_sharding": _over("documents", hilbert.shard_query),
    "op10_licences": _over("documents", licences.licence_query),
    "op11_compression": _compression,
    "op12_collocations": _over("documents", phrases.phrases_query),
    "op13_periodic_runs": _over("documents", periodic.runs_query),
}
