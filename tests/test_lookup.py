"""Lookups over the written layout read few row groups."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from risklens.sources import documents, sessions

N = 40_000


def _scanned(df) -> int:
    """Rows that the scan of an executed plan gave."""
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_document_lookup_reads_few_rows(spark, tmp_path):
    files = spark.range(N).select(
        F.lit("main").alias("project_name"), F.format_string("pkg%d/mod_%d.py", F.col("id") % 7, "id").alias("file_path"),
        F.sha2(F.col("id").cast("string"), 512).alias("content"),
    )
    path = str(tmp_path / "docs")
    documents.write_for_lookup(files, path, ["project_name", "file_path"], group_bytes=64 << 10)
    parts = [pq.ParquetFile(p).metadata for p in (tmp_path / "docs").glob("*.parquet")]
    assert sum(m.num_row_groups for m in parts) > 20
    assert any(m.row_group(0).column(1).statistics.min > "pkg0" for m in parts)
    found = documents.get_document(spark.read.parquet(path), "main", "pkg5/mod_12.py")
    assert [(r.file_path, len(r.content)) for r in found.collect()] == [("pkg5/mod_12.py", 128)]
    assert _scanned(found) < N / 20
    # inside the bounds of a row group, but not in it: the filter says so
    missing = documents.get_document(spark.read.parquet(path), "main", "pkg5/mod_12.pyx")
    assert missing.collect() == []
    assert _scanned(missing) == 0


def test_finding_lookup_reads_its_session(spark, tmp_path):
    rows = spark.range(N).select(F.format_string("proj%03d", F.col("id") % 100).alias("project_name"), F.floor(F.col("id") / 100).alias("seq"))
    path = str(tmp_path / "findings")
    documents.write_for_lookup(rows, path, ["project_name", "seq"], group_bytes=16 << 10)
    stored = spark.read.parquet(path)
    one = sessions.findings_for(stored, "proj003", 17)
    assert [tuple(r) for r in one.collect()] == [("proj003", 17)]
    assert _scanned(one) < N / 4
    assert sessions.findings_for(stored, "proj003").count() == N // 100
    none = sessions.findings_for(stored, "nowhere")
    assert none.collect() == []
    assert _scanned(none) == 0
