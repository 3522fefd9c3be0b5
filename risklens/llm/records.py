"""Packed numpy records through Spark shuffles, and sized joins.

A shuffle row here is a block of many fixed-width records that belong to one
bucket of the key's hash, so the cost per record is that of its bytes.  A block
holds the first bytes of all its records, then the second ones and so on: high bytes
of counters are runs of zeros then, which the shuffle's compression takes out.  Whoever
reads a partition gets all records of its buckets as one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklens.session import materialize

U64 = np.uint64
BUCKETS = 4096
BROADCAST_BYTES = 24 << 20
NO_ID = np.iinfo(np.int64).max  # a null id sorts after all others


def bucket_of(key: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    return (key >> U64(64 - (buckets - 1).bit_length())).astype(np.int64)


def blocks(records: np.ndarray, key: np.ndarray, buckets: int = BUCKETS) -> tuple[list[int], list[bytes]]:
    """Bucket numbers and packed blocks of ``records``, one block per bucket met."""
    bucket = bucket_of(key, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    sorted_bucket = bucket[order]
    at = np.flatnonzero(np.diff(sorted_bucket, prepend=-1))
    ends = np.append(at[1:], len(order))
    plain = records[order].view(np.uint8).reshape(len(order), records.dtype.itemsize)
    return sorted_bucket[at].tolist(), [plain[a:b].T.tobytes() for a, b in zip(at.tolist(), ends.tolist())]


def unpack(parts: list[bytes], dtype: np.dtype) -> np.ndarray:
    width = dtype.itemsize
    out, at = np.empty((sum(map(len, parts)) // width, width), dtype=np.uint8), 0
    for part in parts:
        n = len(part) // width
        out[at : at + n] = np.frombuffer(part, dtype=np.uint8).reshape(width, n).T
        at += n
    return out.reshape(-1).view(dtype)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new value of the sorted columns begins."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def read_all(batches: Iterator[pa.RecordBatch], column: str) -> list[bytes]:
    """All non-null blocks of a partition."""
    return [x for b in batches for x in b.column(column).to_pylist() if x is not None]


def small_join(big: DataFrame, small: DataFrame, on, how: str, row_bytes: int) -> DataFrame:
    """Join with a side that is usually small: its rows are counted, and up to
    ``BROADCAST_BYTES`` it is sent to all executors; beyond that both sides are
    shuffled.  ``small`` must be cheap to count (a written table)."""
    if small.count() * (row_bytes + 64) <= BROADCAST_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def thinned(df: DataFrame, hashed, rows: int) -> DataFrame:
    """Rows whose hash lies in a range that about four times ``rows`` of them meet; all
    rows of a small table.  Taking the first ``rows`` of that by hash then moves a
    bounded number, however many partitions there are."""
    share = min(1.0, 4 * rows / max(df.count(), 1))
    return df.filter(F.pmod(hashed, F.lit(1 << 30)) <= int(share * (1 << 30)))


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under names of its own (c0, c1, ...), which nothing added to it can clash
    with, and the new name of each column; ``toDF(*df.columns)`` restores them."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def row_keys(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``df`` with a key of two longs for every row, by which documents are ordered:
    ``__doc``, the id (the largest long for null), and ``__tie``.

    Of an id it is the text's hash, so rows of one id with different texts are
    documents of their own, and copies of a row one document.  Rows without an id
    are written once with their number in order of the text's hash; each is a
    document of its own."""
    own, content = F.col(f"`{doc_id}`").cast("bigint"), F.xxhash64(F.col(f"`{text}`").cast("string"))
    columns = [F.col(f"`{c}`") for c in df.columns]
    nameless = df.filter(own.isNull())
    named = df.select(*columns, F.coalesce(own, F.lit(int(NO_ID))).alias("__doc"), content.alias("__tie"))
    if nameless.isEmpty():
        return named
    # the first number tells equal texts apart, so they need not share a partition
    ordered = nameless.select(*columns, F.lit(int(NO_ID)).alias("__doc"), content.alias("__hash"), F.monotonically_increasing_id().alias("__n")).orderBy("__hash", "__n")
    written = materialize(ordered.select(*columns, "__doc", F.monotonically_increasing_id().alias("__tie")), "nameless")
    return named.filter(own.isNotNull()).union(written)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) edges of long ids: (node, label), label the
    smallest id of the component.  Ids without an edge are not listed.

    Alternating large and small stars: every node's neighbours are pointed at the
    smallest of them, with grouped minima and joins only, so no neighbourhood is
    ever gathered.  Each round is written, and the rounds end when one changes
    nothing; their number grows with the logarithm of the longest chain.
    """
    pairs = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # each node's smaller neighbours, and the node itself, point at the smallest
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(
            least.select("u", F.col("m").alias("v"))
        ).distinct()
        pairs = materialize(small, "stars")
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
    labels = pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
