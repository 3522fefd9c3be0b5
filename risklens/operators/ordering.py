"""Numbering and ranking inside groups that may be arbitrarily large.

``row_number() OVER (PARTITION BY g ORDER BY ...)`` puts a whole group in one
task.  The two helpers here give the same numbers without that:

* :func:`chunk_rank` needs an integer sequence that is unique inside the group.
  The sequence is cut in fixed ranges, rows are numbered inside a range, and the
  ranges' row counts (a small, map-side combined aggregate) give the offsets.
* :func:`group_position` needs only a total order.  One range-partitioned sort
  is written out; the position is then arithmetic on the sorted row number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens.session import materialize

# Rows of one group that one task numbers at a time.
CHUNK_ROWS = 1 << 20


def chunk_rank(
    df: DataFrame,
    by: Sequence[str],
    seq: str,
    out: str = "rank",
    lead: Column | None = None,
    chunk: int = CHUNK_ROWS,
) -> DataFrame:
    """1-based rank inside ``by``, ordered by ``lead`` descending, then ``seq``.

    ``lead`` must take few values (a score); ``seq`` must be an integer that is
    unique inside ``by``.
    """
    # one struct as the key: it compares null groups as equal, and window,
    # aggregate and join all agree on a single shuffle of the rows
    group = F.struct(*by)
    marked = df.withColumn("_key", F.struct(
        group.alias("g"), (lead if lead is not None else F.lit(0)).alias("lead"),
        F.expr(f"`{seq}` div {chunk}").alias("chunk"),
    ))
    before = Window.partitionBy("_key.g").orderBy(F.col("_key.lead").desc(), "_key.chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        marked.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    local = marked.withColumn("_local", F.row_number().over(Window.partitionBy("_key").orderBy(seq)))
    return local.join(offsets, "_key").select(
        *df.columns, (F.col("_local") + F.col("_offset")).cast("bigint").alias(out)
    )


def group_position(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], out: str = "seq", keep: Sequence[str] | None = None
) -> DataFrame:
    """1-based position inside ``by`` under a total order, for any group size.
    ``keep`` names the columns to carry on, by default all.

    The sorted table is written once, because range bounds are sampled per
    execution: numbering and offsets must see the same partitions.
    """
    columns = list(keep or df.columns)
    ordered = df.orderBy(*by, *order).select(
        *dict.fromkeys([*columns, *by]), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")
    )
    stored = materialize(ordered, "sorted")
    keys = [*by, "_part"]
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy(*keys)
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    # at most one row per group and sorted partition it touches; written, so that
    # later reads of the result do not count again
    starts = materialize(starts, "offsets")
    joined = stored.alias("s").join(
        starts.alias("t"), [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    )
    return joined.select(
        *[F.col(f"s.`{c}`") for c in columns],
        (F.col("s._row") - F.col("t._first") + F.col("t._offset") + 1).cast("bigint").alias(out),
    )


def latest_by(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key under ``order``.

    ``row_number() = 1`` is planned with a partial group limit below the shuffle,
    so each task sends at most one row per key however many copies it holds.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")
