"""Sharding along a Hilbert curve over quantised metadata.

Every row gets a cell per dimension; the curve visits the cells so that
neighbours on the curve are neighbours in all dimensions.  Rows are sorted by
curve index and cut into runs, so a shard covers a compact box of the metadata
and its value ranges prune it for a filter on any of the dimensions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens.operators.ordering import group_position

BITS = 5


def quantise_hash(col: Column, bits: int = BITS) -> Column:
    """Cell of a category: equal values share a cell; null is cell 0."""
    return F.when(col.isNull(), F.lit(0)).otherwise(
        F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(1 << bits))
    ).cast("int")


def quantise_log(col: Column, bits: int = BITS) -> Column:
    """Cell of a count: half powers of two, the last cell open; null or less than
    1 is cell 0."""
    cell = F.floor(F.log2(F.greatest(col.cast("double"), F.lit(1.0))) * 2).cast("int")
    return F.least(F.coalesce(cell, F.lit(0)), F.lit((1 << bits) - 1))


def hilbert_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """Index on the curve of a cell given by one integer per dimension, each
    below ``2 ** bits``.

    Cell coordinates are turned into the transposed index by exchanging and
    inverting low bits from the top level down, then Gray-decoded; the levels are
    one native ``aggregate`` over a literal array.
    """
    n = len(cells)
    levels = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<int>")

    def step(x: Column, level: Column) -> Column:
        mask = level - 1

        def turn(a: Column, i: int) -> Column:
            swap = a[0].bitwiseXOR(a[i]).bitwiseAND(mask)
            on = a[i].bitwiseAND(level) != 0
            out = [a[k] for k in range(n)]
            out[0] = F.when(on, a[0].bitwiseXOR(mask)).otherwise(a[0].bitwiseXOR(swap))
            if i:
                out[i] = F.when(on, a[i]).otherwise(a[i].bitwiseXOR(swap))
            return F.array(*out)

        for i in range(n):
            x = _let(x, partial(turn, i=i))
        return x

    start = F.array(*[c.cast("int") for c in cells])
    turned = F.aggregate(levels, start, step)

    def gray(x: Column) -> Column:
        out = [x[0]]
        for i in range(1, n):
            out.append(x[i].bitwiseXOR(out[-1]))
        return F.array(*out)

    def flips(x: Column) -> Column:
        return F.aggregate(
            levels, F.lit(0),
            lambda t, level: F.when(x[n - 1].bitwiseAND(level) != 0, t.bitwiseXOR(level - 1)).otherwise(t),
        )

    def index(x: Column) -> Column:
        def bit(b: int, i: int) -> Column:
            value = F.shiftrightunsigned(x[i], b).bitwiseAND(F.lit(1)).cast("bigint")
            return F.shiftleft(value, b * n + (n - 1 - i))

        total = F.lit(0).cast("bigint")
        for b in range(bits):
            for i in range(n):
                total = total.bitwiseOR(bit(b, i))
        return total

    return _let(
        turned,
        lambda a: _let(gray(a), lambda g: _let(flips(g), lambda t: _let(
            F.transform(g, lambda v: v.bitwiseXOR(t)), index
        ))),
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def curve_shards(df: DataFrame, cells: Sequence[Column], n_shards: int, ties: Sequence[str], bits: int = BITS) -> DataFrame:
    """``df`` with ``shard`` (0 up to ``n_shards`` - 1), ``slot`` (gapless from 0 in the
    shard) and ``curve``; shard sizes differ by one row at most.

    Rows with equal curve index are ordered by the columns ``ties``; rows equal in
    those too are interchangeable.  Columns of ``df`` named like the three new ones
    are replaced.  Null cells' rules are the quantisers'; an empty table gives an
    empty table.

    One range-partitioned sort of the given columns, written once; the sort key
    contains ``ties``, so a cell that holds a third of all rows is still split.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot", "curve")]
    marked = df.select(*[F.col(f"`{c}`") for c in kept], hilbert_index(cells, bits).alias("curve"))
    placed = group_position(marked, [], ["curve", *[F.col(f"`{t}`") for t in ties]], "_position")
    n = placed.count()
    shard = f"((_position - 1) * {n_shards} div {max(n, 1)})"
    first = f"(({shard} * {n} + {n_shards - 1}) div {n_shards})"
    return placed.select(
        *[F.col(f"`{c}`") for c in kept], "curve", F.expr(shard).cast("int").alias("shard"),
        F.expr(f"_position - 1 - {first}").cast("bigint").alias("slot"),
    )


def write_shards(df: DataFrame, path: str) -> None:
    """Write a sharded table, one folder per shard, rows in slot order; every
    file's column ranges are those of a run of the curve."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_query(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """All documents in shards by source, language and length."""
    text = F.col("text").cast("binary")
    rows = docs.select(
        "doc_id", "source", "lang", "n_chars",
        (F.coalesce(F.length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).cast("bigint").alias("text_crc32"),
    )
    cells = [quantise_hash(F.col("source")), quantise_hash(F.col("lang")), quantise_log(F.col("n_chars"))]
    return curve_shards(rows, cells, n_shards, ["text_crc32", "doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
