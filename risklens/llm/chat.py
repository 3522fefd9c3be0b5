"""Collapse of conversation snapshots that were logged while they grew.

Every turn gets the hash of all turns up to it.  A conversation whose last hash
is an earlier hash of another one is a prefix of it; an anti-join removes those,
and what is maximal is rendered turn by turn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens.session import materialize

# turn numbers of one conversation that one window numbers at a time
CHUNK_TURNS = 4096


def _running(rows: DataFrame, value: Column, total: Column, before: Column) -> DataFrame:
    """Per (conversation, chunk): ``total`` over it, ``before`` over the chunks ahead of it."""
    sums = rows.groupBy("_key").agg(total.alias("_total"))
    ahead = Window.partitionBy("_key.c").orderBy(F.col("_key.k").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return sums.select("_key", "_total", before.over(ahead).alias("_before"))


def prefix_hashes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", content: Sequence[str] = ("role", "text")) -> DataFrame:
    """Distinct turns with ``position`` (1-based), ``n_turns`` and the hashes
    ``h1``, ``h2`` of all turns up to this one.

    The hash of a prefix is the exclusive or of 64-bit hashes of (position, content),
    in two independent forms.  Turns are ordered by number, then by content, nulls
    last.  Conversations are numbered in fixed ranges of turn numbers with offsets
    from a small aggregate, so a conversation with a third of all turns is split.
    """
    fields = [f"`{c}`" for c in (conv, turn, *content)]
    plain = turns.select(*[F.col(c) for c in fields]).distinct()
    rows = plain.withColumn("_key", F.struct(F.col(fields[0]).alias("c"), F.expr(f"{fields[1]} div {CHUNK_TURNS}").alias("k")))
    order = Window.partitionBy("_key").orderBy(*[F.col(c).asc_nulls_last() for c in fields[1:]])
    counts = _running(rows, F.lit(1), F.count(F.lit(1)), F.sum("_total"))
    everything = counts.withColumn("n_turns", F.sum("_total").over(Window.partitionBy("_key.c")))
    numbered = materialize(
        rows.withColumn("_local", F.row_number().over(order))
        .join(everything, "_key")
        .withColumn("position", F.col("_local") + F.coalesce("_before", F.lit(0)))
        .drop("_local", "_total", "_before"),
        "turns",
    )
    marks = [x for c in content for x in (F.col(f"`{c}`").isNull(), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))]
    hashed = numbered.withColumns({
        "_a": F.xxhash64(F.lit(1), "position", *marks), "_b": F.xxhash64(F.lit(2), "position", *marks),
    })
    sums = hashed.groupBy("_key").agg(F.bit_xor("_a").alias("_ta"), F.bit_xor("_b").alias("_tb"))
    ahead = Window.partitionBy("_key.c").orderBy(F.col("_key.k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_key", F.coalesce(F.bit_xor("_ta").over(ahead), F.lit(0)).alias("_oa"),
        F.coalesce(F.bit_xor("_tb").over(ahead), F.lit(0)).alias("_ob"),
    )
    upto = Window.partitionBy("_key").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hashed.withColumns({"_ra": F.bit_xor("_a").over(upto), "_rb": F.bit_xor("_b").over(upto)})
        .join(offsets, "_key")
        .select(
            *[F.col(c) for c in fields], "position", "n_turns",
            F.col("_ra").bitwiseXOR(F.col("_oa")).alias("h1"), F.col("_rb").bitwiseXOR(F.col("_ob")).alias("h2"),
        )
    )


def collapse_snapshots(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns of the maximal conversations: ``conv``, ``position``, ``n_turns``, ``role``, ``text``.

    A conversation is dropped if all its turns are the first turns of a longer one;
    of equal conversations the smallest id stays (null ids last).  Turn numbers
    only order the turns, so gaps and other starting numbers do not matter.  A turn
    that is logged twice counts once.  Null roles and texts equal only null ones.  A null
    conversation id is one conversation.  Only the four named columns are read,
    so others cannot clash.  An empty table gives an empty table.
    """
    hashed = materialize(prefix_hashes(turns, conv, turn, (role, text)), "prefixes")
    whole = hashed.filter("position = n_turns").select(F.struct(F.col(f"`{conv}`").alias("id")).alias("_conv"), "n_turns", "h1", "h2")
    # one row per distinct conversation, then no prefix of another
    distinct = whole.groupBy("n_turns", "h1", "h2").agg(F.min_by("_conv", F.struct(F.col("_conv.id").isNull(), F.col("_conv.id"))).alias("_conv"))
    shorter = hashed.filter("position < n_turns").select(F.col("position").alias("n_turns"), "h1", "h2").distinct()
    maximal = distinct.join(shorter, ["n_turns", "h1", "h2"], "left_anti").select("_conv")
    keyed = hashed.withColumn("_conv", F.struct(F.col(f"`{conv}`").alias("id")))
    return keyed.join(maximal, "_conv", "left_semi").select(
        F.col(f"`{conv}`"), "position", "n_turns", F.col(f"`{role}`"), F.col(f"`{text}`")
    )


def render_turns(turns: DataFrame, role: str = "role", text: str = "text", out: str = "rendered") -> DataFrame:
    """``turns`` with ``out``: the turn between its markers.  A conversation is its
    turns' texts in order, end to end, whatever its length.  A null role is
    ``unknown``, a null text empty; a column named ``out`` is replaced."""
    return turns.withColumn(out, F.concat(
        F.lit("<|"), F.coalesce(F.col(f"`{role}`"), F.lit("unknown")), F.lit("|>\n"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit("<|end|>\n"),
    ))


def chat_query(conversations: DataFrame) -> DataFrame:
    """All maximal conversations, one rendered turn per row."""
    return render_turns(collapse_snapshots(conversations)).select("conv_id", "position", "n_turns", "role", "rendered")
