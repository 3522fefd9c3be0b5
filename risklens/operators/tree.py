"""Depth-limited dependency trees as ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens.session import materialize


def _branch(last: Column) -> Column:
    return F.when(last, "└── ").otherwise("├── ")


def dep_tree(edges: DataFrame, roots: DataFrame, files: DataFrame, max_depth: int = 2) -> DataFrame:
    """Rows (root, path, depth, node, text) of each root's import tree.

    Children stand in import order; ``path`` sorts the rows of a root.  A node is
    opened only where a pre-order walk meets it first, later places just list it.
    An unknown root gives one row saying so.

    Up to depth 2 that rule needs only a file's own imports, so it is a join and
    two aggregates.  Deeper, where a node opens depends on everything opened before
    it; rounds of joins and grouped minima settle that for all roots at once.
    """
    known = files.select("project_name", F.col("file_path").alias("root"))
    asked = roots.select("project_name", "root").distinct()
    no_path = F.array().cast("array<bigint>")
    missing = asked.join(known, ["project_name", "root"], "left_anti").select(
        "project_name", "root", no_path.alias("path"), F.lit(0).cast("bigint").alias("depth"),
        F.col("root").alias("node"), F.concat(F.lit("File not found: "), F.col("root")).alias("text"),
    )
    present = asked.join(known, ["project_name", "root"], "left_semi")
    tops = present.select(
        "project_name", "root", no_path.alias("path"), F.lit(0).cast("bigint").alias("depth"),
        F.col("root").alias("node"), F.col("root").alias("text"),
    )
    out = tops.unionByName(missing)
    if max_depth <= 0:
        return out
    if max_depth > 2:
        return out.unionByName(_walked(edges, present, max_depth))

    ends = edges.groupBy("project_name", "src").agg(F.max(F.struct("stmt_seq", "pos")).alias("_end"))
    placed = edges.join(ends, ["project_name", "src"]).select(
        "project_name", "src", "dst", F.array("stmt_seq", "pos").alias("_place"),
        ((F.col("stmt_seq") == F.col("_end.stmt_seq")) & (F.col("pos") == F.col("_end.pos"))).alias("_last"),
    )
    first = placed.join(
        present.withColumnRenamed("root", "src"), ["project_name", "src"], "left_semi"
    )
    level1 = first.select(
        "project_name", F.col("src").alias("root"), F.col("_place").alias("path"),
        F.lit(1).cast("bigint").alias("depth"), F.col("dst").alias("node"),
        F.concat(_branch(F.col("_last")), "dst").alias("text"),
    )
    out = out.unionByName(level1)
    if max_depth == 1:
        return out
    opened = first.filter(F.col("src") != F.col("dst")).groupBy("project_name", "src", "dst").agg(
        F.min(F.struct("_place", "_last")).alias("_at")
    )
    below = placed.select(
        "project_name", F.col("src").alias("dst"), F.col("dst").alias("_node"),
        F.col("_place").alias("_sub"), F.col("_last").alias("_sublast"),
    )
    level2 = opened.join(below, ["project_name", "dst"]).select(
        "project_name", F.col("src").alias("root"), F.concat("_at._place", "_sub").alias("path"),
        F.lit(2).cast("bigint").alias("depth"), F.col("_node").alias("node"),
        F.concat(
            F.when(F.col("_at._last"), "    ").otherwise("│   "), _branch(F.col("_sublast")), "_node"
        ).alias("text"),
    )
    return out.unionByName(level2)


def _walked(edges: DataFrame, present: DataFrame, max_depth: int) -> DataFrame:
    """Rows below the root for any depth.

    A node is opened at the least, in pre-order, of its places below opened nodes.  Each
    round puts every node at the least place that the round before offers; the places
    of the first k nodes of a walk no longer change once those of the first k - 1 stand,
    because whatever else is offered begins with a later place.  The rounds end
    when one changes nothing.  A place is the list of import places on the way to it, so
    comparing lists compares pre-order.
    """
    key = ["project_name", "root", "node"]
    ends = edges.groupBy("project_name", "src").agg(F.max(F.struct("stmt_seq", "pos")).alias("_end"))
    steps = materialize(edges.join(ends, ["project_name", "src"]).select(
        "project_name", F.col("src").alias("node"), "dst", F.array("stmt_seq", "pos").alias("place"),
        ((F.col("stmt_seq") == F.col("_end.stmt_seq")) & (F.col("pos") == F.col("_end.pos"))).alias("last"),
    ), "steps")
    # repeated imports of a file offer later places only
    first = steps.groupBy("project_name", "node", "dst").agg(F.min(F.struct("place", "last")).alias("at")).select("project_name", "node", "dst", "at.*")
    tops = present.select(
        "project_name", "root", F.col("root").alias("node"), F.array().cast("array<bigint>").alias("path"), F.lit("").alias("indent"),
    )
    depth = F.size("path") / 2
    opened, mark = tops, None
    while True:
        offers = opened.filter(depth + 1 < max_depth).join(first, ["project_name", "node"]).filter(F.col("dst") != F.col("root")).select(
            "project_name", "root", F.col("dst").alias("node"),
            F.struct(F.concat("path", "place").alias("path"), F.concat("indent", F.when(F.col("last"), "    ").otherwise("│   ")).alias("indent")).alias("at"),
        )
        placed = offers.groupBy(*key).agg(F.min("at").alias("at")).select(*key, "at.*")
        opened = materialize(tops.unionByName(placed), "opened")
        now = opened.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*key, "path")), F.sum(F.hash(*key, "path").cast("bigint"))).first()
        if now == mark:
            break
        mark = now
    return opened.join(steps, ["project_name", "node"]).select(
        "project_name", "root", F.concat("path", "place").alias("path"), (depth + 1).cast("bigint").alias("depth"), F.col("dst").alias("node"),
        F.concat("indent", _branch(F.col("last")), "dst").alias("text"),
    )
