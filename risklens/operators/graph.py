"""Queries over the import graph.

Edges are (project_name, src, dst, stmt_seq, pos); (stmt_seq, pos) is the place
of an import in its file.  Roots are (project_name, root).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklens.functions.text import basename, strip
from risklens.operators.ordering import group_position
from risklens.session import materialize, new_path, write_tidy

NODE = ["project_name", "root", "dst"]

# Steps up to which walks are counted ahead; their number grows with every step.
LIST_DEPTH = 3

# Walks from one root that a task may hold as lists.
LONG_ROOT = 1 << 18

# Walks that one task collects, and those of a batch of roots; a batch has at
# least as many walks as the graph has edges.
TASK_WALKS = 1 << 21
BATCH_WALKS = 1 << 24


def direct_deps(edges: DataFrame, path: str | None = None) -> DataFrame:
    """Imports as rows (src, stmt_seq, pos, dst); all files, or one of them."""
    rows = edges if path is None else edges.filter(F.col("src") == path)
    return rows.select("project_name", "src", "stmt_seq", "pos", "dst")


def dependents(edges: DataFrame, path: str | None = None) -> DataFrame:
    """Files that import a file: distinct (dst, src), for all files or one."""
    rows = edges if path is None else edges.filter(F.col("dst") == path)
    return rows.select("project_name", "dst", "src").distinct()


def dependencies(
    edges: DataFrame, roots: DataFrame, depth: int, order: bool = True,
    fold: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Files reachable in at most ``depth`` steps: (root, dst, level, order).

    A file appears once per root, at its lowest level; the root itself is left
    out.  ``order`` sorts a level the way a queue would visit it: the import
    places along the way, compared element by element; ``order=False`` leaves
    that column and its cost out.

    ``fold`` makes what is kept of the rows, for results that are much smaller
    than them: it gets the rows of a batch of roots, all rows of a root name
    together, and the result is the union of what it returns.  Each batch is
    written before the next one begins, so the disk holds the pairs of one batch,
    about as many as there are edges, and not all pairs.  With ``order`` or beyond
    ``LIST_DEPTH`` steps there is one batch.
    """
    if not order and 0 < depth <= LIST_DEPTH:
        return _dependencies_by_lists(edges, roots, depth, fold)
    found = _dependencies_by_rows(edges, roots, depth, order)
    return found if fold is None else fold(found)


def _dependencies_by_rows(edges: DataFrame, roots: DataFrame, depth: int, order: bool) -> DataFrame:
    """One row per pair, so a root may reach any number of files.

    One join and one map-side combined aggregate per round; rounds that are read
    again are written out, so the plan does not double with every step.
    """
    place = F.array("stmt_seq", "pos") if order else F.array().cast("array<bigint>")
    steps = edges.select("project_name", "src", F.col("dst").alias("_next"), place.alias("_place"))
    if not order:
        # repeated imports of a file add nothing: fewer rows to join
        steps = steps.drop("_place").distinct()
    kept = ["order"] if order else []
    start = roots.select("project_name", "root").distinct()
    frontier = start.select("*", F.col("root").alias("dst"), *[
        F.array().cast("array<bigint>").alias(c) for c in kept
    ])
    seen = start.select("project_name", "root", F.col("root").alias("dst"))
    found = seen.limit(0).select(
        *NODE, F.lit(0).cast("bigint").alias("level"), *[F.array().cast("array<bigint>").alias(c) for c in kept]
    )
    for level in range(1, depth + 1):
        reached = frontier.join(
            steps, (frontier["project_name"] == steps["project_name"]) & (frontier["dst"] == steps["src"])
        ).select(
            frontier["project_name"], "root", F.col("_next").alias("dst"),
            *[F.concat("order", "_place").alias(c) for c in kept],
        )
        nearest = reached.groupBy(*NODE).agg(F.min("order").alias("order")) if order else reached.distinct()
        fresh = nearest.join(seen, NODE, "left_anti").select(*NODE, F.lit(level).cast("bigint").alias("level"), *kept)
        if level < depth:
            fresh = materialize(fresh, "round")
            if level > 1 and fresh.isEmpty():
                break
            seen = seen.unionByName(fresh.select(*NODE))
            frontier = fresh.drop("level")
        found = fresh if level == 1 else found.unionByName(fresh)
    return found


def _walks(edges: DataFrame, depth: int) -> DataFrame:
    """(project_name, src, fan, walks): statements of a file, and its walks of 1 to
    ``depth`` steps along statements: no fewer than the rows of any round."""
    own = edges.groupBy("project_name", "src").agg(F.count(F.lit(1)).cast("double").alias("fan"))
    out = materialize(own.withColumn("walks", F.col("fan")), "walks")
    for _ in range(depth - 1):
        ahead = out.select("project_name", F.col("src").alias("dst"), F.col("walks").alias("_walks"))
        longer = edges.select("project_name", "src", "dst").join(ahead, ["project_name", "dst"]).groupBy(
            "project_name", "src"
        ).agg(F.sum("_walks").alias("_walks"))
        both = out.select("project_name", "src", "fan").join(longer, ["project_name", "src"], "left")
        out = materialize(
            both.select("project_name", "src", "fan", (F.col("fan") + F.coalesce("_walks", F.lit(0.0))).alias("walks")), "walks"
        )
    return out


def _dependencies_by_lists(
    edges: DataFrame, roots: DataFrame, depth: int, fold: Callable[[DataFrame], DataFrame] | None
) -> DataFrame:
    """What a file imports travels as one row, and what a root reaches meets in one
    task; pairs become rows where they are read.  Roots of over ``LONG_ROOT`` walks,
    whose lists no task should hold, go row by row."""
    walks = _walks(edges, depth)
    long = F.col("walks") > LONG_ROOT
    asked = materialize(
        roots.select("project_name", "root").distinct().join(walks.withColumnRenamed("src", "root"), ["project_name", "root"]), "roots"
    )
    n_edges, hubs = walks.agg(F.sum("fan"), F.count_if(F.col("fan") > LONG_ROOT)).first()
    short_walks, long_walks, n_long = asked.agg(
        F.sum(F.when(~long, F.col("walks"))), F.sum(F.when(long, F.col("walks"))), F.count_if(long)
    ).first()
    steps = edges.select("project_name", "src", "dst")
    if hubs:
        # at most one in LONG_ROOT edges; no other root meets them before its last step
        steps = steps.join(F.broadcast(walks.filter(F.col("fan") > LONG_ROOT)), ["project_name", "src"], "left_anti")
    # collected values have no null: one null target per file is added again
    names = F.concat(F.collect_set("dst"), F.when(F.bool_or(F.isnull("dst")), F.array(F.lit(None))).otherwise(F.array()))
    lists = materialize(steps.groupBy("project_name", "src").agg(names.alias("names")), "lists")
    few = asked.filter(~long).select("project_name", "root")
    own = lists.withColumnRenamed("src", "root").join(few, ["project_name", "root"])
    # seen: the files of earlier levels, the root first, without null, which no join meets
    first = materialize(
        own.select("project_name", "root", F.array("root").alias("seen"), _unseen(F.array("root"), F.col("names")).alias("fresh")), "round"
    )
    size = max(BATCH_WALKS, n_edges or 0)
    batches = max(1, math.ceil((short_walks or 0) / size), min(n_long, math.ceil((long_walks or 0) / size))) if fold else 1
    tasks = math.ceil((short_walks or 0) / batches / TASK_WALKS) + 1

    def found(mine: Column) -> DataFrame:
        rows = _list_rounds(lists, first.filter(mine), depth, tasks)
        far = asked.filter(long & mine).select("project_name", "root")
        if not n_long or far.isEmpty():
            return rows
        return rows.unionByName(_dependencies_by_rows(edges, far, depth, False))

    if batches == 1:
        return fold(found(F.lit(True))) if fold else found(F.lit(True))
    spark = edges.sparkSession
    folder = new_path(spark, "batches")
    for i in range(batches):
        part = fold(found(F.pmod(F.xxhash64("root"), F.lit(batches)) == i))
        write_tidy(part, f"{folder}/{i}")
    return spark.read.schema(part.schema).parquet(*[f"{folder}/{i}" for i in range(batches)])


def _unseen(seen: Column, names: Column) -> Column:
    """Distinct ``names`` that are not in ``seen``, an array of distinct values."""
    return F.slice(F.array_distinct(F.concat(seen, names)), F.size(seen) + 1, F.lit(1 << 30))


def _list_rounds(lists: DataFrame, first: DataFrame, depth: int, tasks: int) -> DataFrame:
    """Rows (root, dst, level) of the roots of ``first``, whose ``fresh`` are the files of level 1."""
    pairs = lambda df: df.select("project_name", "root", F.explode("fresh").alias("dst"))
    level_of = lambda n: F.lit(n).cast("bigint").alias("level")
    found, state = pairs(first).withColumn("level", level_of(1)), first
    for level in range(2, depth + 1):
        frontier = pairs(state)
        reached = frontier.join(
            lists, (frontier["project_name"] == lists["project_name"]) & (frontier["dst"] == lists["src"])
        ).select(frontier["project_name"], "root", F.lit(None).cast(first.schema["seen"].dataType).alias("seen"), "names")
        known = F.concat("seen", F.filter("fresh", lambda x: x.isNotNull()))
        before = state.select("project_name", "root", known.alias("seen"), F.lit(None).cast(lists.schema["names"].dataType).alias("names"))
        # one exchange, into as many tasks as the walks need; null lists are not collected
        met = before.unionByName(reached).repartition(tasks, "project_name", "root").groupBy("project_name", "root").agg(
            F.flatten(F.collect_list("seen")).alias("seen"), F.flatten(F.collect_list("names")).alias("names")
        )
        state = met.select("project_name", "root", "seen", _unseen(F.col("seen"), F.col("names")).alias("fresh"))
        if level < depth:
            state = materialize(state.filter(F.size("fresh") > 0), "round")
            if state.isEmpty():
                break
        found = found.unionByName(pairs(state).withColumn("level", level_of(level)))
    return found


def context_sections(files: DataFrame, edges: DataFrame, targets: DataFrame, depth: int = 1) -> DataFrame:
    """Sections of every target's context: (root, section, kind, path, content).

    Dependencies come in visiting order, the target last; null and empty
    contents are left out.  ``section`` is dense from 1.  Row form: no target's
    context has to fit in one value.
    """
    found = dependencies(edges, targets, depth).select(
        "project_name", "root", F.col("dst").alias("path"), "level", "order", F.lit("Context").alias("kind")
    )
    own = targets.select("project_name", "root").distinct().select(
        "project_name", "root", F.col("root").alias("path"), F.lit((1 << 62)).alias("level"),
        F.array().cast("array<bigint>").alias("order"), F.lit("Target").alias("kind"),
    )
    wanted = found.unionByName(own)
    text = files.select("project_name", F.col("file_path").alias("path"), "content").filter(F.col("content") != "")
    # number the narrow rows first; contents join afterwards
    has_text = text.select("project_name", "path")
    kept = wanted.join(has_text, ["project_name", "path"], "left_semi")
    numbered = group_position(kept, ["project_name", "root"], ["level", "order"], "section")
    return numbered.join(text, ["project_name", "path"]).select(
        "project_name", "root", "section", "kind", "path", "content"
    )


def context_bundle(files: DataFrame, edges: DataFrame, targets: DataFrame, depth: int = 1) -> DataFrame:
    """One text per target: its dependencies' contents, then its own.

    One value per target by definition, so it is as large as what the target
    imports; :func:`context_sections` has the same as rows.  A target without
    any content gives no row.
    """
    sections = context_sections(files, edges, targets, depth)
    head = F.concat(F.lit("=== "), F.col("kind"), F.lit(": "), F.col("path"), F.lit(" ===\n"), F.col("content"))
    text = F.when(F.col("kind") == "Context", F.concat(head, F.lit("\n\n"))).otherwise(head)
    gathered = sections.select("project_name", "root", "section", text.alias("text")).groupBy("project_name", "root").agg(
        F.array_sort(F.collect_list(F.struct("section", "text"))).alias("_s")
    )
    return gathered.select("project_name", "root", F.array_join(F.col("_s.text"), "").alias("bundle"))


def finding_context(findings: DataFrame, bundles: DataFrame, files: DataFrame) -> DataFrame:
    """Bundle of each finding's file, or the bare file where there is none."""
    text = bundles.select("project_name", F.col("root").alias("file"), "bundle")
    bare = files.select("project_name", F.col("file_path").alias("file"), "content")
    both = findings.join(text, ["project_name", "file"], "left").join(bare, ["project_name", "file"], "left")
    return both.withColumn("context", F.coalesce(F.nullif("bundle", F.lit("")), "content")).drop("bundle", "content")


# Fixed value: the heading of a section.
_SECTION = r"===\s*(Context|Target):\s*(.+?)\s*===\s*\n"


def unpack_bundle(df: DataFrame, col: str) -> DataFrame:
    """Sections of a bundle: the input's other columns, then name, path, kind and
    content.  Contents are stripped, empty ones dropped, and of equal file names
    the last wins.  A text that is no bundle gives one row without a name."""
    keys = [c for c in df.columns if c != col]
    text = F.col(col)
    is_bundle = F.contains(text, F.lit("===")) & (
        F.contains(text, F.lit("Target:")) | F.contains(text, F.lit("Context:"))
    )
    pieces = F.slice(F.split(text, _SECTION), F.lit(2), F.lit(1 << 30))
    kinds = F.regexp_extract_all(text, F.lit(_SECTION), 1)
    paths = F.regexp_extract_all(text, F.lit(_SECTION), 2)
    rows = F.transform(
        F.arrays_zip(kinds.alias("kind"), paths.alias("path"), pieces.alias("piece")),
        lambda z: F.struct(
            basename(strip(z["path"])).alias("name"), strip(z["path"]).alias("path"),
            z["kind"].alias("kind"), strip(z["piece"]).alias("content"),
        ),
    )
    cut = df.withColumn("_full", F.filter(rows, lambda r: r["content"] != ""))
    # inside one text: in order of name and place, the last of each name stays
    cut = cut.withColumn("_named", F.array_sort(F.transform("_full", lambda r, i: F.struct(r["name"].alias("name"), i.alias("i")))))
    last = F.filter("_named", lambda x, j: ~F.get("_named", j + 1)["name"].eqNullSafe(x["name"]))
    kept = F.transform(F.array_sort(F.transform(last, lambda x: x["i"])), lambda i: F.get("_full", i))
    whole = F.array(F.struct(
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("path"),
        F.lit("Raw").alias("kind"), text.alias("content"),
    ))
    chosen = F.when(is_bundle & (F.size("_full") > 0), kept).otherwise(whole)
    return cut.select(*keys, F.explode(chosen).alias("_r")).select(*keys, "_r.*")


def graph_stats(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project: files, import edges, isolated files, imports per file."""
    counted = files.groupBy("project_name").agg(F.count(F.lit(1)).alias("total_files"))
    imports = edges.groupBy("project_name").agg(F.count(F.lit(1)).alias("total_imports"))
    alone = isolated_files(files, edges).groupBy("project_name").agg(F.count(F.lit(1)).alias("isolated_files"))
    out = counted.join(imports, "project_name", "left").join(alone, "project_name", "left")
    out = out.na.fill(0, ["total_imports", "isolated_files"])
    average = F.bround(F.col("total_imports") / F.nullif(F.col("total_files"), F.lit(0)), 2)
    return out.select(
        "project_name", "total_files", "total_imports", F.col("total_files").alias("analyzed_files"),
        "isolated_files", F.coalesce(average, F.lit(0.0)).alias("avg_imports_per_file"),
    )


def isolated_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files without imports that nobody imports."""
    linked = edges.select("project_name", F.explode(F.array("src", "dst")).alias("file_path")).distinct()
    return files.select("project_name", "file_path").join(linked, ["project_name", "file_path"], "left_anti")
