"""Adapter views: the driver's tables seen as files, findings, replies, attempts.

One builder per view.  The columns are plain projections of whole tables; a view
that needs a position inside an order has a ``*_rows`` form without it, so plans
that do not use the position never pay for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risklens.operators.ordering import group_position
from risklens.session import materialize

# Tables stored once per application and state of the input:
# (application id, view, input folder, its files).
_STORED: dict[tuple[str, str, str, int], DataFrame] = {}

# Lines of one order that one task numbers.
LONG_ORDER = 1 << 16

LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
]

PLACE = LINE_ORDER[1:3]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when a scan has fewer splits than that; every row of
    these tables turns into much work.  A large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _files_of(spark: SparkSession, sf_dir: str) -> int:
    """Hash of the input files' names, lengths and times."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(seen)))


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], write: bool = True
) -> DataFrame:
    """Build a derived table once per application and read it until the input files
    change.  ``write=False`` is for builders that already read written tables."""
    key = (spark.sparkContext.applicationId, name, sf_dir, _files_of(spark, sf_dir))
    if key not in _STORED:
        _STORED[key] = materialize(build(), name) if write else build()
    return _STORED[key]


def _chr10() -> Column:
    return F.lit("\n")


def _pick(key: Column, names: list[str]) -> Column:
    """``names[key % n]``, with the last name for the rest."""
    chosen = F.when(key % len(names) == 0, names[0])
    for i, name in enumerate(names[1:-1], 1):
        chosen = chosen.when(key % len(names) == i, name)
    return chosen.otherwise(names[-1])


TYPES = ["SQL Injection", "Path Traversal", "Hardcoded Credentials", "Weak Hashing"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: one Python source file per part, importing three others."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    n = table(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("n")).scalar()
    k = F.col("p_partkey")
    base = part.select(
        k.alias("k"), "p_name", ((k * 7 + 3) % n).alias("a"), ((k * 13 + 5) % n).alias("b"), ((k + 70) % n).alias("c")
    )
    k, a, b, c = (F.col(x) for x in "kabc")
    nl = _chr10()
    path = F.concat(
        F.when(k % 11 == 0, "build/").otherwise(""),
        F.lit("pkg"), k % 10, F.lit("/sub"), k % 7, F.lit("/mod_"), k, F.lit(".py"),
    )
    content = F.concat(
        F.lit("import os"), nl,
        F.lit("import pkg"), a % 10, F.lit(".sub"), a % 7, F.lit(".mod_"), a, nl,
        F.lit("from pkg"), b % 10, F.lit(".sub"), b % 7, F.lit(" import mod_"), b, nl,
        F.lit("from .mod_"), c, F.lit(" import fn"), nl, nl,
        F.lit("def fn_"), k, F.lit("(x):"), nl,
        F.lit('    """'), F.col("p_name"), F.lit('"""'), nl,
        F.lit("    def inner(y):"), nl, F.lit("        return y"), nl,
        F.when(k % 5 == 0, F.concat(F.lit("    h = hashlib.md5(x)"), nl)).otherwise(""),
        F.when(k % 7 == 0, F.concat(F.lit('    token = "t'), k, F.lit('"'), nl)).otherwise(""),
        F.lit("    return x"), nl, nl,
        F.lit("class C_"), k, F.lit(":"), nl, F.lit("    def m(self):"), nl, F.lit("        return 1"), nl,
    )
    return base.select(F.lit("main").alias("project_name"), path.alias("file_path"), content.alias("content"))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: consecutive parts of one order; an edge is (src, dst, ord, pos).

    Orders of up to ``LONG_ORDER`` lines are windows over one shuffle of the lines.  Of
    longer ones the successor comes from a join on (order, position + 1): both keys
    are unique, so an order of any length spreads over all tasks.
    """

    def build() -> DataFrame:
        # lines of an order that agree in number and part give the same edges in any order,
        # so the rest of LINE_ORDER need not travel
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *PLACE).filter(F.col("l_orderkey").isNotNull())
        # at most one in LONG_ORDER rows, so they can be sent to all executors
        long_orders = materialize(
            lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LONG_ORDER).select("l_orderkey"), "long"
        )
        if long_orders.isEmpty():
            return _neighbours(lines)
        few = F.broadcast(long_orders)
        return _neighbours(lines.join(few, "l_orderkey", "left_anti")).unionByName(
            _joined_neighbours(lines.join(few, "l_orderkey", "left_semi"))
        )

    return stored(spark, sf_dir, "graph", build)


def _neighbours(lines: DataFrame) -> DataFrame:
    """Edges of orders that a task can hold."""
    inside = Window.partitionBy("l_orderkey").orderBy(*PLACE)
    placed = lines.select(
        "l_orderkey", "l_partkey", F.row_number().over(inside).cast("bigint").alias("pos"), F.lead(F.struct("l_partkey")).over(inside).alias("_next")
    )
    return placed.filter(F.col("_next").isNotNull()).select(
        F.col("l_partkey").alias("src"), F.col("_next.l_partkey").alias("dst"), F.col("l_orderkey").alias("ord"), "pos"
    )


def _joined_neighbours(lines: DataFrame) -> DataFrame:
    """Edges of orders of any length."""
    # one table for both sides of the self join: positions are computed once
    numbered = materialize(
        group_position(lines, ["l_orderkey"], PLACE, "pos", keep=["l_orderkey", "l_partkey"]),
        "positions",
    )
    here, there = numbered.alias("h"), numbered.alias("t")
    joined = here.join(
        there,
        (F.col("h.l_orderkey") == F.col("t.l_orderkey")) & (F.col("h.pos") + 1 == F.col("t.pos")),
    )
    return joined.select(
        F.col("h.l_partkey").alias("src"), F.col("t.l_partkey").alias("dst"),
        F.col("h.l_orderkey").alias("ord"), F.col("h.pos").alias("pos"),
    )


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 in the edge schema of the graph operators."""
    return graph(spark, sf_dir).select(
        F.lit("main").alias("project_name"), F.col("src").cast("string").alias("src"),
        F.col("dst").cast("string").alias("dst"), F.col("ord").alias("stmt_seq"), F.col("pos"),
    )


def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 without the sequence number: a pure projection of lineitem."""
    return table(spark, sf_dir, "lineitem").select(*_finding_columns())


def _finding_columns() -> list[Column]:
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    return [
        F.concat(F.lit("proj"), F.col("l_suppkey") % 20).alias("project_name"),
        F.concat(F.lit("pkg"), part % 10, F.lit("/mod_"), part, F.lit(".py")).alias("file"),
        F.concat(F.lit("fn_"), line).alias("function"),
        (line * 10).cast("int").alias("start_line"),
        (line * 10 + 5).cast("int").alias("end_line"),
        (F.floor("l_quantity") % 11).cast("int").alias("risk_score"),
        (F.col("l_returnflag") != "N").alias("vulnerable"),
        _pick(part, TYPES).alias("type"),
        (F.col("l_linestatus") == "F").alias("verified"),
        F.when(F.col("l_tax") > 0.04, "evidence").otherwise("").alias("evidence"),
        # key of the attempt log, see `attempts`
        (F.col("l_orderkey") % 150 * 100 + line).alias("finding_id"),
    ]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3: findings with ``seq``, their 1-based place in the project."""

    def build() -> DataFrame:
        # the sort carries the table's own narrow columns; texts are made from them after it
        lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_returnflag", "l_linestatus", (F.col("l_suppkey") % 20).alias("_project"))
        needed = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_returnflag", "l_linestatus"]
        placed = group_position(lines, ["_project"], LINE_ORDER, "seq", keep=needed)
        return placed.select(*_finding_columns(), "seq")

    return stored(spark, sf_dir, "findings", build, write=False)


def verdict_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: model replies in the shapes a reply can have."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props"), "event_id")
    i = F.col("event_id") % 8
    reply = (
        F.when(i == 0, F.concat(
            F.lit('```json\n{"vulnerable": true, "risk_score": '), F.floor("value").cast("int") % 14,
            F.lit(', "type": "'), F.col("event_type"), F.lit('", "description": "d"}\n```')))
        .when(i == 1, F.concat(
            F.lit('{"vulnerable": false, "risk_score": 0, "type": "none", "description": "'),
            F.col("event_type"), F.lit('"}')))
        .when(i == 2, F.concat(
            F.lit('Result: {"vulnerable": true, "risk_score": 9, "type": "'), F.col("event_type"), F.lit('"} end')))
        .when(i == 3, F.col("props"))
        .when(i == 4, F.lit("no json here"))
        .when(i == 5, F.lit('{"vulnerable": "false", "risk_score": "8", "type": "t", "description": "d"}'))
        .when(i == 6, F.lit('{"vulnerable": true, "risk_score": 7.9, "type": "t", "description": "d"}'))
        .otherwise(F.lit('{"vulnerable": true, "risk_score": "high", "type": "t", "description": "d"}'))
    )
    return e.select("event_id", reply.alias("reply"))


def attempt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5 without the attempt number."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    kind = F.col("event_type")
    return e.select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("finding_id"), "event_id", "ts",
        F.concat(F.lit("s"), F.col("event_id") % 5).alias("strategy"),
        F.when(kind == "purchase", "EXPLOIT_SUCCESS").when(kind == "view", "EXPLOIT_FAILED")
        .when(kind == "click", "done").otherwise("").alias("stdout"),
        F.when(kind == "error", "Traceback").otherwise("").alias("stderr"),
        F.when(kind == "error", 1).otherwise(0).alias("exit_code"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5: the attempts of every finding, numbered from 1.  Operators bound the
    number they look at, and Spark applies that bound below the shuffle."""
    window = Window.partitionBy("finding_id").orderBy("ts", "event_id")
    return attempt_rows(spark, sf_dir).withColumn("attempt", F.row_number().over(window)).drop("ts")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6: tracker items, labels as an array."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    key, prio = F.col("o_orderkey"), F.col("o_orderpriority")
    labels = (
        F.when(prio == "1-URGENT", "security,tool,critical").when(prio == "2-HIGH", "security,tool").otherwise("other")
    )
    return o.select(
        key.alias("number"),
        F.concat(F.lit("[Security] "), _pick(key, TYPES), F.lit(" in fn_"), key % 9, F.lit("()")).alias("title"),
        F.concat(F.lit("https://example.org/i/"), key).alias("url"),
        F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"),
        F.split(labels, ",").alias("labels"),
        (key % 10 == 0).alias("is_pr"),
        F.col("o_orderdate").alias("created_at"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7: the document table as a corpus."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    return d.select(
        F.col("source").alias("project_name"),
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("file_path"),
        F.col("text").alias("content"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8: conversation turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def progress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B9: progress records of many sessions, in arrival order ``seq``."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    i, kind = F.col("event_id"), F.col("event_type")
    last = i % 40 == 39
    return e.select(
        F.col("user_id").alias("session"),
        i.alias("seq"),
        F.when(last, F.lit(None)).otherwise(
            F.when(kind == "signup", "init").when(kind == "view", "red_team").when(kind == "click", "blue_team")
            .when(kind == "purchase", "pr").otherwise("error")
        ).alias("phase"),
        F.when(last, F.lit(None)).otherwise(F.concat(F.lit("step "), i)).alias("message"),
        F.when(last, F.lit(None)).otherwise(
            _pick(i, ["recon", "plan", "success", "verify", "warning", "error", "other"])
        ).alias("type"),
        F.when(last, i % 3 != 0).alias("success"),
        F.when(last & (i % 3 != 0), F.concat(F.lit("https://example.org/pr/"), i)).alias("pr_url"),
        F.when(last & (i % 3 == 0), "Not verified").alias("error"),
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B10: page urls, each also in the shapes a repository can be named by."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    i = F.col("page_id")
    name = F.concat(F.lit("owner"), i % 7, F.lit("/repo-"), i)
    shapes = {
        "page": F.col("url"),
        "https": F.concat(F.lit("https://github.com/"), name),
        "git": F.concat(F.lit("https://github.com/"), name, F.lit(".git")),
        "ssh": F.concat(F.lit("git@github.com:"), name, F.lit(".git")),
        "short": name,
        "edit": F.concat(F.lit("https://github.com/"), name, F.lit("/edit")),
        "bare": F.concat(F.lit("repo-"), i),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("shape"), v.alias("url")) for k, v in shapes.items()])
    return p.select("page_id", F.explode(rows).alias("s")).select("page_id", "s.shape", "s.url")
