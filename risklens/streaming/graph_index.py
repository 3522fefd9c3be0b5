"""Documents with their symbols and imports, kept up to date delivery by delivery.

A folder holds two logs.  ``documents`` has each delivered version with its symbols and
the candidate paths of its import statements; ``edges`` has, for each statement, the files
it loads as of a delivery.  A delivery parses its own files only.  It then resolves
their statements, and the statements of other files that name a path the delivery
has brought for the first time; a changed file's former statements get an empty list.
So a delivery writes what it changes, and reads of earlier ones only paths and
candidates, never contents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.operators.imports import asked_paths, resolve_asked
from risklens.operators.ordering import latest_by
from risklens.operators.units import symbols
from risklens.session import materialize

FILE = ["project_name", "file_path"]
STATEMENT = [*FILE, "stmt_seq", "nth"]
DOCUMENTS = (
    "project_name string, file_path string, content string, analyzed_at timestamp, functions array<string>, "
    "asked array<struct<stmt_seq:bigint,nth:int,pos:bigint,rank:int,path:string>>, batch bigint"
)
EDGES = "project_name string, file_path string, stmt_seq bigint, nth int, loads array<struct<pos:bigint,dst:string>>, batch bigint"


def _log(spark: SparkSession, folder: str, name: str, schema: str, before: int | None) -> DataFrame:
    """Rows of the deliveries before ``before`` (None: of all)."""
    if before == 0:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return rows if before is None else rows.filter(F.col("batch") < before)


def _current(documents: DataFrame) -> DataFrame:
    return latest_by(documents, FILE, [F.col("analyzed_at").desc(), F.col("batch").desc()])


def apply_delivery(spark: SparkSession, folder: str, delivered: DataFrame, batch: int) -> None:
    """Index one delivery of (project_name, file_path, content, analyzed_at).

    Of several versions of a file the latest counts; one older than what is stored
    changes nothing.  Only earlier deliveries are read and only this one's folders are
    written, so a repeated delivery replaces itself."""
    stored = _current(_log(spark, folder, "documents", DOCUMENTS, batch).select(*FILE, "analyzed_at", "asked", "batch"))
    once = latest_by(delivered.select(*FILE, "content", "analyzed_at"), FILE, [F.col("analyzed_at").desc(), F.col("content").desc()])
    theirs = stored.select(*FILE, F.col("analyzed_at").alias("_stored"))
    accepted = materialize(
        once.join(theirs, FILE, "left").filter("_stored is null or analyzed_at >= _stored").withColumn("_new", F.col("_stored").isNull()).drop("_stored"), "delivery"
    )
    asked = asked_paths(accepted).select(F.col("stmt.project_name"), F.col("stmt.file_path"), F.struct(
        "stmt.stmt_seq", "stmt.nth", "pos", F.col("_rank").alias("rank"), F.col("_path").alias("path")).alias("a"))
    listed = asked.groupBy(*FILE).agg(F.sort_array(F.collect_list("a")).alias("asked"))
    none = F.array().cast("array<struct<stmt_seq:bigint,nth:int,pos:bigint,rank:int,path:string>>")
    out = accepted.join(symbols(accepted), FILE).join(listed, FILE, "left").withColumn("asked", F.coalesce("asked", none))
    out.select(*FILE, "content", "analyzed_at", "functions", "asked").write.mode("overwrite").parquet(f"{folder}/documents/batch={batch}")

    written = spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents/batch={batch}").select(*FILE, "asked")
    appeared = accepted.filter("_new").select(F.col("project_name"), F.col("file_path").alias("path"))
    # candidates of the files that stay, and the statements among them that may now load another file
    others = stored.join(accepted.select(*FILE), FILE, "left_anti").select(*FILE, F.explode("asked").alias("a")).select(*FILE, "a.*")
    hit = others.join(appeared, ["project_name", "path"], "left_semi").select(*STATEMENT).distinct()
    again = others.join(hit, STATEMENT, "left_semi")
    open_ = materialize(written.select(*FILE, F.explode("asked").alias("a")).select(*FILE, "a.*").unionByName(again), "statements")
    known = stored.select(*FILE).unionByName(appeared.withColumnRenamed("path", "file_path"))
    found = resolve_asked(open_.select(
        F.struct(*STATEMENT).alias("stmt"), "pos", F.col("rank").alias("_rank"), F.col("path").alias("_path"), F.col("project_name").alias("_project")
    ), known).select("stmt.*", "pos", "dst")
    loads = found.groupBy(*STATEMENT).agg(F.sort_array(F.collect_list(F.struct("pos", "dst"))).alias("loads"))
    former = stored.join(accepted.select(*FILE), FILE, "left_semi").select(*FILE, F.explode("asked").alias("a")).select(*FILE, "a.stmt_seq", "a.nth")
    touched = open_.select(*STATEMENT).unionByName(former).distinct()
    empty = F.array().cast("array<struct<pos:bigint,dst:string>>")
    touched.join(loads, STATEMENT, "left").withColumn("loads", F.coalesce("loads", empty)).write.mode("overwrite").parquet(f"{folder}/edges/batch={batch}")


def read_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Current edges, as :func:`build_edges` gives them for all current files."""
    latest = latest_by(_log(spark, folder, "edges", EDGES, None), STATEMENT, [F.col("batch").desc()])
    return latest.select(*FILE, "stmt_seq", "nth", F.explode("loads").alias("e")).select(
        "project_name", F.col("file_path").alias("src"), "e.dst", "stmt_seq", (F.col("nth") * 65536 + F.col("e.pos")).alias("pos")
    )


def read_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """Current documents with ``functions`` (symbols) and ``imports`` (loaded files, in
    order of their statements)."""
    documents = _current(_log(spark, folder, "documents", DOCUMENTS, None)).drop("asked", "batch")
    imports = read_edges(spark, folder).groupBy("project_name", F.col("src").alias("file_path")).agg(
        F.sort_array(F.collect_list(F.struct("stmt_seq", "pos", "dst"))).alias("_i")
    )
    return documents.join(imports, FILE, "left").withColumn("imports", F.coalesce("_i.dst", F.array().cast("array<string>"))).drop("_i")


def start_graph_stream(source: DataFrame, folder: str, checkpoint: str, available_now: bool = True):
    """Index each micro-batch of file versions as one delivery."""
    spark = source.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        apply_delivery(spark, folder, batch, batch_id)

    writer = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
