"""Progress feeds: newline-delimited JSON records of many sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.operators.ordering import latest_by
from risklens.session import materialize, new_path

SCHEMA = (
    "session bigint, seq bigint, phase string, message string, type string, "
    "success boolean, pr_url string, error string, _corrupt string"
)

# Record types the console knows; all others read as info.
TYPES = ["recon", "plan", "exploit", "success", "defense", "patch", "verify", "info"]


def read_progress_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of a folder's records; blank and unreadable lines are skipped."""
    reader = spark.readStream.schema(SCHEMA).option("columnNameOfCorruptRecord", "_corrupt")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return readable(reader.json(path))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """The same records as a table."""
    return readable(spark.read.schema(SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path))


def readable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("_corrupt").isNull() & F.col("session").isNotNull()).drop("_corrupt")


def lane(phase: Column) -> Column:
    return (
        F.when(phase.isin("red_team", "init"), "A").when(phase.isin("blue_team", "pr"), "B")
        .when(phase == "error", "error")
    )


def route(df: DataFrame) -> DataFrame:
    """Records with phase and message, with their lane; other phases are dropped."""
    full = (F.coalesce("phase", F.lit("")) != "") & (F.coalesce("message", F.lit("")) != "")
    return df.filter(full).withColumn("lane", lane(F.col("phase"))).filter(F.col("lane").isNotNull())


def map_type(c: Column) -> Column:
    return F.when(c.isin(*TYPES), c).otherwise("info")


def terminal(df: DataFrame, strict: bool = False) -> DataFrame:
    """Records that end a session; ``strict`` asks for a link as well."""
    keep = F.col("success").isNotNull()
    return df.filter(keep & F.col("pr_url").isNotNull() if strict else keep)


STATE = (
    "session bigint, n_lines bigint, lane string, lane_seq bigint, last_error string, error_seq bigint, "
    "done boolean, success boolean, pr_url string"
)


def session_state(df: DataFrame) -> DataFrame:
    """Per session, over the records before its first terminal one: lines shown,
    current lane, last error, whether it is done, and its link.

    Two map-side combined aggregates; no session is walked in one task."""
    ends = df.filter(F.col("success").isNotNull()).groupBy("session").agg(
        F.min(F.struct("seq", "success", "pr_url", "error")).alias("_end")
    )
    live = df.join(ends, "session", "left").filter(
        F.col("_end").isNull() | (F.col("seq") <= F.col("_end.seq"))
    )
    shown = (F.coalesce("phase", F.lit("")) != "") & (F.coalesce("message", F.lit("")) != "")
    where = F.when(shown, lane(F.col("phase")))
    in_lane = F.when(where.isin("A", "B"), F.col("seq"))
    failed = F.when(where == "error", F.col("seq"))
    state = live.groupBy("session").agg(
        F.count(in_lane).alias("n_lines"),
        F.max(F.when(in_lane.isNotNull(), F.struct(F.col("seq"), where.alias("lane")))).alias("_lane"),
        F.max(F.when(failed.isNotNull(), F.struct("seq", "message"))).alias("_err"),
        F.max("_end").alias("_end"),
    )
    end_error = F.when(~F.col("_end.success"), F.col("_end.error"))
    return state.select(
        "session", "n_lines", F.col("_lane.lane").alias("lane"), F.col("_lane.seq").alias("lane_seq"),
        F.coalesce(end_error, "_err.message").alias("last_error"), F.col("_err.seq").alias("error_seq"),
        F.col("_end").isNotNull().alias("done"), F.col("_end.success").alias("success"),
        F.col("_end.pr_url").alias("pr_url"),
    )


def merge_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """State after one more batch; a done session no longer changes.  Of two lanes or
    errors the one with the greater ``seq`` counts; an end's own error counts most."""
    o, n = old.alias("o"), new.alias("n")
    closed = F.coalesce(F.col("o.done"), F.lit(False))

    def later(name: str) -> Column:
        return F.when(closed, F.col(f"o.{name}")).otherwise(F.coalesce(f"n.{name}", f"o.{name}"))

    def newer(seq: str, also: Column = F.lit(False)) -> Column:
        fresh = also | F.coalesce(F.col(f"n.{seq}") > F.col(f"o.{seq}"), F.col(f"n.{seq}").isNotNull())
        return ~closed & fresh

    in_lane = newer("lane_seq")
    failed = newer("error_seq", F.coalesce(F.col("n.done") & ~F.col("n.success") & F.col("n.last_error").isNotNull(), F.lit(False)))

    def chosen(name: str, fresh: Column) -> Column:
        return F.when(fresh, F.coalesce(f"n.{name}", f"o.{name}")).otherwise(F.col(f"o.{name}")).alias(name)

    return o.join(n, F.col("o.session") == F.col("n.session"), "full_outer").select(
        F.coalesce("o.session", "n.session").alias("session"),
        F.when(closed, F.col("o.n_lines")).otherwise(
            F.coalesce("o.n_lines", F.lit(0)) + F.coalesce("n.n_lines", F.lit(0))
        ).alias("n_lines"),
        chosen("lane", in_lane), chosen("lane_seq", in_lane), chosen("last_error", failed), chosen("error_seq", failed),
        F.coalesce(closed | F.col("n.done"), F.lit(False)).alias("done"),
        later("success").alias("success"), later("pr_url").alias("pr_url"),
    )


def start_session_state(
    stream: DataFrame, state_path: str, checkpoint: str, available_now: bool = True, snapshot_every: int = 50
):
    """Keep the state of all sessions up to date.

    Each micro-batch is reduced to one row per session before it meets the
    stored state, and writes the sessions it changed as one version; every
    ``snapshot_every`` batches a version holds all sessions.  Each row names the last
    such version in ``base``, so readers need not know the interval and it may change.  A batch reads only
    earlier versions, so a repeated batch gives the same result.

    Batches arrive in the order of their records (a session's records may be mixed
    inside a batch): lines are counted as they come, and an end closes a session."""
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        new = session_state(batch)
        base, old = _state_before(spark, state_path, batch_id)
        if batch_id % snapshot_every:
            new = materialize(new, "batch-state")
            old = old.join(new.select("session"), "session", "left_semi")
        else:
            base = batch_id
        merged = merge_state(old, new).withColumn("base", F.lit(base).cast("bigint"))
        merged.write.mode("overwrite").parquet(f"{state_path}/version={batch_id}")

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _state_before(spark: SparkSession, state_path: str, version: int | None) -> tuple[int, DataFrame]:
    """Last full version before ``version`` (None: of all), and the state then."""
    empty = spark.createDataFrame([], STATE)
    if version == 0:
        return 0, empty
    rows = spark.read.schema(STATE + ", base bigint, version bigint").option("basePath", state_path).parquet(state_path)
    if version is not None:
        rows = rows.filter(F.col("version") < version)
    base = rows.agg(F.max("base")).first()[0]
    if base is None:
        return 0, empty
    newest = latest_by(rows.filter(F.col("version") >= base), ["session"], [F.col("version").desc()])
    return base, newest.drop("base", "version")


def read_state(spark: SparkSession, state_path: str, version: int | None = None) -> DataFrame:
    """State after batch ``version``, by default the last one; before the first it is empty."""
    return _state_before(spark, state_path, None if version is None else max(version + 1, 0))[1]


def run_to_table(stream: DataFrame, label: str) -> DataFrame:
    """Run a stateless stream over everything available and read its output."""
    spark = stream.sparkSession
    out, checkpoint = new_path(spark, label), new_path(spark, f"{label}-checkpoint")
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
