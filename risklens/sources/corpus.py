"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from risklens.functions.text import norm_path

SCHEMA = "project_name string, file_path string, content string"


def decode(content: Column, on_bad_utf8: str = "ignore") -> Column:
    """Bytes to text: ``ignore`` drops bad bytes, ``skip`` gives null for the file.

    A text that is valid as it stands is never altered, also when it holds the
    replacement character itself."""
    if on_bad_utf8 == "skip":
        return F.try_validate_utf8(content.cast("string"))
    if on_bad_utf8 != "ignore":
        raise ValueError(f"unknown mode: {on_bad_utf8}")
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit("")))


def decode_files(df: DataFrame, on_bad_utf8: str = "ignore") -> DataFrame:
    """Decode a binary ``content`` column; files that cannot be read are dropped."""
    return df.withColumn("content", decode(F.col("content"), on_bad_utf8)).filter(F.col("content").isNotNull())


def _spelled(spark: SparkSession, path: str) -> str:
    """A folder's path as its file system writes it, without scheme and trailing slash."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(folder).toUri().getPath().rstrip("/")


def read_corpus(
    spark: SparkSession, path: str, project: str, glob: str = "*.py", on_bad_utf8: str = "ignore"
) -> DataFrame:
    """All files below ``path`` whose name matches ``glob``; a missing folder is
    an empty corpus."""
    reader = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    )
    try:
        raw = reader.load(path)
    except AnalysisException as err:
        if err.getCondition() not in ("PATH_NOT_FOUND", "PATH_DOES_NOT_EXIST"):
            raise
        return spark.createDataFrame([], SCHEMA)
    # paths come back as the file system spells them: cut off the root in that spelling
    root = _spelled(spark, path)
    bare = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    relative = F.when(F.startswith(bare, F.lit(root + "/")), F.substr(bare, F.lit(len(root) + 2))).otherwise(
        F.raise_error(F.concat(F.lit(f"not below {root}: "), bare)).cast("string")
    )
    files = raw.select(F.lit(project).alias("project_name"), norm_path(relative).alias("file_path"), "content")
    return decode_files(files, on_bad_utf8)
