"""Classify candidate input paths as a DataFrame job.

Format rules are a ``CASE`` chain over the path text; existence, kind and size
come from a left join to a ``binaryFile`` listing that selects only ``path``
and ``length`` (the file content column is pruned, so no file is read).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions.text import js_trim

# Messages and the upload limit (200 MiB) of the reference.
UPLOAD_MAX_BYTES = 200 * 1024 * 1024
EXTENSION = ".csv"
MSG_REQUIRED = "File path is required"
MSG_INVALID_CHARS = "File path contains invalid characters"
MSG_EXTENSION = "File must have a .csv extension"
MSG_UNREADABLE = "File does not exist or is not readable"


def too_large(limit: int) -> str:
    return f"File exceeds the maximum size of {limit} bytes"


def path_format_error(raw: Column) -> Column:
    t = js_trim(F.coalesce(raw, F.lit("")))
    return (
        F.when(F.length(t) == 0, F.lit(MSG_REQUIRED))
        .when(F.instr(t, "\u0000") > 0, F.lit(MSG_INVALID_CHARS))
        .when(~F.lower(t).endswith(EXTENSION), F.lit(MSG_EXTENSION))
    )


def listing(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Regular files under ``roots`` with their size (content not read)."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
        .select(F.col("path").alias("_lpath"), F.col("length").alias("size_bytes"))
    )


def qualified(spark: SparkSession, path: Column) -> Column:
    """A path as the cluster's file system names it: with its scheme, host and, where relative, working folder."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(jvm.org.apache.hadoop.fs.Path("/")).toString().rstrip("/")
    here = fs.getWorkingDirectory().toString().rstrip("/")
    # an empty host is left out, as in file:/a for file:///a
    named = F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):///", "$1:/")
    return F.when(path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:/"), named).when(path.startswith("/"), F.concat(F.lit(root), path)) \
        .otherwise(F.concat(F.lit(here + "/"), path))


def classify_paths(candidates: DataFrame, path_col: str, files: DataFrame, limit: int = UPLOAD_MAX_BYTES) -> DataFrame:
    """Adds ``message`` (NULL = importable) and ``size_bytes``.

    ``files`` is a ``listing``: paths are compared as the file system qualifies them.
    """
    trimmed = js_trim(F.coalesce(F.col(path_col), F.lit("")))
    uri = qualified(candidates.sparkSession, trimmed)
    joined = candidates.withColumn("_uri", uri).join(files, F.col("_uri") == F.col("_lpath"), "left")
    msg = (
        F.coalesce(
            path_format_error(F.col(path_col)),
            F.when(F.col("_lpath").isNull(), F.lit(MSG_UNREADABLE)),
            F.when(F.col("size_bytes") > limit, F.lit(too_large(limit))),
        )
    )
    return joined.withColumn("message", msg).drop("_uri", "_lpath")
