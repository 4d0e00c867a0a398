"""CSV text output: data files (fixtures, generated input) and the error report.

Spark's CSV writer escapes quotes with a backslash, writes ``""`` for empty
strings and trims leading blanks, so lines are built as one string column
(``concat_ws`` of escaped cells) and written with the text writer.

Ordering is a global sort (range partitioning): part files come out in key
order and no task ever holds more than one range.  A file's header is a row
with a key that sorts before every data row of that file.
"""

from __future__ import annotations

import datetime as dt
import os
import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions.text import csv_quote, csv_line
from tollgate.operators.report import REPORT_HEADER, order_key, report_text

# Report file names are errors-<ISO stamp, ':' and '.' as '-'>.csv
# and up to 99 numbered alternatives are tried before giving up.
REPORT_PREFIX = "errors-"
MAX_FILE_NAME_ATTEMPTS = 100


def write_csv_files(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    order_col: str,
    rows_per_file: int = 1_000_000,
    header: str | None = None,
    line_end: str = "\n",
    bom: bool = False,
    cells: Sequence[Column] | None = None,
    tasks: int | None = None,
) -> list[str]:
    """Write ``df`` as CSV files of ``rows_per_file`` consecutive ``order_col`` values.

    File k holds order values ``[k*rows_per_file, (k+1)*rows_per_file)``; all its
    rows are written by one task in order; ``tasks``, or as many as there are shuffle partitions,
    share the files.  Returns the written file paths.
    """
    header = header if header is not None else ",".join(columns)
    cell_cols = list(cells) if cells is not None else [csv_quote(F.col(c).cast("string")) for c in columns]
    body = df.select(
        F.floor(F.col(order_col) / F.lit(rows_per_file)).cast("bigint").alias("_file"),
        F.col(order_col).cast("bigint").alias("_ord"),
        csv_line(*[F.coalesce(c, F.lit("")) for c in cell_cols]).alias("_text"),
    )
    heads = body.select("_file").distinct().select(
        "_file", F.lit(-1).cast("bigint").alias("_ord"), F.lit(("\ufeff" if bom else "") + header).alias("_text")
    )
    text = F.concat(F.col("_text"), F.lit(line_end[:-1])) if len(line_end) > 1 else F.col("_text")
    out = (
        body.unionByName(heads)
        .withColumn("part", F.format_string("%06d", F.col("_file")))
        .repartition(*([max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))] if tasks else []), "part")
        .sortWithinPartitions("part", "_ord")
        .select("part", text.alias("value"))
    )
    out.write.mode("errorifexists").partitionBy("part").text(path)
    from tollgate.session import list_files, rename_suffix

    spark = df.sparkSession
    return rename_suffix(spark, list_files(spark, path), ".txt", ".csv")


def report_stamp(run_ts: dt.datetime) -> str:
    """ISO timestamp (UTC, milliseconds) with ':' and '.' replaced by '-'."""
    iso = run_ts.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.") + f"{run_ts.microsecond // 1000:03d}Z"
    return re.sub(r"[:.]", "-", iso)


def report_path(report_dir: str, run_ts: dt.datetime, exists=os.path.exists) -> str:
    """First free name among errors-<stamp>.csv, errors-<stamp>-1.csv, ... -99."""
    stamp = report_stamp(run_ts)
    for attempt in range(MAX_FILE_NAME_ATTEMPTS):
        name = f"{REPORT_PREFIX}{stamp}.csv" if attempt == 0 else f"{REPORT_PREFIX}{stamp}-{attempt}.csv"
        candidate = os.path.join(report_dir, name)
        if not exists(candidate):
            return candidate
    raise FileExistsError(f"Could not create a unique error report file in {report_dir}")


def report_frame(rej: DataFrame, partition_cols: Sequence[str] = ()) -> DataFrame:
    """Report lines plus the header row, with the G1 order key (header sorts first)."""
    lines = report_text(rej, partition_cols)
    spark: SparkSession = rej.sparkSession
    keys = order_key(partition_cols)
    head = spark.range(1).select(
        *[F.lit(-1).cast("bigint").alias(k) for k in keys], F.lit(",".join(REPORT_HEADER)).alias("line")
    )
    return lines.select(*[F.col(k).cast("bigint") for k in keys], "line").unionByName(head)


def write_report(rej: DataFrame, report_dir: str, run_ts: dt.datetime,
                 partition_cols: Sequence[str] = (), single_file: bool = False, files: DataFrame | None = None) -> str:
    """Write the ordered report as text parts under a fresh errors-<stamp>.csv path.

    With ``files`` (file_seq, file_path) each file's lines are in a folder of its own, after a
    header of their own, and ``_files`` names the folders.
    """
    from tollgate.session import path_exists

    path = report_path(report_dir, run_ts, exists=lambda p: path_exists(rej.sparkSession, p))
    if files is not None:
        write_file_reports(rej, path, files)
        return path
    framed = report_frame(rej, partition_cols).orderBy(*order_key(partition_cols))
    if single_file:  # opt-in for small reports; a global sort already orders the parts
        framed = framed.coalesce(1)
    framed.select("line").write.mode("errorifexists").text(path)
    return path


MANIFEST = "_files"


def write_file_reports(rej: DataFrame, path: str, files: DataFrame, batch_id: int | None = None) -> None:
    """A folder of report lines per file (file=<file_seq>), header first, in report order, and a manifest.

    The manifest (``_files``, JSON lines) has file, file_path, lines and batch of every folder.
    """
    keys = order_key(["file_seq"])
    lines = report_text(rej, ["file_seq"]).select(*[F.col(k).cast("bigint") for k in keys], "line")
    heads = lines.select("file_seq").distinct().select(
        "file_seq", *[F.lit(-1).cast("bigint").alias(k) for k in keys[1:]], F.lit(",".join(REPORT_HEADER)).alias("line"))
    # a file may hold a third of all rows: ranges of the report order, not files, go to tasks, and
    # the parts of a folder come in the order of their names
    text = lines.unionByName(heads).orderBy(*keys).select(F.col("file_seq").alias("file"), F.col("line").alias("value"))
    text.write.mode("overwrite").partitionBy("file").text(path)
    counted = lines.groupBy("file_seq").agg(F.count("*").cast("bigint").alias("lines"))
    named = counted.join(files.select(F.col("file_seq").cast("bigint").alias("file_seq"), "file_path"), "file_seq")
    manifest = named.select(F.col("file_seq").alias("file"), "file_path", "lines", F.lit(batch_id).cast("bigint").alias("batch"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/{MANIFEST}")


def report_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, file_path, lines and batch of the folders of a report of several files."""
    return spark.read.schema("file bigint, file_path string, lines bigint, batch bigint").json(f"{path.rstrip('/')}/{MANIFEST}")
