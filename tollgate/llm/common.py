"""What the operators share: reading tables, Arrow batches of bounded size, written lineage cuts."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.session import ensure_checkpoint_dir

#: A Python task holds one Arrow batch at a time; texts may be long, so batches are bounded in bytes too.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_steps: list[list[str]] = []  # scratch paths of the steps that are being worked out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch (a session setting that only affects batch sizes, never rows)."""
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with one function call per bounded batch."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The text column, null as the empty text."""
    return [t or "" for t in column(batch, name).to_pylist()]


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of the text column without decoding them, null as the empty text."""
    col = column(batch, name)
    raw = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [t or b"" for t in raw.to_pylist()]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the session names in ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    for made in _steps[-1:]:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The files survive lost executors, and the planner knows their size: a join with a small
    table is broadcast by that size, a join with a large one shuffles.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def row_key(text: Column | None = None) -> Column:
    """Tells apart rows that share a doc_id but not their text."""
    text = F.col("text") if text is None else text
    return F.xxhash64(text, text.isNull())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path of this run."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(spark: SparkSession, step: Callable[[], DataFrame], name: str, before: str | None = None) -> tuple[DataFrame, str]:
    """What ``step`` plans, written, and its path; the scratch tables that it made on the way go.

    So does ``before``, the path of the table that the step alone has read.
    """
    _steps.append([])
    try:
        out = step()
    finally:
        made = _steps.pop()
    path = scratch(spark, name)
    out.write.parquet(path)
    for old in [*made, *([before] if before else [])]:
        remove(spark, old)
    free(spark)
    return spark.read.schema(out.schema).parquet(path), path


def free(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that are gone: it does so when their handles are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
