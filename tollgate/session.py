"""Session helpers: the settings this engine relies on, and the shared scratch area.

Scratch output (fixture CSV files, lineage cuts, stream checkpoints) always goes
under ``spark.checkpoint.dir`` as the cluster names it.  Only when that setting
is unset (tests, a laptop) do we pick a local directory ourselves.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the plans depend on.  AQE re-plans joins from runtime sizes and splits
# skewed shuffle partitions; the session time zone pins date arithmetic to UTC.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tollgate") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for k, v in ENGINE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, creating a local one only if none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        # unset: tests and single machines only; a cluster names a shared folder
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="tollgate-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint area."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, path: str, prefix: str = "part-", depth: int = 1) -> list[str]:
    """Data files in ``path`` and in folders up to ``depth`` below, as fully qualified URIs.

    The names come in one answer of the JVM, not in one a file.
    """
    jvm = spark.sparkContext._jvm
    jpath, fs = _fs(spark, path)
    literal = re.sub(r"([\\{}\[\]*?,])", r"\\\1", path.rstrip("/"))
    found = []
    for d in range(depth + 1):
        statuses = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{literal}/{'*/' * d}{prefix}*"))
        found += _below(spark, fs.makeQualified(jpath).toString(), statuses)
    return sorted(found)


def _below(spark: SparkSession, root: str, statuses) -> list[str]:
    """The paths of files below ``root``, as one text from the JVM: {root/a,root/b}."""
    jvm, root = spark.sparkContext._jvm, root.rstrip("/") + "/"
    text = jvm.org.apache.commons.lang3.ArrayUtils.toString(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(statuses))[1:-1]
    return [root + name for name in ("," + text).split("," + root)[1:]]


def rename_suffix(spark: SparkSession, files: list[str], old: str, new: str) -> list[str]:
    """Rename each file's suffix (a metadata operation on the cluster filesystem)."""
    out = [f[: -len(old)] + new if f.endswith(old) else f + new for f in files]
    move_files(spark, list(zip(files, out)))
    return out


def move_files(spark: SparkSession, pairs: list[tuple[str, str]]) -> None:
    """Rename files within one file system."""
    if not pairs:
        return
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    _, fs = _fs(spark, pairs[0][0])
    for src, dst in pairs:
        if not fs.rename(jpath(src), jpath(dst)):
            raise OSError(f"Could not rename {src} to {dst}")


def make_folder(spark: SparkSession, path: str) -> None:
    jpath, fs = _fs(spark, path)
    fs.mkdirs(jpath)


def create_exclusive(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a small file that isn't there yet; False if it is (of two writers one succeeds)."""
    jpath, fs = _fs(spark, path)
    if fs.exists(jpath):
        return False
    try:
        out = fs.create(jpath, False)
    except Exception as e:  # noqa: BLE001 - py4j wraps what the file system throws
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None where there is none."""
    jpath, fs = _fs(spark, path)
    if not fs.exists(jpath):
        return None
    stream = fs.open(jpath)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, none where there is no folder."""
    jpath, fs = _fs(spark, path)
    if not fs.exists(jpath):
        return []
    return [p.rsplit("/", 1)[1] for p in _below(spark, fs.makeQualified(jpath).toString(), fs.listStatus(jpath))]


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this run."""
    jpath, fs = _fs(spark, path)
    fs.delete(jpath, True)
