"""Session helpers: the shared working folder, lineage cuts and checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset on a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _LOCAL_DIRS:
        path = tempfile.mkdtemp(prefix="chatterloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _LOCAL_DIRS[key] = path
    return _LOCAL_DIRS[key]


def _own_dir(spark: SparkSession) -> str:
    """Folder of the staged tables of this application."""
    return f"{shared_dir(spark)}/chatterloom-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete all staged tables of this application. Results that were not written or collected can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and return a scan of it: its lineage ends there.

    It runs at once, and the table stays until release() or until the application's folder is deleted.
    by: a column to partition the table by, so that later filters on it read only their part.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most max_rows rows (they are counted), else unchanged.

    Meant for staged tables, whose count comes from file footers.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def with_defaults(builder):
    """Session settings the engine expects; used by tests and bench, not needed on a configured cluster."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
