"""Lineage cuts: tables written once to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Spark's setting that removes a query's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else a temporary one for local tests."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="evalloom-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/evalloom-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str, compression: str = "snappy", schema: StructType | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there and lost executors cost nothing.

    Nothing reads the write's shuffle files once it has ended, so Spark is told to remove them then. `schema` is what the table is
    read as, where that isn't df's own.
    """
    spark = df.sparkSession
    path, before = new_path(spark, tag), spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(schema or df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote and nothing reads any more. Other tables are left alone."""
    for df in tables:
        spark = df.sparkSession
        own = f"/evalloom-{spark.sparkContext.applicationId}/"
        for path in {f.rpartition("/")[0] for f in df.inputFiles() if own in f}:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
