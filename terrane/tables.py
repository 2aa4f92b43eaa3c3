"""Tables that are computed once and kept in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where a local session has none. Off one machine it must be set: executors couldn't read the driver's."""
    context, path = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not path and context.getCheckpointDir() is None and not re.match(r"local(\[[^,]*\])?$", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="shared-"))
    return path or context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """Computed now, kept as a Parquet table in the shared folder, lineage cut there.

    The shuffle files that made it go when it is written: a held DataFrame
    would keep them, and they aren't needed again.
    """
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_folder(spark)}/{uuid.uuid4().hex}", spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Removes kept tables that nothing will read again; others, and none, are left alone."""
    for df in tables:
        if df is not None and (path := _PATHS.pop(df, None)):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
