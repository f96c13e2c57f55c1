"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints. Only a local session may do without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    named = "file://" + tempfile.mkdtemp(prefix="pagewright-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


_written: dict[str, list[str]] = {}


def release(spark: SparkSession) -> None:
    """Deletes the tables that materialised() has written in this session: results that were not yet read go."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialised(df: DataFrame) -> DataFrame:
    """df written once and read back, so that branches do not compute it again and lost executors cost little."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
