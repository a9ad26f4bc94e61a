"""Helpers shared by the operators: shared-storage staging and small plan sizes."""
from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import stage_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. Only where the session
    names none, as in tests, a temporary folder is taken."""
    path = f"{stage_folder(spark)}/lexloom-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table when the driver ends; an ended session has nothing
    to delete with."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the gateway may be closed already
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared storage once and read it back: cuts the lineage,
    survives lost executors, and gives the optimizer its true size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stage_split(df: DataFrame, name: str, by: str) -> DataFrame:
    """Like `stage`, in one folder for each value of a column with few values, so
    that readers of one kind open only its files."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
