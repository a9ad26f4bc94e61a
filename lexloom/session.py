"""Session settings and checkpoint folder."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lexloom", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution and skew-join handling on, UTC time."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The checkpoint folder that the cluster names, if any."""
    return spark.conf.get("spark.checkpoint.dir", None)


def stage_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. A temporary folder stands in for
    it where driver and executors are one process; a cluster must name one, since
    each of its machines would write to its own disk."""
    shared = shared_folder(spark)
    if shared:
        return shared
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder (master is {master})")
    return tempfile.mkdtemp(prefix="spark-")


def materialize(df: DataFrame) -> DataFrame:
    """Compute a table once and cut its lineage at a reliable checkpoint in the
    cluster's shared folder; where none is named, as in tests, in a temporary
    one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(stage_folder(spark))
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that must not be broadcast. The planner guesses the size of texts
    and of checkpointed tables from the Parquet files behind them, which are many times
    smaller, and would gather such a side on the driver."""
    return df.hint("merge")
