"""A session with the settings that the engine expects."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A Spark session; ``conf`` overrides. Partition counts are left to adaptive execution where not given."""
    b = SparkSession.builder.appName("docloom")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``); it goes when the application ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file:///tmp/checkpoints/docloom"
    path = f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of the shared folder, written now: lineage ends there, and what reads it often works nothing out again."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a table for each core up to which :func:`spread` moves rows.
SPREAD_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt out to all of them; any other as it is.

    A file of one row group is one task, however long its texts take.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES and len(df.inputFiles()) < cores else df


#: Bytes of a table as it is stored that a task of :func:`dealt` reads, about.
TASK_BYTES = 4 << 20


def dealt(df: DataFrame, key: str, most: int = TASK_BYTES) -> DataFrame:
    """A table dealt out by ``key`` to tasks of about ``most`` bytes, at least one for each core: what a task gathers of its rows doesn't grow with the table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // most)), key)


def use_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
