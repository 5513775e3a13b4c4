"""Intermediate results as Parquet in the folder that all executors share."""

from __future__ import annotations

import uuid
from math import ceil

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder in the warehouse, but on one machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stored").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read from there; its lineage ends at those files."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that one task joins or adds up, about.
TASK_ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of about so many rows, dealt by keys over as many partitions as keep a task's rows few; as it is where Spark's own number of partitions does."""
    n = ceil(rows / TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
