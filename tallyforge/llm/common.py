"""What the text operators share: tables, stored intermediate results, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, one in the warehouse, but on one machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/_stored").rstrip("/")


#: Rows and bytes that a Python worker gets at a time while stored() writes; texts are long, so Spark's defaults of 10,000 rows and 64 MB take much memory.
BATCH, BATCH_BYTES = 1000, 8 << 20


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read from there.

    Its lineage ends at those files, so that a lost executor costs no more than a reread.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k, None) for k in most}
    for k, limit in most.items():
        now = int(before[k] or 0)
        spark.conf.set(k, str(min(now, limit) if now > 0 else limit))
    try:
        df.write.parquet(path)
    finally:
        for k, value in before.items():
            if value is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, value)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, unlike lower()."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once although use may name it in many places or in lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)
