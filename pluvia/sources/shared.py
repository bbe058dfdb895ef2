"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. A local session without one gets a temporary folder; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pluvia-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def path(spark: SparkSession, tag: str) -> str:
    return f"{folder(spark)}/pluvia/{tag}-{uuid.uuid4().hex}"


def stored(spark: SparkSession):
    """A writer of tables that cuts their lineage: df -> the table as it is read back."""

    def write(df: DataFrame) -> DataFrame:
        to = path(spark, "table")
        df.write.parquet(to)
        return spark.read.schema(df.schema).parquet(to)

    return write


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into as many partitions as shuffles have: few bytes with much work in each row are not put together into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
