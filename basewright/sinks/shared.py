"""A folder every executor can reach, for tables written between two steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`.

    Where it is unset, a folder below the warehouse stands in for it, but only with a local
    master: on a cluster it has to be named, as a folder that all executors share.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.conf.get("spark.master", "").startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_steps"
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def new_path(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/basewright/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str = "step", **options: str) -> DataFrame:
    """`df`, computed now, written to the shared folder and read back.

    Work after it starts from files: a lost executor re-reads them instead of
    recomputing, and Spark knows their real size, so that it broadcasts the result
    only if that is below `spark.sql.autoBroadcastJoinThreshold`. `options` are the writer's.
    """
    spark = df.sparkSession
    path = new_path(spark, purpose)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
