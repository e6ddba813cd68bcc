"""Keeping plans in hand: reliable checkpoints, and costly columns worked out once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the cluster's checkpoint folder, so a lost executor costs no recomputation.

    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: ``spark.checkpoint.dir``, else beside the warehouse folder.

    Both are on the file system that all executors share; a machine's own temporary folder is not.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return (shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints").rstrip("/")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters read but do not repeat.

    A filter is pushed through a projection with its expressions copied into it; through a
    generator it is not.
    """
    return df.withColumn(name, F.explode(F.array(value)))
