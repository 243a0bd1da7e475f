"""Helpers of the plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the folder of ``spark.checkpoint.dir``; a temporary one only in a local session without that setting."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once a row and where it stands.

    Spark moves filters before a distinct, a join or an exchange, and with them all that
    their columns are made of; not so what filters a generator's output.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp("checkpoint")


def tasks(spark: SparkSession) -> int:
    """Over how many parts work is dealt: the session's shuffle partitions, which grow with the cluster and its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranged(rows: DataFrame, *order: str | Column, ranges: int | None = None) -> DataFrame:
    """``rows`` in ranges of an order, numbered in ``_range``, and written, so that the numbers stay what they are."""
    return cut(rows.repartitionByRange(ranges or tasks(rows.sparkSession), *order).withColumn("_range", F.spark_partition_id()))
