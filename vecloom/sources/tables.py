"""Tables of the data folder as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vectors import doubles, unit


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """More tasks for a table of fewer files than cores (a file of one row group is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 0 < len(df.inputFiles()) < cores else df


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """id, label, x: the embeddings as unit vectors of doubles."""
    raw = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label", doubles("embedding").alias("x"))
    return spread(raw, "id").withColumn("x", unit("x"))


def nouns(spark: SparkSession, folder: str) -> DataFrame:
    """id, x: a second set in the same space, the embeddings read backwards."""
    return vectors(spark, folder).select("id", F.reverse("x").alias("x"))
