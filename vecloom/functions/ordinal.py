"""Ordinals and lineage without a single task that holds all rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``.

    Where that is unset a session on one machine (tests) gets a temporary folder;
    on a cluster it would be the driver's own disk, so it is an error there.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="vecloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in :func:`shared_folder`."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_ordinal(df: DataFrame, *keys: str, name: str = "ordinal") -> DataFrame:
    """``df`` with the place (from 0) of each row in the order of the keys.

    Rows are dealt into ranges of the keys; a row's place is its place in its
    range plus the rows of all ranges before.  Ranges keep equal keys together,
    so keys should tell rows apart.
    """
    part = "__range"
    dealt = cut_lineage(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = dealt.groupBy(part).agg(F.count(F.lit(1)).alias("__n")).select(part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    own = Window.partitionBy(part).orderBy(*keys)
    return dealt.withColumn(name, F.row_number().over(own)).join(counts, part).withColumn(name, (F.col(name) + F.col("__offset") - 1).cast("long")).drop(part, "__offset")
