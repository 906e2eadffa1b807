"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it has been counted and has at most so many rows.
BROADCAST_ROWS = 100_000
#: A key with at least this part of all rows is hot; there are no more such keys than this.
HEAVY = 4096
#: A table whose size is known is written by a task for each so many rows, and by so many tasks at least.
ROWS_A_TASK = 100_000
LEAST_TASKS = 16

#: ASCII white space, the characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that a Python worker holds few texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 * 2**20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    session on one machine (tests) gets a temporary folder; on a cluster that
    would be the driver's own disk, so it is an error there.
    """
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="vecloom-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/vecloom-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs only the tasks that it was running.  ``rows``
    says about how many rows there are: a small table is then not scattered over
    a file for each shuffle partition.  It sets the number of tasks alone, and
    never more tasks than there are partitions.
    """
    path = scratch(df.sparkSession, what)
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, rows // ROWS_A_TASK))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few, else as it is."""
    return F.broadcast(df) if rows <= most else df


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, under the operator's own names."""
    return df.select(*(df[old].alias(new) for new, old in columns.items()))


def id_text(column: Column) -> Column:
    """An id as text, null ids as empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def fold(column: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``: the fold of a row; a null id is in the fold of empty text."""
    return F.crc32(id_text(column)) % F.lit(n)


def hash_sample(df: DataFrame, keys: list[str], most: int, seed: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of the key columns alone.

    Rows of equal keys count once, however many rows there are; of those that
    differ in other columns the smallest stays.  One count decides the rate, so
    no sort and no driver-side list is needed; a table with fewer rows is taken
    whole.  The rate has the hash's 64 bits, so it is right for any count.
    """
    n = df.count()
    if n > most:
        df = df.where(F.xxhash64(*keys, F.lit(seed)) < F.lit((most << 64) // n - 2**63))
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    once = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("least"))
    return once.select(*(c if c in keys else F.col(f"least.{c}").alias(c) for c in df.columns))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int, size: str = "n") -> DataFrame:
    """``rows`` joined with ``groups``, a row for each key that says how many ``rows`` it has.

    Groups of at least 1 / HEAVY of the ``total`` rows number HEAVY at most, so
    they are broadcast and their rows stay where they are; only keys of few rows
    are dealt out, and none of these is hot.
    """
    count = groups.count()
    if count <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key)
    heavy, light = groups.where(F.col(size) * HEAVY >= total), groups.where(F.col(size) * HEAVY < total)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return rows.join(F.broadcast(heavy), key).unionByName(rest)


def row_mark(text: Column) -> Column:
    """A 64-bit mark of a text; with the id it tells rows apart that share an id."""
    return F.xxhash64(text)


def keep_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that ``found`` (id, mark, kept) does not keep; all columns stay, whatever their names.

    ``found`` has a row for each row of a group of several.  Decisions are by
    row, so texts that share an id don't fall together; of rows that repeat in
    id and text one stays.  Null ids are ids like any other.
    """
    i, m = (f"{c}_{uuid.uuid4().hex}" for c in ("id", "mark"))
    marked = docs.withColumn(m, row_mark(F.col(text_col)))

    def meets(side: DataFrame, how: str, left: DataFrame) -> DataFrame:
        keys = side.select(F.col("id").alias(i), F.col("mark").alias(f"{m}_r"))
        return left.join(small(keys, keys.count()), left[id_col].eqNullSafe(F.col(i)) & (left[m] == F.col(f"{m}_r")), how)

    out = meets(found.where(~F.col("kept")).select("id", "mark").distinct(), "left_anti", marked)
    again = found.where("kept").groupBy("id", "mark").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id", "mark")
    if not again.isEmpty():
        out = meets(again, "left_anti", out).unionByName(meets(again, "left_semi", out).dropDuplicates([id_col, m]))
    return out.drop(m)
