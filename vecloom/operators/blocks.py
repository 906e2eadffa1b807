"""Rows of one table against all rows of a second one, block by block.

A task holds a block of its own rows while the second table passes by in
blocks, so what it finds for a row is whole when the block is done: nothing of
the size of the product is kept, shuffled or written.  A small second table is
broadcast; a larger one is written once, packed in blocks, to the folder that
all executors share, and each task reads it from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.ordinal import shared_folder

#: A table of at most so many numbers is broadcast (64 MB as doubles).
BROADCAST_NUMBERS = 8_000_000
#: Rows in a block of the second table, and rows of the first that meet it at a time.
BLOCK = 4096
#: Numbers of a product that a task holds at a time.
PIECE = 2_000_000

Blocks = Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]
Work = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, Blocks], Iterator[pa.RecordBatch]]


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow column as rows."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def pieces(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose product with so many columns is not too large."""
    step = max(1, PIECE // max(1, columns))
    return (slice(at, at + step) for at in range(0, rows, step))


def same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (r, c) at which a[r] equals b[c]."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b, a, "left", order), np.searchsorted(b, a, "right", order)
    r = np.repeat(np.arange(len(a)), high - low)
    return r, order[np.arange(len(r)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)]


def executor_cores(spark: SparkSession) -> int:
    """Cores of an executor, as far as the session tells."""
    sc = spark.sparkContext
    return sc.defaultParallelism if sc.master.startswith("local") else int(sc.getConf().get("spark.executor.cores", "1"))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows, whatever the session's batches are."""
    held, n = [], 0

    def join() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            if n and n + b.num_rows > rows:
                yield join()
                held, n = [], 0
            held.append(b)
            n += b.num_rows
    if n:
        yield join()


def _packed(index: DataFrame, block: int) -> list[str]:
    """Files of packed blocks (ids, numbers) of (id, x) in the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, block):
            ids, x = np.asarray(b.column(0), np.int64), matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

    path = f"{shared_folder(index.sparkSession).rstrip('/')}/vecloom-blocks-{uuid.uuid4().hex}"
    index.mapInArrow(pack, "ids binary, x binary").write.parquet(path)
    return sorted(index.sparkSession.read.schema("ids binary, x binary").parquet(path).inputFiles())


def _read(files: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for name in files:
        fs, path = pyarrow.fs.FileSystem.from_uri(name)
        with fs.open_input_file(path) as file:
            for b in pyarrow.parquet.ParquetFile(file).iter_batches(batch_size=1, use_threads=False):
                ids = np.frombuffer(b.column(0)[0].as_buffer(), np.int64)
                yield ids, np.frombuffer(b.column(1)[0].as_buffer(), np.float64).reshape(len(ids), -1)


@dataclass(frozen=True)
class Source:
    """A table of ``n`` rows that passes by in blocks of (ids, matrix), in use in tasks; ``large`` if it is read from files."""

    n: int
    blocks: Blocks
    large: bool


def source(index: DataFrame, block: int = BLOCK, broadcast_numbers: int = BROADCAST_NUMBERS) -> Source:
    """A table (id, x) made ready to pass by."""
    index = index.select(F.col("id").cast("long").alias("id"), "x")
    n, width = index.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if n * width > broadcast_numbers:
        files = _packed(index, block)
        return Source(n, lambda: _read(files), True)
    side = index.toPandas()
    ids, x = side["id"].to_numpy(np.int64), np.array(side["x"].tolist(), np.float64).reshape(len(side), width)
    order = np.argsort(ids, kind="stable")
    shared = index.sparkSession.sparkContext.broadcast((ids[order], x[order]))

    def whole() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, x = shared.value
        return ((ids[at : at + block], x[at : at + block]) for at in range(0, len(ids), block))

    return Source(n, whole, False)


def meet(rows: DataFrame, passing: Source, work: Work, out: str, block: int = BLOCK) -> DataFrame:
    """``work`` over the rows (id, x and what follows): it gets a batch of them, their ids, their matrix and the passing blocks.

    Where the passing table is large the rows are dealt to twice as many tasks
    as there are cores; else they stay where they are.
    """
    blocks = passing.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, block):
            yield from work(b, b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1)), blocks)

    if passing.large:
        rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "id")
    return rows.mapInArrow(run, out)
