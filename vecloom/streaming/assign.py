"""Streams: vectors assigned to centres as they arrive, and counts of events in windows.

The engine's operators are batch operators; these two carry their state over
from one micro-batch to the next.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.clustering import assigned
from vecloom.operators.metrics import histogram_ema


class RunningHistogram:
    """The moving average of the clusters' shares, one step a micro-batch; a repeated batch is counted once."""

    def __init__(self, k: int, momentum: float = 0.9):
        self.value, self.momentum, self.last = [1 / k] * k, momentum, -1

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        found = {r.cluster: r["count"] for r in batch.groupBy("cluster").count().collect()}  # a row a cluster
        self.value = histogram_ema(self.value, [found.get(i, 0) for i in range(len(self.value))], self.momentum)
        self.last = number


def assigned_stream(vectors: DataFrame, centres: np.ndarray, spherical: bool = True) -> DataFrame:
    """A stream of (id, x) with the nearest centre of each row."""
    return assigned(vectors, centres, spherical).select("id", "cluster", "score")


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """start, kind, n, total of each window; rows later than the watermark are left out, and a window is emitted once it is closed."""
    w = F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def start(stream: DataFrame, checkpoint: str, **options: Any):  # noqa: ANN201
    """Run a stream to its end into a histogram: (query, histogram)."""
    histogram = RunningHistogram(options.get("k", 2), options.get("momentum", 0.9))
    return stream.writeStream.foreachBatch(histogram).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), histogram
