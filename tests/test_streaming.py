import datetime as dt

import numpy as np
import pytest
from vecloom.streaming import assign


def test_vectors_are_assigned_as_they_arrive(spark, tmp_path):
    rows = [(i, [float(i % 4 == 0), float(i % 4 != 0)]) for i in range(40)]
    spark.createDataFrame(rows, "id long, x array<double>").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, x array<double>").parquet(f"{tmp_path}/in")
    query, histogram = assign.start(assign.assigned_stream(stream, np.eye(2)), f"{tmp_path}/state", k=2, momentum=0.5)
    query.awaitTermination(60)
    assert histogram.value == pytest.approx([0.375, 0.625])
    histogram(spark.createDataFrame([(0,)], "cluster int"), 0)  # a repeated batch
    assert histogram.value == pytest.approx([0.375, 0.625])


def test_windows_close_behind_the_watermark(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(at + dt.timedelta(minutes=m), "a", 1.0) for m in (0, 1, 6, 40)]
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = assign.windowed_counts(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.start.minute, r.n) for r in spark.table("closed").collect()) == [(0, 2), (5, 1)]
