"""Choosing samples to ask about, pseudo-labels, and attack targets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.ordinal import cut_lineage, with_ordinal
from vecloom.operators.blocks import matrix
from vecloom.operators.metrics import matching
from vecloom.operators.neighbors import density, top_k


def hardness(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """id, value = ln of 1 - s1 + s2 (1e-8 at least), s1 and s2 the similarities to the two nearest centres."""
    near = top_k(rows, centres.select(F.col("cluster").cast("long").alias("id"), "x"), 2)
    gap = 1 - F.max("score") + F.min("score")
    return near.groupBy(F.col("i").alias("id")).agg(F.log(F.greatest(gap, F.lit(1e-8))).alias("value"))


def z_score(values: DataFrame) -> DataFrame:
    """id, value less its mean over its sample deviation + 1e-8.  Two numbers are broadcast; the values are read twice, so they are kept first."""
    values = cut_lineage(values.select("id", "value"))
    stats = values.agg(F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("s"))
    return values.crossJoin(F.broadcast(stats)).select("id", ((F.col("value") - F.col("m")) / (F.col("s") + 1e-8)).alias("value"))


def sample_values(rows: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """id, value: z-scored hardness plus z-scored density."""
    a, b = z_score(hardness(rows, centres)), z_score(density(rows, k)).withColumnRenamed("value", "v")
    return a.join(b, "id").select("id", (F.col("value") + F.col("v")).alias("value"))


#: Rows of largest score that greedy selection holds on the driver.
HELD = 4096


def greedy(rows: DataFrame, values: DataFrame, budget: int, most: int | None = None, held: int = HELD) -> DataFrame:
    """step (from 0), id: each step takes the row of largest value plus diversity (to ten decimals, then the smaller id).

    Diversity is ln(1 - s) (floored) to the nearest chosen row.  Once a row is
    chosen scores only fall, so the ``held`` rows of largest score are enough as
    long as the best of them is above the last of them when they were fetched;
    else all rows are scored anew in one pass and others are fetched.  The
    choice is that over all rows, whatever their number; more than ``most`` are
    refused if that is given.
    """
    table = cut_lineage(rows.select("id", "x").join(values.select("id", "value"), "id"))
    n = table.count()
    if most is not None and n > most:
        raise ValueError(f"greedy selection takes {most} rows at most")
    chosen: list[int] = []
    taken = np.zeros((0, 0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, value = matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
            diversity = np.log(np.maximum(1 - x @ taken.T, 1e-8)).min(axis=1) if len(taken) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(diversity), pa.array(np.round(value + diversity, 10))], names=["id", "x", "value", "diversity", "score"])

    def fetch() -> tuple[np.ndarray, ...]:
        found = table.where(~F.col("id").isin(chosen)) if chosen else table
        found = found.mapInArrow(score, "id long, x array<double>, value double, diversity double, score double")
        pdf = found.orderBy(F.col("score").desc(), "id").limit(held).toPandas()
        pdf = pdf.sort_values("id", kind="stable")
        bar = pdf["score"].min() if len(pdf) + len(chosen) < n else -np.inf
        return pdf["id"].to_numpy(), np.array(pdf["x"].tolist(), float).reshape(len(pdf), -1 if len(pdf) else 0), pdf["value"].to_numpy(float), pdf["diversity"].to_numpy(float), bar

    ids = np.zeros(0, np.int64)
    for step in range(min(budget, n)):
        at = -1
        if step > 1 and len(ids):
            now = np.round(value + diversity, 10)
            at = int(now.argmax())
            at = at if now[at] > bar else -1
        if at < 0:
            ids, x, value, diversity, bar = fetch()
            at = int(np.round(value + diversity, 10).argmax())
        chosen.append(int(ids[at]))
        taken = np.vstack([taken.reshape(-1, x.shape[1]), x[at]])
        diversity = np.minimum(diversity, np.log(np.maximum(1 - x @ x[at], 1e-8)))
        kept = np.arange(len(ids)) != at
        ids, x, value, diversity = ids[kept], x[kept], value[kept], diversity[kept]
    return rows.sparkSession.createDataFrame(list(enumerate(chosen)), "step int, id long")


def feedback(chosen: DataFrame, rows: DataFrame, centres: DataFrame, t: int) -> DataFrame:
    """id, cluster (the one its label is matched with), positive: whether it is among the t nearest centres, ruled_out: these centres if it is not.

    ``rows`` are (id, x, label, pred); labels without a matched cluster map to 0.
    """
    spark = rows.sparkSession
    of_label = {v: k for k, v in matching(rows).items()}
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in sorted(of_label.items())], "label long, cluster long")
    own = chosen.select("id").join(rows, "id").join(F.broadcast(pairs), "label", "left").select("id", "x", F.coalesce("cluster", F.lit(0)).alias("cluster"))
    near = top_k(own, centres.select(F.col("cluster").cast("long").alias("id"), "x"), t).groupBy(F.col("i").alias("id")).agg(F.sort_array(F.collect_set(F.col("j").cast("int"))).alias("near"))
    hit = F.array_contains("near", F.col("cluster").cast("int"))
    return own.join(near, "id").select("id", "cluster", hit.alias("positive"), F.when(hit, F.array().cast("array<int>")).otherwise(F.col("near")).alias("ruled_out"))


def pseudo_labels(predicted: DataFrame, k: int, share: float, enter: float, leave: float) -> DataFrame:
    """id, label: labels after one update of (id, pred, confidence, label), -1 for none.

    In each cluster the ceil(n / k * share) most confident rows above ``enter``
    get its label if they have none; rows below ``leave`` lose theirs.
    """
    most = max(1, math.ceil(predicted.count() / k * share))
    w = Window.partitionBy("pred").orderBy(F.col("confidence").desc(), "id")
    fresh = F.when((F.row_number().over(w) <= most) & (F.col("confidence") > enter), F.col("pred")).otherwise(F.lit(-1))
    held = F.when(F.col("label") == -1, F.col("fresh")).otherwise(F.col("label"))
    return predicted.withColumn("fresh", fresh).select("id", F.when(F.col("confidence") < leave, F.lit(-1)).otherwise(held).cast("int").alias("label"))


def hash_order(seed: int, *keys: Column | str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *keys))


def attack_targets(rows: DataFrame, seed: int = 42) -> DataFrame:
    """id, target: a row of another label for each row of (id, label), by hashes of seed and id.

    First a label other than the own one, then a member of it.  With one label
    alone, rows take the next one in a hashed order (the last takes the first).
    """
    w = Window.partitionBy("label").orderBy(hash_order(seed, "id"), "id")
    placed = rows.select("id", "label", (F.row_number().over(w) - 1).alias("place"))
    sizes = placed.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    labels = sizes.withColumn("rank", F.row_number().over(Window.orderBy("label")) - 1).withColumn("k", F.count(F.lit(1)).over(Window.partitionBy()))
    n = labels.count()
    if n <= 1:
        ring = with_ordinal(rows.select("id", hash_order(seed, "id").alias("key")), "key", "id").select("id", "ordinal")
        after = ring.select((F.pmod(F.col("ordinal") - 1, F.lit(max(ring.count(), 1)))).alias("ordinal"), F.col("id").alias("target"))
        return ring.join(after, "ordinal").select("id", "target")
    draw = lambda tag: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(tag), F.lit(seed), "id")), 1, 12), 16, 10).cast("long")
    asked = rows.join(labels.select("label", "rank", "k"), "label").select("id", draw("member").alias("draw"), F.pmod(F.col("rank") + 1 + F.pmod(draw("label"), F.col("k") - 1), F.col("k")).alias("rank"))
    met = asked.join(labels.select("rank", F.col("label").alias("other"), "m"), "rank").select("id", "other", F.pmod("draw", "m").alias("place"))
    return met.join(placed.select(F.col("label").alias("other"), "place", F.col("id").alias("target")), ["other", "place"]).select("id", "target")


def perturbed(x: Column | str, noise: Column | str, eps: float = 8 / 255) -> Column:
    """clip(x + clip(noise, -eps, eps), 0, 1)."""
    return F.zip_with(x, noise, lambda a, b: F.greatest(F.least(a + F.greatest(F.least(b, F.lit(eps)), F.lit(-eps)), F.lit(1.0)), F.lit(0.0)))


def attacked(rows: DataFrame, enabled: bool = True, splits: tuple[str, ...] = ("test", "val")) -> DataFrame:
    """The rows that an attack applies to."""
    return rows.where(F.lit(enabled) & F.col("split").isin(*splits))
