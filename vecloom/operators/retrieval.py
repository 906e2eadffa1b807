"""Vocabulary selection and soft retrieval between rows, cluster centres and nouns.

Nouns are (id, x), centres (cluster, x); similarities are inner products of unit
vectors.  A table of k centres against all nouns has k rows a noun: k is the
number of clusters, and the product is the operator's meaning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.ordinal import with_ordinal
from vecloom.functions.vectors import dot, mean_vector, sum_vector, unit
from vecloom.operators.blocks import BROADCAST_NUMBERS, Blocks, meet, pieces, source
from vecloom.operators.neighbors import top_k

# Noun clusters of the datasets that have a default.
SEMANTIC_CLUSTERS = {"cifar10": 167, "cifar20": 167, "stl10": 17, "imagenet10": 43, "imagenetdogs": 65, "dtd": 141, "ucf101": 303, "imagenet": 4271}


def semantic_clusters(dataset: str, rows: int, k: int, size: int, explicit: int | None = None) -> tuple[int, str]:
    """The number of noun clusters and where it comes from: explicit, the dataset's default (k at least), or by size."""
    if explicit is not None:
        return int(explicit), "explicit"
    token = dataset.strip().lower()
    for c in "-_ ":
        token = token.replace(c, "")
    if token in SEMANTIC_CLUSTERS:
        return max(SEMANTIC_CLUSTERS[token], k), "official_default"
    if rows / k < size:
        return 3 * k, "size_heuristic"
    return max(round(rows / size), k), "size_heuristic"


def semantic_clusters_columns(name: Column, rows: Column, k: Column, size: int) -> Column:
    """:func:`semantic_clusters` of columns: (clusters, source); halves round to the even number."""
    token = F.regexp_replace(F.lower(F.trim(name)), "[-_ ]", "")
    own = F.coalesce(*(F.when(token == t, F.lit(v)) for t, v in SEMANTIC_CLUSTERS.items()))
    by_size = F.when(rows / k < size, 3 * k).otherwise(F.greatest(F.bround(rows / size).cast("int"), k))
    found = F.coalesce(F.greatest(own, F.when(own.isNotNull(), k)), by_size)
    return F.struct(found.cast("int").alias("clusters"), F.when(own.isNotNull(), "official_default").otherwise("size_heuristic").alias("source"))


def filter_clusters_column(dataset_default: Column, k: Column, explicit: Column) -> Column:
    """:func:`filter_clusters` of columns."""
    return F.coalesce(explicit, dataset_default, 3 * k).cast("int")


def filter_clusters(dataset_default: int | None, k: int, explicit: int | None = None) -> int:
    """The number of filter clusters: explicit, the dataset's default, or 3 k."""
    return explicit if explicit is not None else dataset_default if dataset_default is not None else 3 * k


def centre_similarity(centres: DataFrame, nouns: DataFrame) -> DataFrame:
    """cluster, noun, s for every centre and noun."""
    c = centres.select("cluster", F.col("x").alias("c"))
    few = c.count() * 64 <= BROADCAST_NUMBERS
    return nouns.select(F.col("id").alias("noun"), "x").crossJoin(F.broadcast(c) if few else c).select("cluster", "noun", dot("c", "x").alias("s"))


def centre_softmax(centres: DataFrame, nouns: DataFrame, temperature: float = 1.0) -> DataFrame:
    """cluster, noun, p: softmax over the centres for each noun."""
    w = Window.partitionBy("noun")
    e = F.exp(F.col("s") / temperature - F.max(F.col("s") / temperature).over(w))
    return centre_similarity(centres, nouns).withColumn("e", e).select("cluster", "noun", (F.col("e") / F.sum("e").over(w)).alias("p"))


def discriminative_nouns(centres: DataFrame, nouns: DataFrame, per_centre: int) -> DataFrame:
    """noun, cluster, confidence: of the nouns most probable under each centre, the ``per_centre`` most confident."""
    p = centre_softmax(centres, nouns)
    own = Window.partitionBy("noun").orderBy(F.round("p", 12).desc(), "cluster")
    top = p.withColumn("r", F.row_number().over(own)).where("r = 1")
    rank = Window.partitionBy("cluster").orderBy(F.round("p", 12).desc(), "noun")
    return top.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= per_centre).select("noun", "cluster", F.col("p").alias("confidence"))


def gradient_scores(centres: DataFrame, nouns: DataFrame, temperature: float = 0.04, q: float = 0.3) -> DataFrame:
    """noun, cluster, score: the q-th root of (sum of p^q + (1 - c)^q - c^q) times the sum of |x|^q, with c the largest p."""
    p = centre_softmax(centres, nouns, temperature)
    best = F.max_by("cluster", F.struct(F.round("p", 12), -F.col("cluster")))
    sums = p.groupBy("noun").agg(F.sum(F.pow("p", F.lit(q))).alias("a"), F.max("p").alias("c"), best.alias("cluster"))
    size = nouns.select(F.col("id").alias("noun"), F.aggregate("x", F.lit(0.0), lambda s, e: s + F.pow(F.abs(e), F.lit(q))).alias("b"))
    head = F.col("a") + F.pow(F.greatest(1 - F.col("c"), F.lit(0.0)), F.lit(q)) - F.pow("c", F.lit(q))
    return sums.join(size, "noun").select("noun", "cluster", F.pow(head * F.col("b"), F.lit(1.0 / q)).alias("score"))


def gradient_nouns(centres: DataFrame, nouns: DataFrame, per_centre: int, temperature: float = 0.04, q: float = 0.3) -> DataFrame:
    """noun, cluster, score: the ``per_centre`` nouns of the smallest scores under each centre."""
    w = Window.partitionBy("cluster").orderBy("score", "noun")
    return gradient_scores(centres, nouns, temperature, q).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_centre).drop("r")


def mean_of_means(nouns: DataFrame, batch: int) -> DataFrame:
    """One row x: the mean of the means of batches by place (rows of the short last batch weigh more).  Places follow the ids."""
    n = with_ordinal(nouns.select("id", "x"), "id").select("x", F.floor(F.col("ordinal") / batch).alias("b"))
    return n.groupBy("b").agg(mean_vector("x").alias("x")).agg(mean_vector("x").alias("x"))


def distinct_nouns(centres: DataFrame, nouns: DataFrame, near: int, apart: float, batch: int) -> DataFrame:
    """noun: among the ``near`` nearest of any centre and with a cosine below 1 - ``apart`` to the nouns' mean."""
    c = centres.select(F.col("cluster").cast("long").alias("id"), unit("x", 1e-8).alias("x"))
    close = top_k(c, nouns.select("id", unit("x", 1e-8).alias("x")), near).select(F.col("j").alias("noun"))
    middle = mean_of_means(nouns, batch).select(F.col("x").alias("m"))
    far = nouns.crossJoin(F.broadcast(middle)).where(dot(unit("x", 1e-8), unit("m", 1e-8)) < 1 - apart).select(F.col("id").alias("noun"))  # one row on the right
    return close.intersect(far)


def candidate_nouns(centres: DataFrame, nouns: DataFrame, k1: int) -> DataFrame:
    """Nouns (id, x) among the k1 nearest of any centre."""
    near = top_k(centres.select(F.col("cluster").cast("long").alias("id"), "x"), nouns, k1)
    return nouns.join(near.select(F.col("j").alias("id")).distinct(), "id", "left_semi")


def soft_retrieval(rows: DataFrame, nouns: DataFrame, temperature: float, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """id, x: for each row the nouns' mean under softmax(similarity / temperature), to unit length.

    The nouns pass by in blocks, while a task holds the sum of each of its rows
    with its largest exponent.
    """
    passing = source(nouns, broadcast_numbers=broadcast_numbers)
    if passing.n == 0:
        raise ValueError("soft retrieval needs a noun")

    def work(found: pa.RecordBatch, _: np.ndarray, x: np.ndarray, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        top, total = np.full(len(x), -np.inf), np.zeros_like(x)
        for _, y in blocks():
            for at in pieces(len(x), len(y)):
                s = x[at] @ y.T
                s /= temperature
                high = np.maximum(top[at], s.max(axis=1))
                s -= high[:, None]
                total[at] = total[at] * np.exp(top[at] - high)[:, None] + np.exp(s, out=s) @ y
                top[at] = high
        # The sum of the weights changes the length alone.
        total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
        yield pa.RecordBatch.from_arrays([found.column(0), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["id", "x"])

    return meet(rows.select("id", "x"), passing, work, "id long, x array<double>")


def weighted_text(rows: DataFrame, nouns: DataFrame, k2: int, temperature: float) -> DataFrame:
    """id, x: the k2 nearest nouns' mean under softmax(similarity / temperature), to unit length."""
    near = top_k(rows, nouns, k2)
    w = Window.partitionBy("i")
    weighed = near.withColumn("e", F.exp((F.col("score") - F.max("score").over(w)) / temperature)).withColumn("w", F.col("e") / F.sum("e").over(w))
    return _blend(weighed, nouns)


def coarse_text(rows: DataFrame, nouns: DataFrame, k: int, temperature: float, mode: str = "similarity") -> DataFrame:
    """id, x: the k nearest nouns' mean, weighed by similarity (negative ones count 0; if all do, by softmax) or by softmax."""
    if mode not in ("similarity", "softmax"):
        raise ValueError("mode must be 'similarity' or 'softmax'")
    near, w = top_k(rows, nouns, k), Window.partitionBy("i")
    e = near.withColumn("e", F.exp((F.col("score") - F.max("score").over(w)) / temperature)).withColumn("soft", F.col("e") / F.sum("e").over(w))
    kept = e.withColumn("pos", F.greatest("score", F.lit(0.0))).withColumn("total", F.sum("pos").over(w))
    by = F.when(F.col("total") > 1e-12, F.col("pos") / F.greatest("total", F.lit(1e-12))).otherwise(F.col("soft"))
    return _blend(kept.withColumn("w", F.col("soft") if mode == "softmax" else by), nouns)


def _blend(weighed: DataFrame, nouns: DataFrame) -> DataFrame:
    """id, x: sums of w times the noun's vector for (i, j, w), to unit length."""
    met = weighed.select("i", "j", "w").join(nouns.select(F.col("id").alias("j"), "x"), "j")
    sums = met.select(F.col("i").alias("id"), F.transform("x", lambda e: e * F.col("w")).alias("x")).groupBy("id").agg(sum_vector("x").alias("x"))
    return sums.withColumn("x", unit("x"))


def confident_centres(scores: DataFrame, rows: DataFrame, k: int, share: float) -> DataFrame:
    """cluster, x: the mean of the int(n // k * share) rows that score highest for each cluster in (id, cluster, score)."""
    most = int(rows.count() // k * share)
    if most < 1:
        raise ValueError("each cluster needs a confident row; raise the share or take more rows")
    w = Window.partitionBy("cluster").orderBy(F.round("score", 10).desc(), "id")
    best = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return best.select("cluster", "id").join(rows.select("id", "x"), "id").groupBy("cluster").agg(mean_vector("x").alias("x"))


def adjusted_text_centres(scores: DataFrame, rows: DataFrame, nouns: DataFrame, k: int, share: float, near: int) -> DataFrame:
    """cluster, x: for each confident centre the mean of its ``near`` nearest nouns, to unit length."""
    c = confident_centres(scores, rows, k, share).select(F.col("cluster").cast("long").alias("id"), unit("x").alias("x"))
    found = top_k(c, nouns.select("id", unit("x", 1e-8).alias("x")), near)
    text = found.join(nouns.select(F.col("id").alias("j"), "x"), "j").groupBy(F.col("i").cast("int").alias("cluster")).agg(mean_vector("x").alias("x"))
    return text.withColumn("x", unit("x"))
