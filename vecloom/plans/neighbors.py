"""Queries of the neighbour operators over all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import metrics, neighbors
from vecloom.operators.blocks import BLOCK
from vecloom.plans.registry import BASE, means_sql, out6, query, r6, topk_sql
from vecloom.sources.tables import nouns, vectors

_SHOW = f"SELECT i, j, {out6('score')} AS score, rank FROM k"


def _shown(near: DataFrame) -> DataFrame:
    return near.select("i", "j", r6("score").alias("score"), "rank")


@query(f"WITH {BASE},{topk_sql('k', 'u', 'n', 5)} {_SHOW}")
def k1_top_k_ip(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(neighbors.top_k(vectors(spark, sf), nouns(spark, sf), 5))


_L2 = "0.0 - list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query(f"WITH {BASE},{topk_sql('k', 'u', 'n', 5, score=_L2)} {_SHOW}")
def k1_top_k_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(neighbors.top_k(vectors(spark, sf), nouns(spark, sf), 5, "l2"))


@query(f"WITH {BASE},{topk_sql('k', 'u', 'u', 5, True)} {_SHOW}")
def k2_knn_without_self(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(neighbors.without_self(vectors(spark, sf), 5))


@query(f"WITH {BASE},{topk_sql('k', 'u', 'u', 25, True)} SELECT i, count(*) AS n, {out6('min(score)')} AS edge, sum(j)::BIGINT AS ids FROM k GROUP BY i")
def k3_knn_masked(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbors.without_self(vectors(spark, sf), 25)
    return near.groupBy("i").agg(F.count(F.lit(1)).alias("n"), r6(F.min("score")).alias("edge"), F.sum("j").alias("ids"))


@query(f"WITH {BASE},{topk_sql('k', 'u', 'u', 6)} {_SHOW}")
def k4_knn_including_self(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(neighbors.including_self(vectors(spark, sf), 5))


@query(f"WITH {BASE},{topk_sql('k', 'u', 'u', 10, True)} SELECT i, count(*) AS n FROM k GROUP BY i HAVING count(*) < 10")
def k5_short_rows(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.short_rows(neighbors.without_self(vectors(spark, sf), 10), 10)


@query(f"WITH {BASE},{topk_sql('k', 'n', 'u', 7)} {_SHOW}")
def k6_top_k_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The way of a large index: it passes by in blocks from the shared folder, while each task holds the bests of its queries."""
    v = vectors(spark, sf)
    return _shown(neighbors.top_k(nouns(spark, sf), v, 7, block=min(max(256, v.count() // 3), BLOCK), broadcast_numbers=0))


@query(
    f"WITH {BASE},{means_sql('c', 'u', 'label')}, q AS (SELECT label AS id, x FROM c),{topk_sql('near', 'q', 'n', 20)},"
    f" few AS (SELECT id, x FROM n WHERE id IN (SELECT j FROM near)),{topk_sql('k', 'u', 'few', 3)} {_SHOW}"
)
def k7_candidates_of_centres(spark: SparkSession, sf: str) -> DataFrame:
    from vecloom.operators import clustering, retrieval

    v = vectors(spark, sf)
    centres = clustering.cluster_means(v.select(F.col("label").alias("cluster"), "x"), 10)
    return _shown(neighbors.top_k(v, retrieval.candidate_nouns(centres, nouns(spark, sf), 20), 3))


@query(
    f"WITH {BASE},{topk_sql('k', 'u', 'u', 10, True)}, d AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY md5('7|' || i || '|' || j), j)::INTEGER AS draw FROM k)"
    " SELECT i, j, draw FROM d WHERE draw <= 4"
)
def k8_sampled_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.sampled(neighbors.without_self(vectors(spark, sf), 10), 4, 7)


@query(f"WITH {BASE},{topk_sql('k', 'u', 'u', 3, True)} SELECT i, j, {out6('list_sum(u.x)')} AS total FROM k JOIN u ON u.id = k.j")
def k9_gather(spark: SparkSession, sf: str) -> DataFrame:
    from vecloom.functions.vectors import total

    v = vectors(spark, sf)
    return neighbors.gather(neighbors.without_self(v, 3), v).select("i", "j", r6(total("x")).alias("total"))


@query(f"WITH {BASE},{topk_sql('k', 'u', 'u', 10, True)} SELECT i AS id, {out6('-ln(greatest(sum(greatest(2 - 2 * score, 0.0)), 1e-8))')} AS value FROM k GROUP BY i")
def k10_density(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.density(vectors(spark, sf), 10).select("id", r6("value").alias("value"))


def votes(spark: SparkSession, sf: str) -> DataFrame:
    """id, label, pred: the most frequent label among the five nearest others (then the smallest)."""
    v = vectors(spark, sf)
    near = neighbors.without_self(v, 5).join(v.select(F.col("id").alias("j"), F.col("label").alias("vote")), "j")
    counts = near.groupBy(F.col("i").alias("id"), "vote").agg(F.count(F.lit(1)).alias("m"))
    best = counts.groupBy("id").agg(F.max_by("vote", F.struct("m", -F.col("vote"))).alias("pred"))
    return v.select("id", "label").join(best, "id")


VOTES = f"""{BASE},{topk_sql('k', 'u', 'u', 5, True)},
votes AS (SELECT k.i AS id, u.label AS vote, count(*) AS m FROM k JOIN u ON u.id = k.j GROUP BY ALL),
voted AS (SELECT u.id, u.label, b.vote AS pred FROM u JOIN (SELECT id, vote, row_number() OVER (PARTITION BY id ORDER BY m DESC, vote) AS r FROM votes) b ON b.id = u.id AND b.r = 1)"""


@query(f"WITH {VOTES} SELECT label, pred, count(*) AS n FROM voted GROUP BY ALL")
def knn_vote_contingency(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: neighbours, vote, contingency."""
    return metrics.contingency(votes(spark, sf))
