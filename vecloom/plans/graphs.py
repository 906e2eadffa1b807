"""Queries of graph, clustering and metric operators over all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vectors import argmax, dot
from vecloom.operators import clustering, graphs, metrics, neighbors
from vecloom.plans.neighbors import VOTES, votes
from vecloom.plans.registry import BASE, long, means_sql, out6, query, r6, topk_sql
from vecloom.sources.tables import nouns, table, vectors

PAIRS = "p AS (SELECT a.id AS i, b.id AS j, round(list_dot_product(a.x, b.x), 10) + 0.0 AS s FROM u a, u b WHERE a.id <> b.id)"
_ROWS = f"SELECT i, count(*) AS n, {out6('sum(w)')} AS degree, {out6('max(w)')} AS top FROM w GROUP BY i"


def _shown(rows: DataFrame) -> DataFrame:
    """A graph by its rows: number of edges, degree, heaviest edge."""
    return rows.select("i", "n", r6("degree").alias("degree"), r6("top").alias("top"))


def _edges(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j", r6("w").alias("w"))


_EDGES = f"SELECT i, j, {out6('w')} AS w FROM w"
_MUTUAL = f"""{BASE},{topk_sql('k', 'u', 'u', 10, True)}, e AS (SELECT i, j, exp(-greatest(2 - 2 * score, 0.0) / 0.5) AS w FROM k),
w AS (SELECT a.i, a.j, (a.w + b.w) / 2 AS w FROM e a JOIN e b ON a.i = b.j AND a.j = b.i)"""
_NEAR = f"{BASE},{topk_sql('k', 'u', 'u', 8, True)}, e AS (SELECT i, j, score AS w FROM k)"
_MAXED = f"{_NEAR}, t AS (SELECT i, j, greatest(w, 0.0) AS w FROM e UNION ALL SELECT j, i, greatest(w, 0.0) FROM e), m AS (SELECT i, j, max(w) AS w FROM t GROUP BY ALL HAVING max(w) > 0)"


def _near_edges(spark: SparkSession, sf: str) -> DataFrame:
    return neighbors.without_self(vectors(spark, sf), 8).select("i", "j", F.col("score").alias("w"))


@query(f"WITH {BASE}, {PAIRS}, w AS (SELECT i, j, s AS w FROM p) {_ROWS}")
def g1_dot_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(graphs.dense_rows(vectors(spark, sf)))


@query(f"WITH {BASE}, {PAIRS}, w AS (SELECT i, j, exp((2 * greatest(least(s, 1.0), -1.0) - 2) / 0.5) AS w FROM p) {_ROWS}")
def g2_rbf_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(graphs.dense_rows(vectors(spark, sf), graphs.rbf(0.5)))


@query(f"WITH {_MUTUAL} {_EDGES}")
def g3_mutual_knn(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(graphs.mutual_knn(vectors(spark, sf), 10, 0.5))


@query(f"""WITH RECURSIVE {_MUTUAL}, reach(id, other) AS (SELECT id, id FROM u UNION SELECT r.id, w.j FROM reach r JOIN w ON w.i = r.other),
c AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT (SELECT count(*) FROM u) AS n_nodes, (SELECT count(*) FROM w) AS nnz, {out6('(SELECT count(*) FROM w) / (SELECT count(*)::DOUBLE * count(*) FROM u)')} AS density,
(SELECT count(*) FROM u WHERE id NOT IN (SELECT i FROM w)) AS isolated, (SELECT count(DISTINCT component) FROM c) AS n_components""")
def g4_graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return graphs.summary(v, graphs.mutual_knn(v, 10, 0.5)).withColumn("density", r6("density"))


@query(f"""WITH {_NEAR}, n2 AS (SELECT i, j, abs(w / greatest(sqrt(sum(w * w) OVER (PARTITION BY i)), 1e-12)) AS w FROM e), b AS (SELECT * FROM n2 UNION ALL SELECT j, i, w FROM n2),
w AS (SELECT i, j, sum(w) / 2 AS w FROM b GROUP BY ALL) {_EDGES}""")
def g5_representation_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(graphs.representation_affinity(_near_edges(spark, sf)))


@query(f"WITH {BASE},{topk_sql('k', 'u', 'u', 3, True)}, b AS (SELECT i, j FROM k UNION ALL SELECT j, i FROM k), w AS (SELECT i, j, count(*) / 2 AS w FROM b GROUP BY ALL) {_EDGES}")
def g6_knn_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(graphs.knn_connectivity(vectors(spark, sf), 3))


@query(f"WITH {_MAXED}, w AS (SELECT * FROM m) {_EDGES}")
def g7_max_symmetric(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(graphs.max_symmetric(_near_edges(spark, sf)))


@query(f"""WITH {_MAXED}, d AS (SELECT i, greatest(sum(w), 1.0) AS d FROM m GROUP BY i HAVING sum(w) > 0),
w AS (SELECT m.i, m.j, m.w / sqrt(a.d * b.d) AS w FROM m JOIN d a ON a.i = m.i JOIN d b ON b.i = m.j) {_EDGES}""")
def g8_transition(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(graphs.transition(graphs.max_symmetric(_near_edges(spark, sf))))


def _sinkhorn_sql(rounds: int, eps: float) -> str:
    steps, u, v = [], "u0", "v0"
    for t in range(rounds):
        side, old = ("i", u) if t % 2 == 0 else ("j", v)
        new, col = (f"u{t + 1}", "u") if side == "i" else (f"v{t + 1}", "v")
        steps.append(
            f"m{t} AS (SELECT c.i, c.j, (c.c + {u}.u + {v}.v) / {eps} AS m FROM c JOIN {u} ON {u}.i = c.i JOIN {v} ON {v}.j = c.j),"
            f" t{t} AS (SELECT {side}, max(m) AS top FROM m{t} GROUP BY {side}),"
            f" l{t} AS (SELECT m.{side}, t.top + ln(sum(exp(m.m - t.top))) AS lse FROM m{t} m JOIN t{t} t USING ({side}) GROUP BY m.{side}, t.top),"
            f" {new} AS (SELECT o.{side}, {eps} * (-ln((SELECT count(*) FROM u)::DOUBLE) - lse) + o.{col} AS {col} FROM {old} o JOIN l{t} USING ({side}))"
        )
        u, v = (new, v) if side == "i" else (u, new)
    return (
        f"WITH {BASE}, c AS (SELECT a.id AS i, b.id AS j, abs(round(list_dot_product(a.x, b.x), 10)) AS c FROM u a, u b), u0 AS (SELECT id AS i, 0.0::DOUBLE AS u FROM u), v0 AS (SELECT id AS j, 0.0::DOUBLE AS v FROM u), "
        + ", ".join(steps)
        + f", w AS (SELECT c.i, c.j, (SELECT count(*) FROM u) * exp((c.c + {u}.u + {v}.v) / {eps}) AS w FROM c JOIN {u} ON {u}.i = c.i JOIN {v} ON {v}.j = c.j) {_ROWS}"
    )


@query(_sinkhorn_sql(4, 0.1))
def g9_sinkhorn(spark: SparkSession, sf: str) -> DataFrame:
    z = vectors(spark, sf).select("id", "x")
    return _shown(graphs.sinkhorn_rows(z, 0.1, 4))


@query(f"WITH {BASE}, {PAIRS}, w AS (SELECT i, j, abs(s) AS w FROM p) {_ROWS}")
def g10_absolute_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(graphs.dense_rows(vectors(spark, sf), graphs.absolute))


@query(f"WITH {_MAXED}, w AS (SELECT i, j, w FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY w DESC, j) AS r FROM m) WHERE r <= 4) {_EDGES}")
def g11_pruned_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(graphs.pruned(graphs.max_symmetric(_near_edges(spark, sf)), 4))


def lloyd_sql(k: int, rounds: int, spherical: bool, source: str = "u", prefix: str = "l") -> str:
    """CTEs of Lloyd's rounds over ``source`` (id, x), the last ``{prefix}`` (id, cluster, score) and ``{prefix}c`` (cluster, x)."""
    p, parts = prefix, []
    parts.append(f"{p}c0 AS (SELECT (row_number() OVER (ORDER BY id))::INTEGER - 1 AS cluster, x FROM {source} ORDER BY id LIMIT {k})")
    score = "list_dot_product(a.x, c.x)" if spherical else "2 * list_dot_product(a.x, c.x) - list_dot_product(c.x, c.x) - list_dot_product(a.x, a.x)"
    for t in range(rounds + 1):
        last = t == rounds
        name = p if last else f"{p}a{t}"
        parts.append(
            f"{name}s AS (SELECT a.id, a.x, c.cluster, round({score}, 10) + 0.0 AS score FROM {source} a, {p}c{t} c),"
            f" {name} AS (SELECT id, x, cluster, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cluster) AS r FROM {name}s) WHERE r = 1)"
        )
        if not last:
            parts.append(means_sql(f"{p}m{t}", name, "cluster", False))
            held = f"SELECT c.cluster, COALESCE(m.x, c.x) AS x FROM {p}c{t} c LEFT JOIN {p}m{t} m USING (cluster)"
            unit = f"SELECT cluster, list_transform(x, lambda e: e / greatest(sqrt(list_dot_product(x, x)), 1e-12)) AS x FROM ({held})"
            parts.append(f"{p}c{t + 1} AS ({unit if spherical else held})")
    parts.append(f"{p}c AS (SELECT * FROM {p}c{rounds})")
    return ", ".join(parts)


@query(f"WITH {BASE}, {lloyd_sql(10, 5, False)} SELECT id, cluster, {out6('score')} AS score FROM l")
def c1_lloyd(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.lloyd(vectors(spark, sf), 10, 5)[0].select("id", "cluster", r6("score").alias("score"))


@query(f"WITH {BASE}, {lloyd_sql(10, 6, True)} SELECT id, cluster, {out6('score')} AS score FROM l")
def c3_spherical_lloyd(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.lloyd(vectors(spark, sf), 10, 6, True)[0].select("id", "cluster", r6("score").alias("score"))


@query(f"WITH {BASE}, {lloyd_sql(8, 4, True, 'n')}, m AS (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1)::INTEGER - 1 AS dim FROM lc) SELECT cluster, dim, {out6('v')} AS value FROM m")
def c4_spherical_centres(spark: SparkSession, sf: str) -> DataFrame:
    return long(clustering.centre_rows(spark, clustering.lloyd(nouns(spark, sf), 8, 4, True)[1]), "x", "cluster")


@query(f"""WITH {BASE}, {lloyd_sql(5, 3, False)} SELECT cluster, count(*) AS n, {out6('sum(score)')} AS cost FROM l GROUP BY cluster""")
def c5_euclidean_sizes(spark: SparkSession, sf: str) -> DataFrame:
    found = clustering.lloyd(vectors(spark, sf), 5, 3)[0]
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("score")).alias("cost"))


@query(
    f"WITH {BASE},{means_sql('c', 'u', 'label')}, f AS (SELECT range::INTEGER AS cluster, COALESCE(c.x, list_transform(range(64), lambda d: 0.0::DOUBLE)) AS x FROM range(12) LEFT JOIN c ON c.label = range),"
    f" m AS (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1)::INTEGER - 1 AS dim FROM f) SELECT cluster, dim, {out6('v')} AS value FROM m"
)
def c6_cluster_means(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters 10 and 11 have no rows and so the zero vector."""
    return long(clustering.cluster_means(vectors(spark, sf).select(F.col("label").alias("cluster"), "x"), 12), "x", "cluster")


@query()
def c7_kmeans_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """k-means of unit rows with as many clusters as labels, against the labels."""
    v = vectors(spark, sf)
    found, _ = clustering.kmeans(v, clustering.default_k(v))
    return metrics.evaluate(v.join(found, "id").select("label", F.col("cluster").alias("pred"))).withColumn("value", r6("value"))


def _named(found: DataFrame) -> DataFrame:
    """id, cluster: clusters by their smallest id, so that their numbers say nothing."""
    return found.join(found.groupBy("cluster").agg(F.min("id").alias("least")), "cluster").select("id", F.col("least").alias("cluster"))


@query()
def c8_spectral(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    if v.count() <= clustering.DRIVER_NODES:
        return _named(clustering.spectral_clustering(v, graphs.rbf_affinity(v, 0.5), 10))
    return _named(clustering.dense_spectral_clustering(v, graphs.rbf(0.5), 10))


@query()
def c10_spectral_knn(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return _named(clustering.spectral_clustering(v, graphs.mutual_knn(v, 15, 0.5), 10))


@query()
def c11_discretised(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return clustering.discretised_rows(clustering.spectral_embedding(v, graphs.knn_connectivity(v, 10), 10))


@query()
def c12_matrix_free_eigenvectors(spark: SparkSession, sf: str) -> DataFrame:
    """The way of a large graph: subspace iteration by joins and sums.  Products with the row of the smallest id don't change if the eigenvectors are turned."""
    v = vectors(spark, sf)
    found = clustering.spectral_embedding(v, graphs.cut_lineage(graphs.knn_connectivity(v, 10)), 3, driver_nodes=0)
    first = found.orderBy("id").limit(1).select(F.col("x").alias("first"))  # one row
    return found.crossJoin(F.broadcast(first)).select("id", F.round(dot("x", "first"), 3).alias("toward"))


@query("SELECT count(DISTINCT label)::INTEGER AS k FROM embeddings")
def c13_default_k(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(clustering.default_k(table(spark, sf, "embeddings")),)], "k int")


# Predictions of the metric queries: the place of the largest of the first eight numbers.
_PRED = f"{BASE}, g AS (SELECT id, label, x, (list_position(x[1:8], list_max(x[1:8])) - 1)::INTEGER AS pred FROM u)"


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).withColumn("pred", argmax(F.slice("x", 1, 8)))


@query(f"WITH {_PRED} SELECT label, pred, count(*) AS n FROM g GROUP BY ALL")
def e1_contingency(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.contingency(_predicted(spark, sf))


def _nmi_sql(rows: str) -> str:
    return f"""c AS (SELECT label, pred, count(*) AS n FROM {rows} GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS t FROM c),
a AS (SELECT label, sum(n)::DOUBLE AS n FROM c GROUP BY label), b AS (SELECT pred, sum(n)::DOUBLE AS n FROM c GROUP BY pred),
mi AS (SELECT sum(c.n / t * ln(c.n * t / (a.n * b.n))) AS v FROM c JOIN a USING (label) JOIN b USING (pred), t),
h AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM a, t) + (SELECT -sum(n / t * ln(n / t)) FROM b, t) AS v)
SELECT {out6('2 * mi.v / h.v')} AS nmi FROM mi, h"""


@query(f"WITH {_PRED}, {_nmi_sql('g')}")
def e2_nmi(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.nmi(_predicted(spark, sf)).select(r6("nmi").alias("nmi"))


@query(f"""WITH {_PRED}, c AS (SELECT label, pred, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n)::DOUBLE AS t FROM c),
a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY label)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY pred))
SELECT {out6('(s - a * b / (t * (t - 1) / 2)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2))')} AS ari FROM s, a, b""")
def e3_ari(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ari(_predicted(spark, sf)).select(r6("ari").alias("ari"))


def _acc_sql() -> str:
    """The best matching of eight clusters and ten labels, by the set of labels used so far."""
    steps = ["d0 AS (SELECT 0 AS mask, 0::BIGINT AS best)"]
    for p in range(8):
        steps.append(
            f"d{p + 1} AS (SELECT mask, max(best) AS best FROM (SELECT mask, best FROM d{p} UNION ALL"
            f" SELECT mask | (1 << l), best + COALESCE((SELECT n FROM c WHERE c.pred = {p} AND c.label = l), 0) FROM d{p}, (SELECT range::INTEGER AS l FROM range(10)) WHERE (mask >> l) & 1 = 0) GROUP BY mask)"
        )
    return f"WITH {_PRED}, c AS MATERIALIZED (SELECT label, pred, count(*) AS n FROM g GROUP BY ALL), {', '.join(steps)} SELECT {out6('max(best) / (SELECT count(*)::DOUBLE FROM g)')} AS acc FROM d8"


@query(_acc_sql())
def e4_acc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.acc(_predicted(spark, sf)).select(r6("acc").alias("acc"))


@query(f"""WITH {_PRED}, d AS (SELECT a.id, a.pred, b.pred AS other, sum(1 - list_dot_product(a.x, b.x)) AS t, count(*) AS m FROM g a, g b GROUP BY ALL),
e AS (SELECT id, max(CASE WHEN pred = other THEN CASE WHEN m > 1 THEN t / (m - 1) ELSE -1 END END) AS a, min(CASE WHEN pred <> other THEN t / m END) AS b FROM d GROUP BY id)
SELECT {out6('avg(CASE WHEN a < 0 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS sil FROM e""")
def e5_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.silhouette(_predicted(spark, sf)).select(r6("sil").alias("sil"))


_D2 = "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query(f"""WITH {_PRED}, d AS (SELECT a.id, a.pred, b.pred AS other, sum(sqrt({_D2.format('a.x', 'b.x')})) AS t, count(*) AS m FROM g a, g b GROUP BY ALL),
e AS (SELECT id, max(CASE WHEN pred = other THEN CASE WHEN m > 1 THEN t / (m - 1) ELSE -1 END END) AS a, min(CASE WHEN pred <> other THEN t / m END) AS b FROM d GROUP BY id)
SELECT {out6('avg(CASE WHEN a < 0 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS sil FROM e""")
def e5_silhouette_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.silhouette(_predicted(spark, sf), "euclidean").select(r6("sil").alias("sil"))


_CENTRES = means_sql("c", "g", "pred", False)


@query(f"""WITH {_PRED},{_CENTRES}, s AS (SELECT g.pred, c.x, avg(sqrt({_D2.format('g.x', 'c.x')})) AS s FROM g JOIN c USING (pred) GROUP BY ALL),
r AS (SELECT a.pred, max((a.s + b.s) / sqrt({_D2.format('a.x', 'b.x')})) AS r FROM s a JOIN s b ON a.pred <> b.pred GROUP BY a.pred) SELECT {out6('avg(r)')} AS dbi FROM r""")
def e6_davies_bouldin(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.davies_bouldin(_predicted(spark, sf)).select(r6("dbi").alias("dbi"))


@query(f"""WITH {_PRED},{_CENTRES}, g1 AS (SELECT 1 AS one, x FROM g),{means_sql('m', 'g1', 'one', False)}, b AS (SELECT sum(z.n * {_D2.format('c.x', 'm.x')}) AS b, count(*) AS k, sum(z.n) AS n
FROM c JOIN (SELECT pred, count(*) AS n FROM g GROUP BY pred) z USING (pred), m), w AS (SELECT sum({_D2.format('g.x', 'c.x')}) AS w FROM g JOIN c USING (pred))
SELECT {out6('b * (n - k) / (w * (k - 1))')} AS chi FROM b, w""")
def e7_calinski_harabasz(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.calinski_harabasz(_predicted(spark, sf)).select(r6("chi").alias("chi"))


@query(f"WITH {_PRED} SELECT count(DISTINCT pred)::INTEGER AS k FROM g")
def e8_valid_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(metrics.valid_clusters(_predicted(spark, sf)),)], "k int")


def _head_sql() -> str:
    pair = lambda c: f"({c} * ({c} - 1) / 2)"
    return f"""WITH {_PRED}, heads AS (SELECT 'a' AS head, label, pred FROM g UNION ALL SELECT 'b', label, (list_position(x[9:14], list_max(x[9:14])) - 1)::INTEGER FROM g),
c AS (SELECT head, label, pred, count(*)::DOUBLE AS n FROM heads GROUP BY ALL), t AS (SELECT head, sum(n) AS t FROM c GROUP BY head),
a AS (SELECT head, label, sum(n) AS n FROM c GROUP BY ALL), b AS (SELECT head, pred, sum(n) AS n FROM c GROUP BY ALL),
mi AS (SELECT head, sum(c.n / t * ln(c.n * t / (a.n * b.n))) AS mi, sum({pair('c.n')}) AS s FROM c JOIN t USING (head) JOIN a USING (head, label) JOIN b USING (head, pred) GROUP BY head),
ha AS (SELECT head, -sum(n / t * ln(n / t)) AS h, sum({pair('n')}) AS p FROM a JOIN t USING (head) GROUP BY head), hb AS (SELECT head, -sum(n / t * ln(n / t)) AS h, sum({pair('n')}) AS p FROM b JOIN t USING (head) GROUP BY head)
SELECT head, {out6('2 * mi / (ha.h + hb.h)')} AS nmi, {out6(f'(s - ha.p * hb.p / {pair("t")}) / ((ha.p + hb.p) / 2 - ha.p * hb.p / {pair("t")})')} AS ari
FROM mi JOIN ha USING (head) JOIN hb USING (head) JOIN t USING (head)"""


@query(_head_sql())
def e10_metrics_by_head(spark: SparkSession, sf: str) -> DataFrame:
    rows = _predicted(spark, sf)
    heads = rows.select(F.lit("a").alias("head"), "label", "pred").unionByName(rows.select(F.lit("b").alias("head"), "label", argmax(F.slice("x", 9, 6)).alias("pred")))
    return metrics.by_head(heads).select("head", r6("nmi").alias("nmi"), r6("ari").alias("ari"))


@query(f"""WITH {_PRED}, h AS (SELECT pred, count(*) / (SELECT count(*)::DOUBLE FROM g) AS share FROM g GROUP BY pred), e AS (SELECT range::INTEGER AS cluster, 0.9 / 8 + 0.1 * COALESCE(share, 0) AS v FROM range(8) LEFT JOIN h ON pred = range)
SELECT cluster, {out6('v / (SELECT sum(v) FROM e)')} AS value FROM e""")
def e11_histogram_average(spark: SparkSession, sf: str) -> DataFrame:
    found = {r.pred: r["count"] for r in _predicted(spark, sf).groupBy("pred").count().collect()}
    ema = metrics.histogram_ema([1 / 8] * 8, [found.get(i, 0) for i in range(8)], 0.9)
    return spark.createDataFrame(list(enumerate(ema)), "cluster int, value double").withColumn("value", r6("value"))


@query(f"WITH {_PRED} SELECT DISTINCT pred FROM g")
def e12_distinct_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf).select("pred").distinct()


@query("""WITH s AS (SELECT p_brand AS name, CASE WHEN p_brand LIKE '%3' THEN NULL ELSE round(avg(p_size) / 50, 4) END AS value FROM part GROUP BY p_brand)
SELECT name, value, (CASE WHEN value IS NULL THEN 0 ELSE (SELECT count(*) FROM s t WHERE t.value > s.value) + 1 END)::INTEGER AS place FROM s""")
def e13_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg((F.avg("p_size") / 50).alias("value"))
    ranked = metrics.leaderboard(scores.withColumn("value", F.when(~F.col("name").endswith("3"), F.col("value"))))
    return ranked.withColumn("place", F.coalesce("place", F.lit(0)))  # 0: not ranked


@query(f"WITH {VOTES}, {_nmi_sql('voted')}")
def knn_vote_nmi(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.nmi(votes(spark, sf)).select(r6("nmi").alias("nmi"))


@query(f"WITH {BASE}, {PAIRS} SELECT count(*) AS negative FROM (SELECT i FROM p GROUP BY i HAVING sum(s) < 0)")
def c9_negative_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose dot-product degree is negative: a spectral method refuses such a graph."""
    return graphs.dense_rows(vectors(spark, sf)).where("degree < 0").agg(F.count(F.lit(1)).alias("negative"))


__all__ = ["dot", "lloyd_sql"]
