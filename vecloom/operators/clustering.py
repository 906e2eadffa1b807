"""k-means and spectral clustering."""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vectors import sum_vector, unit
from vecloom.operators.blocks import BLOCK, BROADCAST_NUMBERS, Blocks, executor_cores, meet, pieces, same, source
from vecloom.operators.blocks import matrix as rows_of
from vecloom.operators.graphs import checked_degrees, cut_lineage, degrees, dense_rows, refuse_degrees

#: Spectral embeddings of at most so many nodes are solved on the driver (a matrix of 128 MB).
DRIVER_NODES = 4000
#: Runs of k-means that go on at the same time.
RUNS = 8
#: Vectors that the block Lanczos method holds at a time.
VECTORS = 160
#: Numbers of edges and of vectors (twice, as they are turned) that one task holds for a spectral embedding, 480 MB.
HELD = 60_000_000
#: Nodes of a block of vectors that pass by the edges.
PASSING = 65_536


def centre_rows(spark: SparkSession, centres: np.ndarray) -> DataFrame:
    """A table (cluster, x) of k centres."""
    return spark.createDataFrame([(i, [float(e) for e in c]) for i, c in enumerate(centres)], "cluster int, x array<double>")


def assigned(vectors: DataFrame, centres: np.ndarray, spherical: bool = False) -> DataFrame:
    """id, cluster, score, x: the nearest centre of each row (largest inner product, or least distance); ties go to the smaller cluster."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.asarray(centres, np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            s = x @ c.T if b.num_rows else np.zeros((0, len(c)))
            if not spherical and b.num_rows:
                s = 2 * s - (c * c).sum(axis=1)[None] - (x * x).sum(axis=1)[:, None]
            s = np.round(s, 10)
            at = s.argmax(axis=1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array(s[np.arange(len(at)), at]), b.column(1)], names=["id", "cluster", "score", "x"])

    return vectors.select("id", "x").mapInArrow(run, "id long, cluster int, score double, x array<double>")


def lloyd(vectors: DataFrame, k: int, iterations: int, spherical: bool = False, start: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray]:
    """Assignments (id, cluster, score, x) and centres after ``iterations`` rounds.

    Starts from the k smallest ids unless ``start`` says otherwise.  A round is
    one pass: rows are assigned in Arrow batches, sums are aggregated in the
    JVM, and k sums reach the driver.  A cluster without rows keeps its centre.
    Spherical centres are scaled to unit length after each round.
    """
    n = vectors.count()
    if not 0 < k <= n:
        raise ValueError(f"k must be from 1 to the number of rows ({n}), got {k}")
    if start is None:
        start = np.array([r.x for r in vectors.orderBy("id").select("x").take(k)], float)
    centres = np.array(start, float)
    for _ in range(iterations):
        sums = assigned(vectors, centres, spherical).groupBy("cluster").agg(sum_vector("x").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        for r in sums:
            centres[r.cluster] = np.array(r.s) / r.n
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return assigned(vectors, centres, spherical), centres


def kmeans(vectors: DataFrame, k: int, iterations: int = 300, redo: int = 20, spherical: bool = True, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """The best of ``redo`` seeded runs by cost: assignments (id, cluster) and centres; rows are scaled to unit length first if ``spherical``.

    Runs don't depend on each other, so RUNS of them go on at the same time; of
    equal costs the first run's is taken.
    """
    n = vectors.count()
    if not 0 < k <= n:
        raise ValueError(f"k must be from 1 to the number of rows ({n}), got {k}")
    table = vectors.select("id", array_to_vector(unit("x") if spherical else F.col("x")).alias("features")).persist()
    table.count()  # kept once, not by each run

    def fitted(r: int) -> tuple[float, int, KMeansModel]:
        model = KMeans(k=k, maxIter=iterations, seed=seed + r, distanceMeasure="cosine" if spherical else "euclidean").fit(table)
        return model.summary.trainingCost, r, model

    with ThreadPool(max(1, min(redo, RUNS))) as pool:
        *_, best = min(pool.map(inheritable_thread_target(vectors.sparkSession)(fitted), range(redo), 1), key=lambda m: m[:2])
    out = best.transform(table).select("id", F.col("prediction").alias("cluster"))
    table.unpersist()  # the assignment is one more pass, made when it is asked for
    return out, np.array(best.clusterCenters())


def cluster_means(assignments: DataFrame, k: int, normalise: bool = True) -> DataFrame:
    """cluster, x for clusters 0 to k - 1: means of (cluster, x); a cluster without rows has the zero vector."""
    spark = assignments.sparkSession
    found = assignments.groupBy("cluster").agg(sum_vector("x").alias("s"), F.count(F.lit(1)).alias("n"))
    width = assignments.select(F.size("x").alias("d")).first()
    zero = F.array_repeat(F.lit(0.0), width.d if width else 0)
    out = spark.range(k).select(F.col("id").cast("int").alias("cluster")).join(found, "cluster", "left")
    out = out.select("cluster", F.coalesce(F.transform("s", lambda e: e / F.col("n")), zero).alias("x"))
    return out.withColumn("x", unit("x")) if normalise else out


def matrix(nodes: DataFrame, edges: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and the dense matrix of a small graph."""
    ids = np.array(sorted(r.id for r in nodes.select("id").collect()), np.int64)
    rows = edges.select("i", "j", "w").toPandas()
    out = np.zeros((len(ids), len(ids)))
    np.add.at(out, (np.searchsorted(ids, rows["i"]), np.searchsorted(ids, rows["j"])), rows["w"].to_numpy(float))
    return ids, out


def _flip(v: np.ndarray) -> np.ndarray:
    """Signs such that the largest entry of each column is positive."""
    return v * np.where(np.take_along_axis(v, np.abs(v).argmax(axis=0)[None], 0) < 0, -1, 1)


def spectral_embedding(nodes: DataFrame, edges: DataFrame, k: int, rounds: int = 60, driver_nodes: int = DRIVER_NODES, seed: int = 0, tolerance: float = 1e-5, degree: int = 8) -> DataFrame:
    """id, x: unit rows of the k leading eigenvectors of D^-1/2 A D^-1/2; a node without edges has the zero vector.

    Small graphs are solved on the driver.  Larger ones go by :func:`_leading`: a
    row holds its edges, and the vectors pass by in blocks, so a product shuffles
    nothing.  A graph whose edges and vectors are HELD numbers at most is one
    task's, which takes all products without a job for each.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    if n <= driver_nodes:
        ids, a = matrix(nodes, edges)
        d = a.sum(axis=1)
        s = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
        _, v = np.linalg.eigh((a * s[:, None] * s[None] + (a * s[:, None] * s[None]).T) / 2)
        v = _flip(v[:, ::-1][:, :k])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return spark.createDataFrame([(int(i), [float(e) for e in row]) for i, row in zip(ids, v)], "id long, x array<double>")
    deg = degrees(edges).where("degree > 0")
    scaled = (
        edges.join(deg.withColumnRenamed("degree", "di"), "i")
        .join(deg.select(F.col("i").alias("j"), F.col("degree").alias("dj")), "j")
        .select("i", "j", (F.col("w") / F.sqrt(F.col("di") * F.col("dj"))).alias("w"))
    )
    packed = scaled.groupBy(F.col("i").alias("id")).agg(F.collect_list(F.struct("j", "w")).alias("e"), F.lit(True).alias("linked"))
    held = nodes.select(F.col("id").cast("long").alias("id")).join(packed, "id", "left")
    held = held.select("id", F.coalesce("e.j", F.array().cast("array<bigint>")).alias("js"), F.coalesce("e.w", F.array().cast("array<double>")).alias("ws"), F.coalesce("linked", F.lit(False)).alias("linked"))

    held = cut_lineage(held)
    if 2 * held.agg(F.sum(F.size("js").cast("long"))).first()[0] + n * 2 * max(VECTORS, 4 * (k + 8)) <= HELD:
        return _held_leading(held, k, n, rounds, seed, tolerance, degree)

    def times(state: DataFrame, last: int) -> DataFrame:
        passing = source(state.select("id", F.slice("q", -last, last).alias("x")), PASSING)

        def work(b: pa.RecordBatch, ids: np.ndarray, q: np.ndarray, blocks: Blocks) -> Iterator[pa.RecordBatch]:
            js, ws = np.asarray(b.column(2).flatten(), np.int64), np.asarray(b.column(3).flatten(), np.float64)
            row = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(b.column(2))))
            z = np.zeros((len(ids), last))
            for xi, x in blocks():
                order = np.argsort(xi, kind="stable")
                place = order[np.minimum(np.searchsorted(xi, js, sorter=order), len(xi) - 1)]
                met = xi[place] == js
                r, w, y = row[met], ws[met], x[place[met]]
                for c in range(last):
                    z[:, c] += np.bincount(r, w * y[:, c], len(ids))
            yield _behind(b, q, z)

        return meet(state.select("id", "q", "js", "ws"), passing, work, "id long, q array<double>, js array<bigint>, ws array<double>")

    return _leading(held, times, k, n, rounds, seed, tolerance, degree)


def dense_embedding(vectors: DataFrame, weigh: Callable[[np.ndarray], np.ndarray] | None, k: int, rounds: int = 60, seed: int = 0, tolerance: float = 1e-5, degree: int = 8, block: int = BLOCK, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """:func:`spectral_embedding` of the dense graph of all pairs of different rows, whose weights ``weigh`` gives as in :func:`graphs.dense_rows`.

    No edge is kept: a product weighs the pairs anew, as rows meet all others in
    passing blocks, and leaves a short row for each row.  Fails on negative degrees.
    """
    deg = cut_lineage(dense_rows(vectors, weigh, block, broadcast_numbers).select(F.col("i").alias("id"), "degree"))
    refuse_degrees(deg)
    n = vectors.count()
    root = F.when(F.col("degree") > 0, 1 / F.sqrt("degree")).otherwise(F.lit(0.0))
    held = vectors.select(F.col("id").cast("long").alias("id"), F.col("x").alias("v")).join(deg, "id", "left").select("id", "v", F.coalesce(root, F.lit(0.0)).alias("s"))
    held = held.withColumn("linked", F.col("s") > 0)

    def times(state: DataFrame, last: int) -> DataFrame:
        lifted = F.transform(F.slice("q", -last, last), lambda e: e * F.col("s"))
        passing = source(state.select("id", F.concat("v", lifted).alias("x")), block, broadcast_numbers)

        def work(b: pa.RecordBatch, ids: np.ndarray, q: np.ndarray, blocks: Blocks) -> Iterator[pa.RecordBatch]:
            v, own, z = rows_of(b.column(2)), b.column(3).to_numpy(zero_copy_only=False), np.zeros((len(ids), last))
            for xi, x in blocks():
                y = np.ascontiguousarray(x[:, -last:])
                for at in pieces(len(v), len(xi)):
                    w = v[at] @ x[:, :-last].T
                    np.round(w, 10, out=w)
                    w = w if weigh is None else weigh(w)
                    w[same(ids[at], xi)] = 0.0
                    z[at] += w @ y
            yield _behind(b, q, z * own[:, None])

        return meet(state.select("id", "q", "v", "s"), passing, work, "id long, q array<double>, v array<double>, s double", block)

    return _leading(held, times, k, n, rounds, seed, tolerance, degree)


def _behind(b: pa.RecordBatch, q: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
    """A batch of (id, q, ...) with ``z`` behind its vectors."""
    return b.set_column(1, "q", _lists(np.column_stack([q, z])))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _leading(held: DataFrame, times: Callable[[DataFrame, int], DataFrame], k: int, n: int, rounds: int, seed: int, tolerance: float, degree: int) -> DataFrame:
    """id, x: unit rows of the k leading eigenvectors of a symmetric matrix, by a block Lanczos method.

    ``times(state, m)`` puts the products of the last m vectors of ``q`` behind
    them.  Each product leaves a checkpoint and a small Gram matrix, from which
    the driver makes the new vectors orthogonal to all before and takes the Ritz
    values over all; beyond ``VECTORS`` vectors the leading half alone is kept.  It ends when the residuals of the k leading ones are below
    ``tolerance``; a warning says so if they are not after ``rounds`` rounds.  The
    start is a hash of the ids, so it doesn't depend on the partitions.
    """
    wide, hashed = _start(k, n, seed)
    state = cut_lineage(held.withColumn("q", hashed).drop("linked"))

    def grow(last: int) -> None:
        nonlocal state
        state = cut_lineage(times(state, last))

    def turn(by: np.ndarray) -> None:
        nonlocal state
        state = _turned(state, by)

    worst = _lanczos(lambda: _gram(state), grow, turn, k, wide, rounds * degree, tolerance)
    if worst is None:
        return state.select("id", F.array_repeat(F.lit(0.0), k).alias("x"))
    _warn(worst, tolerance, rounds)
    return state.select("id", unit("q").alias("x"))


def _start(k: int, n: int, seed: int) -> tuple[int, Column]:
    """The number of start vectors, and a row of them: a hash of its id, or zeros where it isn't linked."""
    wide = min(k + 8, n)  # more columns than asked for: the k leading ones converge faster
    hashed = F.array(*(F.xxhash64("id", F.lit(seed + c)) / F.lit(2.0**63) for c in range(wide)))
    return wide, F.when(F.col("linked"), hashed).otherwise(F.array_repeat(F.lit(0.0), wide))


def _warn(worst: float, tolerance: float, rounds: int) -> None:
    if worst >= tolerance:
        warnings.warn(f"the leading eigenvectors have a residual of {worst:.2g} after {rounds} rounds", stacklevel=4)


def _lanczos(gram_of: Callable[[], np.ndarray], grow: Callable[[int], None], turn_by: Callable[[np.ndarray], None], k: int, wide: int, steps: int, tolerance: float) -> float | None:
    """Turns the vectors, wherever they are, into the k leading ones; the largest residual (0 where nothing is left to go on from), or None if all start at zero.

    ``grow(m)`` puts the products of the last m vectors behind them, ``turn_by``
    multiplies them by a small matrix, and ``gram_of`` gives their Gram matrix.
    """
    most = max(VECTORS, 4 * wide)
    root = _roots(gram_of())
    if not root.shape[1]:
        return None
    turn_by(root)
    last, inner, worst = root.shape[1], np.zeros((0, 0)), np.inf
    for step in range(steps):
        grow(last)
        gram = gram_of()
        m = len(gram) - last
        met = gram[:m, m:]
        grown = np.zeros((m, m))
        grown[: m - last, : m - last] = inner
        grown[:, m - last :], grown[m - last :, :] = met, met.T
        inner = (grown + grown.T) / 2
        values, turn = np.linalg.eigh(inner)
        turn = turn[:, ::-1]
        along = np.linalg.solve(gram[:m, :m], met)
        rest = gram[m:, m:] - met.T @ along
        ends = turn[m - last :, :k]
        worst = float(np.sqrt(max(np.einsum("ac,ab,bc->c", ends, rest, ends).max(initial=0.0), 0.0)))
        fresh = _roots(rest, 1e-12)
        if worst < tolerance or not fresh.shape[1] or step == steps - 1:
            break
        kept = np.eye(m)
        if m + last > most:
            # A thick restart: the leading Ritz vectors stay, and the new vectors go on from them.
            kept, inner = turn[:, : most // 2], np.diag(values[::-1][: most // 2])
        turn_by(np.block([[kept, -along @ fresh], [np.zeros((last, kept.shape[1])), fresh]]))
        last = fresh.shape[1]
    by = np.zeros((len(gram), k))
    by[:m, : min(k, m)] = turn[:, :k]
    turn_by(by)
    return worst if fresh.shape[1] else 0.0


def _held_leading(held: DataFrame, k: int, n: int, rounds: int, seed: int, tolerance: float, degree: int) -> DataFrame:
    """:func:`_leading` over rows of (id, js, ws, linked) by one task, with the same vectors; its products run on the threads of its executor."""
    wide, hashed = _start(k, n, seed)
    threads = executor_cores(held.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).combine_chunks().sort_by("id").to_batches()[0]
        ids, q, js, w = table.column(0).to_numpy(), rows_of(table.column(1)), np.asarray(table.column(2).flatten(), np.int64), np.asarray(table.column(3).flatten(), np.float64)
        row = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(table.column(2))))
        del found, table
        to = np.minimum(np.searchsorted(ids, js), len(ids) - 1)
        met = ids[to] == js
        row, to, w = row[met], to[met], w[met]
        step = max(1, -(-len(ids) // (4 * threads)))
        stretches = [slice(at, min(at + step, len(ids))) for at in range(0, len(ids), step)]

        def product(of: slice, y: np.ndarray) -> np.ndarray:
            z, (low, high) = np.zeros((of.stop - of.start, y.shape[1])), np.searchsorted(row, [of.start, of.stop])
            if high > low:
                at = np.flatnonzero(np.diff(row[low:high], prepend=-1))
                z[row[low + at] - of.start] = np.add.reduceat(y[to[low:high]] * w[low:high, None], at, axis=0)
            return z

        with ThreadPool(threads) as pool:

            def grow(last: int) -> None:
                nonlocal q
                y = np.ascontiguousarray(q[:, -last:])
                q = np.hstack([q, np.concatenate(pool.map(lambda of: product(of, y), stretches))])

            def turn(by: np.ndarray) -> None:
                nonlocal q
                q = np.concatenate(pool.map(lambda of: q[of] @ by, stretches))

            def gram() -> np.ndarray:
                g = sum(pool.map(lambda of: q[of].T @ q[of], stretches))
                return (g + g.T) / 2

            worst = _lanczos(gram, grow, turn, k, wide, rounds * degree, tolerance)
        if worst is None:
            worst, q = 0.0, np.zeros((len(ids), k))
        for at in range(0, len(ids), 8192):
            part = ids[at : at + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(part), _lists(q[at : at + 8192]), pa.array(np.full(len(part), worst))], names=["id", "q", "worst"])

    out = cut_lineage(held.withColumn("q", hashed).select("id", "q", "js", "ws").coalesce(1).mapInArrow(run, "id long, q array<double>, worst double"))
    _warn(out.first().worst, tolerance, rounds)
    return out.select("id", unit("q").alias("x"))


def _gram(state: DataFrame) -> np.ndarray:
    """Q^T Q of a vector column, one small matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                q = rows_of(b.column(0))
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    parts = [np.frombuffer(r.g) for r in state.select("q").mapInArrow(run, "g binary").collect()]
    gram = np.sum(parts, axis=0).reshape(math.isqrt(len(parts[0])), -1)
    return (gram + gram.T) / 2


def _roots(gram: np.ndarray, floor: float = 1e-12) -> np.ndarray:
    """M with M^T G M = I over the directions of a Gram matrix that are longer than ``floor`` of the longest (and than ``floor``, squared)."""
    values, turn = np.linalg.eigh(gram)
    on = values > floor * max(values.max(initial=0.0), floor)
    return turn[:, on] / np.sqrt(values[on])


def _turned(state: DataFrame, by: np.ndarray) -> DataFrame:
    """``state`` with the vectors of ``q`` times a small matrix."""
    at = state.columns.index("q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.set_column(at, "q", _lists(rows_of(b.column(at)) @ by))

    return state.mapInArrow(run, state.schema)


def spectral_clustering(nodes: DataFrame, edges: DataFrame, k: int, redo: int = 10, seed: int = 42, driver_nodes: int = DRIVER_NODES) -> DataFrame:
    """id, cluster: k-means on the spectral embedding; fails on negative degrees."""
    checked_degrees(nodes, edges)
    return kmeans(cut_lineage(spectral_embedding(nodes, edges, k, driver_nodes=driver_nodes)), k, redo=redo, spherical=False, seed=seed)[0]


def dense_spectral_clustering(vectors: DataFrame, weigh: Callable[[np.ndarray], np.ndarray] | None, k: int, redo: int = 10, seed: int = 42) -> DataFrame:
    """id, cluster: k-means on the spectral embedding of the dense graph of (id, x), of which no edge is kept; fails on negative degrees."""
    return kmeans(cut_lineage(dense_embedding(vectors, weigh, k)), k, redo=redo, spherical=False, seed=seed)[0]


def discretised(embedding: np.ndarray, rounds: int = 100, seed: int = 0) -> np.ndarray:
    """Clusters of the rows of an n x k eigenvector matrix by turning it towards indicator vectors (Yu and Shi)."""
    x = embedding / np.maximum(np.linalg.norm(embedding, axis=1, keepdims=True), 1e-12)
    n, k = x.shape
    rng = np.random.default_rng(seed)
    turn = np.zeros((k, k))
    turn[:, 0] = x[rng.integers(n)]
    c = np.zeros(n)
    for j in range(1, k):
        c += np.abs(x @ turn[:, j - 1])
        turn[:, j] = x[c.argmin()]
    last = 0.0
    for _ in range(rounds):
        label = (x @ turn).argmax(axis=1)
        u, s, vt = np.linalg.svd(np.eye(k)[label].T @ x)
        if abs(s.sum() - last) < 1e-12:
            break
        last, turn = s.sum(), vt.T @ u.T
    return label


def discretised_rows(embedding: DataFrame, most: int = 32_000_000, seed: int = 0) -> DataFrame:
    """id, cluster of (id, x) by :func:`discretised`: the n x k matrix goes to the driver, so it is refused beyond ``most`` numbers."""
    n, k = embedding.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if n * k > most:
        raise ValueError(f"{n} rows of {k} numbers are too many to turn on the driver; use k-means on the embedding")
    rows = embedding.orderBy("id").toPandas()
    label = discretised(np.array(rows["x"].tolist()), seed=seed)
    return embedding.sparkSession.createDataFrame([(int(i), int(c)) for i, c in zip(rows["id"], label)], "id long, cluster int")


def default_k(labels: DataFrame, explicit: int | None = None) -> int:
    """The explicit number of clusters, else that of the distinct labels."""
    return explicit if explicit is not None else labels.select("label").where("label IS NOT NULL").distinct().count()
