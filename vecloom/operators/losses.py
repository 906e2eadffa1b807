"""Training objectives over soft assignments, and linear heads fitted by hand-written gradients.

Rows hold two probability vectors, ``a`` (image side) and ``b`` (text side or
neighbour).  All sums over rows are JVM aggregates of fixed size (2k x 2k at
most); what is left is arithmetic on one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.vectors import dot, mean_vector, sum_vector
from vecloom.operators.blocks import BLOCK, BROADCAST_NUMBERS, Blocks, meet, pieces, source


def gram(rows: DataFrame, x: Column, width: int) -> np.ndarray:
    """X^T X of a vector column, summed in the JVM."""
    cells = F.flatten(F.transform(x, lambda p: F.transform(x, lambda q: p * q)))
    got = rows.agg(sum_vector(cells).alias("g")).first().g
    return np.array(got, float).reshape(width, width)


def entropy(p: np.ndarray, floor: float) -> float:
    p = np.maximum(p, floor)
    return float(-(p * np.log(p)).sum())


def means(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean of a, mean of b, mean of -ln <a, b> (logarithms floored at -100)."""
    agreement = -F.greatest(F.log(dot("a", "b")), F.lit(-100.0))
    r = rows.agg(mean_vector("a").alias("a"), mean_vector("b").alias("b"), F.avg(F.coalesce(agreement, F.lit(100.0))).alias("c")).first()
    return np.array(r.a), np.array(r.b), float(r.c)


def column_contrast(g: np.ndarray, temperature: float) -> float:
    """Contrast of 2k columns given their Gram matrix: each column's partner against all other columns."""
    n, k = len(g), len(g) // 2
    length = np.maximum(np.sqrt(np.diag(g)), 1e-12)
    s = g / np.outer(length, length) / temperature
    partner = (np.arange(n) + k) % n
    np.fill_diagonal(s, -np.inf)
    top = s.max(axis=1)
    lse = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
    return float((lse - s[np.arange(n), partner]).mean())


def tac_loss(rows: DataFrame, k: int, temperature: float = 0.5, entropy_weight: float = 5.0) -> dict[str, float]:
    """distill, consistency, entropy (of both sides), total = distill + consistency - weight * entropy."""
    a, b, consistency = means(rows)
    distill = column_contrast(gram(rows, F.concat("a", "b"), 2 * k), temperature)
    h = entropy(a, 1e-9) + entropy(b, 1e-9)
    return {"distill": distill, "consistency": consistency, "entropy": h, "total": distill + consistency - entropy_weight * h}


def alignment_loss(rows: DataFrame, beta: float = 0.5) -> dict[str, float]:
    """instance, cluster, total = beta * instance + (1 - beta) * cluster; the cluster part is a logistic loss of column products."""
    _, _, instance = means(rows)
    columns = np.array(rows.agg(sum_vector(F.zip_with("a", "b", lambda x, y: x * y)).alias("s")).first().s)
    cluster = float(np.log1p(np.exp(-columns)).mean())
    return {"instance": instance, "cluster": cluster, "total": beta * instance + (1 - beta) * cluster}


def column_cross_entropy(rows: DataFrame, k: int) -> float:
    """Mean over clusters of the cross-entropy between the two sides' columns, each scaled to sum 1."""
    r = rows.agg(sum_vector("a").alias("a"), sum_vector("b").alias("b")).first()
    a, b = np.maximum(np.array(r.a), 1e-8), np.maximum(np.array(r.b), 1e-8)
    # -sum_i (a_ik / A_k) ln max(b_ik / B_k, 1e-8)
    logs = F.transform("b", lambda v, c: F.log(F.greatest(v / F.array(*map(F.lit, b.tolist()))[c], F.lit(1e-8))))
    s = np.array(rows.agg(sum_vector(F.zip_with("a", logs, lambda x, y: x * y)).alias("s")).first().s)
    return float((-s / a).mean())


def scan_loss(rows: DataFrame, entropy_weight: float = 2.0) -> dict[str, float]:
    """consistency, entropy (of side a), total = consistency - weight * entropy."""
    a, _, consistency = means(rows)
    h = entropy(a, 1e-8)
    return {"consistency": consistency, "entropy": h, "total": consistency - entropy_weight * h}


def beta_mi(rows: DataFrame, prior: list[float], beta: float = 0.6) -> DataFrame:
    """id, loss = -ln of the sum of (a b)^beta / prior."""
    weights = F.array(*map(F.lit, prior))
    terms = F.zip_with(F.zip_with("a", "b", lambda x, y: F.pow(x * y, F.lit(beta))), weights, lambda x, w: x / w)
    return rows.select("id", (-F.log(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))).alias("loss"))


def balance_loss(rows: DataFrame, history: list[float], floor: float = 1e-4, most: float = 5.0) -> float:
    """Negative entropies of both sides, weighed by how rarely a cluster was used."""
    r = rows.agg(mean_vector("a").alias("a"), mean_vector("b").alias("b")).first()
    h = np.maximum(np.array(history, float), max(floor, 1e-8))
    h /= h.sum()
    w = np.minimum(1 / len(h) / h, most)
    w /= max(w.mean(), 1e-8)
    a, b = np.maximum(np.array(r.a), 1e-8), np.maximum(np.array(r.b), 1e-8)
    return float((w * a * np.log(a)).sum() + (w * b * np.log(b)).sum())


def assignment_contrast(rows: DataFrame, k: int, temperature: float = 0.5) -> float:
    """Contrast of image columns with text columns, both ways."""
    g = gram(rows, F.concat("a", "b"), 2 * k)
    length = np.maximum(np.sqrt(np.diag(g)), 1e-12)
    s = (g / np.outer(length, length))[:k, k:] / max(temperature, 1e-6)
    ce = lambda m: float(np.mean(np.log(np.exp(m - m.max(axis=1, keepdims=True)).sum(axis=1)) + m.max(axis=1) - np.diag(m)))
    return (ce(s) + ce(s.T)) / 2


def coding_rate(rows: DataFrame, width: int, eps: float = 0.01) -> float:
    """Half the log-determinant of I + width / (n eps) Z^T Z over unit rows (id, x)."""
    n = rows.count()
    g = gram(rows, F.col("x"), width)
    return float(np.linalg.slogdet(np.eye(width) + width / (n * eps) * g)[1] / 2)


def compressed_rate(rows: DataFrame, width: int, eps: float = 0.01) -> float:
    """The coding rate of the clusters of (id, x, cluster), by their share of the rows."""
    cells = F.flatten(F.transform("x", lambda p: F.transform("x", lambda q: p * q)))
    groups = rows.groupBy("cluster").agg(sum_vector(cells).alias("g"), F.count(F.lit(1)).alias("m")).collect()  # a row a cluster
    n = sum(r.m for r in groups)
    return float(sum((r.m + 1e-8) * np.linalg.slogdet(np.eye(width) + width / ((r.m + 1e-8) * eps) * np.array(r.g).reshape(width, width))[1] / (2 * n) for r in groups))


def predicted(rows: DataFrame, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """id, cluster: the largest logit of a linear head for each row; ties go to the smaller cluster."""
    from vecloom.operators.clustering import assigned

    # An inner product with a one appended is the affine map.
    wide = rows.select("id", F.concat("x", F.array(F.lit(1.0))).alias("x"))
    return assigned(wide, np.column_stack([w, b]), spherical=True).select("id", "cluster")


def probabilities(rows: DataFrame, w: np.ndarray, b: np.ndarray) -> DataFrame:
    """id, pred, confidence: the most probable cluster of each row under a linear head."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten(), float).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, w.shape[1]))
            p = np.round(_softmax(x @ w.T + b), 10) if len(x) else np.zeros((0, len(b)))
            at = p.argmax(axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(p[np.arange(len(at)), at])], names=["id", "pred", "confidence"])

    return rows.select("id", "x").mapInArrow(run, "id long, pred int, confidence double")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def linear_head(centres: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a head whose logits rank the centres by distance."""
    return 2 * alpha * centres, -alpha * (centres**2).sum(axis=1)


def fit_scan_head(pairs: DataFrame, start: tuple[np.ndarray, np.ndarray], rounds: int = 50, rate: float = 0.5, entropy_weight: float = 2.0) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Gradient descent of the neighbour-consistency loss over pairs (x, y) of row and neighbour vectors.

    A round is two passes over Arrow batches: the first sums the means that the
    entropy needs, the second the gradients under them; both bring k by d numbers
    a partition at most.  Returns weights, bias and the loss by round; the last
    loss, one more than there are rounds, is that of the weights returned.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    w, b = (np.array(p, float) for p in start)
    pairs = pairs.select("x", "y").persist()
    spark, n, losses = pairs.sparkSession, pairs.count(), []

    def summed(slope: np.ndarray | None) -> np.ndarray:
        shared = spark.sparkContext.broadcast((w, b, slope))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, b, slope = shared.value
            for batch in batches:
                x, y = (np.asarray(batch.column(c).flatten(), float).reshape(batch.num_rows, -1) for c in (0, 1))
                p, q = _softmax(x @ w.T + b), _softmax(y @ w.T + b)
                agree = np.maximum((p * q).sum(axis=1, keepdims=True), 1e-12)
                if slope is None:
                    out = [p.sum(axis=0), [-np.log(agree).sum()]]
                else:
                    dp, dq = slope - q / agree, -p / agree
                    ep, eq = p * (dp - (p * dp).sum(axis=1, keepdims=True)), q * (dq - (q * dq).sum(axis=1, keepdims=True))
                    out = [(ep.T @ x + eq.T @ y).ravel(), (ep + eq).sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(out).tolist()], pa.list_(pa.float64()))], names=["v"])

        return np.array(pairs.mapInArrow(run, "v array<double>").agg(sum_vector("v").alias("v")).first().v)

    for r in range(rounds + 1):
        got = summed(None)
        mean = np.maximum(got[:-1] / n, 1e-8)
        losses.append(float(got[-1] / n - entropy_weight * entropy(got[:-1] / n, 1e-9)))
        if r == rounds:
            break
        step = summed(entropy_weight * (np.log(mean) + 1)) / n
        w, b = w - rate * step[: w.size].reshape(w.shape), b - rate * step[w.size :]
    pairs.unpersist()
    return w, b, losses


def _contrast_slope(g: np.ndarray, temperature: float) -> np.ndarray:
    """The derivative of :func:`column_contrast` by the Gram matrix."""
    n, k = len(g), len(g) // 2
    length = np.maximum(np.sqrt(np.diag(g)), 1e-12)
    s = g / np.outer(length, length) / temperature
    p = np.exp(s - s.max())
    np.fill_diagonal(p, 0)
    slope = p / p.sum(axis=1, keepdims=True)
    slope[np.arange(n), (np.arange(n) + k) % n] -= 1
    slope /= n
    out = slope / np.outer(length, length) / temperature
    out[np.arange(n), np.arange(n)] = -0.5 * ((slope + slope.T) * s).sum(axis=1) / length**2
    return out


def fit_two_heads(
    rows: DataFrame, k: int, rounds: int = 30, rate: float = 1.0, temperature: float = 0.5, entropy_weight: float = 5.0, start: tuple[np.ndarray, ...] | None = None, seed: int = 42, beta: float | None = None
) -> tuple[tuple[np.ndarray, ...], list[float]]:
    """Two linear heads under :func:`tac_loss`, one for x and one for the text side y of (id, x, y); under :func:`alignment_loss` if ``beta`` is given.

    Gradient descent on all rows.  A round is two passes over Arrow batches: the
    first sums the Gram matrix of all columns and the means, the second the
    gradients under them; both bring arrays of a fixed size to the driver.
    Returns (weights and bias of x, weights and bias of y) and the loss by round.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    rows = rows.select("x", "y").persist()
    n, dx, dy = rows.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(F.size("y"))).first()
    if start is None:
        rng = np.random.default_rng(seed)
        start = (rng.normal(0, 1, (k, dx)), np.zeros(k), rng.normal(0, 1, (k, dy)), np.zeros(k))
    heads, found, spark = [np.array(h, float) for h in start], [], rows.sparkSession

    def summed(kind: str, extra: tuple = ()) -> np.ndarray:
        shared = spark.sparkContext.broadcast((heads, extra))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (w, b, v, c), extra = shared.value
            for batch in batches:
                x, y = (np.asarray(batch.column(i).flatten(), float).reshape(batch.num_rows, -1) for i in (0, 1))
                p, q = _softmax(x @ w.T + b), _softmax(y @ v.T + c)
                agree = np.maximum((p * q).sum(axis=1, keepdims=True), 1e-12)
                z = np.concatenate([p, q], axis=1)
                if kind == "sums":
                    out = [(z.T @ z).ravel(), z.sum(axis=0), [-np.log(agree).sum()]]
                else:
                    slope, by_mean, instance = extra
                    dz = instance * np.concatenate([-q / agree, -p / agree], axis=1) / n + z @ (slope + slope.T) + by_mean / n
                    dp, dq = dz[:, : len(b)], dz[:, len(b) :]
                    ep, eq = p * (dp - (p * dp).sum(axis=1, keepdims=True)), q * (dq - (q * dq).sum(axis=1, keepdims=True))
                    out = [(ep.T @ x).ravel(), ep.sum(axis=0), (eq.T @ y).ravel(), eq.sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(out).tolist()], pa.list_(pa.float64()))], names=["v"])

        return np.array(rows.mapInArrow(run, "v array<double>").agg(sum_vector("v").alias("v")).first().v)

    for _ in range(rounds):
        got = summed("sums")
        g, mean, consistency = got[: 4 * k * k].reshape(2 * k, 2 * k), np.maximum(got[4 * k * k : -1] / n, 1e-9), got[-1] / n
        if beta is None:
            found.append(float(column_contrast(g, temperature) + consistency - entropy_weight * -(mean * np.log(mean)).sum()))
            step = summed("steps", (_contrast_slope(g, temperature), entropy_weight * (np.log(mean) + 1), 1.0))
        else:
            # The products of the columns of one cluster stand in the Gram matrix.
            columns, slope = np.diag(g[:k, k:]), np.zeros((2 * k, 2 * k))
            found.append(float(beta * consistency + (1 - beta) * np.log1p(np.exp(-columns)).mean()))
            slope[np.arange(k), k + np.arange(k)] = -(1 - beta) / k / (1 + np.exp(np.minimum(columns, 700)))
            step = summed("steps", (slope, np.zeros(2 * k), beta))
        at = 0
        for i, h in enumerate(heads):
            heads[i] = h - rate * step[at : at + h.size].reshape(h.shape)
            at += h.size
    rows.unpersist()
    return tuple(heads), found


def fit_taught_head(
    pairs: DataFrame, start: tuple[np.ndarray, np.ndarray], rounds: int = 30, rate: float = 0.5, beta: float = 0.6, keep: float = 0.9, sharpen: float = 0.5
) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """A student head under :func:`beta_mi` against its teacher, over pairs (x, y) of row and neighbour vectors.

    The student sees x and the teacher y; the teacher's logits are divided by
    ``sharpen``, and its parameters and the prior of its clusters are moving
    averages that keep ``keep`` of themselves a round.  A round is one pass over
    Arrow batches that brings arrays of a fixed size to the driver.  Returns the
    teacher's weights and bias and the loss by round; the last loss, one more
    than there are rounds, is that of the parameters returned.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    pairs = pairs.select("x", "y").persist()
    spark, n, found = pairs.sparkSession, pairs.count(), []
    w, b = (np.array(p, float) for p in start)
    v, c, prior = w.copy(), b.copy(), np.full(len(b), 1 / len(b))
    for r in range(rounds + 1):
        shared = spark.sparkContext.broadcast((w, b, v, c, prior))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            w, b, v, c, prior = shared.value
            for batch in batches:
                x, y = (np.asarray(batch.column(i).flatten(), float).reshape(batch.num_rows, -1) for i in (0, 1))
                p, q = np.maximum(_softmax(x @ w.T + b), 1e-8), _softmax((y @ v.T + c) / sharpen)
                terms = (p * q) ** beta / prior
                total = np.maximum(terms.sum(axis=1, keepdims=True), 1e-12)
                # p times the slope by p is -beta times each term's share.
                part = -beta * terms / total
                e = part - p * part.sum(axis=1, keepdims=True)
                out = np.concatenate([(e.T @ x).ravel(), e.sum(axis=0), q.sum(axis=0), [-np.log(total).sum()]])
                yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["v"])

        got = np.array(pairs.mapInArrow(sums, "v array<double>").agg(sum_vector("v").alias("v")).first().v) / n
        found.append(float(got[-1]))
        if r == rounds:
            break
        w, b = w - rate * got[: w.size].reshape(w.shape), b - rate * got[w.size : w.size + b.size]
        v, c = keep * v + (1 - keep) * w, keep * c + (1 - keep) * b
        prior = np.maximum(keep * prior + (1 - keep) * got[w.size + b.size : -1], 1e-8)
    pairs.unpersist()
    return v, c, found


def fit_labelled_head(
    rows: DataFrame, start: tuple[np.ndarray, np.ndarray], rounds: int = 30, rate: float = 1.0, decay: float = 1e-4, negatives: DataFrame | None = None, negative_weight: float = 1.0
) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """A linear head by cross-entropy over (x, cluster), classes weighed by their rarity; a round is one pass.

    ``negatives`` are (x, cluster) that are known not to belong together: each
    adds -ln(1 - p) of its cluster, all of them ``negative_weight`` together.

    Returns weights, bias and the loss by round.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    rows = rows.select("x", "cluster", F.lit(True).alias("yes"))
    against = negatives.count() if negatives is not None else 0
    if against:
        rows = rows.unionByName(negatives.select("x", "cluster", F.lit(False).alias("yes")))
    rows = rows.persist()
    w, b = (np.array(p, float) for p in start)
    counts = {r.cluster: r["count"] for r in rows.where("yes").groupBy("cluster").count().collect()}  # a row a cluster
    weight = np.array([1 / counts[c] if counts.get(c) else 0.0 for c in range(len(b))]) / max(len(counts), 1)
    spark, found = rows.sparkSession, []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((w, b))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            w, b = shared.value
            for batch in batches:
                x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, -1)
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(int)
                yes = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                p, at = _softmax(x @ w.T + b), np.arange(len(y))
                mine = p[at, y]
                other = np.maximum(1 - mine, 1e-6)
                own = np.where(yes, weight[y], negative_weight / max(against, 1) * mine / other)[:, None]
                loss = -(np.where(yes, weight[y], 0) * np.log(np.maximum(mine, 1e-12))).sum() - negative_weight / max(against, 1) * np.log(other[~yes]).sum()
                p[at, y] -= 1
                p[~yes] *= -1  # away from the cluster
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([((own * p).T @ x).ravel(), (own * p).sum(axis=0), [loss]]).tolist()], pa.list_(pa.float64()))], names=["v"])

        row = rows.mapInArrow(sums, "v array<double>").agg(sum_vector("v").alias("v")).first()
        if row.v is None or not len(row.v):
            break
        got = np.array(row.v)
        found.append(float(got[-1]))
        w = w - rate * (got[: w.size].reshape(w.shape) + decay * w)
        b = b - rate * got[w.size : -1]
    rows.unpersist()
    return w, b, found


def contrast_by_batch(pairs: DataFrame, buckets: int, temperature: float, block: int = BLOCK, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """bucket, part, value: the contrast of each side of (id, a, b) with all sides of its mini-batch (the remainder of the id), plain and weighed by the sigmoid of its own pair.

    Rows meet the others in passing blocks and keep a running sum of exponents, so
    a mini-batch may be of any size.
    """
    own = (dot("a", "b") / temperature).alias("own")
    bucket = F.pmod("id", F.lit(buckets)).cast("int").alias("bucket")
    sides = pairs.select("id", F.explode(F.array("a", "b")).alias("x"), bucket, own)
    passing = source(sides.select("id", F.concat("x", F.array(F.col("bucket").cast("double"))).alias("x")), block, broadcast_numbers)

    def work(b: pa.RecordBatch, ids: np.ndarray, q: np.ndarray, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        of = b.column(2).to_numpy()
        top, total = np.full(len(q), -np.inf), np.zeros(len(q))
        for _, x in blocks():
            for k in np.intersect1d(of, x[:, -1].astype(int)).tolist():
                rows, y = np.flatnonzero(of == k), x[x[:, -1] == k, :-1]
                for at in pieces(len(rows), len(y)):
                    r = rows[at]
                    s = q[r] @ y.T / temperature
                    high = np.maximum(top[r], s.max(axis=1))
                    total[r] = total[r] * np.exp(top[r] - high) + np.exp(s - high[:, None]).sum(axis=1)
                    top[r] = high
        yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(top + np.log(total))], names=["bucket", "own", "all"])

    met = meet(sides, passing, work, "bucket int, own double, all double", block)
    met = met.select("bucket", (F.col("all") - F.col("own")).alias("loss"), (1 / (1 + F.exp(-F.col("own")))).alias("w"))
    found = met.groupBy("bucket").agg(F.avg("loss").alias("plain"), (F.sum(F.col("w") * F.col("loss")) / F.sum("w")).alias("weighed"))
    return found.select("bucket", F.explode(F.array(*(F.struct(F.lit(n).alias("part"), F.col(n).alias("value")) for n in ("plain", "weighed")))).alias("v")).select("bucket", "v.*")
