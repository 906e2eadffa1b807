"""Clustering metrics.  External ones read (label, pred), internal ones (id, x unit rows, pred)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions.ordinal import cut_lineage
from vecloom.functions.vectors import dot, mean_vector, squared_distance, sum_vector
from vecloom.operators.blocks import BLOCK, BROADCAST_NUMBERS, Blocks, meet, pieces, source

EXTERNAL = ("nmi", "ari", "acc")
INTERNAL = ("sil", "dbi", "chi")


def contingency(rows: DataFrame) -> DataFrame:
    """label, pred, n."""
    return rows.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def nmi(rows: DataFrame) -> DataFrame:
    """One row: mutual information over the mean of the entropies; 1 if both are one cluster."""
    cells = contingency(rows)
    whole = cells.select("*", F.sum("n").over(Window.partitionBy()).alias("t"), F.sum("n").over(Window.partitionBy("label")).alias("a"), F.sum("n").over(Window.partitionBy("pred")).alias("b"))
    mi = whole.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))

    def entropy(column: str) -> DataFrame:
        sizes = cells.groupBy(column).agg(F.sum("n").alias("n")).select("n", F.sum("n").over(Window.partitionBy()).alias("t"))
        return sizes.agg((-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).alias(f"h_{column}"))

    # Each side is one row.
    one = mi.crossJoin(entropy("label")).crossJoin(entropy("pred"))
    both = F.col("h_label") + F.col("h_pred")
    return one.select(F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(2 * F.col("mi") / both, F.lit(0.0))).alias("nmi"))


def ari(rows: DataFrame) -> DataFrame:
    """One row: the adjusted Rand index; 1 if nothing is left to adjust."""
    cells = contingency(rows)
    pairs = lambda c: c * (c - 1) / 2
    both = cells.agg(F.sum(pairs(F.col("n"))).alias("s"), F.sum("n").alias("t"))
    a = cells.groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("a"))
    b = cells.groupBy("pred").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("b"))
    expected, most = F.col("a") * F.col("b") / pairs(F.col("t")), (F.col("a") + F.col("b")) / 2
    return both.crossJoin(a).crossJoin(b).select(F.when(most == expected, F.lit(1.0)).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def hungarian(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of least cost; rows <= columns (shortest augmenting paths)."""
    n, m = cost.shape
    u, v, of, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        of[0], j = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            free = ~used[1:]
            reach = cost[of[j] - 1] - u[of[j]] - v[1:]
            better = free & (reach < least[1:])
            least[1:][better], way[1:][better] = reach[better], j
            after = 1 + int(np.where(free, least[1:], np.inf).argmin())
            delta = least[after]
            u[of[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j = after
            if of[j] == 0:
                break
        while j:
            of[j], j = of[way[j]], way[j]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if of[j]:
            out[of[j] - 1] = j - 1
    return out


def matching(rows: DataFrame, most_cells: int = 4_000_000) -> dict[int, int]:
    """label of each matched pred under the one-to-one matching of most rows; the contingency table reaches the driver if it is small."""
    cells = cut_lineage(contingency(rows))  # read three times
    labels, preds = ([r[0] for r in cells.select(c).distinct().orderBy(c).collect()] for c in ("label", "pred"))
    if len(labels) * len(preds) > most_cells:
        raise ValueError("too many labels and clusters for a matching")
    table = np.zeros((len(preds), len(labels)))
    for r in cells.collect():
        table[preds.index(r.pred), labels.index(r.label)] = r.n
    if len(preds) <= len(labels):
        return {preds[i]: labels[j] for i, j in enumerate(hungarian(table.max(initial=0) - table))}
    return {preds[j]: labels[i] for i, j in enumerate(hungarian((table.max(initial=0) - table).T))}


def acc(rows: DataFrame) -> DataFrame:
    """One row: the share of rows that the best one-to-one matching covers."""
    matched = matching(rows)
    pairs = rows.sparkSession.createDataFrame(sorted(matched.items()), "pred long, label long") if matched else None
    n = rows.count()
    hit = contingency(rows).join(F.broadcast(pairs), ["pred", "label"]).agg(F.sum("n")).first()[0] if pairs is not None else 0
    return rows.sparkSession.createDataFrame([(float(hit or 0) / n if n else 0.0,)], "acc double")


def evaluate(rows: DataFrame, names: tuple[str, ...] = EXTERNAL) -> DataFrame:
    """metric, value for each external metric by name."""
    known = {"nmi": nmi, "ari": ari, "acc": acc}
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown metric {unknown[0]!r}")
    parts = [known[n](rows).select(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def valid_clusters(rows: DataFrame) -> int:
    """The number of clusters; fails unless 2 <= clusters < rows."""
    n, k = rows.agg(F.count(F.lit(1)), F.count_distinct("pred")).first()
    if not 2 <= k < n:
        raise ValueError(f"internal metrics need 2 <= clusters < rows, got {k} clusters and {n} rows")
    return k


def _clusters(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pred").agg(mean_vector("x").alias("c"), sum_vector("x").alias("s"), F.count(F.lit(1)).alias("m"))


def _euclidean_sums(rows: DataFrame, block: int = BLOCK, broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """id, pred, other, t, m: the sum of the distances of each row to the rows of each cluster, and their number.

    Rows meet the table in passing blocks and keep a number a cluster.  The work
    is the square of the rows by its meaning.
    """
    sizes = rows.groupBy("pred").agg(F.count(F.lit(1)).alias("m")).collect()  # a row a cluster
    kind, k = rows.schema["pred"].dataType.simpleString(), len(sizes)
    codes = rows.sparkSession.createDataFrame([(r.pred, code, r.m) for code, r in enumerate(sizes)], f"other {kind}, code long, m long")
    coded = rows.join(F.broadcast(codes) if k <= 100_000 else codes, F.col("pred").eqNullSafe(F.col("other")))
    passing = source(coded.select(F.col("code").alias("id"), "x"), block, broadcast_numbers)

    def work(found: pa.RecordBatch, _: np.ndarray, x: np.ndarray, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        sums, size = np.zeros((len(x), k)), (x * x).sum(axis=1)
        for at_y, y in blocks():
            # Rows of one cluster stand together, so their distances are added up by stretches.
            order = np.argsort(at_y, kind="stable")
            at_y, y = at_y[order], y[order]
            here, start = np.unique(at_y, return_index=True)
            size_y = (y * y).sum(axis=1)
            for at in pieces(len(x), len(y)):
                d = x[at] @ y.T
                d *= -2
                d += size[at][:, None]
                d += size_y[None]
                np.maximum(d, 0, out=d)
                np.sqrt(d, out=d)
                # A row's distance to itself is nothing, whatever rounding leaves.
                d[d < 1e-7] = 0
                sums[at, here] += np.add.reduceat(d, start, axis=1)
        yield pa.RecordBatch.from_arrays([found.column(0), found.column(2), pa.array(sums.tolist(), pa.list_(pa.float64()))], names=["id", "pred", "t"])

    met = meet(rows.select("id", "x", "pred"), passing, work, f"id {rows.schema['id'].dataType.simpleString()}, pred {kind}, t array<double>", block)
    each = met.select("id", "pred", F.posexplode("t").alias("code", "t"))
    return each.join(F.broadcast(codes) if k <= 100_000 else codes, "code").select("id", "pred", "other", "t", "m")


def silhouette(rows: DataFrame, metric: str = "cosine", sample: int | None = None, seed: int = 42, broadcast_rows: int = 100_000) -> DataFrame:
    """One row: the mean silhouette of unit rows.

    Cosine distances to a cluster follow from the sum of its unit vectors, so a
    row meets k sums and no other row.  The Euclidean form meets all rows in
    blocks, in which only sums by cluster are kept.  All rows count, unless a
    ``sample`` is asked for: the rows of the smallest hashes of their ids.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown silhouette metric {metric!r}")
    n = rows.count()
    if sample is not None and n > sample:
        rows = rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "id")), "id").limit(sample)
    if metric == "cosine":
        sums = rows.groupBy("pred").agg(sum_vector("x").alias("s"), F.count(F.lit(1)).alias("m")).select(F.col("pred").alias("other"), "s", "m")
        k = sums.count()
        side = F.broadcast(sums) if k <= broadcast_rows else sums
        far = rows.crossJoin(side).select("id", "pred", "other", "m", (F.col("m") - dot("x", "s")).alias("t"))  # k rows for each row
    else:
        far = _euclidean_sums(rows)
    own = F.max(F.when(F.col("pred") == F.col("other"), F.when(F.col("m") > 1, F.col("t") / (F.col("m") - 1)).otherwise(F.lit(-1.0))))
    near = F.min(F.when(F.col("pred") != F.col("other"), F.col("t") / F.col("m")))
    each = far.groupBy("id").agg(own.alias("a"), near.alias("b"))
    value = F.when((F.col("a") < 0) | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.avg(value).alias("sil"))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    """One row: the mean over clusters of the worst ratio of scatters to centre distance."""
    centres = _clusters(rows).select("pred", "c")
    scatter = rows.join(centres, "pred").groupBy("pred").agg(F.avg(F.sqrt(squared_distance("x", "c"))).alias("s")).join(centres, "pred")
    a, b = scatter.select(F.col("pred").alias("p"), F.col("s").alias("sp"), F.col("c").alias("cp")), scatter.select(F.col("pred").alias("q"), F.col("s").alias("sq"), F.col("c").alias("cq"))
    gap = F.sqrt(squared_distance("cp", "cq"))
    ratio = a.join(b, F.col("p") != F.col("q")).groupBy("p").agg(F.max(F.when(gap == 0, F.lit(0.0)).otherwise((F.col("sp") + F.col("sq")) / gap)).alias("r"))
    return ratio.agg(F.avg("r").alias("dbi"))


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    """One row: scatter between clusters over scatter within, each by its degrees of freedom."""
    centres = _clusters(rows).select("pred", "c", "m")
    middle = rows.agg(mean_vector("x").alias("g"), F.count(F.lit(1)).alias("n"))
    between = centres.crossJoin(middle).agg(F.sum(F.col("m") * squared_distance("c", "g")).alias("b"), F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    within = rows.join(centres, "pred").agg(F.sum(squared_distance("x", "c")).alias("w"))
    return between.crossJoin(within).select(F.when(F.col("w") == 0, F.lit(1.0)).otherwise(F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1))).alias("chi"))


def evaluate_internal(rows: DataFrame, names: tuple[str, ...] = INTERNAL, metric: str = "cosine", sample: int | None = 5000) -> DataFrame:
    """metric, value for each internal metric by name."""
    if sample is not None and sample < 2:
        raise ValueError("a silhouette sample has two rows or more")
    valid_clusters(rows)
    known = {"sil": lambda r: silhouette(r, metric, sample), "dbi": davies_bouldin, "chi": calinski_harabasz}
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown metric {unknown[0]!r}")
    out = None
    for n in names:
        part = known[n](rows).select(F.lit(n).alias("metric"), F.col(n).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def by_head(rows: DataFrame) -> DataFrame:
    """head, nmi, ari for each head of (head, label, pred)."""
    cells = rows.groupBy("head", "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    h = lambda *c: Window.partitionBy("head", *c)
    w = cells.select("*", F.sum("n").over(h()).alias("t"), F.sum("n").over(h("label")).alias("a"), F.sum("n").over(h("pred")).alias("b"))
    pairs = lambda c: c * (c - 1) / 2
    # A margin occurs once for each of its cells; weighing by n / margin counts it once.
    out = w.groupBy("head").agg(
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"),
        (-F.sum(F.col("n") / F.col("t") * F.log(F.col("a") / F.col("t")))).alias("hl"),
        (-F.sum(F.col("n") / F.col("t") * F.log(F.col("b") / F.col("t")))).alias("hp"),
        F.sum(pairs(F.col("n"))).alias("s"),
        F.sum(F.col("n") * (F.col("a") - 1) / 2).alias("pa"),
        F.sum(F.col("n") * (F.col("b") - 1) / 2).alias("pb"),
        F.first("t").alias("t"),
    )
    expected, most = F.col("pa") * F.col("pb") / pairs(F.col("t")), (F.col("pa") + F.col("pb")) / 2
    return out.select(
        "head",
        F.when(F.col("hl") + F.col("hp") == 0, F.lit(1.0)).otherwise(F.greatest(2 * F.col("mi") / (F.col("hl") + F.col("hp")), F.lit(0.0))).alias("nmi"),
        F.when(most == expected, F.lit(1.0)).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"),
    )


def leaderboard(scores: DataFrame) -> DataFrame:
    """name, value, place: ranks on values rounded to four places; ties share a rank, missing values have none."""
    shown = scores.withColumn("value", F.round("value", 4))
    ranks = shown.where("value IS NOT NULL").withColumn("place", F.rank().over(Window.orderBy(F.col("value").desc())))
    return ranks.unionByName(shown.where("value IS NULL").withColumn("place", F.lit(None).cast("int")))


def histogram_ema(history: list[float], counts: list[int], momentum: float) -> list[float]:
    """A histogram's moving average after one batch, rescaled to sum 1."""
    batch = np.array(counts, float) / max(sum(counts), 1.0)
    out = np.array(history, float) * momentum + batch * (1 - momentum)
    return (out / max(out.sum(), 1e-8)).tolist()
