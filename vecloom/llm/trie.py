"""Prefix trie of conversations, as a Patricia tree.

A conversation is the sequence of its turns' digests.  Distinct sequences are
sorted and dealt to parts by ranges.  Of each part, adjacent common prefixes give
the points alone (branches, ends, leaves) with compressed edges between them;
aggregates are computed on these, and unary nodes are read off each edge by
suffix sums of the words along it.

Nodes that reach over the bound of two parts (seams) are prefixes of the bound
itself.  Each part makes them points of their own and says what lies below them
within the part; the sums over parts are a small tree, compressed and expanded
by the same rule: chains of unary seams are summed, the tree of chains (PARTS
times four at most) is added up on the driver, and suffix sums along each chain
give the seams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import LEAST_TASKS, pick, stored

#: Bytes of a turn's digest.
TURN = 16
#: Distinct sequences of a part on average, and parts at most (beyond that parts grow).
PATHS = 2000
PARTS = 20_000
#: Conversations whose ids are joined at once.
IDS = 65_536

NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Stands for a null id, which comes after all others.
LAST = 1 << 63
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SEAM = "key binary, parent binary, depth long, n long, conv long, kids long, leaves long, saved long, words long, ends string"


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turns for each conversation: its turns in order, as (digest, words).

    Turns are ordered by number, null first, those of one number by their digest.
    A null role or text counts as empty.  Rows of a null conversation are one
    conversation of null id.  The digest is of role and text; texts themselves
    are not gathered, and a conversation is one row of 40 bytes a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = pick(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).select(
        F.col("conv").cast("long").alias("conv"),
        F.struct(
            F.col("turn").isNotNull().alias("numbered"),
            "turn",
            F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN).alias("digest"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words"),
        ).alias("t"),
    )
    return rows.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from their start."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


def prefix_keys(path: bytes, depth: int) -> list[bytes]:
    """A key of each prefix of 0 to ``depth`` turns."""
    h = hashlib.sha256()
    keys = [h.digest()[:TURN]]
    for d in range(depth):
        h.update(path[d * TURN : (d + 1) * TURN])
        keys.append(h.digest()[:TURN])
    return keys


class Patricia:
    """The compressed tree of sorted distinct paths.

    Depths to ``a`` on the first path and to ``b`` on the last are seams: points
    of their own whose members may go on in other parts.  The root always is one.
    """

    def __init__(self, paths: list[bytes], words: list[list[int]], n: list[int], conv: list[int], a: int, b: int):
        self.paths, self.words, self.a = paths, words, a
        shared = [0, *(common(p, q) for p, q in zip(paths, paths[1:]))]
        forced: dict[int, set[int]] = {0: set(range(a + 1))}
        at = len(paths) - 1
        for d in range(b, -1, -1):
            while at > 0 and shared[at] >= d:
                at -= 1
            forced.setdefault(at, set()).add(d)
        self.depth: list[int] = []
        self.low: list[int] = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.seam: list[bool] = []
        stack: list[int] = []
        for i, path in enumerate(paths):
            while stack and self.depth[stack[-1]] > shared[i]:
                last = stack.pop()
                if self.depth[stack[-1]] < shared[i]:
                    # The path before runs past the place where this one leaves it: a branch within its edge.
                    stack.append(self._point(shared[i], self.low[last], stack[-1], -1, False))
                    self.parent[last] = stack[-1]
            long, own = len(path) // TURN, forced.get(i, set())
            for d in sorted({d for d in own if i == 0 or d > shared[i]} | {long}):
                stack.append(self._point(d, i, stack[-1] if stack else -1, i if d == long else -1, d in own))
        self._sum(n, conv)

    def _point(self, depth: int, low: int, parent: int, end: int, seam: bool) -> int:
        self.depth.append(depth)
        self.low.append(low)
        self.parent.append(parent)
        self.end.append(end)
        self.seam.append(seam)
        return len(self.depth) - 1

    def _sum(self, n: list[int], conv: list[int]) -> None:
        size = len(self.depth)
        self.n, self.conv, self.kids, self.leaves, self.below = [0] * size, [LAST + 1] * size, [0] * size, [0] * size, [0] * size
        self.sums: dict[int, np.ndarray] = {}
        for v in sorted(range(size), key=self.depth.__getitem__, reverse=True):
            if (e := self.end[v]) >= 0:
                self.n[v] += n[e]
                self.conv[v] = min(self.conv[v], conv[e])
            q = self.parent[v]
            if not self.seam[v] and not self.kids[v]:
                self.leaves[v] = 1
            if q >= 0:
                self.n[q] += self.n[v]
                self.conv[q] = min(self.conv[q], self.conv[v])
                if not self.seam[v]:
                    self.kids[q] += 1
                    self.leaves[q] += self.leaves[v]
                    sums = self.along(self.low[v])
                    self.below[q] += self.below[v] + (self.n[v] - 1) * int(sums[self.depth[v]] - sums[self.depth[q]])

    def along(self, path: int) -> np.ndarray:
        """Words of the first 0, 1, ... turns of a path."""
        if path not in self.sums:
            self.sums[path] = np.concatenate([[0], np.cumsum(np.asarray(self.words[path], np.int64))]).astype(np.int64)
        return self.sums[path]

    def seams(self, ends: list[str]) -> pa.RecordBatch:
        """What lies within the part below each seam."""
        rows = []
        keys: dict[int, list[bytes]] = {}
        for v in (v for v in range(len(self.depth)) if self.seam[v]):
            d, low = self.depth[v], self.low[v]
            if len(keys.get(low, ())) <= d:
                deepest = max(self.depth[u] for u in range(len(self.depth)) if self.seam[u] and self.low[u] == low)
                keys[low] = prefix_keys(self.paths[low], deepest)
            k = keys[low]
            rows.append((k[d], k[d - 1] if d else None, d, self.n[v], _id(self.conv[v]), self.kids[v], self.leaves[v], self.below[v], self.words[low][d - 1] if d else 0, ends[self.end[v]] if self.end[v] >= 0 else None))
        kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in SEAM.split(", ")])

    def nodes(self, ends: list[str], first: dict[int, int | None], last: dict[int, int | None]) -> pa.Table:
        """All nodes below the seams, unary ones too; ``first`` and ``last`` hold the ids of the seams by depth."""
        at = [v for v in range(len(self.depth)) if not self.seam[v]]
        columns: list[list] = [[] for _ in range(8)]
        for v in at:
            q, deep, n, own = self.parent[v], self.depth[v], self.n[v], _id(self.conv[v])
            top = self.depth[q]
            above = _id(self.conv[q]) if not self.seam[q] else (first if self.low[q] == 0 and top <= self.a else last)[top]
            sums, long = self.along(self.low[v]), deep - top
            columns[0] += [own] * long
            columns[1] += range(top + 1, deep + 1)
            columns[2] += [above] + [own] * (long - 1)
            columns[3] += [n] * long
            columns[4] += [1] * (long - 1) + [self.kids[v]]
            columns[5] += [self.leaves[v]] * long
            columns[6] += (self.below[v] + (n - 1) * (sums[deep] - sums[top:deep])).tolist()
            columns[7] += [NO_ENDS] * (long - 1) + [ends[self.end[v]] if self.end[v] >= 0 else NO_ENDS]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, [*[pa.int64()] * 7, pa.string()])], names=[c.split()[0] for c in NODE.split(", ")])


def _id(conv: int) -> int | None:
    return None if conv >= LAST else conv


def _tree(paths: pa.Table, seams: pa.Table) -> tuple[Patricia, list[str], dict[str, dict[int, int | None]]]:
    paths = paths.sort_by("path")
    sides: dict[str, dict[int, int | None]] = {"first": {}, "last": {}}
    for side, d, c in zip(*(seams[name].to_pylist() for name in ("side", "depth", "conv"))):
        sides[side][d] = c
    conv = [LAST if c is None else c for c in paths["conv"].to_pylist()]
    tree = Patricia(paths["path"].to_pylist(), paths["words"].to_pylist(), paths["n"].to_pylist(), conv, max(sides["first"], default=0), max(sides["last"], default=0))
    return tree, paths["ends"].to_pylist(), sides


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) to the decimal ids of each key, joined, IDS at most a row."""
    part, seq, key, held = TaskContext.get().partitionId(), 0, None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([",".join(held)], pa.string())], names=["key", "part", "seq", "ids"])

    out: list[pa.RecordBatch] = []
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (k != key or len(held) == IDS):
                out.append(row())
                seq, held = seq + 1, []
            key = k
            held.append("" if c is None else str(c))
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            out = []
    if held:
        yield row()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_joined_ids` in order to one digest a key; no more than a row is held."""
    key, h = None, None
    for batch in batches:
        keys, found = [], []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                h.update(b"," + ids.encode())
                continue
            if h is not None:
                keys.append(key)
                found.append(h.hexdigest())
            key, h = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["key", "ends"])


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, next, last, head) to a row for each prefix that the last path of a part shares with the first of the next."""
    for batch in batches:
        for part, after, last, head in zip(*(c.to_pylist() for c in batch.columns)):
            keys = prefix_keys(last, common(last, head))
            n = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([after] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(keys, pa.binary()), pa.array([False] * (n - 1) + [True])],
                names=["part", "next", "depth", "key", "tip"],
            )


def distinct_paths(found: DataFrame, paths: int = PATHS) -> DataFrame:
    """part, path, words, n, conv, ends for each distinct sequence of (conv, turns); parts are ranges of paths."""
    rows = stored(
        found.select("conv", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["words"]).alias("words")).withColumn("key", F.unhex(F.sha2("path", 256))),
        "paths",
    )
    # Ids of a key come in ranges, so one key may fill many tasks; only joined ids of a range meet again.
    tasks = max(LEAST_TASKS, -(-rows.count() // (4 * IDS)))
    dealt = rows.select("key", "conv").repartitionByRange(tasks, F.col("key"), F.col("conv").asc_nulls_last()).sortWithinPartitions(F.col("key"), F.col("conv").asc_nulls_last())
    joined = dealt.mapInArrow(_joined_ids, "key binary, part int, seq long, ids string")
    ends = joined.repartition("key").sortWithinPartitions("key", "part", "seq").select("key", "ids").mapInArrow(_hashed_ids, "key binary, ends string")
    each = rows.groupBy("key").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    whole = stored(each.join(ends, "key").drop("key"), "distinct")
    parts = min(max(LEAST_TASKS, -(-whole.count() // paths)), PARTS)
    return stored(whole.repartitionByRange(parts, "path").withColumn("part", F.spark_partition_id()), "sorted")


def prefix_trie(found: DataFrame, paths: int = PATHS) -> DataFrame:
    """A row for each node of the trie of (conv, turns), as :func:`sequences` gives them.

    conv_id (smallest member) and depth name a node; parent_conv_id is null for
    the root.  n_convs counts members, n_children children, n_leaves childless
    nodes of the subtree; saved_tokens adds, over the subtree, the words of each
    node's turn times its members but one; ends_sha256 is the digest of the ids
    that end at the node.  Conversations without turns end at the root; equal
    conversations share all nodes; of ids that repeat each row is a member; a
    null id comes after all others and is written as empty text.  Without any
    conversation there is no node, not even the root.
    """
    spark = found.sparkSession
    rows = distinct_paths(found, paths)
    ranges = stored(rows.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last")), "ranges")
    order = sorted(r.part for r in ranges.select("part").collect())  # PARTS at most
    after = spark.createDataFrame(list(zip(order, order[1:])), "part int, next int")
    heads = ranges.select(F.col("part").alias("next"), F.col("first").alias("head"))
    met = ranges.join(F.broadcast(after), "part").join(heads, "next").select("part", "next", "last", "head")
    spine = stored(met.mapInArrow(_bounds, "part int, next int, depth long, key binary, tip boolean"), "spine")

    def sides(of: DataFrame) -> DataFrame:
        return of.select("part", F.lit("last").alias("side"), "depth", "conv").unionByName(of.select(F.col("next").alias("part"), F.lit("first").alias("side"), "depth", "conv"))

    grouped = rows.groupBy("part")
    unknown = sides(spine.withColumn("conv", F.lit(None).cast("long")))

    def below(left: pa.Table, right: pa.Table) -> pa.Table:
        tree, ends, _ = _tree(left, right)
        return tree.seams(ends)

    by_part = grouped.cogroup(unknown.groupBy("part")).applyInArrow(below, SEAM)
    sums = (F.sum(c).alias(c) for c in ("n", "kids", "leaves", "saved"))
    seams = stored(
        by_part.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.max("words").alias("words"), F.max("ends").alias("ends"), *sums), "seams"
    )
    known = sides(spine.join(seams.select("key", "conv"), "key"))

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        tree, ends, side = _tree(left, right)
        # Without a neighbour on a side, the root is the only seam there.
        root = {0: next((s[0] for s in side.values() if 0 in s), _id(tree.conv[tree.parent.index(-1)]))}
        return tree.nodes(ends, root | side["first"], root | side["last"])

    nodes = grouped.cogroup(known.groupBy("part")).applyInArrow(local, NODE)
    return nodes.unionByName(_expanded(seams, spine))


def _expanded(seams: DataFrame, spine: DataFrame) -> DataFrame:
    """The nodes that are seams, their sums over all parts added up along chains."""
    spark = seams.sparkSession
    root = spark.createDataFrame([(-1, 0, bytearray(prefix_keys(b"", 0)[0]), True)], "part int, depth long, key binary, tip boolean")
    bounds = spine.select("part", "depth", "key", "tip").unionByName(root)
    inner = seams.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("seam_kids"))
    tips = bounds.where("tip").select("key").distinct().withColumn("tip", F.lit(True))
    whole = seams.join(inner, "key", "left").join(tips, "key", "left").fillna(0, ["seam_kids"])
    whole = stored(whole.withColumn("point", (F.col("seam_kids") != 1) | F.coalesce("tip", F.lit(False))).withColumn("own", F.col("saved") + (F.col("n") - 1) * F.col("words")), "points")
    # A chain is named by the point at its lower end, which is the next one down any bound.
    down = Window.partitionBy("part").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    chains = bounds.join(whole.select("key", "point"), "key").withColumn("chain", F.last(F.when(F.col("point"), F.col("key")), ignorenulls=True).over(down))
    chained = stored(whole.join(chains.groupBy("key").agg(F.first("chain").alias("chain")), "key"), "chains")
    # One row a chain: there are at most two bounds a part, each with a tip and a branch.
    totals = chained.groupBy("chain").agg(F.min("depth").alias("top"), F.min_by("parent", "depth").alias("parent"), F.sum("own").alias("saved"), F.sum("leaves").alias("leaves")).collect()
    below = {bytes(t.chain): [0, 0] for t in totals}
    for t in sorted(totals, key=lambda t: -t.top):
        if t.parent is not None:
            mine, above = below[bytes(t.chain)], below[bytes(t.parent)]
            above[0] += mine[0] + t.saved
            above[1] += mine[1] + t.leaves
    under = spark.createDataFrame([(bytearray(k), *v) for k, v in below.items()], "chain binary, under_saved long, under_leaves long")
    up = Window.partitionBy("chain").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    parents = seams.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    return (
        chained.join(F.broadcast(under), "chain")
        .withColumn("saved_tokens", F.col("under_saved") + F.sum("own").over(up))
        .withColumn("n_leaves", F.col("under_leaves") + F.sum("leaves").over(up))
        .join(parents, "parent", "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), (F.col("kids") + F.col("seam_kids")).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
