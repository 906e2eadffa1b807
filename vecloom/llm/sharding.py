"""Shards of near equal bytes by Karmarkar-Karp differencing.

Groups of equal texts are indivisible.  Differencing repeatedly combines the two
partial partitions of largest spread, oppositely ordered.  Groups of at least
1 / HEAVY of all bytes, HEAVY of them at most, go first, on the driver.  All
others are dealt to chunks by a hash of their digest, and each chunk is
differenced together with its share of the partition of the large groups, so
that what these left uneven is made up for by all chunks in proportion.  One
chunk closes: it is differenced together with what all others left.  No step
holds more than a chunk or HEAVY groups.  Sums and the assignment of rows are
DataFrame operations.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import HEAVY, join_groups, pick, small, stored

#: Groups of a chunk on average.
CHUNK = 8192
#: Copies of one row that a task spells out at once.
SPAN = 65_536


def combine(partitions: Iterable[tuple[object, list[int]]], k: int) -> tuple[dict[object, list[int]], list[int]]:
    """Differencing of partial partitions (key, sums of its k places): the part of each place, and the sums of the parts.

    A single item is a partition with all of its size at place 0.  Ties of
    spread are broken by the order of sums and keys, so the result depends on
    these alone.
    """
    heap = []
    for order, (key, sums) in enumerate(sorted(partitions, key=lambda x: (sorted(x[1], reverse=True), x[0]), reverse=True)):
        # Sums in ascending order, with the members of each; places without bytes hold no group.
        places = sorted((s, i) for i, s in enumerate(sums))
        heap.append((places[0][0] - places[-1][0], order, [s for s, _ in places], [((key, i),) if s else () for s, i in places]))
    heapq.heapify(heap)
    order, keys = len(heap), [h[3] for h in heap]
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        # Largest meets smallest.  Members are nested pairs, so joining two parts takes constant time.
        both = sorted((x + y, i) for i, (x, y) in enumerate(zip(a, reversed(b), strict=True)))
        members = [[in_a[i], in_b[k - 1 - i]] for _, i in both]
        sums = [x for x, _ in both]
        heapq.heappush(heap, (sums[0] - sums[-1], order, sums, members))
        order += 1
    if not keys:
        return {}, [0] * k
    _, _, sums, members = heap[0]
    part: dict[object, list[int]] = {}
    for i, tree in enumerate(members):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node)
            else:
                for key, place in node:
                    part.setdefault(key, [0] * k)[place] = i
    return part, sums


def difference(sizes: list[tuple[str, int]], k: int) -> tuple[dict[str, int], list[int]]:
    """k-way largest differencing of single items: the part of each key, and the sums of the parts."""
    part, sums = combine([(key, [size] + [0] * (k - 1)) for key, size in sizes], k)
    return {key: places[0] for key, places in part.items()}, sums


def beside(sizes: list[tuple[bytes, int]], held: list[int]) -> dict[bytes, int]:
    """The part of each item, differenced together with a partition that is held: parts are the places of ``held``."""
    k, least = len(held), min(held)
    part, _ = combine([(key, [size] + [0] * (k - 1)) for key, size in sizes] + [(b"", [h - least + 1 for h in held])], k)
    home = {at: place for place, at in enumerate(part.pop(b""))}
    return {key: home[places[0]] for key, places in part.items()}


def places(groups: DataFrame, shards: int, chunk: int = CHUNK, heavy: int = HEAVY) -> DataFrame:
    """digest, shard for each group (digest, bytes, n) of texts."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = [(bytes(r.digest), r.bytes) for r in groups.where(F.col("bytes") * heavy >= total).select("digest", "bytes").collect()]  # heavy rows at most
    part, held = difference(large, shards)
    rest = groups.where(F.col("bytes") * heavy < total)
    left = total - sum(held)
    chunks = max(1, -(-(groups.count() - len(large)) // chunk))
    dealt = rest.select(F.pmod(F.xxhash64("digest"), F.lit(chunks)).alias("chunk"), "digest", "bytes")

    def placed(rows: pd.DataFrame, beside_what: list[int]) -> pd.DataFrame:
        found = beside(list(zip(rows["digest"], rows["bytes"].tolist())), beside_what)
        return pd.DataFrame({"digest": rows["digest"], "bytes": rows["bytes"], "shard": [found[d] for d in rows["digest"]]})

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        own = int(rows["bytes"].sum())
        return placed(rows, [h * own // left for h in held])

    shape = "digest binary, bytes long, shard int"
    most = stored(dealt.where("chunk > 0").groupBy("chunk").applyInPandas(share, shape), "chunks")
    sums = list(held)
    for r in most.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():  # a row a shard
        sums[r.shard] += r.bytes
    last = stored(dealt.where("chunk = 0").groupBy("chunk").applyInPandas(lambda rows: placed(rows, sums), shape), "closing")
    first = spark.createDataFrame([(bytearray(d), part[d]) for d, _ in large], "digest binary, shard int")
    return first.unionByName(most.select("digest", "shard")).unionByName(last.select("digest", "shard"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, chunk: int = CHUNK, heavy: int = HEAVY, rows_per_bucket: int = 20_000) -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: sums of size (UTF-8 bytes plus 1) are near equal, and
    equal texts share a shard.  A null text counts as empty: size 1, crc32 0,
    in the group of empty texts.  Slots count from 0 without gaps in each shard;
    rows of a bucket are numbered in the order of their ids, null ids first, and
    rows that are the same in every respect are counted before they are numbered.
    ``grown_shard`` is null.  Very long texts are sizes like any other, columns
    besides id and text are not read.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        pick(docs, id=id_col, text=text_col).select(
            "id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"), F.unhex(F.sha2(text, 256)).alias("digest"),
        ),
        "rows",
    )
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    n = rows.count()
    where = stored(groups.select("digest", "n").join(places(groups, shards, chunk, heavy), "digest"), "shards")
    buckets = max(1, -(-n // (shards * rows_per_bucket)))
    bucket = F.pmod(F.xxhash64("id", "size", "crc", F.lit(7)), F.lit(buckets)).cast("int").alias("bucket")
    # Equal rows are counted first, so that no bucket holds more rows than it has different ones.
    placed = join_groups(rows, where, "digest", n).select("shard", bucket, "id", "size", "crc")
    placed = stored(placed.groupBy("shard", "bucket", "id", "size", "crc").agg(F.count(F.lit(1)).alias("copies")), "counted")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("rows"))
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "bucket").orderBy("id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("r", F.coalesce(F.sum("copies").over(own), F.lit(0))).join(small(offsets, buckets * shards), ["shard", "bucket"])
    numbered = numbered.withColumn("first", F.col("offset") + F.col("r")).withColumn("end", F.col("first") + F.col("copies"))
    slots = F.explode(F.sequence("first", F.col("end") - 1))
    each = numbered.where(F.col("copies") <= SPAN).withColumn("slot", slots)
    if not placed.where(F.col("copies") > SPAN).isEmpty():
        # Rows that repeat very often go to different tasks in spans before they are spelled out.
        spans = numbered.where(F.col("copies") > SPAN).withColumn("first", F.explode(F.sequence(F.col("first"), F.col("end") - 1, F.lit(SPAN).cast("long"))))
        spans = spans.withColumn("end", F.least("end", F.col("first") + SPAN)).repartition("shard", "first")
        each = each.unionByName(spans.withColumn("slot", slots))
    return each.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def spread(placed: DataFrame, shards: int = 8) -> tuple[int, float]:
    """Bytes between the largest and the smallest shard of a result of :func:`shard`, and their part of the mean."""
    sums = np.zeros(shards, np.int64)
    for r in placed.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():  # a row a shard
        sums[r.shard] = r.bytes
    return int(sums.max() - sums.min()), float((sums.max() - sums.min()) / max(sums.mean(), 1))
