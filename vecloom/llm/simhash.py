"""SimHash near-dedup with pivot distance tables.

Fingerprints: each bit is the majority over the XXH64 (seed 42) of all 3-word
shingles.  The distinct fingerprints form a table with their Hamming distances
to ``PIVOTS`` reference fingerprints.  By the triangle inequality two
fingerprints within distance ``r`` differ by at most ``r`` in every coordinate.
The first coordinates are cut into cells of ``r + 1``, and a pair meets only if
its cells are the same or neighbours; pairs that meet and differ by more than
``r`` in any other coordinate are discarded, and the survivors are verified on
their bits.

Within the cells pairs meet by blocks, so that nothing is compared with the
whole table: the 64 bits are cut into ``parts`` segments, and as ``r`` flipped
bits reach ``r`` segments at most, two linked fingerprints agree on ``parts - r``
segments.  A cell of a block in which more than ``most`` squared pairs would meet
is not joined: each of its members links to the neighbours that it shares with
others.  Two fingerprints are within distance 2 exactly if some third one is
within distance 1 of both, and at most 65 fingerprints share such a neighbour;
so dense groups cost 65 rows a member, never the square of their size, and no
link is lost.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import join_groups, keep_rows, pick, row_mark, small, stored

#: Reference fingerprints: XXH64 (seed 9) of the decimal numbers from 0.
PIVOTS = 16
#: Coordinates that are cut into cells.
CELLS = 2
SHINGLE = 3
RADIUS = 2
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LONG = 4_000_000


def pivots(n: int = PIVOTS) -> list[int]:
    """The reference fingerprints as signed 64-bit numbers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i).encode(), 9)).astype(np.int64)) for i in range(n)]


def word_blocks(data: bytes, shingle: int = SHINGLE) -> Iterator[list[bytes]]:
    """Words in order; of a very long text in blocks that overlap by ``shingle - 1`` words, so every shingle comes once."""
    if len(data) <= _LONG:
        yield data.split()
        return
    found, carry = (m.group() for m in _WORD.finditer(data)), []
    while block := list(itertools.islice(found, 500_000)):
        yield carry + block
        carry = (carry + block)[1 - shingle :]


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The fingerprint of a whole text, unsigned; zero for a text without words."""
    digest, seed = xxhash.xxh64_intdigest, itertools.repeat(42)
    ones, n, last = np.zeros(64, np.int64), 0, []
    for words in word_blocks((text or "").encode("utf-8", "replace").lower()):
        last = words
        if len(words) < SHINGLE:
            continue
        for at in range(0, len(words) - SHINGLE + 1, 8192):
            part = words[at : at + 8192 + SHINGLE - 1]
            h = np.fromiter(map(digest, map(b" ".join, zip(part, part[1:], part[2:])), seed), np.uint64)
            ones += majority(h)
            n += len(h)
    if not n:
        if not last:
            return 0
        return digest(b" ".join(last), 42)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, mark, fp (the 64 bits as a signed long) for each row; ids may repeat or be null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(2)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["id", "mark", "fp"])

    rows = pick(docs, id=id_col, text=text_col).select("id", row_mark(F.col("text")).alias("mark"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, mark long, fp long")


def distances(fp: Column, references: list[int]) -> Column:
    """The coordinates of a fingerprint: an array of its Hamming distances to the references."""
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte") for p in references))


def undiscarded(a: Column, b: Column, first: int, radius: int) -> Column:
    """Whether no coordinate from ``first`` on differs by more than the radius."""
    out = F.lit(True)
    for i in range(first, PIVOTS):
        out = out & (F.abs(a[i].cast("int") - b[i].cast("int")) <= radius)
    return out


def apart(a: Column, b: Column) -> Column:
    """The Hamming distance of two fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def own_cell(d: Column, radius: int = RADIUS) -> Column:
    """The cell of a fingerprint in the first CELLS coordinates, as one number."""
    out = F.lit(0)
    for i in range(CELLS):
        out = out * 100 + F.floor(d[i].cast("int") / (radius + 1)).cast("int")
    return out


def near_cells(d: Column, radius: int = RADIUS) -> Column:
    """All cells in which a fingerprint within the radius may be: the own one and the neighbours that the radius reaches."""
    def crossed(cells: Column, x: Column) -> Column:
        reach = F.sequence(F.floor((x - radius) / (radius + 1)).cast("int"), F.floor((x + radius) / (radius + 1)).cast("int"))
        return F.flatten(F.transform(cells, lambda c: F.transform(reach, lambda y: c * 100 + y)))

    out = F.array(F.lit(0))
    for i in range(CELLS):
        out = crossed(out, d[i].cast("int"))
    return out


def segment_masks(rows: int, radius: int = RADIUS) -> list[int]:
    """Masks of the blocks: as many segments as make a block hold a few of ``rows`` evenly spread fingerprints."""
    parts = radius + 1
    while parts < 8 and rows > 8 * 2 ** (64 * (parts - radius) // parts):
        parts += 1
    edges = [64 * i // parts for i in range(parts + 1)]
    own = [sum(1 << j for j in range(edges[i], edges[i + 1])) for i in range(parts)]
    return [sum(c) for c in itertools.combinations(own, parts - radius)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def blocks(distinct: DataFrame, rows: int) -> DataFrame:
    """fp, d, k, bits: a row for each block of each of the ``rows`` distinct fingerprints of column ``fp``; d are its coordinates."""
    parts = F.array(*(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(segment_masks(rows))))
    return distinct.select("fp", distances(F.col("fp"), pivots()).alias("d")).select("fp", "d", F.explode(parts).alias("block")).select("fp", "d", "block.k", "block.bits")


def links(distinct: DataFrame, rows: int, most: int = 32, report: dict[str, int] | None = None) -> DataFrame:
    """Links among the ``rows`` distinct fingerprints of column ``fp``: a, b with a < b.

    Every two fingerprints within the radius are connected by the links, though
    in a cell of more than ``most`` squared pairs not each by a link of its own.
    ``report`` receives the pairs that blocks alone would bring together, those
    that meet in neighbouring cells, those that no pivot discards, and the
    links; it costs passes of its own.
    """
    keyed = blocks(distinct, rows)
    home = keyed.select("k", "bits", own_cell(F.col("d")).alias("cell"), "fp", "d", F.lit(1).alias("home"))
    reach = keyed.select("k", "bits", F.explode(near_cells(F.col("d"))).alias("cell"), "fp", "d", F.lit(0).alias("home"))
    at = ["k", "bits", "cell"]
    both = home.unionByName(reach)
    # A cell with one member that nobody else reaches has two rows.
    sizes = stored(both.groupBy(*at).agg(F.sum("home").alias("members"), F.count(F.lit(1)).alias("all")).where("members > 0 AND all > 2"), "cells")
    within = stored(both.join(small(sizes, sizes.count()), at).select(*at, "fp", "d", "home", (F.col("members") * (F.col("all") - F.col("members")) > most * most).alias("crowded")), "members")
    few = within.where("NOT crowded")
    a = few.where("home = 0").select(*at, F.col("fp").alias("a"), F.col("d").alias("da"))
    b = few.where("home = 1").select(*at, F.col("fp").alias("b"), F.col("d").alias("db"))
    met = a.join(b, at).where(F.col("a") < F.col("b"))
    left = met.where(undiscarded(F.col("da"), F.col("db"), CELLS, RADIUS))
    pairs = left.where(apart(F.col("a"), F.col("b")) <= RADIUS).select("a", "b")
    if report is not None:
        held = keyed.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("n"))
        report["blocked"] = held.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        report |= {"met": met.count(), "undiscarded": left.count(), "linked": pairs.count(), "crowded": within.where("crowded").select("fp").distinct().count()}
    crowd = within.where("crowded").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << j)) for j in range(64)))
    reached = crowd.select("fp", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fp")))).alias("z"))
    shared = reached.groupBy("z").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = shared.select("a", F.explode("all").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of a link table (a, b); root is the smallest node that it reaches.

    Alternating large and small stars; each round is written to the shared
    folder, and rounds end when the table no longer changes.
    """
    now = stored(edges.select("a", "b").where("a != b").distinct(), "links")
    while True:
        many = now.count()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: the larger neighbours of a node (and itself) go to its smallest one.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("n"), "m").where("n != m")
        large = large.select(F.greatest("n", "m").alias("a"), F.least("n", "m").alias("b")).distinct()
        # Small star: the smaller neighbours of a node and itself go to its smallest one.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("n"), "m").where("n != m").distinct()
        after = stored(stars.select(F.col("m").alias("a"), F.col("n").alias("b")), "links", many)
        ordered = now.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if _sum(after) == _sum(ordered):
            return after.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        now = after


def _sum(edges: DataFrame) -> tuple:
    """The number of links and a checksum that does not depend on their order."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 32) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at Hamming distance 2 or less; ``component_id`` is the
    smallest id that a row reaches over links, itself included.  Texts without
    words (null, empty) have fingerprint zero and link like any other; very long
    texts are read block by block.  Repeated rows share fingerprint and
    component.  Null ids are no component's smallest id unless all its ids are
    null.  Other columns are not read, whatever their names.  An empty table
    gives an empty result.
    """
    return classified(docs, id_col, text_col, most).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classified(docs: DataFrame, id_col: str, text_col: str, most: int = 32) -> DataFrame:
    """id, mark, fp, root (the component's smallest fingerprint), component_id of each row."""
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    # Exact copies of a fingerprint collapse before anything is compared.
    distinct = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = components(links(distinct.select("fp"), distinct.count(), most))
    return placed(rows, distinct, roots, "fp").select("id", "mark", "fp", "root", "component_id")


def placed(rows: DataFrame, distinct: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """``rows`` with the ``root`` of the component of their key and its smallest id, ``component_id``, from (key, least, n) and (node, root)."""
    known = distinct.join(roots, distinct[key] == roots.node, "left").select(key, "least", "n", F.coalesce("root", key).alias("root"))
    least, many = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("keys")), distinct.count()
    # A component may hold a third of all keys: its rows are met like a hot key.
    classes = stored(join_groups(known, least, "root", many, "keys").select(key, "root", "component_id", "n"), "classes", many)
    return join_groups(rows, classes, key, rows.count()).drop("n")


def survivors(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each component of (id, mark, root), the one of the smallest id (then mark); null ids come last."""
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    best = found.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")
    total = found.count()
    several = join_groups(found, best, "root", total, "size")
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))
    return keep_rows(docs, stored(several.select("id", "mark", kept.alias("kept")), "several", total), id_col, text_col)


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near copies, the one of the smallest id; all columns stay, whatever their names.

    Rows fall one by one, so that different texts under one id are told apart;
    of rows with the same id and text one stays.  Null ids come last.  An empty
    table stays empty.
    """
    return survivors(docs, stored(classified(docs, id_col, text_col), "found"), id_col, text_col)
