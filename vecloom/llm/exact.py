"""Exact dedup by a log-structured merge index of text digests (native).

Flush: the rows of a batch are dealt to memtables.  Each collapses its rows by
digest (smallest identifier among the rows of most code points, number of rows)
and is written as a run sorted by digest, with a filter: a bitmap in blocks,
one bit a digest, PER_DIGEST bits for each.  Compaction probes the filters
first: a digest whose bit no second run has set is in one run alone and moves
to the next level as it is; the others are merged, FAN runs to one, level by
level, until one run is left.  Lookup probes the filters, then the last level,
then compares the bytes.  Digests of one row need nothing more; those of several
(hits) are verified byte by byte, and texts that share a digest but not their
bytes are split into classes of their own.

Only DataFrame functions run here: no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.common import BLANKS, join_groups, keep_rows, pick, row_mark, small, stored

#: Memtables of a batch, and runs that a compaction merges to one.
MEMTABLES = 4
FAN = 4
#: Bits of a filter for each digest, bits of one of its blocks, and blocks (4 KB each) that are broadcast at most.
PER_DIGEST = 16
BLOCK = 32_768
BROADCAST_BLOCKS = 4096


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _entry() -> Column:
    """Orders the rows of a class: most code points, then smallest id, null ids last; rows of one id by the mark of their text."""
    return F.struct((-F.col("points")).alias("neg"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("mark").alias("mark"))


def _entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, points, mark, digest of each row."""
    points = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    return pick(docs, id=id_col, text=text_col).select("id", points.alias("points"), row_mark(F.col("text")).alias("mark"), _digest(F.col("text")).alias("digest"))


def blocks_for(digests: int) -> int:
    """Blocks of a filter for so many digests."""
    return max(1, -(-digests * PER_DIGEST // BLOCK))


def _place(key: str, blocks: int) -> tuple[Column, Column]:
    """Block and bit of a key in a filter."""
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(blocks)).alias("block"), F.pmod(F.shiftrightunsigned(h, 40), F.lit(BLOCK)).alias("bit")


def bitmap(rows: DataFrame, key: str, blocks: int, *by: str) -> DataFrame:
    """by, block, bits: a filter of the keys for each value of the columns ``by``."""
    return rows.select(*by, *_place(key, blocks)).groupBy(*by, "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def shared_bits(of_runs: DataFrame) -> DataFrame:
    """level_run, block, bits: the bits that at least two of the runs to merge have set, from (level_run, place, block, bits)."""
    pairs = of_runs.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1)))).where("other != place")
    pairs = pairs.select("level_run", "block", F.least("place", "other").alias("a"), F.greatest("place", "other").alias("b"), "bits")
    met = pairs.groupBy("level_run", "block", "a", "b").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("sides")).where("sides = 2")
    return met.groupBy("level_run", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def probe(rows: DataFrame, bits: DataFrame, key: str, blocks: int, total: int, *by: str) -> DataFrame:
    """``rows`` with ``maybe``: whether the filter has the bit of their key; ``total`` is the filter's number of blocks."""
    block, bit = _place(key, blocks)
    met = rows.select("*", block, bit).join(F.broadcast(bits) if total <= BROADCAST_BLOCKS else bits, [*by, "block"], "left")
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return met.withColumn("maybe", F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))).drop("block", "bit", "bits")


@dataclass
class DigestIndex:
    """An LSM index.  ``log`` are the rows flushed, ``level`` the runs (run, digest, best, n) of the present level."""

    spark: SparkSession
    runs: int = 0
    log: DataFrame | None = None
    level: DataFrame | None = None
    #: Of each compaction: runs before, digests, and digests that the filters sent to be merged.
    merges: list[tuple[int, int, int]] = field(default_factory=list)

    @staticmethod
    def empty(spark: SparkSession) -> DigestIndex:
        return DigestIndex(spark)

    def flush(self, docs: DataFrame, id_col: str, text_col: str) -> DigestIndex:
        """Add a batch: rows go to memtables by a hash, and each memtable is written as one run."""
        entries = _entries(docs, id_col, text_col)
        log = stored(entries.withColumn("run", (F.pmod(F.xxhash64("id", "mark"), F.lit(MEMTABLES)) + self.runs).cast("int")), "log")
        runs = log.groupBy("run", "digest").agg(F.min(_entry()).alias("best"), F.count(F.lit(1)).alias("n"))
        runs = stored(runs.sortWithinPartitions("run", "digest"), "level0")
        return DigestIndex(self.spark, self.runs + MEMTABLES, log if self.log is None else self.log.unionByName(log), runs if self.level is None else self.level.unionByName(runs), self.merges)

    def compact(self) -> DigestIndex:
        """Merge runs level by level until one is left: a row for each digest."""
        if self.level is None:
            raise ValueError("the index holds no run; flush a batch first")
        runs, level, merges = self.runs, self.level, list(self.merges)
        while runs > 1:
            after = -(-runs // FAN)
            digests = level.count()
            blocks = blocks_for(-(-digests // after))
            met = level.select(F.floor(F.col("run") / FAN).cast("int").alias("level_run"), (F.col("run") % FAN).alias("place"), "digest", "best", "n")
            shared = stored(shared_bits(bitmap(met, "digest", blocks, "level_run", "place")), "filter", digests)
            probed = probe(met, shared, "digest", blocks, after * blocks, "level_run")
            apart = probed.where(~F.col("maybe")).select("level_run", "digest", "best", "n")
            merged = probed.where("maybe").groupBy("level_run", "digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
            path = stored(merged, "merged", digests)
            level = stored(apart.unionByName(path).withColumnRenamed("level_run", "run"), "level")
            merges.append((runs, digests, digests - level.count() + path.count()))
            runs = after
        return DigestIndex(self.spark, runs, self.log, level, merges)

    def lookup(self, docs: DataFrame, id_col: str, text_col: str, held: DataFrame) -> DataFrame:
        """Which of ``docs`` have a text that the index holds: id, keep_id.

        The filter is probed first, then the entries; a hit counts if its bytes
        equal those of the kept row in ``held``, the rows that were flushed.
        """
        index = self if self.runs == 1 else self.compact()
        blocks = blocks_for(index.level.count())
        bits = bitmap(index.level, "digest", blocks)
        asked = pick(docs, id=id_col, text=text_col).select("id", normalised(F.col("text")).alias("norm"), _digest(F.col("text")).alias("digest"))
        maybe = probe(asked, bits, "digest", blocks, blocks).where("maybe").join(index.level, "digest").select("id", "norm", "digest", "best")
        kept = pick(held, keep_id=id_col, text=text_col).select("keep_id", normalised(F.col("text")).alias("kept_norm"))
        met = maybe.join(kept, F.col("best.id").eqNullSafe(F.col("keep_id")) & (F.col("norm") == F.col("kept_norm")))
        return met.select("id", "keep_id").distinct()


def classified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, points, digest, mark, best, n of each row: its class of equal texts; mark is null where the class is this row alone."""
    index = DigestIndex.empty(docs.sparkSession).flush(docs, id_col, text_col).compact()
    total = index.log.count()
    alone = index.level.where("n = 1").select(F.col("best.id").alias("id"), (-F.col("best.neg")).alias("points"), "digest", F.lit(None).cast("long").alias("mark"), "best", "n")
    hits = stored(index.level.where("n > 1").select("digest", "n"), "hits", total)
    several = join_groups(index.log, hits, "digest", total).drop("n", "run")
    # Byte verification.  A filter of the marks keeps all other texts out of digests and shuffles;
    # copies collapse in the map tasks, so about one text a class and task is shuffled.
    repeated = hits.count()
    blocks = blocks_for(repeated)
    marked = pick(docs, id=id_col, text=text_col).withColumn("mark", row_mark(F.col("text")))
    maybe = probe(marked, stored(bitmap(several, "mark", blocks), "marks", repeated), "mark", blocks, blocks).where("maybe")
    texts = maybe.select("id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), "mark", normalised(F.col("text")).alias("norm"), _digest(F.col("text")).alias("digest"))
    seen = join_groups(texts, hits, "digest", total).groupBy("digest", "norm").agg(F.min(_entry()).alias("best"), F.count(F.lit(1)).alias("n"))
    classes = stored(seen.groupBy("digest").agg(F.count(F.lit(1)).alias("variants"), F.first("best").alias("best"), F.first("n").alias("n")), "verified", repeated)
    rows = join_groups(index.log.drop("run"), classes.where("variants = 1").drop("variants"), "digest", total).select(*alone.columns)
    unlike = classes.where("variants > 1").select("digest")
    if not unlike.isEmpty():
        # Digests whose rows differ in bytes: classes by the bytes themselves.
        w = Window.partitionBy("digest", "norm")
        apart = texts.join(unlike, "digest", "left_semi").withColumn("best", F.min(_entry()).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
        rows = rows.unionByName(apart.select(*alone.columns))
    return alone.unionByName(rows)


def _kept() -> Column:
    """Whether a row is the one of its class that stays; a class of one row has no mark."""
    best = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("points") == -F.col("best.neg")) & F.col("mark").eqNullSafe(F.col("best.mark"))
    return (F.col("n") == 1) | best


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ``[\\x20\\x09-\\x0D]``; null
    equals empty.  Of equal texts the row with the most code points stays, ties
    go to the smallest id and null ids come last; of rows that share an id and
    differ in white space alone, one of most code points stays.  Rows that share
    id and text are told apart by nothing, so all of them say ``kept`` if one
    does; very long
    texts are read whole.  Other columns are not read, whatever their names.  An
    empty table gives an empty result.
    """
    return classified(docs, id_col, text_col).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        _kept().alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of equal texts, the one that :func:`exact_dedup` keeps; all columns stay as they are.

    Rows fall one by one: texts that differ all stay, also under one id or a
    null one.  Of rows with the same id and text one stays, an arbitrary one if
    they differ in other columns.  An empty table stays empty.
    """
    found = stored(classified(docs, id_col, text_col).where("n > 1").select("id", "mark", _kept().alias("kept")), "classes")
    return keep_rows(docs, found, id_col, text_col)
