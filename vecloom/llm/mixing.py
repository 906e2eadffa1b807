"""Mixing sources to target weights by Poisson replication (native).

A document of source ``s`` is repeated ``X ~ Poisson(rate_s)`` times, where the
rate is the target share of the budget over the source's present mass.  ``X``
is the inverse of the Poisson distribution at a uniform number that a hash of
the seed and the id gives, so a re-run (or a lost executor) repeats the same
draw.  A rate above ROUND is cut into equal rounds of ROUND at most, each with
a hash of its own: the sum of Poisson draws is a Poisson draw of the summed rate,
and tables of the distribution stay short at any rate.  Many rounds of a
document are dealt over the cluster before they are drawn.  The copies are then
shuffled globally by a second hash.

Only DataFrame functions run here: no Python on the executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm.common import HEAVY, id_text, pick

#: The largest rate that is drawn at once, and rounds that a task draws of one document at once.
ROUND = 64
SPAN = 1024
#: Copies of a round are numbered within so many places; P(X >= 256) is below 2**-52 at rate 64.
COPIES = 256


def uniform(key: Column, seed: int | str) -> Column:
    """A number in (0, 1) from the first 52 bits of an md5 of seed and key."""
    return (_bits(key, seed).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def _bits(key: Column, seed: int | str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, budget: float = 1.0) -> DataFrame:
    """A row for each source: source, mass, rate.

    Mass is UTF-8 bytes plus one a document.  ``weights`` are relative target
    shares of the mass; a source that they don't name has weight 0, and None
    means equal shares for all sources.  ``budget`` is the mass of the mixture
    over that of the input.  A null source is a source like any other.
    """
    mass = pick(docs, source=source_col, text=text_col).groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("mass"))
    if weights is None:
        weighed = mass.withColumn("w", F.lit(1.0))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "named string, w double")
        weighed = mass.join(table, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "mass", F.coalesce("w", F.lit(0.0)).alias("w"))
    sums = weighed.agg(F.sum("w").alias("all_w"), F.sum("mass").alias("all_mass"))  # one row
    rate = F.col("w") * F.lit(float(budget)) * F.col("all_mass").cast("double") / (F.col("all_w") * F.col("mass").cast("double"))
    return weighed.crossJoin(F.broadcast(sums)).select("source", "mass", F.when(F.col("all_w") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def distribution(rate_table: DataFrame) -> DataFrame:
    """A row for each source: source, rate, rounds, cdf (P(X <= k) of one round, from k = 0 until the rest is below 2**-52; 191 numbers at most)."""
    rounds = F.greatest(F.ceil(F.col("rate") / ROUND).cast("long"), F.lit(1).cast("long"))
    parts = rate_table.select("source", "rate", rounds.alias("rounds")).withColumn("part", F.col("rate") / F.col("rounds"))
    terms = parts.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("part") + 12 * F.sqrt("part") + 30).cast("int"))))
    w = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    logs = terms.withColumn("lg", F.sum(F.when(F.col("k") == 0, -F.col("part")).otherwise(F.ln(F.col("part") / F.col("k")))).over(w))
    sums = logs.withColumn("cdf", F.sum(F.exp("lg")).over(w))
    return sums.groupBy("source", "rate", "rounds").agg(F.sort_array(F.collect_list("cdf")).alias("cdf"))


def poisson_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = 17, copy_col: str = "mix_copy", key_col: str = "mix_key") -> DataFrame:
    """``docs`` with each row repeated by its draw and shuffled; all columns stay, ``copy_col`` (from 0) and ``key_col`` are added.

    ``copy_col`` numbers the copies of a row: COPIES times the round, plus the
    place in the round, so it has no gaps where the rate is ROUND or less.
    Columns of these two names in the input are replaced, all others stay
    whatever their names.  Rows with equal ids get equal draws (ties of
    ``key_col`` keep no order); a null id counts as empty text.  A text is
    carried whole, however long.  Empty tables and sources of weight 0 give no
    rows.  The rows come in the order of ``key_col`` within a partition and
    hashed over the partitions, so reading the partitions in turn reads a global
    shuffle.
    """
    own = {c: f"{c}_{uuid.uuid4().hex}" for c in ("source", "cdf", "rounds", "span", "round", "u", "n")}
    col = lambda c: F.col(own[c])
    docs = docs.drop(copy_col, key_col)
    cdf = distribution(rates(docs, source_col, text_col, weights, budget)).where("rate > 0").select(*(F.col(c).alias(own[c]) for c in ("source", "cdf", "rounds")))
    sources = cdf.count()
    # HEAVY sources (1.5 KB each) are broadcast at most; more are met by a shuffle on the source.
    drawn = docs.join(F.broadcast(cdf) if sources <= HEAVY else cdf, docs[source_col].eqNullSafe(col("source")))
    few = drawn.where(col("rounds") <= SPAN).withColumn(own["round"], F.explode(F.sequence(F.lit(0).cast("long"), col("rounds") - 1)))
    if not cdf.where(col("rounds") > SPAN).isEmpty():
        # Spans of rounds of one document go to different tasks before any copy is made.
        spans = drawn.where(col("rounds") > SPAN).withColumn(own["span"], F.explode(F.sequence(F.lit(0).cast("long"), F.floor((col("rounds") - 1) / SPAN))))
        spans = spans.repartition(F.col(id_col), col("span"))
        first = col("span") * SPAN
        many = spans.withColumn(own["round"], F.explode(F.sequence(first, F.least(first + SPAN, col("rounds")) - 1))).drop(own["span"])
        few = few.unionByName(many)
    key = F.when(col("round") == 0, id_text(F.col(id_col))).otherwise(F.concat(id_text(F.col(id_col)), F.lit("|"), col("round").cast("string")))
    # sequence(0, X) minus its last element has X elements, none for X = 0.
    count = F.size(F.filter(col("cdf"), lambda c: c <= col("u")))
    base = col("round") * COPIES
    copies = (
        few.withColumn(own["u"], uniform(key, seed))
        .withColumn(own["n"], count)
        .where(col("n") > 0)
        .drop(own["source"], own["cdf"], own["u"], own["rounds"])
        .withColumn(copy_col, F.explode(F.sequence(base, base + col("n") - 1)))
        .drop(own["n"], own["round"])
        .withColumn(key_col, _bits(F.concat(id_text(F.col(id_col)), F.lit("|"), F.col(copy_col).cast("string")), f"shuffle{seed}"))
    )
    return copies.repartition(F.col(key_col)).sortWithinPartitions(key_col)
