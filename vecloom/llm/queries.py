"""The query of each operator over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import bpe, exact, langid, licenses, media, mixing, runs, sharding, simhash, tokenfile, toxicity, trie, wordpiece
from vecloom.llm.common import bounded_batches, fold, id_text, table


def op1_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; fold 1 of 3 is held out."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(langid.learned_rows(docs)))
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "n_windows")


def op2_longest_match_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of word pieces of every document."""
    bounded_batches(spark)
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


def op3_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded text of every document."""
    bounded_batches(spark)
    return bpe.round_trip(table(spark, sf_dir, "documents"), outputs=("ids_sha256", "decoded_sha256"))


def op4_descriptor_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the pictures that all embeddings draw; each tenth has an edited copy."""
    bounded_batches(spark)
    return media.find_copies(media.drawn_media(table(spark, sf_dir, "embeddings")), exact=True)


def op5_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document; fold 0 of 5 is held out."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")), "id")
    return toxicity.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits", "terms"
    )


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal byte shares for all sources, as much in all as the input holds; a row for each copy."""
    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "mix_copy", "mix_key", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


def op7_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, by the law of near equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices in every document; the number, the distinct names, and the best coverage."""
    bounded_batches(spark)
    found = licenses.scan(table(spark, sf_dir, "documents"))
    coverage = F.round(F.array_max(F.transform("matches", lambda m: m["coverage"])), 6)
    return found.select("doc_id", "n_matches", F.array_join("licenses", ";").alias("licenses"), F.coalesce(coverage, F.lit(0.0)).alias("best_coverage"), "matches")


def op9_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the component of near copies that it is in."""
    bounded_batches(spark)
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op10_lsm_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal texts of every document."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``: the words of about a tenth of the documents, chosen by a hash of the id, repeat from some word on; all others stay as they are."""
    h = F.crc32(id_text(F.col("doc_id")))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(w, i)), " ")).otherwise(F.lit(""))

    # Inside the transform the words are one value; spelled out they would be cut again for each word.
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("doc_id").isNotNull(), F.transform(F.array(words), repeated)[0]).otherwise(F.col("text")).alias("text"))


def op11_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, after the planted repetitions: their number, the longest, and digests of all runs and of the collapsed text."""
    bounded_batches(spark)
    found = runs.find_runs(planted_runs(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        found.withColumn("longest", longest)
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
            F.floor(1000 * F.col("longest.length") / -F.col("longest.period")).alias("exponent_milli"),
            F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
        )
    )


def rebuilt(found: DataFrame) -> DataFrame:
    """``conv``, ``turns``: each conversation c with its first h turns replaced by those of conversation c - c % 20; h is crc32 of c, modulo 4.

    A null id has no such conversation and h = 0.
    """
    base = found.where(F.col("conv") % 20 == 0).select(F.col("conv").alias("of"), F.slice("turns", 1, 3).alias("head"))
    h = fold(F.col("conv"), 4).cast("int")
    led = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), h))
    met = found.withColumn("of", F.col("conv") - F.col("conv") % 20).join(base, "of", "left")
    return met.select("conv", F.concat(led, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def op12_patricia_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations, with the aggregates of its subtree."""
    return trie.prefix_trie(rebuilt(trie.sequences(table(spark, sf_dir, "conversations"))))


def op13_ranked_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in files, read back: where each begins, its length with the end id, and a checksum."""
    bounded_batches(spark)
    back = tokenfile.read(tokenfile.token_files(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_cnn_language, op2_longest_match_tokens, op3_segment_tree_bpe, op4_descriptor_copies, op5_levenshtein_toxicity, op6_poisson_mix, op7_karmarkar_karp,
        op8_patience_licenses, op9_pivot_simhash, op10_lsm_exact_dedup, op11_lyndon_runs, op12_patricia_conversations, op13_ranked_id_files,
    )
}

_MIX = """
WITH mass AS (
  SELECT source, SUM(strlen(COALESCE(text, '')) + 1) AS mass FROM documents GROUP BY source
), rates AS (
  SELECT source, 1.0::DOUBLE * 1.0::DOUBLE * (SUM(mass) OVER ())::DOUBLE / ((SUM(1.0::DOUBLE) OVER ()) * mass::DOUBLE) AS rate FROM mass
), parts AS (
  SELECT source, greatest(CAST(ceil(rate / 64) AS BIGINT), 1) AS rounds, rate / greatest(CAST(ceil(rate / 64) AS BIGINT), 1) AS part FROM rates WHERE rate > 0
), terms AS (
  SELECT source, part, UNNEST(range(0, CAST(ceil(part + 12 * sqrt(part) + 30) AS BIGINT) + 1)) AS k FROM parts
), logs AS (
  SELECT source, k, SUM(CASE WHEN k = 0 THEN -part ELSE ln(part / k) END) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS lg FROM terms
), sums AS (
  SELECT source, k, SUM(exp(lg)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM logs
), arrays AS (
  SELECT source, list(cdf ORDER BY k) AS cdf FROM sums GROUP BY source
), rounds AS (
  SELECT source, UNNEST(range(0, rounds)) AS round FROM parts
), drawn AS (
  SELECT d.*, r.round, len(list_filter(a.cdf, lambda c: c <= (('0x' || substr(md5('17|' || COALESCE(d.doc_id::VARCHAR, '') || CASE WHEN r.round = 0 THEN '' ELSE '|' || r.round END), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)) AS n
  FROM documents d JOIN arrays a ON d.source IS NOT DISTINCT FROM a.source JOIN rounds r ON d.source IS NOT DISTINCT FROM r.source
), copies AS (
  SELECT *, UNNEST(range(0, n)) + round * 256 AS mix_copy FROM drawn WHERE n > 0
)
"""

# The crc32 of a short text, bit by bit: DuckDB has no function for it.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda a, zero: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"""

_TRIE = f"""
WITH own AS (
  SELECT conv_id AS c, list(struct_pack(r := COALESCE(role, ''), t := COALESCE(text, '')) ORDER BY turn NULLS FIRST) AS turns FROM conversations GROUP BY conv_id
), heads AS (
  SELECT c, turns, c - c % 20 AS b, ({_CRC.format("c::VARCHAR")} % 4)::BIGINT AS h FROM own
), seqs AS (
  SELECT x.c, list_concat(COALESCE(y.turns[1:x.h], []), x.turns[x.h + 1:]) AS turns FROM heads x LEFT JOIN own y ON y.c = x.b
), steps AS (
  SELECT c, turns, UNNEST(range(0, len(turns) + 1)) AS d FROM seqs
), prefixes AS (
  SELECT c, d, turns[1:d] AS key, len(turns) = d AS is_end, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(turns[d].t, '[^\\x20\\x09-\\x0D]+')) END AS words FROM steps
), members AS (
  SELECT *, MIN(c) OVER (PARTITION BY d, key) AS node FROM prefixes
), nodes AS (
  SELECT node, d, COUNT(*) AS n, (COUNT(*) - 1) * MAX(words) AS own, sha256(COALESCE(string_agg(CASE WHEN is_end THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM members GROUP BY node, d
), linked AS (
  SELECT x.*, p.node AS parent FROM nodes x LEFT JOIN members p ON p.c = x.node AND p.d = x.d - 1
), kids AS (
  SELECT parent AS node, d - 1 AS d, COUNT(*) AS kids FROM linked WHERE d > 0 GROUP BY parent, d - 1
), whole AS (
  SELECT l.*, COALESCE(k.kids, 0) AS kids FROM linked l LEFT JOIN kids k USING (node, d)
), sums AS (
  SELECT a.node, a.d, SUM(w.own) AS saved, SUM((w.kids = 0)::INTEGER) AS leaves FROM whole w JOIN members a ON a.c = w.node AND a.d <= w.d GROUP BY a.node, a.d
)
SELECT w.node::BIGINT AS conv_id, w.d::BIGINT AS depth, w.parent::BIGINT AS parent_conv_id, w.n::BIGINT AS n_convs, w.kids::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, w.ends AS ends_sha256
FROM whole w JOIN sums s USING (node, d)"""

SQL: dict[str, str] = {
    "op12_patricia_conversations": _TRIE,
    "op6_poisson_mix": _MIX
    + """SELECT doc_id, source, mix_copy,
  ('0x' || substr(md5('shuffle17|' || COALESCE(doc_id::VARCHAR, '') || '|' || mix_copy), 1, 13))::BIGINT AS mix_key,
  strlen(COALESCE(text, ''))::BIGINT AS n_bytes
FROM copies""",
    "op10_lsm_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(COALESCE(text, '')) AS points, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), c AS (
  SELECT doc_id, norm, FIRST_VALUE(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, COUNT(*) OVER (PARTITION BY norm) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM c""",
}
