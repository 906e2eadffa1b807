"""Queries of sources and feature operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.vectors import norm
from vecloom.operators import features
from vecloom.plans import catalog
from vecloom.plans.registry import BASE, long, means_sql, out6, query, r6
from vecloom.sources.tables import nouns, spread, table, vectors


@query("SELECT p_partkey AS id, regexp_replace(lower(trim(p_type)), '[-_ ]', '', 'g') AS token FROM part")
def s1_name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), features.name_token(F.col("p_type")).alias("token"))


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else "NULL" if x is None else str(x)
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_SPECS = [(d.name, d.mode, ",".join(d.splits)) for d in catalog.DATASETS]


_NAMES = [d.name for d in catalog.DATASETS]
#: A dataset for each part, as a user might spell it: odd parts in capitals, with dashes.
_ASKED = f"asked AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN replace(upper(name), '_', '-') ELSE name END AS asked FROM part JOIN (SELECT name, place FROM (VALUES {_values([(n, i) for i, n in enumerate(_NAMES)])}) t(name, place)) d ON d.place = p_partkey % {len(_NAMES)})"
_TOKEN = "replace(replace(lower(asked), '-', ''), '_', '')"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES)).cast("int"))
    spelled = F.when(F.col("p_partkey") % 2 == 1, F.translate(F.upper(name), "_", "-")).otherwise(name)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), spelled.alias("asked"))


def _looked_up(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of (id, asked) with what is known of the dataset of that name, however it is spelled."""
    told = known.withColumn("token", features.name_token(F.col("name")))
    return rows.withColumn("token", features.name_token(F.col("asked"))).join(F.broadcast(told), "token").drop("token")  # a row a dataset


@query(f"WITH {_ASKED} SELECT id, name, mode, splits FROM asked JOIN (VALUES {_values(_SPECS)}) t(name, mode, splits) ON replace(name, '_', '') = {_TOKEN}")
def s2_datasets_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset that each part asks for."""
    known = catalog.datasets(spark).select("name", "mode", F.array_join("splits", ",").alias("splits"))
    return _looked_up(_asked(spark, sf), known).select("id", "name", "mode", "splits")


@query("SELECT vec_id AS id, label FROM embeddings ORDER BY vec_id LIMIT 100")
def s5_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The row limit is the feature: the first 100 rows by id."""
    return catalog.first_rows(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"), 100)


@query("SELECT label AS fine, (CASE WHEN label IN (0, 4, 8) THEN 0 WHEN label IN (1, 5, 9) THEN 1 WHEN label IN (2, 6) THEN 2 ELSE 3 END)::INTEGER AS coarse, count(*) AS n FROM embeddings GROUP BY ALL")
def s6_coarse_labels(spark: SparkSession, sf: str) -> DataFrame:
    fine = table(spark, sf, "embeddings").select(F.col("label").alias("fine"))
    return catalog.coarse(fine, "fine", [0, 1, 2, 3, 0, 1, 2, 3, 0, 1]).groupBy("fine", "coarse").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, c_mktsegment AS class_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def s7_class_subset(spark: SparkSession, sf: str) -> DataFrame:
    from vecloom.sources.files import class_subset

    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("class_name"))
    return class_subset(rows, spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "class_name string")).select("id", "class_name")


@query("SELECT DISTINCT c_mktsegment AS class_name FROM customer EXCEPT SELECT * FROM (VALUES ('BUILDING'), ('NOSUCH')) t(class_name)")
def s7_other_classes(spark: SparkSession, sf: str) -> DataFrame:
    wanted = spark.createDataFrame([("BUILDING",), ("NOSUCH",)], "class_name string")
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("class_name")).distinct().join(wanted, "class_name", "left_anti")


@query("SELECT p_partkey AS id, translate(p_type, '_-', '  ') AS entry FROM part")
def s12_class_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), features.readable(F.col("p_type")).alias("entry"))


@query(f"WITH {_ASKED} SELECT id, name, train, test FROM asked JOIN (VALUES {_values(sorted((k, *v) for k, v in catalog.SPLITS.items()))}) t(name, train, test) ON replace(name, '_', '') = {_TOKEN}")
def s13_default_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The splits that the dataset of each part is trained and tested on; datasets for tests alone have none."""
    return _looked_up(_asked(spark, sf), catalog.default_splits(spark)).select("id", "name", "train", "test")


_SPLIT = "CASE WHEN label < 6 THEN 'train' WHEN label < 8 THEN 'val' ELSE 'test' END"


@query(f"SELECT vec_id AS id, label, ({_SPLIT}) = 'test' AS evaluated FROM embeddings WHERE ({_SPLIT}) IN ('train', 'val', 'test')")
def s14_train_and_eval(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.expr(_SPLIT).alias("split"))
    train, test = catalog.train_and_eval(rows, ("train", "val"), "test")
    return train.withColumn("evaluated", F.lit(False)).unionByName(test.withColumn("evaluated", F.lit(True))).select("id", "label", "evaluated")


@query(f"SELECT {_SPLIT} AS split, count(*) AS n_samples, count(DISTINCT label) AS n_classes FROM embeddings GROUP BY 1")
def s15_split_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.split_stats(table(spark, sf, "embeddings").select("label", F.expr(_SPLIT).alias("split")))


@query(f"""SELECT id, label, split, row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 0 ELSE 1 END, id)::BIGINT - 1 AS ordinal
FROM (SELECT vec_id AS id, label, {_SPLIT} AS split FROM embeddings) WHERE split IN ('train', 'val')""")
def s17_joined_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.expr(_SPLIT).alias("split"))
    return catalog.joined_splits(rows, ("train", "val")).select("id", "label", "split", "ordinal")


@query(f"""WITH {_ASKED}, d AS (SELECT id, name, CASE id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM asked JOIN (VALUES {_values([(n,) for n in _NAMES])}) t(name) ON replace(name, '_', '') = {_TOKEN})
SELECT id, name, split, CASE WHEN name = 'places365_standard' AND split = 'train' THEN 'train-standard' WHEN name = 'pets' AND split = 'train' THEN 'trainval' ELSE split END AS read FROM d""")
def s18_split_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """The split that is read for the one that each part asks for."""
    rows = _looked_up(_asked(spark, sf), catalog.datasets(spark).select("name")).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 3 + 1).cast("int")))
    return rows.select("id", "name", "split", catalog.split_alias(F.col("name"), F.col("split")).alias("read"))


_PIXELS = "list_transform(embedding, lambda e: abs(e::DOUBLE) * CASE WHEN label < 5 THEN 255 ELSE 1 END)"


@query(f"""WITH p AS (SELECT vec_id AS id, {_PIXELS} AS x FROM embeddings), s AS (SELECT id, CASE WHEN list_max(x) > 1 THEN list_transform(x, lambda e: e / 255.0) ELSE x END AS x FROM p)
SELECT id, {out6('list_sum(x)')} AS total, {out6('list_max(x)')} AS largest FROM s""")
def f1_pixels(spark: SparkSession, sf: str) -> DataFrame:
    from vecloom.functions.vectors import total

    raw = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: F.abs(e.cast("double")) * F.when(F.col("label") < 5, 255).otherwise(1)).alias("x"))
    return features.pixels(raw).select("id", r6(total("x")).alias("total"), r6(F.array_max("x")).alias("largest"))


@query(f"""WITH w AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM documents),
c AS (SELECT id, term, count(*) AS tf FROM w WHERE length(term) >= 2 GROUP BY ALL),
t AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM c GROUP BY term ORDER BY cf DESC, term LIMIT 512),
s AS (SELECT c.id, c.term, c.tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + t.df)) + 1.0) AS w FROM c JOIN t USING (term))
SELECT id, term, {out6('w / sqrt(sum(w * w) OVER (PARTITION BY id))')} AS weight FROM s""")
def f3_tf_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return features.tf_idf(docs, 512).select("id", "term", r6("weight").alias("weight"))


@query(f"SELECT n_nationkey AS id, t.prompt::INTEGER AS prompt, replace(t.pattern, '%s', n_name) AS text FROM nation, (VALUES {_values(list(enumerate(features.PROMPTS)))}) t(prompt, pattern)")
def f5_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return features.prompts(table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query(
    f"WITH {BASE}, p AS (SELECT id, range AS prompt, list_concat(x[range + 1:], x[:range]) AS x FROM n, range(7)),{means_sql('m', 'p', 'id')},"
    f" l AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1)::INTEGER - 1 AS dim FROM m) SELECT id, dim, {out6('v')} AS value FROM l"
)
def f6_prompt_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Seven views of each noun, turned by 0 to 6 places."""
    views = nouns(spark, sf).select("id", F.explode(F.array(*(F.concat(F.slice("x", p + 1, 64), F.slice("x", 1, p)) if p else F.col("x") for p in range(7)))).alias("x"))
    return long(features.ensemble(views))


@query(f"WITH {BASE}, l AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1)::INTEGER - 1 AS dim FROM u) SELECT id, dim, {out6('v')} AS value FROM l")
def f7_unit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return long(vectors(spark, sf))


@query(f"WITH {BASE} SELECT id, {out6('sqrt(list_dot_product(x, x))')} AS len FROM u")
def f8_strictly_unit(spark: SparkSession, sf: str) -> DataFrame:
    return features.strictly_unit(vectors(spark, sf).select("id", "x")).select("id", r6(norm("x")).alias("len"))


@query(
    f"WITH {BASE}, l AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1)::INTEGER - 1 AS dim FROM u)"
    f" SELECT id, dim, {out6('(v - avg(v) OVER (PARTITION BY dim)) / greatest(stddev_pop(v) OVER (PARTITION BY dim), 1e-6)')} AS value FROM l"
)
def f9_standardised(spark: SparkSession, sf: str) -> DataFrame:
    return long(features.standardised(vectors(spark, sf).select("id", "x")))


@query(f"WITH {BASE}, j AS (SELECT u.id, list_concat(u.x, n.x) AS x FROM u JOIN n USING (id)), l AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1)::INTEGER - 1 AS dim FROM j) SELECT id, dim, {out6('v')} AS value FROM l")
def f10_concatenated(spark: SparkSession, sf: str) -> DataFrame:
    return long(features.concatenated(vectors(spark, sf), nouns(spark, sf)))


@query("SELECT p_partkey AS id, list_aggregate(list_filter(string_split(translate(lower(trim(p_name || '/' || p_type || '.v:1')), '/\\ :=.', '-----p'), '-'), lambda t: t <> ''), 'string_agg', '-') AS token FROM part")
def f13_cache_tokens(spark: SparkSession, sf: str) -> DataFrame:
    named = F.concat("p_name", F.lit("/"), "p_type", F.lit(".v:1"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), features.cache_token_column(named).alias("token"))
