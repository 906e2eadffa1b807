"""The catalogue: datasets and their splits, encoders, and rules over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.ordinal import with_ordinal


@dataclass(frozen=True)
class Dataset:
    name: str
    mode: str
    splits: tuple[str, ...]


# Names, ways of obtaining and splits of the benchmark's datasets.
DATASETS = (
    Dataset("cifar10", "python", ("train", "test")),
    Dataset("cifar20", "python", ("train", "test")),
    Dataset("cifar100", "python", ("train", "test")),
    Dataset("stl10", "python", ("train", "test", "train+unlabeled")),
    Dataset("imagenet", "manual", ("train", "val")),
    Dataset("imagenet10", "manual", ("train", "val")),
    Dataset("imagenet_dogs", "manual", ("train", "val")),
    Dataset("imagenet_a", "external_scripted", ("test",)),
    Dataset("imagenet_sketch", "external_scripted", ("test",)),
    Dataset("imagenet_r", "python_optional", ("test",)),
    Dataset("imagenet_v2", "python_optional", ("test",)),
    Dataset("imagenet_c", "manual", ("test",)),
    Dataset("dtd", "python", ("train", "val", "test", "trainval")),
    Dataset("places365_standard", "python", ("train", "train-standard", "val")),
    Dataset("aircraft", "python", ("train", "val", "trainval", "test")),
    Dataset("flowers", "python", ("train", "val", "test")),
    Dataset("food", "python", ("train", "test")),
    Dataset("pets", "python", ("train", "trainval", "test")),
    Dataset("cars", "manual", ("train", "test")),
    Dataset("ucf101", "manual", ("train", "val", "test")),
)

# Train and test splits by dataset.
SPLITS = {
    "cifar10": ("train", "test"), "cifar20": ("train", "test"), "cifar100": ("train", "test"), "stl10": ("train", "test"),
    "imagenet10": ("train", "val"), "imagenetdogs": ("train", "val"), "dtd": ("trainval", "test"), "ucf101": ("train", "val"),
    "imagenet": ("train", "val"), "places365standard": ("train", "val"), "aircraft": ("train", "test"), "cars": ("train", "test"),
    "flowers": ("train", "test"), "food": ("train", "test"), "pets": ("train", "test"),
}
VARIANTS = ("imageneta", "imagenetsketch", "imagenetr", "imagenetv2", "imagenetc")

# Legal pairs of pretraining and backbone, with model and weights.
ENCODERS = {
    ("LAION400M", "ViT-B/32"): ("ViT-B-32-quickgelu", "laion400m_e32"),
    ("LAION2B", "ViT-B/32"): ("ViT-B-32", "laion2b_s34b_b79k"),
    ("LAION400M", "ViT-B/16"): ("ViT-B-16", "laion400m_e32"),
    ("LAION2B", "ViT-B/16"): ("ViT-B-16", "laion2b_s34b_b88k"),
    ("SigLIP", "ViT-B/16"): ("ViT-B-16-SigLIP", "webli"),
    ("LAION400M", "ViT-L/14"): ("ViT-L-14", "laion400m_e32"),
    ("LAION2B", "ViT-L/14"): ("ViT-L-14", "laion2b_s32b_b82k"),
}


def token(name: str) -> str:
    """A name as it is compared."""
    return name.strip().lower().translate(str.maketrans("", "", "-_ "))


def dataset(name: str) -> Dataset:
    found = {token(d.name): d for d in DATASETS}.get(token(name))
    if found is None:
        raise ValueError(f"unknown dataset '{name}'; known: {', '.join(sorted(d.name for d in DATASETS))}")
    return found


def datasets(spark: SparkSession) -> DataFrame:
    """name, mode, splits, place (by name, from 1)."""
    rows = [(d.name, d.mode, list(d.splits), i) for i, d in enumerate(sorted(DATASETS, key=lambda d: d.name), 1)]
    return spark.createDataFrame(rows, "name string, mode string, splits array<string>, place int")


def encoder(pretraining: str, backbone: str) -> tuple[str, str]:
    """Model and weights of a legal pair, whatever the case and dashes of its names."""
    flat = lambda s: s.strip().upper().translate(str.maketrans("", "", "-_ /"))
    for (p, b), found in ENCODERS.items():
        if (flat(p), flat(b)) == (flat(pretraining), flat(backbone)):
            return found
    raise ValueError(f"no encoder '{pretraining}' with backbone '{backbone}'")


def default_splits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in sorted(SPLITS.items())], "name string, train string, test string")


def default_split(name: str) -> tuple[str, str]:
    if token(name) not in SPLITS:
        raise ValueError(f"no default splits of '{name}'")
    return SPLITS[token(name)]


def evaluation_split(name: str) -> str:
    return "test" if token(name) in VARIANTS else default_split(name)[1]


def domain_shift(source: str, target: str | None) -> tuple[str, str, str, str, bool]:
    """(train dataset, train split, eval dataset, eval split, whether they differ); ImageNet's variants need it as their source."""
    train, test = default_split(source)
    if target is None:
        return source, train, source, test, False
    if token(target) in VARIANTS and token(source) != "imagenet":
        raise ValueError("the variants of ImageNet need ImageNet as their source")
    return source, train, target, evaluation_split(target), True


def first_rows(rows: DataFrame, n: int | None, label: str = "label") -> DataFrame:
    """The first n rows by id; without n all, which needs labels."""
    if n is None:
        if label not in rows.columns:
            raise ValueError("without labels the number of rows has to be given")
        return rows
    return rows.orderBy("id").limit(n)


def coarse(rows: DataFrame, label: str, mapping: list[int]) -> DataFrame:
    """``rows`` with the coarse label of each fine one, by a literal list."""
    return rows.withColumn("coarse", F.element_at(F.array(*map(F.lit, mapping)), F.col(label) + 1))


def train_and_eval(rows: DataFrame, train: tuple[str, ...], test: str) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col("split").isin(*train)), rows.where(F.col("split") == test)


def split_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("label").alias("n_classes"))


def joined_splits(rows: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """The splits one after the other, with an ordinal over all."""
    parts = [rows.where(F.col("split") == s).withColumn("part", F.lit(i)) for i, s in enumerate(splits)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_ordinal(out, "part", "id")


def split_alias(name: Column, split: Column) -> Column:
    """The split that is read for an asked one."""
    return F.when((name == "places365_standard") & (split == "train"), "train-standard").when((name == "pets") & (split == "train"), "trainval").otherwise(split)


def class_names(n: int) -> list[str]:
    """Made-up names for a dataset without any."""
    return [f"class_{i}" for i in range(n)]
