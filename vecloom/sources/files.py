"""Sources and sinks: image folders, archives, vocabularies, class lists, feature caches and reports."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.functions.ordinal import with_ordinal

IMAGE_SUFFIXES = "(?i).*\\.(jpg|jpeg|png|ppm|bmp|pgm|tif|tiff|webp)$"


def image_folder(spark: SparkSession, root: str, split: str) -> DataFrame:
    """id, class_name, label, path, content of ``root/split/class/*``; labels follow the sorted class names, ids the sorted paths.

    Listing and ranking read paths alone; the bytes are joined afterwards.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/{split}").where(F.col("path").rlike(IMAGE_SUFFIXES))
    below = F.element_at(F.split("path", f"/{split}/"), -1)
    named = files.select("path", "content", F.element_at(F.split(below, "/"), 1).alias("class_name"))
    classes = named.select("class_name").distinct().withColumn("label", F.row_number().over(Window.orderBy("class_name")) - 1)
    ids = with_ordinal(named.select("path"), "path", name="id")
    return named.join(classes, "class_name").join(ids, "path").select("id", "class_name", "label", "path", "content")


def checked_split(split: str, supported: tuple[str, ...]) -> str:
    if split not in supported:
        raise ValueError(f"split '{split}' is none of {', '.join(supported)}")
    return split


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, content: the files in tar archives, an archive a task; names that leave the archive are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
                    for m in tar:
                        if not m.isfile():
                            continue
                        if m.name.startswith("/") or ".." in m.name.split("/"):
                            raise ValueError(f"{archive}: {m.name} leaves the archive")
                        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([m.name]), pa.array([tar.extractfile(m).read()], pa.binary())], names=["archive", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, name string, content binary")


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """class_name of each line of a text file; blank lines and what follows a # are left out."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*", "")).alias("class_name")).where("class_name != ''")


def class_subset(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted classes; fails if a wanted class has no row."""
    missing = [r.class_name for r in wanted.distinct().join(images, "class_name", "left_anti").orderBy("class_name").limit(5).collect()]
    if missing:
        raise ValueError(f"no rows of the classes {', '.join(missing)}")
    return images.join(wanted, "class_name", "left_semi")


def renamed_classes(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """Images in numbered class folders under the names that stand at these places of the sorted list."""
    places = wanted.distinct().withColumn("at", (F.row_number().over(Window.orderBy("class_name")) - 1).cast("string")).select("at", F.col("class_name").alias("named"))
    out = images.join(places, F.col("class_name") == F.col("at"))
    return out.select(*(F.col("named").alias("class_name") if c == "class_name" else images[c] for c in images.columns))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, word of a CSV with a column ``word``: trimmed, blanks left out, order and repeats kept.

    Only that column is read.  Ordinals follow the order of files and lines.
    """
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    if "word" not in raw.columns:
        raise ValueError("the vocabulary has no column 'word'")
    words = raw.select(F.monotonically_increasing_id().alias("at"), F.trim("word").alias("word")).where("word != ''")
    return with_ordinal(words, "at").select("ordinal", "word")


def write_features(features: DataFrame, path: str, key: dict[str, object]) -> str:
    """Keep features below a folder that names all of the key's parameters; returns it."""
    out = f"{path}/{_digest(key)}"
    features.write.mode("overwrite").parquet(out)
    return out


def read_features(spark: SparkSession, path: str, key: dict[str, object], ids: DataFrame) -> DataFrame | None:
    """Kept features, if they are there and hold just these ids; else None."""
    try:
        found = spark.read.parquet(f"{path}/{_digest(key)}")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    left = found.select("id").exceptAll(ids.select("id")).limit(1).count() + ids.select("id").exceptAll(found.select("id")).limit(1).count()
    return None if left else found


def _digest(key: dict[str, object]) -> str:
    import hashlib

    return hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:32]


def write_predictions(predictions: DataFrame, path: str) -> None:
    """(id, head, cluster), a folder a head."""
    predictions.write.mode("overwrite").partitionBy("head").parquet(path)


def content_hash(predictions: DataFrame) -> DataFrame:
    """head, n, digest: an order-independent content hash of each head's predictions, summed in the JVM."""
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", "id", "cluster"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return predictions.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.sum(part).cast("string").alias("digest"))


def report(metrics: DataFrame) -> DataFrame:
    """One row: (metric, value) as a JSON object in the order of the names."""
    pairs = metrics.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"))
    return pairs.select(F.to_json("m").alias("report"))
